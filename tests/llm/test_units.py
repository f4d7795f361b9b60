"""Brute-force checks of the parts that need no Spark."""

import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from slowscope.llm import bpe, bpe_codec, lm_score, packing, simhash, token_counts, topk, toxicity

TEXTS = ["", " ", "a", "Hello  world\n\n x", "don't 12 + é<|endoftext|>b", "\x1c\x85 a\xa0b", "😀 x 中文 ok", "a\nb c\n d", "x" * 3000, "tab\tand \n mix ", "naïve déjà-vu, vraiment!!! [ok]"]


@pytest.fixture(scope="module")
def library():
    return bpe.hf_tokenizer("byte_bpe_50k.json")


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.json_encoder("byte_bpe_50k.json")(text), "<u4").tolist() == want
    assert bpe.bulk_ids("byte_bpe_50k.json")(text).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab'.s1é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_of_any_text(text):
    library = bpe.hf_tokenizer("byte_bpe_50k.json")
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.json_encoder("byte_bpe_50k.json")(text), "<u4").tolist() == want
    assert bpe.bulk_ids("byte_bpe_50k.json")(text).tolist() == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n\t\r\x0b\x1c\xa0\u3000ab'.1é中😀", "<|endoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_counts_of_any_text(text):
    """Tabs, blank lines, indentation and special strings take the table and the caches too."""
    library = bpe.hf_tokenizer("byte_bpe_50k.json")
    counter = token_counts.Counts("byte_bpe_50k.json", [" a", "b"], b"\x01\x01", limit=3)
    for _ in range(2):
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_irregular_texts_take_the_table():
    counter = token_counts.Counts("byte_bpe_50k.json", ["def", " x", "\n   ", ":"], bytes([200, 100, 50, 25]))
    assert counter("def x:\n    x") == 200 + 100 + 25 + 50 + 100


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \nab'.1é😀"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_codec_round_trip(text):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(bpe.resolve("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    table = bpe.ranks_tokenizer("byte_bpe_50k.tiktoken")[1]
    ids = bpe.ranks_encoder("byte_bpe_50k.tiktoken")(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert bpe_codec.decode_ids(ids, table) == text.encode()
    assert "".join(bpe_codec.decode_pieces([ids[i : i + 4] for i in range(0, len(ids), 4)], table)) == text
    ends, first, last = (x.tolist() for x in bpe_codec.offsets(ids, text, bpe_codec.token_lengths(table)))
    at = 0
    for i, end in enumerate(ends):
        assert text.encode()[at:end] in text[first[i] : last[i]].encode()
        at = end
    assert at == len(text.encode())


def brute_fingerprint(text):
    import re

    lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = re.findall(rb"[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\n\x0b\x85", max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def groups_of(edges):
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    found: dict[int, set] = {}
    for x in list(parent):
        found.setdefault(root(x), set()).add(x)
    return sorted(tuple(sorted(g)) for g in found.values() if len(g) > 1)


@pytest.mark.parametrize("m", [2, 63, 64, 65, 130, 300])
def test_bit_sliced_links(m):
    rng = np.random.default_rng(m)
    base = rng.integers(-(2**63), 2**63 - 1, size=max(1, m // 8), dtype=np.int64)
    fps = base[rng.integers(0, len(base), m)]
    for _ in range(3):
        fps = fps ^ (np.int64(1) << rng.integers(0, 63, m)) * rng.integers(0, 2, m)
    fps = np.unique(fps)
    near = [(a, b) for i, a in enumerate(fps.tolist()) for b in fps[:i].tolist() if ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    assert groups_of(simhash.stars(fps, np.array([0]))) == groups_of(near)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=60), st.sampled_from([3, 1000]))
def test_packing(sizes, most_open):
    docs = [(i, n) for i, n in enumerate(sizes)]
    rows = list(packing.pack_rows(docs, lambda n: np.arange(1, n + 1, dtype=np.uint32), window=16, most_open=most_open))
    windows: dict[int, int] = {}
    for doc, start, length, ids, total, seq, offset in rows:
        assert offset == windows.get(seq, 0) and length > 0 and total == sizes[doc] + 1
        windows[seq] = offset + length
    assert all(n == 16 or n & (n - 1) == 0 for n in windows.values())
    for doc, n in docs:
        own = sorted(r[1:4] for r in rows if r[0] == doc)
        assert b"".join(ids for _, _, ids in own) == np.array([*range(1, n + 1), 0], "<u4").tobytes()
        assert [s for s, _, _ in own] == np.cumsum([0] + [length for _, length, _ in own])[:-1].tolist()


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = packing.Packer(window=32)
    for size in rng.integers(1, 32, 300).tolist():
        counts = packer.levels.copy()

        def cost(h):
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + size < 32:
                after[h + size] += 1
            return int((after[1:32] ** 2).sum())

        fits = [h for h in range(32 - size + 1) if h == 0 or counts[h]]
        assert cost(packer.level_for(size)) == min(map(cost, fits))
        list(packer.place((0, 0, np.zeros(size, np.uint32), size)))


def test_exact_search():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 8))
    x[100:160] = x[100]  # ties
    ids = rng.permutation(500)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    pivots = topk.far_apart(x, 10)
    table = topk.pivot_distances(x, pivots, top, False).astype(np.float32)
    for floors in (np.full(40, -np.inf), np.array([sorted(x @ x[i])[-30] for i in range(40)], float)):
        got = topk.search(ids[:40], x[:40], floors, ids, x, table, pivots, top, 5)
        for i in range(40):
            want = sorted((-int(s), int(j)) for s, j in zip(x @ x[i], ids, strict=True) if j != ids[i])[:5]
            assert [(-s, j) for q, j, s in got if q == ids[i]] == want


def test_pivots_spare_most_evaluations_of_clustered_vectors():
    rng = np.random.default_rng(2)
    centers = rng.integers(-200, 200, (20, 32))
    x = centers[rng.integers(0, 20, 4000)] + rng.integers(-6, 7, (4000, 32))
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    pivots = topk.far_apart(x[:1000], 24)
    assert len({tuple(np.round(p / 30)) for p in pivots.tolist() for p in [np.array(p)]}) >= 20  # one for each cluster
    table, count = topk.pivot_distances(x, pivots, top, False).astype(np.float32), []
    topk.search(np.arange(40), x[:40], np.full(40, -np.inf), np.arange(4000), x, table, pivots, top, 5, count)
    assert len(count) == 40 and np.mean(count) < 0.35 * 4000


@pytest.mark.parametrize("most", [1 << 10, 1 << 29, 1 << 40])
def test_products_are_exact(most):
    rng = np.random.default_rng(most)
    x, q = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, 16)
    assert [int(v) for v in topk.products(x, q)] == [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]


def small_model(counts, outside=()):
    """A model with random weights over the words of counts; outside: words beside its table."""
    words = sorted(counts, key=lambda w: (-counts[w], w))
    n, v = np.zeros(lm_score.SUFFIX_CLASSES), np.zeros(lm_score.SUFFIX_CLASSES)
    for w, c in outside:
        n[lm_score.suffix_class(w)] += c
        v[lm_score.suffix_class(w)] += 1
    total = sum(counts.values()) + int(n.sum())
    model = lm_score.Model(words, np.array([counts[w] for w in words], float), total, len(words) + len(outside), n, v)
    model.weights = np.random.default_rng(0).normal(size=model.weights.shape).astype(np.float32)
    return model


def brute_score(model, ids):
    """log10 probabilities by plain loops over the tree."""
    out = []
    for t, own in enumerate(ids):
        b1 = ids[t - 1] if t else model.start
        b2 = ids[t - 2] if t > 1 else model.start
        row = lambda k, a, b=0: int(model.rows(k, np.array([a]), np.array([b]))[0])
        places = range(model.path_start[own], model.path_start[own + 1])
        decisions = [(0, int(model.root_branch[own]), [row(1, b1), row(2, b2), row(3, b1, b2)])]
        decisions += [(int(model.path_node[p]), int(model.path_branch[p]), [row(4, b1, int(model.path_node[p]))]) for p in places]
        total = 0.0
        for node, branch, rows in decisions:
            scores = [float(model.bias[node, j]) + sum(float(model.weights[r, j]) for r in rows) for j in range(lm_score.WIDTH)]
            total += scores[branch] - np.log(sum(np.exp(scores)))
        out.append(total / np.log(10) - model.inside[own])
    return out


@pytest.mark.parametrize("n_words", [1, 2, 16, 17, 500])
def test_language_model_is_a_distribution_and_equals_brute_force(n_words):
    counts = {b"w%d" % i: 1000 // (i + 1) for i in range(n_words)} | {b" ": 50}
    model = small_model(counts, [(b"rare", 3), (b"other", 1)])
    total = 0.0
    for last in range(model.start):  # each word of the table, and each suffix class
        ids = np.array([0, 1 % model.table, last])
        inside = 10 ** model.inside[last]  # n + v + 1 places of a suffix class share its probability
        total += inside * 10 ** lm_score.token_scores(model, ids, np.array([0]))[2]
    assert abs(total - 1) < 1e-4
    ids = np.random.default_rng(1).integers(0, model.start, 40)
    got = lm_score.token_scores(model, np.concatenate([ids, ids[:9]]), np.array([0, 40]))
    assert np.allclose(got, brute_score(model, ids.tolist()) + brute_score(model, ids[:9].tolist()), atol=1e-4)


def test_zero_weights_give_unigrams():
    model = small_model({b"a": 7, b"b": 3, b" ": 2})
    model.weights[:] = 0
    ids = np.array([0, 1, 2, 3])
    want = [np.log10(c / (12 + 3 + lm_score.SUFFIX_CLASSES)) for c in (8, 4, 3, 1)]
    assert np.allclose(lm_score.token_scores(model, ids, np.array([0])), want, atol=1e-5)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    w = rng.normal(size=(8, lm_score.WIDTH))
    bias, rows, branch = rng.normal(size=(5, lm_score.WIDTH)), (rng.integers(0, 8, 5), rng.integers(0, 8, 5)), rng.integers(0, lm_score.WIDTH, 5)
    g = lm_score._softmax(w, rows, bias, branch, True)[1]
    by_row = np.zeros_like(w)
    for r in rows:
        np.add.at(by_row, r, g)
    for r, j in ((0, 0), (3, 5), (7, 15)):
        up, down = w.copy(), w.copy()
        up[r, j] += 1e-5
        down[r, j] -= 1e-5
        slope = -(lm_score._softmax(up, rows, bias, branch, False)[0].sum() - lm_score._softmax(down, rows, bias, branch, False)[0].sum()) / 2e-5
        assert abs(slope - by_row[r, j]) < 1e-4
    # one step moves each touched row against its summed gradient
    w32, squares, uses = w.astype(np.float32), np.zeros(8, np.float32), np.zeros(8, np.int64)
    before = w32.copy()
    lm_score._step(w32, squares, uses, rows, g.astype(np.float32))
    assert uses.sum() == 10 and np.allclose(squares, (by_row**2).mean(axis=1), rtol=1e-4)
    assert np.allclose(w32, before - lm_score.LEARNING_RATE * by_row / np.sqrt(squares + 1e-3)[:, None], atol=1e-5)


def test_training_beats_unigrams():
    model = small_model({b"red": 2000, b"fox": 2000, b"blue": 2000, b"sea": 2000, b" ": 1})
    model.weights[:] = 0
    end = model.lookup()[b" "]
    own = [model.lookup()[w] for w in (b"red", b"fox", b"blue", b"sea")]
    text = np.array(own * 1000 + [end])
    before = lm_score.token_scores(model, text, np.array([0])).sum()
    model.weights += lm_score.local_steps(model, [text] * 10)[0]
    assert lm_score.token_scores(model, text, np.array([0])).sum() > before / 4


def test_chain_on_held_out_rows():
    rng = np.random.default_rng(3)
    y = np.column_stack([rng.random(2000) < 0.3, rng.random(2000) < 0.2]).astype(float)
    rows = [np.array(sorted(({0} if a else set()) | ({1} if b else set()) | set(rng.integers(2, 40, 5).tolist()))) for a, b in y]
    x, fold = toxicity.Sparse(rows, 40), np.arange(2000) % 5
    train = np.arange(2000) < 1500
    models = toxicity.fit_chain(x.take(train), y[train], fold[train])
    got = np.array([toxicity.chain_probabilities(r.tolist(), models, 40) for r in rows[1500:]])
    assert ((got[:, 1] > 0.5) == (y[1500:, 1] == 1)).mean() > 0.98
    assert toxicity.fit_chain(x, np.zeros((2000, 2)), fold) == [None, None]


def test_chain_is_fed_out_of_fold_probabilities():
    """The second model equals one fitted on first probabilities that plain loops over the folds predict."""
    rng = np.random.default_rng(4)
    rows = [np.array(sorted(set(rng.integers(0, 30, 6).tolist()))) for _ in range(300)]
    y = np.column_stack([[float(3 in r) for r in rows], [float(3 in r and 5 not in r) for r in rows]])
    fold = rng.integers(0, toxicity.FOLDS, 300)
    models = toxicity.fit_chain(toxicity.Sparse(rows, 30), y, fold)
    out = np.zeros(300)
    for f in range(toxicity.FOLDS):
        train = [i for i in range(300) if fold[i] != f]
        w = toxicity.fit_linear(toxicity.Sparse([rows[i] for i in train], 30), np.empty((len(train), 0)), y[train, 0])
        for i in range(300):
            if fold[i] == f:
                out[i] = 1 / (1 + np.exp(-(sum(w[j] for j in rows[i]) + w[-1])))
    assert np.allclose(models[1], toxicity.fit_linear(toxicity.Sparse(rows, 30), out[:, None], y[:, 1]), atol=1e-6)
    # the gradient step of one model, densely
    dense = np.zeros((300, 30))
    for i, r in enumerate(rows):
        dense[i, r] = 1
    x = toxicity.Sparse(rows, 30)
    v = rng.normal(size=30)
    assert np.allclose(x.times(v), dense @ v) and np.allclose(x.back(out), dense.T @ out)


def test_folds_match_crc32():
    assert zlib.crc32(b"12") % 7 == zlib.crc32(str(12).encode()) % 7
