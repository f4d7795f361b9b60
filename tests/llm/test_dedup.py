"""The pipeline's near-dedup: five-word shingles, Jaccard 0.8 or more, against brute force."""

import random

import corpus_pipeline
import pytest

from slowscope.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    docs = []
    for k in range(60):
        words = [word() for _ in range(rng.randint(40, 300))]
        docs.append((10 * k, " ".join(words)))
        for copy in range(1, 4):
            changed = list(words)
            for _ in range(max(1, len(words) * copy // 70)):  # Jaccard from about 0.9 down to 0.65
                changed[rng.randrange(len(words))] = word()
            docs.append((10 * k + copy, " ".join(changed)))
    return [*docs, (1000, None), (1001, " \n"), (1002, "two words"), (1003, "Two  WORDS")]


def kept_by_brute_force(docs):
    label = list(range(len(docs)))
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if like(docs[a][1], docs[b][1])]
    for _ in range(len(docs)):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {docs[i][0] for i in set(label)}, pairs


def test_planted_near_copies_go(spark, planted):
    want, pairs = kept_by_brute_force(planted)
    far = sum((simhash.fingerprint(planted[a][1]) ^ simhash.fingerprint(planted[b][1])).bit_count() > 3 for a, b in pairs)
    assert far > 40 and 60 < len(want) < 200
    docs = spark.createDataFrame(planted, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()} == want
    assert {r.doc_id for r in simhash.deduplicate(docs, bucket=2, cell=2).collect()} == want


def test_alike_at_the_border():
    ten = simhash.np.arange(10, dtype="uint64")
    assert simhash.alike(ten[:8], ten) and not simhash.alike(ten[:7], ten)
    assert simhash.alike(ten[:9], ten[1:][:9]) and not simhash.alike(ten[:8], ten[2:])


def copies(n, words, rng, changed=1):
    """n texts, each with `changed` words of its own in place of others."""
    out = []
    for k in range(n):
        own = list(words)
        for at in rng.sample(range(len(own)), changed):
            own[at] = f"own{rng.randrange(10**9)}x{k}"
        out.append(" ".join(own))
    return out


def sketched(spark, texts):
    found = {}
    for t in texts:
        s = simhash.shingle_set(t)
        v, fp, bands = simhash.sketch(s)
        found[v] = (v, fp, len(s), bands.tolist())
    return spark.createDataFrame(list(found.values()), "v long, fp long, n int, bands array<long>")


@pytest.mark.parametrize("bucket", [16, 1024])
def test_candidates_follow_the_sets_not_their_pairs(spark, bucket):
    rng = random.Random(3)
    texts = copies(200, [f"w{k}" for k in range(150)], rng) + [" ".join(f"x{rng.randrange(10**9)}" for _ in range(60)) for _ in range(20)]
    edges = [(r.u, r.v) for r in simhash.candidates(sketched(spark, texts), bucket).collect()]
    assert len(edges) <= simhash.BANDS * 200 < 200 * 199 // 2  # all pairs of the copies are candidates
    joined = simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(joined) == 200 and len({r.root for r in joined}) == 1


def test_groups_of_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    other = [f"o{k}" if k % 30 == 0 else w for k, w in enumerate(base)]  # its copies are near the base's, but not alike
    chain = [list(base)]
    for k in range(30):
        chain.append([f"c{k}" if j == 119 - 4 * k else w for j, w in enumerate(chain[-1])])
    chain = [" ".join(w) for w in chain[1:]]
    texts = copies(60, base, rng) + copies(40, other, rng) + chain[4:]
    docs = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(docs)
    want, pairs = kept_by_brute_force([(k, t) for k, t in enumerate(texts)])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.deduplicate(df, bucket=64, cell=8).collect()} == want
    met = []
    decided = simhash._decided
    monkeypatch.setattr(simhash, "_decided", lambda held: met.append(held.count()) or decided(held))
    alike = spark.createDataFrame(list(enumerate(copies(100, base, rng))), "doc_id long, text string")
    assert simhash.deduplicate(alike, cell=8).count() == 1
    assert 100 <= sum(met) <= 200  # sets sent to be compared; every block with every other would be 1,300
