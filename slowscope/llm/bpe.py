"""Byte-level BPE ids for whole texts, with a bounded cache of text chunks.

The pre-token pattern of the public byte-level vocabularies never lets a match
cross the point before a single space (or a single newline) that stands between
two non-space characters.  A text is therefore cut there by ``str.split`` and
each chunk is encoded on its own by the library; equal chunks are encoded once
per worker.  A text with any other white space, or with a special string that
the library treats apart, is handed to the library whole.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: White space that is not a lone space or newline; also characters that some
#: regex engines count as white space.  Texts with these take the whole-text way.
_IRREGULAR = re.compile(r"[^\S \n]|[\x1c-\x1f᠎​﻿]|[ \n][ \n]")

#: Chunks kept per generation and worker; two generations live at a time.
CACHE_CHUNKS = 300_000

#: Longer chunks are encoded but not kept.
CACHE_CHUNK_CHARS = 64


def resolve(name: str) -> str:
    """A path as it is, or a bare file name among the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def hf_tokenizer(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(resolve(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte:
    itself if it is a visible Latin-1 character, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two pieces that the merge making `token` joins: what lower ranks leave of it."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@lru_cache(maxsize=2)
def ranks_tokenizer(name: str):
    """A tokenizers.Tokenizer with the ids of a ranks file and the split pattern of the
    installed package, and the table id -> bytes.  Merges come from the ranks: token t
    is the merge of the two parts into which the ranks below t's cut it."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    import public_tokenizers
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(resolve(name))
    chars = byte_alphabet()
    spell = lambda b: "".join(chars[x] for x in b)
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        if len(token) > 1 and len(pair := _parts(token, ranks)) == 2:
            merges.append((spell(pair[0]), spell(pair[1])))
    tokenizer = Tokenizer(models.BPE({spell(t): i for t, i in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tokenizer, table


class Cache(dict):
    """chunk -> value, in two generations of at most `limit` entries."""

    def __init__(self, make: Callable[[str], object], limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > CACHE_CHUNK_CHARS:
                return value
        self[key] = value
        return value

    def turn(self) -> None:
        """Between texts: drop the older generation once the newer one is full."""
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


def chunks(text: str, special: tuple[str, ...] = ()) -> list[str] | None:
    """Chunks of the text after a newline put before it; None if it must go whole.
    A chunk that starts with a newline stands for itself, any other for a space and itself."""
    if not text or text[0] in " \n" or text[-1] in " \n" or _IRREGULAR.search(text) or any(s in text for s in special):
        return None
    return ("\n" + text.replace("\n", " \n")).split(" ")


#: Above this the engines' tables of letters may differ; such chunks go to the whole tokenizer.
_PLAIN_LIMIT = "\u0250"

_SPELL = dict(enumerate(spelled for _, spelled in sorted(byte_alphabet().items())))


#: Letters and signs whose Unicode class has long been settled, so every engine's pattern agrees.
_SETTLED_CLASS = r"\x00-\u024F\u0391-\u03A1\u03A3-\u03CE\u0400-\u0481\u05D0-\u05EA\u0620-\u064A\u2010-\u2027\u2030-\u205E\u20AC\u3001-\u3020\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3\uFF01-\uFF5E"
_SETTLED = re.compile(f"[^{_SETTLED_CLASS}]")

#: Also those that only some engines count as white space.
_ODD = re.compile(rf"[^{_SETTLED_CLASS}]|[\x1c-\x1f]")


def is_odd(text: str) -> bool:
    """Whether engines may cut the text differently."""
    return _ODD.search(text) is not None


def spelled(pre_token: str) -> str:
    """The pre-token's bytes in the byte alphabet."""
    return pre_token.encode().decode("latin-1").translate(_SPELL)


@lru_cache(maxsize=1)
def pre_tokens() -> Callable[[str], list[str]]:
    """Cuts a text into pre-tokens by the byte-level pattern."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


class IdEncoder:
    """texts -> ids as little-endian uint32 bytes.

    A chunk not met before is cut by the pre-token pattern, its bytes are spelled in
    the byte alphabet, and the library's model merges each pre-token.
    """

    def __init__(self, tokenizer, special: tuple[str, ...] = (), limit: int = CACHE_CHUNKS):
        self.special = special
        self._encode, self._merge, self._split = tokenizer.encode, tokenizer.model.tokenize, pre_tokens()
        self._cache = Cache(self._made, limit)
        self._newline = len(self.whole("\n"))

    def whole(self, text: str) -> bytes:
        return np.array(self._encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        if max(chunk) >= _PLAIN_LIMIT:
            return self.whole(chunk)
        ids: list[int] = []
        for pre_token in self._split(chunk):
            ids += [t.id for t in self._merge(spelled(pre_token))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _made(self, key: str) -> bytes:
        return self.chunk(key if key[0] == "\n" else " " + key)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = chunks(text, self.special)
        if pieces is None:
            return self.whole(text)
        ids = b"".join(map(self._cache.__getitem__, pieces))[self._newline :]
        self._cache.turn()
        return ids


@lru_cache(maxsize=2)
def json_encoder(name: str) -> IdEncoder:
    """For a tokenizers .json file; its added tokens inside texts are handled as its default."""
    tokenizer = hf_tokenizer(name)
    return IdEncoder(tokenizer, tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()))


@lru_cache(maxsize=2)
def ranks_encoder(name: str) -> IdEncoder:
    return IdEncoder(ranks_tokenizer(name)[0])


class BulkIds:
    """ids (numpy uint32) of whole texts as the tokenizers library gives them for a byte-level
    .json file, computed by tiktoken over the same merges where both surely agree: it needs a
    fifth of the CPU.  Special strings, which the library cuts out first, and rare characters go
    to the library itself.  A file that is no plain byte-level BPE goes there altogether."""

    def __init__(self, name: str):
        import json

        self._library = hf_tokenizer(name)
        self._special = tuple(t.content for t in self._library.get_added_tokens_decoder().values())
        self._fast = None
        state = json.loads(self._library.to_str())
        model, pre = state["model"], state.get("pre_tokenizer") or {}
        vocab = model.get("vocab", {})
        back = {c: b for b, c in byte_alphabet().items()}
        plain = (
            model["type"] == "BPE" and not state.get("normalizer") and not model.get("dropout") and not model.get("end_of_word_suffix")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        own = {t: i for t, i in vocab.items() if t not in self._special}
        if plain and all(set(t) <= back.keys() for t in own):
            import tiktoken
            import public_tokenizers

            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            order = [own[a + b] for a, b in pairs]
            if order == sorted(order) and len(own) == 256 + len(pairs) and sorted(own.values()) == list(range(len(own))):
                self._fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(back[c] for c in t): i for t, i in own.items()}, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self._fast is None or any(s in text for s in self._special) or _SETTLED.search(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def bulk_ids(name: str) -> BulkIds:
    return BulkIds(name)
