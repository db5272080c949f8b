"""Encoding whole texts by encoding each different chunk once.

A text is cut where white space follows something else, and between a letter and ASCII punctuation other than the apostrophe. The patterns
of the vocabularies cut there too: no token spans such a place, and what they make of white space depends only on what comes after it. So the
ids of a text are those of its chunks, in order. Texts with white space outside ASCII (or control characters on whose kind libraries differ)
are left whole, as one chunk; so are texts that spell a special token, which the library finds before anything else and gives its own id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import WORD_BYTE, Texts

#: Chunks that a worker remembers; beyond it starts anew. About 300 bytes each.
REMEMBERED = 1_000_000
#: Different chunks that go to the encoder at once.
AT_ONCE = 4096


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII punctuation that takes no part in the patterns' contractions.
MARK = np.zeros(256, bool)
MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def unusual(texts: Texts) -> np.ndarray:
    """Which texts hold white space outside ASCII, U+180E, U+200B to U+200D, U+2060 or 0x1C to 0x1F."""
    b = texts.bytes
    hit = np.flatnonzero(((b >= 0x1C) & (b <= 0x1F)) | (b == 0xC2) | (b == 0xE1) | (b == 0xE2) | (b == 0xE3))
    if not len(hit):
        return np.zeros(texts.n, bool)
    x, y, z = b[hit], b[np.minimum(hit + 1, len(b) - 1)], b[np.minimum(hit + 2, len(b) - 1)]
    bad = (
        (x < 0x20)
        | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0)))
        | ((x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E))))
        | ((x == 0xE2) & (y == 0x80) & ((z <= 0x8D) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)))
        | ((x == 0xE2) & (y == 0x81) & ((z == 0x9F) | (z == 0xA0)))
        | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    )
    out = np.zeros(texts.n, bool)
    out[np.searchsorted(texts.at, hit[bad], side="right") - 1] = True
    return out


def spelling(texts: Texts, special: re.Pattern | None) -> np.ndarray:
    """Which texts spell a special token; a match across a border of texts leaves one whole that need not be."""
    out = np.zeros(texts.n, bool)
    if special is not None and len(texts.bytes):
        hit = np.array([m.start() for m in special.finditer(np.ascontiguousarray(texts.bytes))], np.int64)
        out[np.searchsorted(texts.at, hit, side="right") - 1] = True
    return out


def chunks(texts: Texts, special: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ptr (chunks of text i are ptr[i]:ptr[i + 1]), a number for each chunk, the different chunks."""
    if not len(texts.bytes):
        return np.zeros(texts.n + 1, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    b = texts.bytes
    white, letter, mark = ~WORD_BYTE[b], LETTER[b], MARK[b]
    letter[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] != 0x97) & (b[1:] != 0xB7)
    cut = np.zeros(len(b), bool)
    cut[1:] = (white[1:] & ~white[:-1]) | (mark[1:] & letter[:-1]) | (LETTER[b[1:]] & mark[:-1])
    for i in np.flatnonzero(unusual(texts) | spelling(texts, special)):
        cut[texts.at[i] : texts.at[i + 1]] = False
    full = texts.at[1:] > texts.at[:-1]
    cut[texts.at[:-1][full]] = True
    start = np.flatnonzero(cut)
    offsets = np.append(start, len(white)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(texts.bytes))]).dictionary_encode()
    return np.searchsorted(start, texts.at), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), then the same for start[1], and so on."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)


class Remembering:
    """Encodes batches of texts; encode gives the ids of each of a list of chunks, and is asked once for each. special matches what must not
    be cut."""

    def __init__(self, encode: Callable[[list[bytes]], list], special: re.Pattern | None = None):
        self.encode, self.special = encode, special
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), AT_ONCE):
            part = new[at : at + AT_ONCE]
            ids = self.encode(part)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if isinstance(ids[0], np.ndarray) else np.array([y for x in ids for y in x], np.uint32)
            n = len(self.slot)
            while n + len(part) > len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            self.length[n : n + len(part)] = length
            self.start[n : n + len(part)] = self.used + np.cumsum(length) - length
            self.used += len(flat)
            self.slot.update(zip(part, range(n, n + len(part))))

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (n + 1 offsets)."""
        ptr, code, different = chunks(texts, self.special)
        if len(self.slot) > REMEMBERED:
            self.clear()
        found = different.to_pylist()
        self.learn([x for x in found if x not in self.slot])
        slot = np.fromiter(map(self.slot.__getitem__, found), np.int64, len(found))[code] if len(code) else np.zeros(0, np.int64)
        length = self.length[slot]
        at = np.concatenate([[0], np.cumsum(length)])
        return self.flat[spread(self.start[slot], length)], at[ptr]


#: A space at most and letters of ASCII and Latin-1, composed: what reaches the model as one word.
PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: How byte-level models write bytes as characters: printable ones as they are, the others from U+0100 on.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: c for c, b in enumerate((x for x in range(256) if x not in SHOWN), 0x100)}
#: What a tokenizer may do to a plain word before its model sees it.
WAYS = (lambda s: s, lambda s: s.strip().lower())
PROBES = ["a", " a", "The", " the", " Zebra", "\u00c9t\u00e9", " \u00e9\u00e8\u00ea\u00e7", "stra\u00dfe", " \u00d1ASBOJA", "Internationalisation", " qzxvkjq", " WHERE"]


def library_encoder(path: str) -> Remembering:
    """By the tokenizers library as it is called with add_special_tokens=False: it adds no special token, and reads one where a text spells it.

    Plain words go straight to the library's model, which spares its bookkeeping of offsets, if that gives what the whole tokenizer gives
    for the probes; everything else goes through the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    whole = lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    direct = lambda s, way: [x.id for x in t.model.tokenize(way(s).encode().decode("latin-1").translate(BYTE_CHARS))]
    model, way = t.model, next((w for w in WAYS if [direct(s, w) for s in PROBES] == whole(PROBES)), None)

    def encode(part: list[bytes]) -> list:
        texts = [x.decode() for x in part]
        plain = [way is not None and bool(PLAIN.fullmatch(s)) for s in texts]
        rest = iter(whole([s for s, p in zip(texts, plain) if not p]))
        tokenize = model.tokenize
        return [[x.id for x in tokenize(way(s).encode().decode("latin-1").translate(BYTE_CHARS))] if p else next(rest) for s, p in zip(texts, plain)]

    added = [a.content.encode() for a in t.get_added_tokens_decoder().values()]
    ignoring = re.IGNORECASE if any(a.normalized for a in t.get_added_tokens_decoder().values()) else 0
    return Remembering(encode, re.compile(b"|".join(map(re.escape, added)), ignoring) if added else None)


_encoders: dict[str, Remembering] = {}


def encoder(path: str) -> Remembering:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = library_encoder(path)
    return _encoders[path]
