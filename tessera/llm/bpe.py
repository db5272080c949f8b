"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by an incremental UTF-8 state machine.

The merges are compiled in three steps. (1) Each token's last merge is found, in order of rank. (2) Two tokens may stand side by side if no
merge across their border comes before the merges that made them; the encoding of a text is the only sequence of tokens that spells it and
in which all neighbours may stand so. (3) A transducer reads bytes. Its state is the last token that it has emitted and the bytes since,
with the last token of each prefix of these; a byte leads to one next state and emits the tokens that all readings still open share. Readings
stay open only while the bytes since can begin a token, so the lookahead is bounded by the longest token. States and transitions are made
when first met and forgotten together when there are too many.

Defined results: a null text counts as empty and has no ids; rows without an id are left out; rows that repeat an id are encoded each; other
columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, batch
from .tokens import PLAIN, Remembering

#: States that a worker keeps; about 0.7 KB each.
STATES = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class State:
    """root: last emitted token (-1: none). tokens, chain: for each position since, the token that ends there and the position (0: the root)
    where it starts. live: (position, node of the trie) for each reading that can still become a token."""

    __slots__ = ("chain", "live", "number", "root", "tokens")

    def __init__(self, number: int, root: int, tokens: tuple, chain: tuple, live: tuple):
        self.number, self.root, self.tokens, self.chain, self.live = number, root, tokens, chain, live

    def path(self, p: int) -> list[int]:
        """Tokens from the root to position p."""
        out = []
        while p:
            out.append(self.tokens[p - 1])
            p = self.chain[p - 1]
        return out[::-1]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.spell = {v: k for k, v in ranks.items()}
        self.left: dict[int, tuple] = {}  # the tokens that a token's first byte has belonged to, in order of their making
        self.right: dict[int, tuple] = {}  # the same for its last byte
        self.allowed: dict[tuple[int, int], bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token in sorted(self.spell):
            self.compile(token)
        self.reset()

    def compile(self, token: int) -> None:
        b = self.spell[token]
        if len(b) == 1:
            self.left[token] = self.right[token] = (token,)
        else:
            for cut in range(1, len(b)):
                x, y = self.ranks.get(b[:cut], token), self.ranks.get(b[cut:], token)
                if x < token and y < token and x in self.left and y in self.left and self.first_across(x, y) == (token, True):
                    self.left[token], self.right[token] = (*self.left[x], token), (*self.right[y], token)
                    break
            else:
                return  # no merges lead to it; it stands only for a whole piece
        node = 0
        for c in b:
            if c not in self.trie[node]:
                self.trie[node][c] = len(self.trie)
                self.trie.append({})
                self.ends.append(-1)
            node = self.trie[node][c]
        self.ends[node] = token

    def first_across(self, x: int, y: int) -> tuple[int, bool]:
        """The first merge across the border of x and y (-1: none), and whether it comes after all merges within them."""
        xs, ys, i, j = self.right[x], self.left[y], 0, 0
        never = len(self.spell) + 1
        while True:
            across = self.ranks.get(self.spell[xs[i]] + self.spell[ys[j]], never)
            next_x = xs[i + 1] if i + 1 < len(xs) else never
            next_y = ys[j + 1] if j + 1 < len(ys) else never
            if across < next_x and across <= next_y:  # of equal ranks the leftmost merge is first
                return across, next_x == next_y == never
            if next_x == next_y == never:
                return -1, True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def may_follow(self, x: int, y: int) -> bool:
        if x < 0:
            return True
        key = (x, y)
        if key not in self.allowed:
            self.allowed[key] = self.first_across(x, y)[0] < 0
        return self.allowed[key]

    def reset(self) -> None:
        self.allowed.clear()
        self.initial = State(0, -1, (), (), ((0, 0),))
        self.states: dict[tuple, State] = {}
        #: state number * 256 + byte: where it leads and what it emits
        self.moves: dict[int, tuple[State, list[int] | None]] = {}

    def move(self, s: State, byte: int) -> tuple[State, list[int] | None]:
        at, token, begin, live = len(s.tokens) + 1, -1, -1, []
        trie, ends, root, tokens, allowed = self.trie, self.ends, s.root, s.tokens, self.allowed
        for start, node in s.live:
            child = trie[node].get(byte)
            if child is not None:
                if trie[child]:
                    live.append((start, child))
                if token < 0 <= (end := ends[child]):
                    before = tokens[start - 1] if start else root
                    ok = allowed.get((before, end))
                    if self.may_follow(before, end) if ok is None else ok:
                        token, begin = end, start
        if token < 0:
            raise ValueError(f"no token for byte {byte}")
        live.append((at, 0))
        tokens, chain, out = (*tokens, token), (*s.chain, begin), None
        # where the chains of all open readings meet: what lies before is settled
        meet = {p for p, _ in live}
        while len(meet) > 1:
            last = max(meet)
            meet.remove(last)
            meet.add(chain[last - 1])
        if off := meet.pop():
            out = []
            p = off
            while p:
                out.append(tokens[p - 1])
                p = chain[p - 1]
            out.reverse()
            root, tokens, chain = out[-1], tokens[off:], tuple([c - off if c > off else 0 for c in chain[off:]])
            live = [(p - off, node) for p, node in live]
        key = (root, tokens, chain, tuple(live))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(len(self.states) + 1, *key)
        self.moves[s.number << 8 | byte] = step = to, out
        return step

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.reset()
        ids: list[int] = []
        s, moves = self.initial, self.moves
        for byte in data:
            s, out = moves.get(s.number << 8 | byte) or self.move(s, byte)
            if out:
                ids += out
        return ids + s.path(len(s.tokens))


#: Continuation bytes that a lead byte asks for; 0 also for those that no character begins with.
FOLLOW = np.zeros(256, np.uint8)
FOLLOW[0xC2:0xE0], FOLLOW[0xE0:0xF0], FOLLOW[0xF0:0xF5] = 1, 2, 3


def complete(data: np.ndarray) -> int:
    """Bytes up to the last place where the UTF-8 machine is between characters."""
    n = len(data)
    for back in range(1, min(3, n) + 1):
        c = int(data[n - back])
        if c & 0xC0 != 0x80:
            return n - back if FOLLOW[c] >= back else n
    return n


class Decoder:
    """Ids to text in blocks; the bytes of a character that a block cuts wait for the next."""

    def __init__(self, ranks: dict[bytes, int], block: int = 1 << 16):
        spell = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            spell[v] = k
        self.block = block
        self.length = np.array([*map(len, spell)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(spell), np.uint8)

    def raw(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        end = np.cumsum(length)
        return self.flat[np.repeat(self.start[ids] - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        held = np.zeros(0, np.uint8)
        for at in range(0, len(ids), self.block):
            data = np.concatenate([held, self.raw(ids[at : at + self.block])])
            cut = complete(data)
            held = data[cut:]
            yield data[:cut].tobytes().decode("utf-8", "replace")
        if len(held):
            yield held.tobytes().decode("utf-8", "replace")


_made: dict[tuple[str, str], tuple[Remembering, Decoder]] = {}


def coder(path: str, pattern: str) -> tuple[Remembering, Decoder]:
    """Of this worker: encodes batches of texts, decodes ids."""
    if (path, pattern) not in _made:
        import regex

        gc.set_threshold(1_000_000, 50, 50)  # the states are many and hold no cycles
        ranks = read_ranks(path)
        t, split = Transducer(ranks), regex.compile(pattern).findall

        def encode(part: list[bytes]) -> list[list[int]]:
            out = []
            for x in part:
                s = x.decode()
                out.append(t.piece(x) if PLAIN.fullmatch(s) else [i for m in split(s) for i in t.piece(m.encode())])
            return out

        _made[path, pattern] = Remembering(encode), Decoder(ranks)
    return _made[path, pattern]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digest_of(parts: Iterable[str]) -> str:
    h, encoder = hashlib.sha256(), codecs.getincrementalencoder("utf-8")()
    for x in parts:
        h.update(encoder.encode(x))
    return h.hexdigest()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """For each document the number and digest of its ids and the digest of what they decode to; with keep_ids the ids too."""
    schema = OUT.append(pa.field("ids", pa.list_(pa.int32()))) if keep_ids else OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decoder = coder(ranks_path, pattern)
        for b in batches:
            t = Texts(b.column("text"))
            ids, at = encode(t)
            each = [ids[s:e] for s, e in zip(at[:-1], at[1:])]
            more = {"ids": [x.astype(np.int32) for x in each]} if keep_ids else {}
            yield batch(schema, doc_id=b.column("doc_id"), n_tokens=np.diff(at), ids_sha256=[hashlib.sha256(x.astype("<u4")).hexdigest() for x in each], decoded_sha256=[digest_of(decoder.stream(x)) for x in each], **more)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    out = texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("doc_id", id_col)
