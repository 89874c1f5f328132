"""BPE encoding and decoding by a tokenization automaton (operator 2).

The merges compile into a deterministic automaton over tokens that accepts exactly the BPE
tokenizations. It starts as one state with a loop for each byte. The gadget of a merge
(a, b) -> c splits the state that a leads to, p, into a copy without its arc b, to which a now
leads; and it adds arcs c beside every arc a, leading to where b led from p. The state after a
token depends on the token alone, so the automaton is kept as a persistent chain of splits:
a state is (the state it was copied from, the removed arc b, the merge's rank), and a removed
arc takes with it the arcs that later merges put beside it (the tokens whose left spine passes
b after that rank). Arcs are looked up once and then stand in a transition table.

A word is encoded from left to right: from each reached position the byte trie offers the arc
labels that match the text, and the automaton allows exactly one way to each position.
Decoding emits the arcs' byte labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillon.llm._common import texts

#: Fixed values of byte-level BPE: the printable stand-ins of bytes, and the word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Code point ranges that are letters or digits to the regex module and neither
#: to the tokenizers library, whose Unicode tables are older.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C,
    0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0,
    0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09,
    0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0,
    0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
#: A code point that is neither to both.
NEITHER = "\ue000"


def byte_chars() -> dict[str, int]:
    """Printable bytes stand for themselves; the rest for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Vocabulary:
    labels: dict[int, bytes]
    bytes_ids: list[int]
    merges: list[tuple[int, int, int]]
    added: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizer JSON file of byte-level BPE (read by the driver)."""
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    @classmethod
    def of(cls, spec: dict) -> Vocabulary:
        to_byte = byte_chars()
        vocab = spec["model"]["vocab"]
        labels = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        ids = {labels[i]: i for i in labels if len(labels[i]) == 1}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return cls(labels, [ids[bytes([b])] for b in range(256)], merges, added)


class Automaton:
    """The compiled tokenization automaton. States are numbers; state 0 is the start."""

    def __init__(self, v: Vocabulary):
        self.labels, self.added = v.labels, v.added
        self.parent, self.cut, self.since = [0], [-1], [-1]
        #: the state that a token leads to; a token's left part and the rank that made it
        self.to: dict[int, int] = dict.fromkeys(v.bytes_ids, 0)
        self.left: dict[int, int] = {}
        self.rank: dict[int, int] = dict.fromkeys(v.bytes_ids, -1)
        for k, (a, b, c) in enumerate(v.merges):
            self._gadget(k, a, b, c)
        # A trie over the labels of reachable tokens: node -> byte -> node, and a node's token.
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t in self.to:
            node = 0
            for x in v.labels[t]:
                if (n := self.next[node].get(x)) is None:
                    n = self.next[node][x] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = n
            self.token[node] = t
        #: the transition table: state -> token -> whether the arc stands, filled when first met
        self.arcs: list[dict[int, bool]] = [{} for _ in self.parent]

    def _gadget(self, k: int, a: int, b: int, c: int) -> None:
        p, after = self.to[a], self.to[b]
        self.parent.append(p)
        self.cut.append(b)
        self.since.append(k)
        self.to[a] = len(self.parent) - 1
        if c not in self.rank:
            self.to[c], self.left[c], self.rank[c] = after, a, k

    def _allows(self, state: int, token: int) -> bool:
        spine: dict[int, int] = {}
        t, above = token, len(self.rank) + len(self.since)
        while True:
            spine[t] = above
            if t not in self.left:
                break
            above, t = self.rank[t], self.left[t]
        while state:
            if spine.get(self.cut[state], -1) >= self.since[state]:
                return False
            state = self.parent[state]
        return True

    def word(self, data: bytes) -> list[int]:
        """Token ids of one pre-split word, by table-driven transitions; linear in its length."""
        n = len(data)
        state: list[int] = [-1] * (n + 1)
        state[0] = 0
        came: list[int] = [0] * (n + 1)
        by: list[int] = [0] * (n + 1)
        arcs, to, trie, token = self.arcs, self.to, self.next, self.token
        for i in range(n):
            s, node, j = state[i], 0, i
            if s < 0:
                continue
            row = arcs[s]
            while j < n:
                node = trie[node].get(data[j])
                if node is None:
                    break
                j += 1
                t = token[node]
                if t >= 0 and state[j] < 0:
                    ok = row.get(t)
                    if ok is None:
                        ok = row[t] = self._allows(s, t)
                    if ok:
                        state[j], came[j], by[j] = to[t], i, t
        out = []
        while n:
            out.append(by[n])
            n = came[n]
        return out[::-1]


class Words(dict):
    """Ids of words met before; longer words than any that recur are not kept."""

    def __init__(self, a: Automaton):
        self.a = a

    def __missing__(self, w: str) -> list[int]:
        ids = self.a.word(w.encode())
        if len(w) <= 64:
            self[w] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts; words met before come from a bounded table."""

    LIMIT = 400_000

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.words = regex.compile(PATTERN).findall
        self.added = regex.compile("|".join(regex.escape(x) for x in sorted(automaton.added, key=len, reverse=True))) if automaton.added else None
        self.label = dict(automaton.labels) | {i: x.encode() for x, i in automaton.added.items()}
        self.seen = Words(automaton)

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _NEWER.search(text):
                ends = [0, *accumulate(map(len, self.words(_NEWER.sub(NEITHER, text))))]
                return [text[a:b] for a, b in zip(ends, ends[1:])]
        return self.words(text)

    def _plain(self, text: str) -> list[int]:
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
        found = self.split(text)
        return list(chain.from_iterable(map(self.seen.__getitem__, found)))

    def encode(self, text: str) -> list[int]:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.a.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(key: str, value) -> Codec:
    """One codec for each Python worker and vocabulary; the automaton compiles once there."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(Automaton(value()))
    return _codecs[key]


def encode_decode(docs: DataFrame, tokenizer: str, *, with_ids: bool = False) -> DataFrame:
    """Encodes each text and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256
    (of the decoded text in UTF-8) and, with_ids, the ids and the decoded text themselves. One
    row for each input row: a null or empty text has no tokens, and the digests of no bytes;
    repeated rows give repeated results. Texts of any length are encoded whole. The vocabulary
    (bounded by its own size) is read by the driver and broadcast.
    """
    v = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, lambda: v.value)
        digits = {i: str(i) for i in c.label}
        for batch in batches:
            rows: list[list] = [[] for _ in range(3 + 2 * with_ids)]
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                decoded = b"".join(map(c.label.__getitem__, ids)).decode("utf-8", "replace")
                row = (len(ids), hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded)
                for out, x in zip(rows, row):
                    out.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], schema=pa.schema(zip(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"], [pa.int64(), *kinds]))) if with_ids else pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, schema)
