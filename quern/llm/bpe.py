"""Byte-level BPE: a minimal perfect hash for pre-tokens that are in the vocabulary, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Segments and pre-tokens in a generation of a worker's memo; a full one is kept until the next is full, which changes no result.
MEMO = 300_000
GOLDEN, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: A cut before a blank inside a longer run of white space would change its tokens.
ODD = re.compile(r"\s \s|\s \Z")


class PerfectHash:
    """Distinct keys to 0..n-1 without gaps. A level holds a bit for each key that meets no other there; the rest go on to
    the next level; a key's number is the count of bits before its own. For other keys the number means nothing."""

    GAMMA = 1.7

    def __init__(self, keys: list[bytes]):
        left = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        self.sizes: list[int] = []
        self.words: list[int] = []
        self.before: list[int] = []
        self.first: list[int] = []
        count = 0
        while len(left):
            size = max(64, int(len(left) * self.GAMMA) // 64 * 64)
            at = self._mix(left, len(self.sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words = np.packbits(alone.reshape(-1, 8)[:, ::-1], axis=1).ravel().view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            self.sizes.append(size)
            self.first.append(len(self.words))
            self.words += words.tolist()
            self.before += (count + np.cumsum(ones) - ones).tolist()
            count += int(ones.sum())
            left = left[~alone[at.astype(np.int64)]]
        self.count = count

    @staticmethod
    def _mix(h: np.ndarray, level: int) -> np.ndarray:
        x = h + np.uint64((level + 1) * GOLDEN & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def __call__(self, key: bytes) -> int:
        """The key's number, or -1 for some of the keys that are not in the set."""
        h = xxhash.xxh64_intdigest(key)
        for level, size in enumerate(self.sizes):
            x = h + (level + 1) * GOLDEN & MASK
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
            x = (x ^ (x >> 31)) % size
            w = self.first[level] + (x >> 6)
            word, bit = self.words[w], x & 63
            if word >> bit & 1:
                return self.before[w] + (word & ((1 << bit) - 1)).bit_count()
        return -1


class Encoder:
    """Encodes and decodes by a rank file; each match of the pattern is encoded on its own, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.keys: list[bytes] = [b""] * len(keys)
        self.ids = array("I", bytes(4 * len(keys)))
        for key in keys:
            n = self.hash(key)
            self.keys[n], self.ids[n] = key, self.ranks[key]
        #: For two bytes that make a piece, its rank plus one where a heap entry has it; else 0.
        self.pairs = [0] * (1 << 16)
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                self.pairs[piece[0] << 8 | piece[1]] = (rank + 1) << 40
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        self.older_segments: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int | None:
        """First tier: the id of a pre-token that is in the vocabulary."""
        n = self.hash(piece)
        return self.ids[n] if n >= 0 and self.keys[n] == piece else None

    def merged(self, piece: bytes) -> array:
        """Second tier: the pair of lowest rank is merged first, the leftmost of equals, until no pair is in the vocabulary."""
        rank, n = self.ranks.get, len(piece)
        # A heap entry is one number: rank, start of the left part, end of the right part.
        wide = 20 if n < 1 << 20 else 40
        pairs = self.pairs if wide == 20 else [r << 40 for r in self.pairs]
        heap = [r | i << wide | i + 2 for i, r in enumerate(map(pairs.__getitem__, map(int.__add__, map((256).__mul__, piece), piece[1:]))) if r]
        if not heap:
            return array("I", [self.single[b] for b in piece])
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        low, high = (1 << wide) - 1, 2 * wide
        while heap:
            top = pop(heap)
            i, end = top >> wide & low, top & low
            j = after[i]
            if j >= n or after[j] != end or before[j] != i:
                continue  # one of the two has grown since, or is a part no more
            after[i] = end
            before[j] = -2
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    push(heap, (r + 1) << high | i << wide | after[end])
            if (p := before[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                push(heap, (r + 1) << high | p << wide | end)
            after[j] = -1
        out, i = array("I"), 0
        while i < n:
            j = after[i]
            out.append(rank(piece[i:j]))
            i = j
        return out

    def word(self, token: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        if (known := self.words.get(token)) is not None:
            return known
        if (ids := self.older_words.get(token)) is None:
            piece = token.encode("utf-8", "surrogatepass")
            rank = self.whole(piece)
            ids = rank.to_bytes(4, "little") if rank is not None else self.merged(piece).tobytes()
        if len(self.words) >= MEMO:
            self.words, self.older_words = {}, self.words
        if len(token) <= 64:
            self.words[token] = ids
        return ids

    def segment(self, text: str) -> bytes:
        if (ids := self.older_segments.get(text)) is None:
            ids = b"".join(map(self.word, self.find(text)))
        if len(self.segments) >= MEMO:
            self.segments, self.older_segments = {}, self.segments
        if len(text) <= 64:
            self.segments[text] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        No match of the pattern crosses a blank that follows a visible character, so the text is cut there and segments
        met before are not matched again; texts with longer runs of white space around blanks are matched as a whole.
        """
        if ODD.search(text):
            return b"".join(map(self.word, self.find(text)))
        first, *rest = text.split(" ")
        segment = self.segment
        out = [segment(first)] if first else []
        known = self.segments.get
        out += [ids if (ids := known(s)) is not None else segment(s) for s in map(" ".__add__, rest)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, pattern)


def _run(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [tool.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _back(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [tool.decode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], ["doc_id", "ids", "bytes"])

    return run


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers.

    Null counts as empty, and empty texts have no ids. Repeated rows stay; extra columns are ignored. path is the rank file
    on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(path, pattern), "doc_id long, ids binary")


def decode_column(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds bytes, the text that the ids stand for, to (doc_id, ids). An id that is not in the vocabulary fails the task."""
    return encoded.select("doc_id", "ids").mapInArrow(_back(path, pattern), "doc_id long, ids binary, bytes binary")


def token_array(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def digest(ids: bytes) -> str:
    return hashlib.sha256(ids).hexdigest()


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, and the SHA-256 of its ids and of the bytes that they decode to."""
    back = decode_column(encode_column(docs, path, pattern, id_col, text_col), path, pattern)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
