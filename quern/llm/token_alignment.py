"""Alignment of two tokenizers through a dictionary of groups: links are expanded once for each distinct group of the corpus."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import materialise

#: Tokens (of both sides) to a block of documents; a longer document is a block of its own. Segments in a generation of a worker's memo.
BLOCK_TOKENS, MEMO = 1_500_000, 300_000
#: No token of either kind reaches over a blank between two visible characters, so texts are cut there.
CUT = re.compile(r"(?<=\S)(?= \S)")
NO_TOKENS = (b"", 0, 0, None)


def byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Token groups of texts: a group ends wherever a token of each side ends."""

    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for s, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.names = [str(i) for i in range(max(len(self.a_size), len(self.b_size)))]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a blank inside could reach over a cut")
        self.memo: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _grouped(self, segment: str, a: list[int], b: list[int]) -> tuple | None:
        """(group keys, tokens of A, tokens of B) of a segment, or None where the bytes of either side differ from it."""
        whole = segment.encode("utf-8", "surrogatepass")
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        keys, size_a, size_b, name = [], self.a_size, self.b_size, self.names
        i = j = from_i = from_j = end_a = end_b = 0
        for x in a:
            i += 1
            end_a += size_a[x]
            while end_b < end_a:
                end_b += size_b[b[j]]
                j += 1
            if end_a == end_b:
                keys.append(f"{','.join([name[x] for x in a[from_i:i]])}|{','.join([name[x] for x in b[from_j:j]])}")
                from_i, from_j = i, j
        return tuple(keys), len(a), len(b)

    def learn(self, segments: list[str]) -> dict[str, tuple | None]:
        """The groups of all given segments, those met before from the memo."""
        found, new = {}, []
        for s in segments:
            if s in self.memo:
                found[s] = self.memo[s]
            elif s in self.older:
                found[s] = self.memo[s] = self.older[s]
            else:
                new.append(s)
        if new:
            a = self.a.encode_batch(new, add_special_tokens=False)
            # The piece tokenizer puts a blank before what it is given; every segment starts with one.
            b = self.b.encode([s[1:] for s in new], num_threads=1)
            for s, x, y in zip(new, a, b):
                found[s] = groups = self._grouped(s, x.ids, y)
                if len(s) <= 64:
                    self.memo[s] = groups
        if len(self.memo) >= MEMO:
            self.memo, self.older = {}, self.memo
        return found

    def documents(self, texts: list[str | None]) -> Iterator[tuple[list[str], int, int]]:
        """(group keys in order, tokens of A, tokens of B) of each text; nothing where a text has no tokens."""
        cut = [CUT.split(" " + t) if t else [] for t in texts]
        known = self.learn(list({s for c in cut for s in c}))
        for segments in cut:
            parts = [known[s] for s in segments]
            if None in parts:
                parts = []
            yield [k for p in parts for k in p[0]], sum(p[1] for p in parts), sum(p[2] for p in parts)

    def links(self, key: str) -> Counter:
        """(A id, B id) to how many occurrence pairs of the group overlap in bytes."""
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        ea, eb = list(accumulate(self.a_size[x] for x in a)), list(accumulate(self.b_size[x] for x in b))
        out: Counter = Counter()
        i = j = 0
        while i < len(a) and j < len(b):
            out[a[i], b[j]] += 1
            at, other = ea[i], eb[j]
            i += at <= other
            j += other <= at
        return out


@cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each worker process."""
    return Aligner(byte_path, piece_path)


BLOCK = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
    "groups array<string>, docs array<long>, starts binary, places binary, times binary"
)


def _blocks(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        index: dict[str, int] = {}
        docs: list[int] = []
        places: list[np.ndarray] = []
        times: list[np.ndarray] = []
        tokens = 0

        def out() -> pa.RecordBatch:
            starts = np.cumsum([0, *map(len, places)]).astype("<i8")
            ids, na, nb, ng, digests = (list(c) for c in zip(*rows))
            join = lambda parts: np.concatenate([np.zeros(0, "<i4"), *parts]).astype("<i4").tobytes()
            row = {"block": number, "doc_ids": ids, "n_a": na, "n_b": nb, "n_groups": ng, "digests": digests, "groups": list(index), "docs": docs,
                   "starts": starts.tobytes(), "places": join(places), "times": join(times)}
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for doc_id, (keys, a, b) in zip(part.column(0).to_pylist(), tool.documents(part.column(1).to_pylist())):
                    digest = hashlib.sha256(";".join(keys).encode()).hexdigest() if keys else ""
                    rows.append((doc_id, a, b, len(keys), digest))
                    counted = Counter(keys)
                    here = np.empty(len(counted), "<i4")
                    for n, key in enumerate(counted):
                        if (p := index.get(key)) is None:
                            p = index[key] = len(docs)
                            docs.append(0)
                        docs[p] += 1
                        here[n] = p
                    places.append(here)
                    times.append(np.fromiter(counted.values(), "<i4", len(counted)))
                    tokens += a + b
                    if tokens >= BLOCK_TOKENS:
                        yield out()
                        rows, index, docs, places, times, tokens, number = [], {}, [], [], [], 0, number + 1
        if rows:
            yield out()

    return run


def _links(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_path, piece_path)
        for batch in batches:
            which, a, b, n = [], [], [], []
            for row, key in enumerate(batch.column(0).to_pylist()):
                for (x, y), times in tool.links(key).items():
                    which.append(row)
                    a.append(x)
                    b.append(y)
                    n.append(times)
            part = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], ["grp", "docs", "a", "b", "n"])

    return run


def _views(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(block.column(n)[0].as_py(), kind) for n, kind in (("starts", "<i8"), ("places", "<i4"), ("times", "<i4")))


def _shared_counts(key: tuple, block: pa.Table, asked: pa.Table) -> pa.Table:
    """In how many documents of a block a pair occurs that several groups have. asked has (place, a, b)."""
    empty = pa.table({"a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "docs": pa.array([], pa.int64())})
    if not block.num_rows or not asked.num_rows:
        return empty
    starts, places, _ = _views(block)
    pair = asked.column("a").to_numpy().astype(np.int64) << 32 | asked.column("b").to_numpy()
    distinct, number = np.unique(pair, return_inverse=True)
    place = asked.column("place").to_numpy()
    order = np.argsort(place, kind="stable")
    place, number = place[order], number[order]
    low, high = np.searchsorted(place, places, "left"), np.searchsorted(place, places, "right")
    many = high - low
    # Every pair that a group of a document has, as document and pair in one number; what a document repeats counts once.
    doc = np.repeat(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    held = np.unique(doc * len(distinct) + number[at])
    total = np.bincount(held % len(distinct), minlength=len(distinct))
    some = total > 0
    return pa.table({"a": (distinct[some] >> 32).astype(np.int32), "b": (distinct[some] & 0xFFFFFFFF).astype(np.int32), "docs": total[some]})


def _settled(key: tuple, block: pa.Table, worth: pa.Table) -> pa.Table:
    """The rows of a block's documents, from what each of its groups is worth."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not block.num_rows:
        return pa.table({n: pa.array([], pa.string() if n == "groups_sha256" else pa.int64()) for n in names})
    starts, places, times = _views(block)
    columns = {n: block.column(c)[0].as_py() for n, c in zip(("doc_id", "n_a", "n_b", "n_groups"), ("doc_ids", "n_a", "n_b", "n_groups"))}
    size = len(block.column("docs")[0])
    at = worth.column("place").to_numpy()
    for name in ("n_links", "n_best", "count_sum"):
        value = np.zeros(size, np.int64)
        value[at] = worth.column(name).to_numpy()
        running = np.concatenate([[0], np.cumsum(value[places] * times)])
        columns[name] = running[starts[1:]] - running[starts[:-1]]
    columns["groups_sha256"] = block.column("digests")[0].as_py()
    return pa.table({n: pa.array(columns[n], pa.string() if n == "groups_sha256" else pa.int64()) for n in names})


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer over blank and text, B the piece tokenizer, which adds the blank. A pair's count is the
    number of rows of docs (repeated ones each) that hold it linked. The distinct groups of the corpus are a table; their
    links are expanded there, once each. A pair of one group occurs in as many documents as the group; for pairs of several
    groups each block of documents counts those that have any of them. What a group is worth goes back to the blocks by
    group key. Null and empty texts, and those whose tokens do not give their bytes back (such as texts with U+2581), have
    zeros and an empty string. Very long texts are a block each; extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks(byte_path, piece_path), BLOCK), "blocks")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("groups", "docs")).alias("place", "g")).select("block", "place", F.col("g.groups").alias("grp"), F.col("g.docs").alias("docs"))
    dictionary = asked.groupBy("grp").agg(F.sum("docs").alias("docs"))
    links = materialise(dictionary.mapInArrow(_links(byte_path, piece_path), "grp string, docs long, a int, b int, n long"), "links")
    pairs = materialise(links.groupBy("a", "b").agg(F.count("*").alias("n_groups"), F.sum("docs").alias("docs")), "pairs")
    shared = links.join(pairs.where("n_groups > 1").select("a", "b"), ["a", "b"]).groupBy("grp").agg(F.collect_list(F.struct("a", "b")).alias("shared"))
    questions = asked.select("block", "place", "grp").join(shared, "grp").select("block", "place", F.inline("shared").alias("a", "b"))
    slim = blocks.select(F.col("block").alias("own"), "starts", "places", "times")
    in_blocks = slim.groupBy("own").cogroup(questions.groupBy("block")).applyInArrow(_shared_counts, "a int, b int, docs long")
    counted = pairs.where("n_groups = 1").select("a", "b", "docs").unionByName(in_blocks.groupBy("a", "b").agg(F.sum("docs").alias("docs")))
    counted = materialise(counted, "pair-counts")
    best = counted.groupBy("a").agg(F.max("docs").alias("best"))
    # One row for each id of A's vocabulary at most.
    judged = counted.join(F.broadcast(best), "a")
    worth = links.select("grp", "a", "b", "n").join(judged, ["a", "b"]).groupBy("grp").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("docs") == F.col("best"), F.col("n")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")
    )
    worth = materialise(worth, "worth")
    answers = asked.select("block", "place", "grp").join(worth, "grp").select("block", "place", "n_links", "n_best", "count_sum")
    whole = blocks.select(F.col("block").alias("own"), "doc_ids", "n_a", "n_b", "n_groups", "digests", "docs", "starts", "places", "times")
    return whole.groupBy("own").cogroup(answers.groupBy("block")).applyInArrow(
        _settled, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
