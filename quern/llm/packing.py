"""Best-fit packing of token pieces: a configuration linear program over the length histogram, then rounded."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.storage import materialise

CAPACITY, END = 4096, 1
#: Rounds of multiplicative weights, the share of tokens that may be covered amiss, and the weights of an empty token in turn.
ROUNDS, TOLERANCE, EMPTY = 40, 0.02, (0.999, 0.995, 0.99, 0.98, 0.95, 0.9, 0.8, 0.5, 0.1)
#: Patterns drawn from a solution at most, the share of pieces that is left to best-fit, and the seed of the draws.
DRAWS, REMAINDER, SEED = 8000, 0.03, 7
#: Words of a generation of a worker's memo; a full generation is kept until the next is full, which changes no result.
MEMO = 400_000
#: Bytes of the texts whose words are told apart together.
GROUP_BYTES = 2 << 20
#: Texts that are encoded whole: with white space for Python that the tokenizer does not take as such, or a special token.
UNLIKE = re.compile("[\x1c-\x1f]|<\\|")
#: Letters whose lower case may depend on what stands around them, or that this version may know otherwise than the tokenizer's.
FAR = re.compile("[\u0130-\U0010ffff]")
#: A letter and the punctuation between it and white space, which the tokenizer encodes apart from the letter; an apostrophe is not sure to be.
TAIL = r"""([a-z\x{df}-\x{f6}\x{f8}-\x{12f}])([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)(\s|$)"""
#: Words of letters that are encoded in one call.
JOINED = 4096


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space: tokens of a word don't depend on the words around it, so
    each distinct word is encoded by the library once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tool.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _joined(self, stems: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded as one text: an id that can only end a word tells where each stops."""
        ids = np.array(self.tool.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(stems):
            return self._ids(stems)
        data, stops = ids.tobytes(), [0, *ends.tolist()]
        return [data[x:y] for x, y in zip(stops, stops[1:])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def lowered(text: str) -> str:
        """A text in lower case where that is sure to be what the tokenizer makes of it."""
        return text.lower() if text.isascii() or not FAR.search(text) else text

    def learn(self, words: list[str]) -> None:
        """Makes the ids of these distinct words known; what the older generation knows is not encoded anew."""
        if len(self.known) >= MEMO:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        need = []
        for w in missing:
            if (ids := older.get(w)) is None:
                need.append(w)
            else:
                known[w] = ids
        plain = [w for w in need if w.isalpha() and (w.isascii() or not FAR.search(w))]
        for at in range(0, len(plain), JOINED):
            known.update(zip(plain[at : at + JOINED], self._joined(plain[at : at + JOINED])))
        rest = [w for w in need if w not in known]
        known.update(zip(rest, self._ids(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Words are split, told apart and laid out by Arrow, so that
        each distinct word of these texts is looked up once."""
        odd = [bool(UNLIKE.search(t)) for t in texts]
        plain = pa.array(["" if o else self.lowered(t) for t, o in zip(texts, odd)], pa.large_string())
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, TAIL, r"\1 \2\3"))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        laid = pa.array([self.known[w] for w in words], pa.large_binary()).take(coded.indices.cast(pa.int64()))
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[np.asarray(lists.offsets)].tolist() if len(laid) else [0] * (len(texts) + 1)
        data = laid.buffers()[2].to_pybytes() if len(laid) and laid.buffers()[2] is not None else b""
        return [self._ids([t])[0] if o else data[x:y] for t, o, x, y in zip(texts, odd, ends, ends[1:])]


@cache
def word_tokens(path: str) -> WordTokens:
    """One tokenizer for each worker process."""
    return WordTokens(path)


def _pieces(path: str, capacity: int, end: int):
    close = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = word_tokens(path)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), 1))
            cuts = [0, *(np.flatnonzero(np.diff(ends // GROUP_BYTES)) + 1).tolist(), batch.num_rows]
            for at, stop in zip(cuts, cuts[1:]):
                texts = [x or "" for x in batch.column(1)[at:stop].to_pylist()]
                for doc, found in zip(ids[at:stop], tool.encode(texts)):
                    found += close
                    for piece, start in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every whole text and the end id, cut only where longer than capacity."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(path, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Mixture:
    """A fractional solution of the configuration program: patterns drawn from it cover every length in proportion to its need."""

    lengths: np.ndarray
    weights: np.ndarray  # of each length; a pattern's weight is the product over its pieces and its empty tokens
    sums: np.ndarray  # [c]: the weight of all ways to fill exactly c tokens
    ends: np.ndarray  # [c]: the weight of leaving c tokens empty
    copies: float  # sequences in all
    gap: float  # tokens covered too often or too seldom, as a share of all

    def draw(self, size: int, rng: np.random.Generator) -> list[np.ndarray]:
        """Patterns, each as the places in lengths of its pieces."""
        room, sums, out = len(self.sums) - 1, np.append(self.sums, 0.0), []
        empty = np.cumsum(self.ends * self.sums[::-1])
        for low in range(0, size, 256):
            n = min(256, size - low)
            left = room - np.minimum(np.searchsorted(empty, rng.random(n) * empty[-1], side="right"), room)
            rows: list[list[int]] = [[] for _ in range(n)]
            live = np.flatnonzero(left > 0)
            left = left[live]
            while len(live):
                known = np.searchsorted(self.lengths, left.max(), side="right")
                after = left[:, None] - self.lengths[None, :known]
                total = (sums[np.maximum(after, -1)] * self.weights[:known]).cumsum(1)
                pick = np.minimum((total <= (rng.random(len(left)) * total[:, -1])[:, None]).sum(1), known - 1)
                for row, p in zip(live.tolist(), pick.tolist()):
                    rows[row].append(p)
                left = left - self.lengths[pick]
                live, left = live[left > 0], left[left > 0]
            out += [np.array(r, np.int64) for r in rows]
        return out


def _levelled(lengths: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights times rate ** length, with the rate that makes them sum up to one, so that sums over patterns stay in range."""
    low, high = -2.0, 2.0
    for _ in range(50):
        rate = (low + high) / 2
        if np.exp(np.minimum(logs - rate * lengths, 50.0)).sum() > 1:
            low = rate
        else:
            high = rate
    return np.exp(logs - high * lengths), high


def _fillings(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """[c]: the weight of all ways to fill c tokens: the knapsack by dynamic programming, summing where the plain one takes the best."""
    sums, fit = np.zeros(capacity + 1), np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    sums[0] = 1.0
    for c in range(1, capacity + 1):
        k = fit[c]
        if k:
            sums[c] = weights[:k] @ sums[c - lengths[:k]]
    return sums


def _settled(lengths: np.ndarray, need: np.ndarray, logs: np.ndarray, empty: float, capacity: int, rounds: int, tolerance: float) -> tuple[Mixture | None, np.ndarray]:
    """The weights after rounds of multiplicative updates, and the mixture they make (None where no pattern has a weight)."""
    mix, tokens = None, need * lengths
    for _ in range(rounds):
        weights, rate = _levelled(lengths, logs)
        sums = _fillings(lengths, weights, capacity)
        ends = (empty * np.exp(-rate)) ** np.arange(capacity + 1) if empty else np.eye(1, capacity + 1)[0]
        whole = float((ends * sums[::-1]).sum())
        if not whole > 0 or not np.isfinite(whole):
            return None, logs
        around = np.convolve(sums, sums)[: capacity + 1]
        if empty:
            around = np.convolve(around, ends)[: capacity + 1]
        share = weights * np.maximum(around[capacity - lengths], 0.0) / whole  # pieces of each length to a sequence
        copies = tokens.sum() / max((share * lengths).sum(), 1e-300)
        cover = copies * share / need
        mix = Mixture(lengths, weights, sums, ends, copies, float((np.abs(cover - 1) * tokens).sum() / tokens.sum()))
        if mix.gap < tolerance:
            break
        logs = logs - 0.5 * np.log(np.clip(cover, 0.05, 20.0))
    return mix, logs


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, tolerance: float = TOLERANCE, full: bool = True) -> Mixture | None:
    """The configuration linear program, solved by multiplicative weights; None where nothing is to be packed.

    A length's weight is the exponential of its dual price. A round prices all patterns at once by the knapsack's dynamic
    program, in which a pattern counts by the exponential of its price, and divides each weight by a power of how far the
    patterns so weighted cover the length beyond its need; it ends when the tokens covered amiss are under the tolerance.
    First only full patterns count. Where these can't cover the lengths, empty tokens get a weight, which falls step by step,
    each from the weights before, as long as the tolerance is reached.
    """
    lengths = np.array(sorted(n for n, k in histogram.items() if k), np.int64)
    if not len(lengths):
        return None
    need = np.array([histogram[n] for n in lengths.tolist()], float)
    start = np.log(need / need.sum())
    best = _settled(lengths, need, start, 0.0, capacity, rounds, tolerance)[0] if full else None
    if best is not None and best.gap < tolerance:
        return best
    logs = start
    for empty in EMPTY:
        mix, logs = _settled(lengths, need, logs, empty, capacity, 3 * rounds, tolerance)
        if mix is None or (best is not None and mix.gap >= 4 * tolerance and best.gap < mix.gap):
            break
        best = mix
    return best


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: the best of dual solutions that count pieces over a half, and those small beside them."""
    need = np.zeros(capacity + 1)
    for length, n in histogram.items():
        need[length] = n
    tokens, half = need * np.arange(capacity + 1), capacity // 2
    best = tokens.sum() / capacity
    over, sizes = np.cumsum(need[::-1])[::-1], np.cumsum(tokens[::-1])[::-1]  # of pieces of that length or more
    for k in range(1, half + 1):
        alone, large = over[capacity - k + 1], over[half + 1] - over[capacity - k + 1]
        rest = sizes[k] - sizes[half + 1] - (capacity * large - (sizes[half + 1] - sizes[capacity - k + 1]))
        best = max(best, alone + large + max(0.0, rest) / capacity)
    return int(np.ceil(best - 1e-9))


Group = tuple[list[tuple[int, int]], int]


def program(histogram: dict[int, int], capacity: int = CAPACITY, draws: int = DRAWS, remainder: float = REMAINDER) -> tuple[list[Group], dict[int, int]]:
    """Groups of like sequences by the rounded linear program, and the histogram of what it leaves.

    Patterns drawn from the fractional solution are taken as whole copies (the number of sequences shared out among the draws)
    as far as the pieces of every length go, until half of the sequences are made; then the program is solved anew for the
    rest, until the remainder or a round that makes next to nothing is left.
    """
    left, groups, full = dict(histogram), [], True
    rng, pieces = np.random.default_rng(SEED), sum(histogram.values())
    while sum(left.values()) > remainder * pieces:
        mix = configurations(left, capacity, full=full)
        if mix is None:
            break
        full = full and mix.ends[1:].max(initial=0.0) == 0
        sequences = max(1, round(mix.copies))
        size = min(4 * sequences, draws)
        each, target, made = max(1, -(-sequences // size)), -(-sequences // 2), 0
        for pattern in mix.draw(size, rng):
            places, times = np.unique(pattern, return_counts=True)
            items = list(zip(mix.lengths[places].tolist(), times.tolist()))
            copies = min(each, target - made, *(left.get(length, 0) // k for length, k in items)) if items else 0
            if copies > 0:
                groups.append((items, copies))
                made += copies
                for length, k in items:
                    left[length] -= k * copies
        left = {length: n for length, n in left.items() if n}
        if made < 0.05 * sequences:
            break
    return groups, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Group], float]:
    """Groups of like sequences ([(length, times)], how many), covering the histogram exactly, and the share of pieces that the
    rounded linear program places; the rest goes best-fit, longest first, into the fullest sequence that has room, whole
    groups of like sequences at a time."""
    whole = {length: n for length, n in histogram.items() if n}
    groups, left = program(whole, capacity)
    share = 1 - sum(left.values()) / sum(whole.values()) if whole else 0.0
    room: dict[int, list[Group]] = {}
    levels: list[int] = []

    def put(items: list[tuple[int, int]], count: int) -> None:
        free = capacity - sum(length * k for length, k in items)
        if free not in room:
            room[free] = []
            insort(levels, free)
        room[free].append((items, count))

    for items, count in groups:
        put(items, count)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(levels, length)
            if at == len(levels):
                each, items, count = capacity // length, [], n
            else:
                free = levels[at]
                items, count = room[free].pop()
                if not room[free]:
                    del room[free], levels[at]
                each = free // length
            full = min(count, n // each)
            if full:
                put([*items, (length, each)], full)
                n, count = n - full * each, count - full
            if n and count:  # fewer than fill another of these
                put([*items, (length, n)], 1)
                n, count = 0, count - 1
            if items and count:
                put(items, count)
    return [g for free in levels for g in room[free]], share


def placement(groups: list[Group]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, over its places in order: (places before, times in a sequence, first sequence, offset)."""
    entries: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    base = 0
    for items, count in groups:
        offset = 0
        for length, k in items:
            entries.setdefault(length, []).append((filled.get(length, 0), k, base, offset))
            filled[length] = filled.get(length, 0) + k * count
            offset += length * k
        base += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*own)) for length, own in entries.items()}


def _assign(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length, rank = table.column("length").to_numpy(), table.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                size = int(length[rows[0]])
                before, times, base, first = places[size]
                g = np.searchsorted(before, rank[rows], side="right") - 1
                step = rank[rows] - before[g]
                sequence[rows] = base[g] + step // times[g]
                offset[rows] = first[g] + step % times[g] * size
            out = table.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 128) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences hold capacity tokens at most.

    A null or empty text is one piece of the end id. Repeated rows are packed each; null ids are kept; extra columns are
    ignored; an empty table gives an empty result. The driver sees the histogram (capacity rows) and the sizes of ranking
    groups (about 20,000 at most): pieces of a length are ranked in salted groups by the row's number in the written table of
    pieces, so that no length and no row that repeats thousands of times is one task's work.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenise(docs, path, capacity, end, id_col, text_col).withColumn("mark", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not histogram:
        return pieces.drop("mark").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    groups, _ = plan(histogram, capacity)
    per = max(group_rows, sum(histogram.values()) // 20_000)
    salts = spark.createDataFrame([(length, -(-n // per)) for length, n in histogram.items()], "length long, salts long")  # capacity rows at most
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("mark"), "salts")).drop("salts")
    before: list[tuple[int, int, int]] = []
    seen: dict[int, int] = {}
    for r in salted.groupBy("length", "salt").count().orderBy("length", "salt").collect():
        before.append((r["length"], r["salt"], seen.get(r["length"], 0)))
        seen[r["length"]] = seen.get(r["length"], 0) + r["count"]
    offsets = spark.createDataFrame(before, "length long, salt long, before long")
    order = Window.partitionBy("length", "salt").orderBy("mark")
    ranked = salted.withColumn("n", F.row_number().over(order)).join(F.broadcast(offsets), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("n") - 1).alias("rank"))
    return ranked.mapInArrow(_assign(placement(groups)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
