"""A Katz backoff model of word pairs: Good-Turing discounts, exactly normalised backoff weights, counts in partitioned tables.

The corpus is worked in blocks of documents. A block asks the count tables, which are partitioned by word and by history, for
what it needs and gets whole-corpus counts back in the order asked; nothing that grows with the corpus visits the driver.
Words are told apart by their 64-bit XXH64 values.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.storage import materialise, release

#: Counts up to CUT are discounted by Good-Turing; larger ones by half a count, so that every history leaves some mass.
CUT, HALF = 5, 0.5
#: Tokens to a block, and distinct words or pairs to a partition of the count tables.
BLOCK_TOKENS, PART_ROWS = 1_000_000, 400_000
HELD_FOLDS, HELD_REST = 7, 2
END, START = 0, 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def _pack_real(values: np.ndarray) -> bytes:
    return _pack(values.astype("<f8").view("<u8"))


def _unpack_real(data: bytes) -> np.ndarray:
    return _unpack(data).view(np.float64)


class _Locals(dict):
    """Words of a block, numbered as they come; 0 is the end of a document."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    local, ids, lengths, train, tokens = _Locals(), [], [], [], []

    def flush() -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))
        hashes = np.r_[np.uint64(END), np.where(hashes <= START, hashes + np.uint64(2), hashes)]
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        taught = np.repeat(np.array(train, bool), np.array(lengths))
        counts = np.bincount(place[flat[taught]], minlength=len(order))
        row = {
            "docs": [np.array([i if i is not None else 0 for i in ids], "<i8").tobytes()],
            "nulls": [bytes(i is None for i in ids)],
            "lengths": [_pack(np.array(lengths, np.uint64))],
            "train": [bytes(train)],
            "vocab": [hashes[order].astype("<u8").tobytes()],
            "counts": [_pack(counts.astype(np.uint64))],
            "tokens": [_pack(place[flat].astype(np.uint64))],
            "n_words": [len(order)],
            "n_train": [int(taught.sum())],
            "n_train_docs": [int(sum(train))],
        }
        return pa.RecordBatch.from_pydict(row)

    held = 0
    for batch in batches:
        for doc, text, teaches in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = words_of(text.as_py())
            tokens.append(np.array([local[w] for w in words] + [0], np.int64))
            ids.append(doc)
            lengths.append(len(words) + 1)
            train.append(bool(teaches))
            held += len(words) + 1
            if held >= BLOCK_TOKENS:
                yield flush()
                local, ids, lengths, train, tokens, held = _Locals(), [], [], [], [], 0
    if ids:
        yield flush()


def _word_requests(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocab, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashes, n = np.frombuffer(vocab, "<u8"), _unpack(counts)
                cuts = np.searchsorted(hashes, _borders(parts))  # parts are ranges of the hash, so a sorted vocabulary falls into runs
                runs = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
                used = [(p, r) for p, r in enumerate(runs) if r.start < r.stop]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [p for p, _ in used],
                        "block": [block] * len(used),
                        "hashes": [hashes[r].tobytes() for _, r in used],
                        "counts": [_pack(n[r]) for _, r in used],
                    },
                    schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]),
                )

    return run


def _borders(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(parts)] + [(1 << 64) - 1], np.uint64)


ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))])


def count_of_counts(counts: np.ndarray) -> list[int]:
    """How many have a count of 1, 2, ... CUT + 1."""
    return np.bincount(np.minimum(counts, CUT + 2).astype(np.int64), minlength=CUT + 3)[1 : CUT + 2].tolist()


def _word_counts(parts: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        asked = [np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()]
        counts = [_unpack(c) for c in table.column("counts").to_pylist()]
        words, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts).astype(np.float64), len(words)).astype(np.uint64)
        rank = np.empty(len(words), np.uint64)
        rank[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(words), dtype=np.uint64)
        ids = rank * np.uint64(parts) + np.uint64(part) + np.uint64(2)  # small for frequent words; 0 and 1 stay free
        ends = np.cumsum([len(a) for a in asked])
        rows = [(b, part, _pack(ids[i]), _pack(total[i]), None) for b, i in zip(table.column("block").to_pylist(), np.split(back, ends[:-1]))]
        rows.append((None, part, None, None, [*count_of_counts(total), int((total > 0).sum())]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ANSWER)], schema=ANSWER)

    return run


def _numbered(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block with the ids and whole-corpus counts of its words, in the order of its vocabulary."""
    right = right.sort_by("part")
    join = lambda name: np.concatenate([_unpack(x) for x in right.column(name).to_pylist()])
    columns = [left.column(c) for c in ("block", "docs", "nulls", "lengths", "train", "tokens")]
    return pa.table([*columns, pa.array([_pack(join("ids"))]), pa.array([_pack(join("counts"))])], names=["block", "docs", "nulls", "lengths", "train", "tokens", "ids", "counts"])


NUMBERED = "block long, docs binary, nulls binary, lengths binary, train binary, tokens binary, ids binary, counts binary"


def discounts(n: list[int]) -> np.ndarray:
    """[r]: the share of a count of r that stays, for r up to CUT, from counts of counts 1..CUT+1.

    Katz's formula where the counts of counts allow it; where they give a share outside (0, 1), an absolute discount.
    """
    out = np.ones(CUT + 1)
    n = [0, *n]
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else HALF
    common = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        share = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = share if 0 < share < 1 else (r - absolute) / r
    return out


def kept(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    c = counts.astype(np.float64)
    return np.where(counts <= CUT, c * share[np.minimum(counts, CUT).astype(np.int64)], c - HALF)


def unigram(counts: np.ndarray, total: int, share: np.ndarray, unknown: float) -> np.ndarray:
    """P(word); all words that were never seen are one event with the mass that discounting left."""
    return np.where(counts > 0, kept(counts, share) / max(total, 1), unknown)


class _Block:
    """The pairs of a block: histories and words by id, asked once each, ordered by part of the table, history and word."""

    def __init__(self, row: dict, parts: int, total: int, start_count: int):
        self.lengths = _unpack(row["lengths"]).astype(np.int64)
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        tokens, ids, counts = _unpack(row["tokens"]).astype(np.int64), _unpack(row["ids"]), _unpack(row["counts"])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.count = counts[tokens]  # of every token's word
        word, history, before = ids[tokens], np.empty(len(tokens), np.uint64), np.empty(len(tokens), np.uint64)
        history[1:], before[1:] = word[:-1], self.count[:-1]
        history[self.first], before[self.first] = START, start_count
        self.before = before  # how often every token's history was followed by anything
        # A history that a part's share of the corpus stands behind is split by word.
        hot = before >= max(total // parts, 2)
        part = np.where(hot, (history + word * np.uint64(0x9E3779B1)) % np.uint64(parts), history % np.uint64(parts))
        order = np.lexsort((word, history, part))
        p, h, w = part[order], history[order], word[order]
        new = np.r_[True, (p[1:] != p[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])] if len(p) else np.zeros(0, bool)
        self.pair = np.empty(len(tokens), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        first = order[new]
        self.part, self.history, self.word = part[first], history[first], word[first]
        self.word_count, self.hot = self.count[first], hot[first]
        taught = np.repeat(self.train, self.lengths)
        self.n = np.bincount(self.pair[taught], minlength=len(first)).astype(np.uint64)
        cuts = np.searchsorted(self.part, np.arange(parts + 1, dtype=np.uint64))
        self.runs = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]


REQUEST = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("history", "word", "n", "word_count", "hot"))])


def _deltas(h: np.ndarray) -> np.ndarray:
    return np.diff(h, prepend=np.uint64(0))


def _pair_requests(parts: int, total: int, start_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row, parts, total, start_count)
                out = [(k, row["block"], _pack(_deltas(b.history[r])), _pack(b.word[r]), _pack(b.n[r]), _pack(b.word_count[r]), np.packbits(b.hot[r]).tobytes()) for k, r in b.runs]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), REQUEST)], schema=REQUEST)

    return run


PAIRS = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("classes", pa.binary()), ("mass", pa.binary()), ("history", pa.int64()), ("stats", pa.list_(pa.int64())), ("share", pa.float64())]
)


def _pair_counts(total: int, share: np.ndarray, unknown: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = table.to_pylist()
        history = np.concatenate([np.cumsum(_unpack(r["history"]), dtype=np.uint64) for r in rows])
        word = np.concatenate([_unpack(r["word"]) for r in rows])
        n = np.concatenate([_unpack(r["n"]) for r in rows])
        word_count = np.concatenate([_unpack(r["word_count"]) for r in rows])
        sizes = [len(_unpack(r["word"])) for r in rows]
        hot = np.concatenate([np.unpackbits(np.frombuffer(r["hot"], np.uint8))[:s] for r, s in zip(rows, sizes)]).astype(bool)
        order = np.lexsort((word, history))
        h, w = history[order], word[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[new]
        counts = np.bincount(group, n.astype(np.float64), len(first)).astype(np.uint64)
        # Of each history: how many words followed it 1, ..., CUT and more times, and the unigram mass of those words.
        heads, of = np.unique(history[first], return_inverse=True)
        seen = counts > 0
        kind = np.minimum(counts, CUT + 1).astype(np.int64)
        classes = np.bincount(of[seen] * (CUT + 2) + kind[seen], minlength=len(heads) * (CUT + 2)).reshape(len(heads), CUT + 2)[:, 1:]
        mass = np.bincount(of, np.where(seen, unigram(word_count[first], total, share, unknown), 0.0), len(heads))
        head_hot = np.zeros(len(heads), bool)
        head_hot[of] = hot[first]
        out = []
        ends = np.cumsum(sizes)
        for r, own in zip(rows, np.split(np.arange(len(history)), ends[:-1])):
            mine = of[group[own]]
            asked = mine[np.r_[True, mine[1:] != mine[:-1]]]  # histories in the order asked
            out.append((r["block"], part, _pack(counts[group[own]]), _pack(classes[asked].ravel().astype(np.uint64)), _pack_real(mass[asked]), None, None, None))
        out.append((None, part, None, None, None, None, count_of_counts(counts), None))
        out += [(None, part, None, None, None, int(heads[i]), classes[i].tolist(), float(mass[i])) for i in np.flatnonzero(head_hot)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), PAIRS)], schema=PAIRS)

    return run


def backoff(before: np.ndarray, classes: np.ndarray, more: np.ndarray, mass: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Backoff weight of histories followed `before` times: the mass that discounting left, over the unigram mass of unseen words.

    classes[:, r-1] words followed r times (r <= CUT), classes[:, CUT] more often, `more` times together.
    """
    r = np.arange(1, CUT + 1)
    stays = classes[:, :CUT] @ (r * share[1:]) + more - HALF * classes[:, CUT]
    left = 1.0 - stays / np.maximum(before, 1)
    return np.where(before > 0, np.maximum(left, 0.0) / np.maximum(1.0 - mass, 1e-300), 1.0)


def _scores(parts: int, total: int, vocabulary: int, start_count: int, share1: np.ndarray, unknown: float, share2: np.ndarray, hot: dict[int, tuple[list[int], float]]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        answers = {r["part"]: r for r in right.to_pylist()}
        b = _Block(row, parts, total, start_count)
        counts = np.zeros(len(b.part), np.uint64)
        weight = np.ones(len(b.part))
        before = np.zeros(len(b.part))
        before[b.pair] = b.before
        for k, r in b.runs:
            answer = answers[k]
            counts[r] = _unpack(answer["counts"])
            classes, mass = _unpack(answer["classes"]).reshape(-1, CUT + 1).astype(np.float64), _unpack_real(answer["mass"])
            heads = b.history[r]
            head_of = np.cumsum(np.r_[True, heads[1:] != heads[:-1]]) - 1
            classes, mass = classes[head_of], mass[head_of]
            for i in np.flatnonzero(b.hot[r]):
                classes[i], mass[i] = hot[int(heads[i])]
            small = classes[:, :CUT] @ np.arange(1, CUT + 1)
            weight[r] = backoff(before[r], classes, np.maximum(before[r] - small, 0.0), mass, share2)
        p1 = unigram(b.count, total, share1, unknown)
        c = counts[b.pair]
        known_pair = c > 0
        p = np.where(known_pair, kept(c, share2) / np.maximum(b.before.astype(np.float64), 1), weight[b.pair] * p1)
        base = (b.count.astype(np.float64) + 1) / (total + vocabulary + 1)
        add = lambda x: np.add.reduceat(x, b.first)
        docs, nulls = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["nulls"], np.uint8).astype(bool)
        return pa.table(
            {
                "doc_id": pa.array(docs, mask=nulls),
                "held_out": pa.array(~b.train),
                "n_tokens": pa.array(b.lengths),
                "n_known": pa.array(add((b.count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(docs), total, np.int64)),
                "base_score": pa.array(add(np.log10(base))),
                "score": pa.array(add(np.log10(p))),
            }
        )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files go as soon as the table they fed is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = HELD_FOLDS, rest: int = HELD_REST) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    Learns from rows whose crc32(doc_id as text) mod folds is not rest (a null id counts as ''). A text is its words and one
    end; the first word's history is the start of a text. P(w|h) is the discounted share of the pair where it was seen, else
    the history's backoff weight times P(w); a history never seen backs off with weight 1; words never seen are one event.
    Null texts count as empty; repeated rows are learned and scored each; extra columns are ignored; without training rows
    every probability is 1; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spread = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != rest
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), spread.alias("teaches"))
    with _tidy(spark):
        blocks = rows.mapInArrow(
            _blocks, "docs binary, nulls binary, lengths binary, train binary, vocab binary, counts binary, tokens binary, n_words long, n_train long, n_train_docs long"
        )
        blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
        sums = blocks.agg(F.sum("n_words"), F.sum("n_train"), F.sum("n_train_docs")).first()
        if sums[0] is None:
            return spark.createDataFrame([], SCORES)
        words, total, start_count = sums
        parts = max(8, -(-words // PART_ROWS))
        asked = blocks.select("block", "vocab", "counts").mapInArrow(_word_requests(parts), "part int, block long, hashes binary, counts binary")
        answers = materialise(asked.groupBy("part").applyInArrow(_word_counts(parts), "block long, part int, ids binary, counts binary, stats array<long>"), "words")
        stats = answers.where("block is null").select(*[F.sum(F.col("stats")[i]) for i in range(CUT + 2)]).first()
        share1, vocabulary = discounts(list(stats[: CUT + 1])), stats[CUT + 1]
        # What discounting leaves of the unigrams: counts beyond CUT lose half a count each.
        small = sum(stats[i] * (i + 1) * share1[i + 1] for i in range(CUT))
        large = total - sum(stats[i] * (i + 1) for i in range(CUT)) - HALF * (vocabulary - sum(stats[:CUT]))
        unknown = 1.0 - (small + large) / total if total else 1.0
        numbered = materialise(
            blocks.select("block", "docs", "nulls", "lengths", "train", "tokens").groupBy("block").cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(_numbered, NUMBERED),
            "numbered",
        )
        release(blocks)
        release(answers)
        # About two words in three of a block's distinct pairs; parts of the pair table hold a bounded number of requests each.
        pair_parts = max(8, -(-int(words) * 5 // PART_ROWS))
        requests = numbered.mapInArrow(_pair_requests(pair_parts, total, start_count), "part int, block long, history binary, word binary, n binary, word_count binary, hot binary")
        pairs = materialise(
            requests.groupBy("part").applyInArrow(
                _pair_counts(total, share1, unknown),
                "block long, part int, counts binary, classes binary, mass binary, history long, stats array<long>, share double",
            ),
            "pairs",
        )
        of_pairs = pairs.where("block is null and history is null").select(*[F.sum(F.col("stats")[i]) for i in range(CUT + 1)]).first()
        share2 = discounts(list(of_pairs))
        split = pairs.where("history is not null").groupBy("history").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(CUT + 1)]).alias("classes"), F.sum("share").alias("mass"))
        hot = {r["history"]: (r["classes"], r["mass"]) for r in split.collect()}  # as many as parts at most
        scored = numbered.groupBy("block").cogroup(pairs.where("block is not null").groupBy("block")).applyInArrow(
            _scores(pair_parts, total, vocabulary, start_count, share1, unknown, share2, hot), SCORES
        )
        return materialise(scored, "scores")
