"""Ranked lexical search: a max tree over document ranges for each term, searched best first with exact integer bounds."""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.storage import materialise
from quern.llm.words import words

#: Documents to a block of the index, to a lowest range of the tree, and ranges to a range of the next level.
BLOCK, LEAF, FAN = 16_384, 64, 8
#: Postings after which a block ends in any case, and items that search a block together.
POSTINGS, TOGETHER = 4_000_000, 2_000
#: Distinct terms of the items up to which only they are indexed; with more, all terms are, and the terms meet by a join.
VOCABULARY = 200_000
INDEX = "block long, term binary, docs binary, times binary, sizes binary"
BLOCKS = "block long, ids array<long>, n_docs long, n_words long"


def impact(times: np.ndarray, sizes: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What a term's occurrences give before its weight: (10^9 tf) div (1000 tf + 8 m)."""
    m = 25 + (75 * sizes * n_docs) // n_words
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


def _index(wanted: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        postings: dict[bytes, tuple[array, array, array]] = {}
        n_docs = n_words = held = 0

        def out() -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64())
            names = ["block", "term", "docs", "times", "sizes", "ids", "n_docs", "n_words"]
            head = [[number], [None], [None], [None], [None], [ids], [n_docs], [n_words]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(head, kinds)], names)
            terms = list(postings)
            for at in range(0, len(terms), 5000):
                some = terms[at : at + 5000]
                packed = [[postings[t][k].tobytes() for t in some] for k in range(3)]
                body = [[number] * len(some), some, *packed, [None] * len(some), [None] * len(some), [None] * len(some)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(body, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = words(text.as_py())
                counted = Counter(found)
                here = len(ids)
                ids.append(doc_id.as_py())
                n_docs += bool(found)
                n_words += len(found)
                own = counted.keys() if wanted is None else counted.keys() & wanted
                held += len(own)
                for term in own:
                    if (p := postings.get(term)) is None:
                        p = postings[term] = (array("i"), array("i"), array("i"))
                    p[0].append(here)
                    p[1].append(counted[term])
                    p[2].append(len(found))
                if len(ids) >= BLOCK or held >= POSTINGS:
                    yield from out()
                    ids, postings, n_docs, n_words, held, number = [], {}, 0, 0, 0, number + 1
        if ids:
            yield from out()

    return run


def _tops(n_docs: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [int(impact(_ints(t), _ints(s), n_docs, n_words).max()) for t, s in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top, pa.int64())], ["block", "term", "top"])

    return run


def _ints(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_py(), "<i4").astype(np.int64)


class Block:
    """The postings of a block of documents with a max tree for each term: level 0 are ranges of LEAF documents, a range of
    the next level covers FAN of the level below, the last level is the whole block."""

    def __init__(self, n_rows: int, terms: dict[bytes, tuple[np.ndarray, np.ndarray]]):
        self.terms, self.n_rows = terms, n_rows
        self.sizes = [-(-n_rows // LEAF)]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FAN))
        self.trees: dict[bytes, list[np.ndarray]] = {}

    def tree(self, term: bytes) -> list[np.ndarray]:
        if (levels := self.trees.get(term)) is None:
            docs, gives = self.terms[term]
            levels = [np.zeros(self.sizes[0], np.int64)]
            np.maximum.at(levels[0], docs // LEAF, gives)
            for size in self.sizes[1:]:
                padded = np.zeros(size * FAN, np.int64)
                padded[: len(levels[-1])] = levels[-1]
                levels.append(padded.reshape(size, FAN).max(axis=1))
            self.trees[term] = levels
        return levels

    def search(self, weights: dict[bytes, int], best: int, least: int, order: np.ndarray) -> list[tuple[int, int]]:
        """The best (score, row) of the block, rows of equal score by their place in `order`; scores below least are left out.

        Ranges are opened by falling bound, the sum over terms of weight and maximum; one whose bound equals the score to
        beat is opened too, as a row of that score may come first by its id.
        """
        terms = [t for t in weights if t in self.terms and weights[t] > 0]
        if not terms or not self.n_rows:
            return []
        w = np.array([weights[t] for t in terms], np.int64)
        trees = [self.tree(t) for t in terms]
        levels = [w @ np.stack([tree[k] for tree in trees]) for k in range(len(self.sizes))]
        top = len(levels) - 1
        heap = [(-int(levels[top][0]), top, 0)]
        found: list[tuple[int, int, int]] = []  # a heap of the best: score, place behind in order, row
        bar = max(1, least)
        while heap and -heap[0][0] >= bar:
            _, level, n = heapq.heappop(heap)
            if level:
                for child in range(n * FAN, min(n * FAN + FAN, self.sizes[level - 1])):
                    if (bound := int(levels[level - 1][child])) >= bar:
                        heapq.heappush(heap, (-bound, level - 1, child))
                continue
            low = n * LEAF
            score = np.zeros(LEAF, np.int64)
            for t, x in zip(terms, w):
                docs, gives = self.terms[t]
                part = slice(*np.searchsorted(docs, (low, low + LEAF)))
                score[docs[part] - low] += x * gives[part]
            for i in np.flatnonzero(score >= bar):
                item = (int(score[i]), -int(order[low + i]), int(low + i))
                if len(found) < best:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
                if len(found) == best:
                    bar = max(bar, found[0][0])
        return [(score, row) for score, _, row in found]


def _search(best: int, n_docs: int, n_words: int):
    def run(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        item, doc, score = [], [], []
        if index.num_rows and asked.num_rows:
            ids: list = []
            terms = {}
            for term, docs, times, sizes, own in zip(*(index.column(c) for c in ("term", "docs", "times", "sizes", "ids"))):
                if term.is_valid:
                    terms[term.as_py()] = (_ints(docs), impact(_ints(times), _ints(sizes), n_docs, n_words))
                else:
                    ids = own.as_py()
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
            block = Block(len(ids), terms)
            for name, least, own_terms, weights in zip(*(asked.column(c) for c in ("item", "least", "terms", "weights"))):
                for s, row in block.search(dict(zip(own_terms.as_py(), weights.as_py())), best, least.as_py(), order):
                    item.append(name.as_py())
                    doc.append(ids[row])
                    score.append(s)
        return pa.table({"item": pa.array(item, pa.binary()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times) of (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                counted = Counter(words(text.as_py()))
                if counted:
                    arrays = [pa.array([name.as_py()] * len(counted), pa.binary()), pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["item", "term", "times"])

    return items.mapInArrow(run, "item binary, term binary, times long")


def index_documents(docs: DataFrame, wanted: frozenset[bytes] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: for each block of up to BLOCK rows one row of its ids and counts (term null), and one for each term
    with packed row numbers, occurrences and document lengths."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(_index(wanted), f"{INDEX}, ids array<long>, n_docs long, n_words long"), "search-index")


def _top(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(
    docs: DataFrame, items: DataFrame, best: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` highest-scoring rows of docs for each row of items, scores above 0 only.

    Scores are exact 64-bit integers; equal ones are ranked by ascending doc_id, null ids last, and rows of one id in any
    order. The top of each tree is a table (block, term, maximum): joined with the items' terms it bounds every block for
    every item. The block of the highest bound is searched first; its score at the last rank bars all other blocks and
    ranges with a lower bound, so nothing that could enter the ranking is left out. Null and empty texts have no terms and
    are never found; items without a term that occurs get no rows; repeated items get their rows each; very long texts are
    indexed whole; extra columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    named = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    # Rows that repeat an item are searched once; an item is known by its id and text.
    own = F.unhex(F.sha2(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))), 256))
    keyed = materialise(named.groupBy("item_id", "text").agg(F.count("*").alias("copies")).withColumn("item", own), "items")
    terms = materialise(item_terms(keyed.select("item", "text")), "item-terms")
    distinct = terms.select("term").distinct()
    few = distinct.limit(VOCABULARY + 1).collect()  # a vocabulary of a known size, or none
    index = index_documents(docs, frozenset(bytes(r.term) for r in few) if len(few) <= VOCABULARY else None, id_col, text_col)
    n_docs, n_words = index.where("term is null").agg(F.sum("n_docs"), F.sum("n_words")).first()
    nothing = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_docs:
        return nothing
    entries = index.where("term is not null")
    known = entries.join(distinct, "term", "left_semi")
    df = known.groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("df"))
    quotient = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1)
    weighted = materialise(df.select("term", F.floor(1000 * F.log(quotient)).cast("long").alias("w")).join(terms, "term").select("item", "term", (F.col("w") * F.col("times")).alias("w")).where("w > 0"), "weights")
    tops = known.select("block", "term", "times", "sizes").mapInArrow(_tops(n_docs, n_words), "block long, term binary, top long")
    bounds = materialise(tops.join(weighted, "term").groupBy("item", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound")), "bounds")
    asked = materialise(weighted.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("weights")), "asked")
    parts = -(-keyed.count() // TOGETHER)
    part = F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")

    def searched(pairs: DataFrame) -> DataFrame:
        requests = pairs.join(asked, "item").select("*", part)
        met = requests.select(F.col("block").alias("own"), F.col("part").alias("own_part")).distinct()
        some = index.select("block", "term", "docs", "times", "sizes", "ids").join(met, F.col("block") == F.col("own")).drop("block")
        return some.groupBy("own", "own_part").cogroup(requests.groupBy("block", "part")).applyInArrow(_search(best, n_docs, n_words), "item binary, doc_id long, score long")

    first = bounds.groupBy("item").agg(F.max_by(F.struct("block", "bound"), F.struct("bound", -F.col("block"))).alias("b")).select("item", "b.block", F.lit(0).cast("long").alias("least"))
    first = materialise(first, "first-blocks")
    opened = materialise(searched(first), "first-found")
    # The score at the last rank of the first block, which a row of any other block has to reach.
    bar = opened.groupBy("item").agg(F.when(F.count("*") >= best, F.min("score")).otherwise(F.lit(1)).alias("least"))
    rest = bounds.join(bar, "item", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= least")
    rest = rest.join(first.select("item", "block"), ["item", "block"], "left_anti").select("item", "block", "least")
    found = _top(opened.unionByName(searched(materialise(rest, "other-blocks"))), best)
    # Rows that repeat an item share its ranking.
    again = found.join(keyed, "item").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return again.select("item_id", (F.col("rank")).cast("int").alias("rank"), "doc_id", "score")
