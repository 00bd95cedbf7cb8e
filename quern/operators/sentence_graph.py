"""Sentence graphs as edge tables: a prefix-filter similarity join, PageRank by sparse joins over all documents at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut

#: A text of at most so many sentences and words is one small matrix in its task; longer ones are dealt over tasks as edge tables.
MATRIX_SENTENCES, MATRIX_WORDS = 1024, 16_384


def _words(sentence: Column | str, stop: list[str] = ()) -> Column:
    """A sentence's words: lower case, two letters or digits at least, no stop words."""
    return F.filter(F.split(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]", " "), " "), lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1)


def sentence_vectors(sentences: DataFrame, stop: list[str] = ()) -> DataFrame:
    """(doc_id, idx, term, w, df): smooth-idf weights of unit length of each sentence's words, of two letters or digits at least.

    sentences is (doc_id, idx, sentence); df is in how many sentences of its document a word stands. Sentences without words
    have no rows.
    """
    each = sentences.select("doc_id", "idx", F.explode(_words("sentence", stop)).alias("term")).groupBy("doc_id", "idx", "term").agg(F.count("*").alias("tf"))
    n = sentences.groupBy("doc_id").agg(F.count("*").alias("n"))
    df = each.groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    weighted = each.join(df, ["doc_id", "term"]).join(n, "doc_id").withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id", "idx")))
    return weighted.select("doc_id", "idx", "term", (F.col("raw") / norm).alias("w"), "df")


def similar_pairs(vectors: DataFrame, least: float = 0.1) -> DataFrame:
    """(doc_id, i, j, weight): the pairs i < j of a document's sentences with a cosine of at least `least` (above 0, if least is 0).

    Words are ordered from rare to common in each document. A sentence's prefix are its words up to where the rest has a norm
    below `least`: two sentences that are similar enough share a word of both prefixes. At the first such word, what is still
    to come is at most the product of the norms of the rests, so a meeting whose bound stays below `least` is dropped before
    anything is shuffled on. The cosines of what is left are summed over all shared words of the two. Nothing is held for a
    whole document.
    """
    rare = Window.partitionBy("doc_id", "idx").orderBy(F.desc("df"), F.desc("term"))
    # From the commonest word on: the squared norm of a word and all that are commoner, and of these alone.
    from_here = F.sum(F.col("w") * F.col("w")).over(rare.rowsBetween(Window.unboundedPreceding, 0))
    ordered = vectors.select("doc_id", "idx", "term", "w", from_here.alias("suffix")).withColumn("rest", F.greatest(F.col("suffix") - F.col("w") * F.col("w"), F.lit(0.0)))
    spare = 1e-9
    prefix = ordered.where(F.col("suffix") >= max(0.0, least - spare) ** 2).select("doc_id", "idx", "term", "w", "rest")
    a = prefix.select("doc_id", "term", F.col("idx").alias("i"), F.col("w").alias("wi"), F.col("rest").alias("ri"))
    b = prefix.select("doc_id", "term", F.col("idx").alias("j"), F.col("w").alias("wj"), F.col("rest").alias("rj"))
    bound = F.col("wi") * F.col("wj") + F.sqrt(F.col("ri") * F.col("rj"))
    met = a.join(b, ["doc_id", "term"]).where((F.col("i") < F.col("j")) & (bound >= least - spare)).select("doc_id", "i", "j").distinct()
    whole = vectors.groupBy("doc_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("ws"))
    one = met.join(whole.select("doc_id", F.col("idx").alias("i"), F.col("ws").alias("mi")), ["doc_id", "i"])
    two = one.join(whole.select("doc_id", F.col("idx").alias("j"), F.col("ws").alias("mj")), ["doc_id", "j"])
    both = F.array_sort(F.array_intersect(F.map_keys("mi"), F.map_keys("mj")))
    weight = F.aggregate(both, F.lit(0.0), lambda s, t: s + F.element_at("mi", t) * F.element_at("mj", t))
    return two.select("doc_id", "i", "j", weight.alias("weight")).where(F.col("weight") >= least if least > 0 else F.col("weight") > 0)


def page_rank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-6, per_node: bool = True, share_dangling: bool = True, before_last: bool = False,
    graph: str = "doc_id", node: str = "idx",
) -> DataFrame:
    """(graph, node, score) of weighted undirected graphs, many at once.

    nodes is (graph, node), edges (graph, i, j, weight), each pair once. A graph stops when its scores change by less than
    the tolerance in sum (times its nodes with per_node), others go on; with before_last it keeps the scores before that last
    step. Nodes without edges give their score to all nodes alike with share_dangling, else to none. Each step is a join of
    the edges with the scores and one sum for each node; no graph is ever in one task.
    """
    g = F.col(graph).alias("g")
    both = cut(edges.select(g, F.col("i").alias("a"), F.col("j").alias("b"), "weight").unionByName(edges.select(g, F.col("j").alias("a"), F.col("i").alias("b"), "weight")))
    degree = both.groupBy("g", F.col("a").alias("v")).agg(F.sum("weight").alias("degree"))
    own = nodes.select(g, F.col(node).alias("v")).distinct()
    sizes = own.groupBy("g").agg(F.count("*").alias("n"))
    state = cut(own.join(degree, ["g", "v"], "left").join(sizes, "g").select("g", "v", "degree", "n", (1 / F.col("n")).alias("rank"), F.lit(False).alias("done")))

    def step(now: DataFrame) -> DataFrame:
        gives = now.where("degree is not null and not done").select("g", F.col("v").alias("a"), (F.col("rank") / F.col("degree")).alias("out"))
        got = both.join(gives, ["g", "a"]).groupBy("g", F.col("b").alias("v")).agg(F.sum(F.col("out") * F.col("weight")).alias("got"))
        new = now.join(got, ["g", "v"], "left")
        spread: Column = F.lit(0.0)
        if share_dangling:
            loose = now.groupBy("g").agg(F.sum(F.when(F.col("degree").isNull(), F.col("rank")).otherwise(0.0)).alias("loose"))
            new = new.join(loose, "g")
            spread = F.col("loose") / F.col("n")
        value = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + spread)
        new = new.select("g", "v", "degree", "n", "rank", "done", F.when(F.col("done"), F.col("rank")).otherwise(value).alias("new"))
        change = new.groupBy("g").agg(F.sum(F.abs(F.col("new") - F.col("rank"))).alias("change"))
        ended = F.col("done") | (F.col("change") < tolerance * (F.col("n") if per_node else 1))
        score = F.when(ended, F.col("rank")).otherwise(F.col("new")) if before_last else F.col("new")
        return new.join(change, "g").select("g", "v", "degree", "n", score.alias("rank"), ended.alias("done"))

    for _ in range(rounds):
        state = cut(step(state))
        if state.where("not done").isEmpty():
            break
    return state.select(F.col("g").alias(graph), F.col("v").alias(node), F.col("rank").alias("score"))


def text_rank(sentences: DataFrame, least: float = 0.1, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """(doc_id, idx, score): centrality of sentences over cosines of at least `least`, as power_rank has it for one document."""
    pairs = similar_pairs(cut(sentence_vectors(sentences)), least)
    return page_rank(sentences, pairs, damping, rounds, tolerance, per_node=False, share_dangling=False, before_last=True)


def strong_edges(nodes: DataFrame, pairs: DataFrame, share: float = 0.75, floor: float = 0.05, per_node: int = 4, least_edges: int = 50) -> DataFrame:
    """(doc_id, source, target, weight, threshold): what a drawing of each graph shows.

    The threshold is the percentile `share` over all pairs of sentences, those without a common word as 0, but `floor` at
    least; of the pairs that reach it, the max(per_node * sentences, least_edges) heaviest. pairs has all pairs above 0.
    """
    n = nodes.groupBy("doc_id").agg(F.count("*").alias("n"))
    sized = n.withColumn("place", share * (F.col("n") * (F.col("n") - 1) / 2 - 1)).where("n > 1")
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc("i"), F.desc("j"))
    ranked = pairs.join(sized, "doc_id").withColumn("down", F.row_number().over(w))
    # Places count from 0 upwards through all pairs; the heaviest pair has the last one.
    up = F.col("n") * (F.col("n") - 1) / 2 - F.col("down")
    at = lambda place: F.sum(F.when(up == place, F.col("weight")).otherwise(0.0))
    low, high = F.floor("place"), F.ceil("place")
    cuts = ranked.groupBy("doc_id", "place").agg(at(low).alias("low"), at(high).alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("place") - F.floor("place"))
    cuts = cuts.select("doc_id", F.greatest(value, F.lit(floor)).alias("threshold"))
    shown = ranked.join(cuts, "doc_id").where((F.col("weight") >= F.col("threshold")) & (F.col("down") <= F.greatest(per_node * F.col("n"), F.lit(least_edges))))
    return shown.select("doc_id", F.col("i").alias("source"), F.col("j").alias("target"), F.round("weight", 4).alias("weight"), F.round("threshold", 4).alias("threshold"))


# --- texts that fit into a task -------------------------------------------------------------------------------------


def _cosines(sentence: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """The cosines of a text's n sentences as sentence_vectors weighs them, 0 on the diagonal; a pair (sentence, code) a word."""
    kinds, code = np.unique(code, return_inverse=True)
    x = np.zeros((n, len(kinds)))
    np.add.at(x, (sentence, code), 1.0)
    x *= np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 1
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, norm, out=x, where=norm > 0)
    out = x @ x.T
    np.fill_diagonal(out, 0)
    return out


def _ranks(edges: np.ndarray, damping: float, rounds: int, tolerance: float) -> np.ndarray:
    """page_rank of one graph, as text_rank calls it."""
    n, degree = len(edges), edges.sum(axis=1)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (edges @ np.divide(rank, degree, out=np.zeros(n), where=degree > 0))
        if np.abs(new - rank).sum() < tolerance:
            break
        rank = new
    return rank


def _strong(edges: np.ndarray, share: float, floor: float, per_node: int, least_edges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(i, j, weight, threshold) of one graph, as strong_edges has them."""
    n = len(edges)
    i, j = np.triu_indices(n, 1)
    weight = edges[i, j]
    ordered = np.sort(weight)
    place = share * (len(weight) - 1)
    low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
    bar = max(low + (high - low) * (place - np.floor(place)), floor)
    own = np.flatnonzero((weight >= bar) & (weight > 0))
    own = own[np.lexsort((-j[own], -i[own], -weight[own]))][: max(per_node * n, least_edges)]
    return i[own], j[own], weight[own], bar


def _matrices(texts: DataFrame, schema: str, give: Callable[[np.ndarray], list]) -> DataFrame:
    """give(cosines) of each text, a list of columns beside its id; texts has (doc_id, words of each sentence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            for k in range(len(ids)):
                one = lists.slice(k, 1).flatten()
                sizes = pc.list_value_length(one).to_numpy(zero_copy_only=False)
                codes = one.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                columns = give(_cosines(np.repeat(np.arange(len(sizes)), sizes), codes, len(sizes)))
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(columns[0]), k))), *map(pa.array, columns)], [c.split()[0] for c in schema.split(", ")])

    return texts.mapInArrow(run, schema)


def _parted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, ss) as (doc_id, words of each sentence) of the texts that fit into a task, and (doc_id, idx, sentence) of the others."""
    sized = docs.where("doc_id is not null and size(ss) > 0").withColumn("words", F.aggregate("ss", F.lit(0), lambda n, s: n + F.size(F.split(s, " "))))
    fits = (F.size("ss") <= MATRIX_SENTENCES) & (F.col("words") <= MATRIX_WORDS)
    small = sized.where(fits).select("doc_id", F.transform("ss", lambda s: _words(s)).alias("ws"))
    return small, cut(sized.where(~fits).select("doc_id", F.posexplode("ss").alias("idx", "sentence")))


def ranks_of_texts(docs: DataFrame, least: float = 0.1, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """text_rank of docs (doc_id, ss), ss the sentences and doc_id unique: short texts where they are read, long ones by edge tables."""
    small, long = _parted(docs)

    def give(cosines: np.ndarray) -> list:
        edges = np.where(cosines >= least, cosines, 0.0) if least > 0 else cosines
        return [np.arange(len(edges), dtype=np.int32), _ranks(edges, damping, rounds, tolerance)]

    found = _matrices(small, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, idx int, score double", give)
    return found if long.isEmpty() else found.unionByName(text_rank(long, least, damping, rounds, tolerance))


def edges_of_texts(docs: DataFrame, share: float = 0.75, floor: float = 0.05, per_node: int = 4, least_edges: int = 50) -> DataFrame:
    """strong_edges of docs (doc_id, ss), ss the sentences and doc_id unique: short texts where they are read, long ones by edge tables."""
    small, long = _parted(docs)

    def give(cosines: np.ndarray) -> list:
        if len(cosines) < 2:
            return [np.zeros(0)] * 4
        i, j, weight, bar = _strong(cosines, share, floor, per_node, least_edges)
        return [i.astype(np.int32), j.astype(np.int32), weight, np.full(len(i), bar)]

    found = _matrices(small, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source int, target int, weight double, threshold double", give)
    found = found.withColumns({"weight": F.round("weight", 4), "threshold": F.round("threshold", 4)})
    if long.isEmpty():
        return found
    pairs = cut(similar_pairs(cut(sentence_vectors(long)), 0.0))
    return found.unionByName(strong_edges(long, pairs, share, floor, per_node, least_edges))
