"""Lexical, fuzzy and vector search over tables of postings: built once, joined with the terms of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.matching import quoted
from quern.operators.lineage import cut

K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional inverted index: (term, doc_id, tf, positions), positions ascending from 0."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.tokens(text_col)).alias("pos", "term"))
    return words.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions")).withColumn("tf", F.size("positions").cast("long"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf); with terms, only theirs, filtered before anything is shuffled."""
    found = T.tokens(text_col)
    if terms is not None:
        found = F.filter(found, lambda t: t.isin(*sorted(set(terms))))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(found).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, freq, doc_freq)."""
    return term_counts(docs, id_col, text_col).groupBy("term").agg(F.sum("tf").alias("freq"), F.count("*").alias("doc_freq"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents, vocabulary size, average length in tokens."""
    sizes = docs.agg(F.count(id_col).alias("documents"), F.avg(F.size(T.tokens(text_col))).alias("avg_length"))
    return sizes.crossJoin(vocabulary(docs, id_col, text_col).agg(F.count("*").alias("terms")))  # one row by one row


def question_terms(spark: SparkSession, question: str) -> DataFrame:
    """(term, times) of a question: a repeated word counts as often as it stands there."""
    return spark.createDataFrame([(question,)], "q string").select(F.explode(T.tokens("q")).alias("term")).groupBy("term").agg(F.count("*").alias("times"))


def asked_terms(spark: SparkSession, question: str) -> list[str]:
    """The question's words, as the plan's own tokens see them: as few as the question has."""
    return sorted(r["term"] for r in question_terms(spark, question).collect())


def weighted(hits: DataFrame, stats: DataFrame, asked: DataFrame) -> DataFrame:
    """BM25 parts of (term, doc_id, len, tf) rows, with (n, avg_len) in one row and (term, times) of a question."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest("avg_len", F.lit(1.0)))
    return (
        hits.join(F.broadcast(asked.join(df, "term").crossJoin(stats)), "term")  # as many rows as the question has terms
        .withColumn("idf", idf)
        .withColumn("score", F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / norm)
    )


def _scored(docs: DataFrame, question: str, id_col: str, text_col: str) -> DataFrame:
    """(term, times, doc_id, len, tf, idf, score): texts are read and split once, into a checkpointed table of each document's length
    and the question's words in it; all else reads that narrow table. An index (quern.operators.retrieval) saves that pass."""
    spark = docs.sparkSession
    terms = asked_terms(spark, question)
    found = docs.select(F.col(id_col).alias("doc_id"), T.tokens(text_col).alias("ts"))
    own = F.filter("ts", lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    base = cut(found.select("doc_id", F.size("ts").alias("len"), own.alias("own")))
    hits = base.select("doc_id", "len", F.explode("own").alias("term")).groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    return weighted(hits, base.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")), question_terms(spark, question))


def bm25(docs: DataFrame, question: str, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Top k by BM25 (doc_id, score); only scores above 0, ties by id."""
    ranked = _scored(docs, question, id_col, text_col).groupBy("doc_id").agg(F.round(F.sum("score"), 4).alias("score"))
    return ranked.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def bm25_explain(docs: DataFrame, question: str, doc: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per term of the question: tf in the document, idf and its part of the score; 0 where the document lacks it."""
    asked = question_terms(docs.sparkSession, question)
    own = _scored(docs, question, id_col, text_col).where(F.col("doc_id") == doc)
    return asked.select("term").join(own, "term", "left").select(
        "term", F.coalesce("tf", F.lit(0)).cast("long").alias("tf"), F.round(F.coalesce("idf", F.lit(0.0)), 6).alias("idf"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score")
    )


def boolean(docs: DataFrame, every: list[str] = (), some: list[str] = (), none: list[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of documents with all of `every`, one at least of `some` (if given) and nothing of `none`. One pass, no shuffle."""
    has = lambda ws: F.array(*[F.lit(w.lower()) for w in ws])
    rule = F.lit(True)
    if every:
        rule &= F.size(F.array_except(has(every), F.col("ts"))) == 0
    if some:
        rule &= F.arrays_overlap("ts", has(some))
    if none:
        rule &= ~F.arrays_overlap("ts", has(none))
    return docs.select(F.col(id_col).alias("doc_id"), T.tokens(text_col).alias("ts")).where(rule).select("doc_id")


def phrase(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, matches): documents where the words stand in a row, and how often (positions that fit from the first word on)."""
    joined = F.concat(F.lit("| "), F.array_join(T.tokens(text_col), " "), F.lit(" "))
    parts = F.split(joined, "(?= " + " ".join(quoted(w.lower()) for w in words) + " )", -1)  # cuts before every match, overlapping ones too
    return docs.select(F.col(id_col).alias("doc_id"), (F.size(parts) - 1).cast("long").alias("matches")).where("matches > 0")


def phrase_of_postings(index: DataFrame, words: list[str]) -> DataFrame:
    """The same from an index of postings: each word votes for the start of the phrase it would belong to."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(w.lower(), i) for i, w in enumerate(words)], "term string, at int")
    each = index.join(F.broadcast(wanted), "term").select("doc_id", "at", F.explode("positions").alias("pos"))
    votes = each.select("doc_id", "at", (F.col("pos") - F.col("at")).alias("start"))
    return votes.groupBy("doc_id", "start").agg(F.countDistinct("at").alias("n")).where(F.col("n") == len(words)).groupBy("doc_id").agg(F.count("*").alias("matches"))


def autocomplete(vocab: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    return vocab.where(F.col("term").startswith(prefix.lower())).orderBy(F.desc("freq"), "term").limit(k)


def fuzzy(vocab: DataFrame, words: list[str], distance: int = 2, k: int = 5) -> DataFrame:
    """Per word its k nearest terms within an edit distance: (word, term, distance, freq), nearest and most frequent first.

    The words ride along as literals; terms are first cut by length, so no pair beyond the band is measured.
    """
    near = vocab.select("term", "freq", F.explode(F.array(*[F.lit(w.lower()) for w in sorted(set(words))])).alias("word")).where(F.abs(F.length("term") - F.length("word")) <= distance)
    near = near.withColumn("distance", F.levenshtein("word", "term", distance).cast("long")).where("distance >= 0")
    w = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "term")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("word", "term", "distance", "freq", "rank")


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays in double precision; 0 where one has no length."""
    x, y = F.transform(T.col(a), lambda v: v.cast("double")), F.transform(T.col(b), lambda v: v.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    return F.when(norms > 0, total(F.zip_with(x, y, lambda p, q: p * q)) / norms).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """Top k by cosine (id, score, rank), filtered before ranking; the vector rides along as a literal."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(v)) for v in query])
    top = rows.select(F.col(id_col).alias("id"), F.round(cosine(vector_col, q), 4).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))  # k rows


def nearest_to_row(vectors: DataFrame, row_id: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Top k nearest to one row of the table, itself left out. The row joins by broadcast: it is one row."""
    query = vectors.where(F.col(id_col) == row_id).select(F.col(vector_col).alias("_q")).limit(1)
    rows = vectors.where(F.col(id_col) != row_id).crossJoin(F.broadcast(query))
    return rows.select(F.col(id_col).alias("id"), F.round(cosine(vector_col, "_q"), 4).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn_join(left: DataFrame, right: DataFrame, k: int = 2, least: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1024) -> DataFrame:
    """Per row of left its k nearest rows of right with cosine of at least `least`: (left_id, right_id, score, rank).

    Both sides are dealt into blocks of about `block` rows, and a task compares one block of each, so it holds two blocks
    whatever the tables' sizes. A task keeps k candidates for a left row; what is merged is k rows for each row and block.
    """
    import numpy as np
    import pandas as pd

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    parts = [max(1, -(-side.count() // block)) for side in (left, right)]
    own = lambda side, n: side.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias("own")).where("v is not null")
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asks = own(left, parts[0]).select("id", "v", F.col("own").alias("a"), other(parts[1]).alias("b"))
    side = own(right, parts[1]).select("id", "v", other(parts[0]).alias("a"), F.col("own").alias("b"))

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("id")
            ids = b["id"].to_numpy()
            s = np.round(unit(np.array(a["v"].tolist(), float)) @ unit(np.array(b["v"].tolist(), float)).T, 6)
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for r, mine in enumerate(best):
                out += [(a["id"].iloc[r], ids[j], s[r, j]) for j in mine if s[r, j] >= least]
        return pd.DataFrame(out, columns=["left_id", "right_id", "score"])

    found = asks.groupBy("a", "b").cogroup(side.groupBy("a", "b")).applyInPandas(run, "left_id long, right_id long, score double")
    w = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def ranked(df: DataFrame, score: str, id_col: str, pool: int) -> DataFrame:
    """(id, rank) of the top `pool` by score; the pool is cut first, so that numbering sees `pool` rows."""
    top = df.orderBy(F.desc(score), id_col).limit(pool)
    return top.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(F.desc(score), id_col)).cast("long").alias("rank"))


def fuse(lists: list[tuple[str, float, DataFrame]], k: int, digits: int = 6, constant: int = RRF) -> DataFrame:
    """Weighted reciprocal-rank fusion of (name, weight, (id, rank from 1)) lists: id, score and the rank in every list.

    A union and one aggregation take the place of a chain of full outer joins.
    """
    union = None
    for name, weight, ranks in lists:
        part = ranks.select("id", F.lit(name).alias("source"), "rank", (F.lit(weight) / (F.lit(constant) + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    per = [F.min(F.when(F.col("source") == name, F.col("rank"))).alias(f"{name}_rank") for name, _, _ in lists]
    return union.groupBy("id").agg(F.round(F.sum("part"), digits).alias("score"), *per).orderBy(F.desc("score"), "id").limit(k)


def best_ranks(ranks: DataFrame) -> DataFrame:
    """Over several question variants (variant, id, rank): each id's best rank, the earliest variant of equals."""
    return ranks.groupBy("id").agg(F.min(F.struct("rank", "variant")).alias("b")).select("id", "b.rank", "b.variant")


def keep_best(lists: list[DataFrame], id_col: str = "id", score: str = "score") -> DataFrame:
    """Union of result lists, the higher score of each id."""
    union = lists[0]
    for more in lists[1:]:
        union = union.unionByName(more)
    return union.groupBy(id_col).agg(F.max(score).alias(score))


def blend(lexical: DataFrame, vector: DataFrame, weight: float = 0.3) -> DataFrame:
    """(1 - weight) * lexical / its maximum + weight * vector / its maximum, absent scores 0: (id, score)."""
    both = lexical.select("id", F.col("score").alias("l"), F.lit(0.0).alias("v")).unionByName(vector.select("id", F.lit(0.0).alias("l"), F.col("score").alias("v")))
    one = both.groupBy("id").agg(F.max("l").alias("l"), F.max("v").alias("v"))
    tops = one.agg(F.max("l").alias("ml"), F.max("v").alias("mv"))
    return one.crossJoin(F.broadcast(tops)).select(  # one row
        "id", F.round((1 - weight) * F.coalesce(F.try_divide("l", "ml"), F.lit(0.0)) + weight * F.coalesce(F.try_divide("v", "mv"), F.lit(0.0)), 6).alias("score")
    )


def trigram_search(docs: DataFrame, question: str, least: float = 0.15, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Top k by trigram similarity above `least`."""
    rows = docs.select(F.col(id_col).alias("id"), F.round(T.trigram_similarity(text_col, F.lit(question)), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(k).where(F.col("score") > least)
