"""What retrieval does around a stored index: cascades, filters, concepts, cross references, names and requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import search as S

# --- cascade --------------------------------------------------------------------------------------------------------

Search = Callable[[], DataFrame]


def cascade(hybrid: Search | None = None, lexical: Search | None = None, vector: Search | None = None, k: int = 10, weight: float = 0.3, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """(id, score, rank, method) of the first way that answers: fused search; else the lexical one, blended with the vector one where
    there is one; else, without a lexical one, the vector one alone. None where no way is given; empty where none finds anything.

    Each search gives (id, score). A way is passed over only when its few rows are none; keep filters what was found.
    """
    found, method = None, "none"
    if hybrid is not None:
        found, method = hybrid(), "hybrid"
    if lexical is not None and (found is None or found.isEmpty()):
        found, method = lexical(), "lexical"
        if vector is not None:
            found, method = S.blend(found, vector(), weight), "blended"
    elif lexical is None and vector is not None and (found is None or found.isEmpty()):
        found, method = vector(), "vector"
    if found is None:
        return None
    found = found if keep is None else keep(found)
    top = found.orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rank"), F.lit(method).alias("method"))  # k rows


def active_first(results: DataFrame, k: int, types: list[str] | None = None, type_col: str = "type", status: str = "status", rank: str = "rank") -> DataFrame:
    """The first k results: those in force in their order, then the expired and replaced ones in theirs; with types, only results of
    these types, compared in lower case with _ for blanks."""
    rows = results if not types else results.where(F.replace(F.lower(F.coalesce(type_col, F.lit(""))), F.lit(" "), F.lit("_")).isin(*types))
    ended = F.coalesce(F.col(status).isin("expired", "replaced"), F.lit(False))
    return rows.orderBy(ended, rank).limit(k)


def filters_of(entities: DataFrame, values: dict[str, str], at: str = "start", label: str = "type", by: str = "doc_id") -> DataFrame:
    """(by, doc_type): the filter value of the last entity of each question that stands for one; no row where none does."""
    value = F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(label))
    own = entities.where(F.col(label).isin(*values)).withColumn("value", value)
    return own.groupBy(by).agg(F.max_by("value", F.struct(at, "value")).alias("doc_type"))


# --- concepts and keyphrases ----------------------------------------------------------------------------------------


def _described(matched: DataFrame, chunks: DataFrame, parents: DataFrame, tags: DataFrame, code: str | None, concept: str | None) -> DataFrame:
    """matched (chunk_id, ...) with its chunk, its parent and its concepts, most certain first; code and concept are left out or filter."""
    concepts = tags.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("low"), "concept"))), lambda x: x["concept"]).alias("concepts"))
    rows = matched.join(chunks, "chunk_id").join(parents, "parent_id").join(concepts, "chunk_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    if code is not None:
        rows = rows.where((F.col("code") == code) | (F.col("short_code") == code))
    return rows if concept is None else rows.where(F.array_contains("concepts", concept))


def phrase_hits(phrases: DataFrame, chunks: DataFrame, parents: DataFrame, tags: DataFrame, query: str, k: int = 10, least: float = 0.3, code: str | None = None, concept: str | None = None) -> DataFrame:
    """Top k chunks with a phrase that contains the query (in any case) or is like it by trigrams: (chunk_id, code, phrases, concepts, score).

    phrases (chunk_id, phrase, rank), chunks (chunk_id, parent_id), parents (parent_id, code, short_code), tags (chunk_id,
    concept, confidence).
    """
    like = F.round(T.trigram_similarity("phrase", F.lit(query)), 6)
    hit = phrases.withColumn("like", like).where(F.contains(F.lower("phrase"), F.lit(query.lower())) | (F.col("like") >= least))
    matched = hit.groupBy("chunk_id").agg(F.array_sort(F.collect_set("phrase")).alias("phrases"), F.max("like").alias("score"))
    return _described(matched, chunks, parents, tags, code, concept).select("chunk_id", "code", "phrases", "concepts", "score").orderBy(F.desc("score"), "chunk_id").limit(k)


def concept_hits(phrases: DataFrame, chunks: DataFrame, parents: DataFrame, tags: DataFrame, concept: str, k: int = 20, least: float = 0.3, code: str | None = None) -> DataFrame:
    """Top k chunks tagged with a concept with a confidence of at least `least`, with their phrases by rank and all their concepts."""
    mine = tags.where((F.col("concept") == concept) & (F.col("confidence") >= least)).select("chunk_id", F.col("confidence").alias("score"))
    own = phrases.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
    matched = mine.join(own, "chunk_id", "left").withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    return _described(matched, chunks, parents, tags, code, None).select("chunk_id", "code", "phrases", "concepts", "score").orderBy(F.desc("score"), "chunk_id").limit(k)


# --- cross references, names, requests ------------------------------------------------------------------------------


def cross_referenced(hits: DataFrame, chunks: DataFrame, each: int = 2, most: int = 600) -> DataFrame:
    """Chunks of the sections that hits (chunk_id, refs array) name, `each` for a reference and none of the hits themselves:
    (ref, chunk_id, text), texts cut to `most` characters. hits are the few rows of a search. A chunk that several references name stands under the first."""
    named = hits.select(F.explode(F.array_distinct("refs")).alias("ref")).where(F.trim("ref") != "").select(F.trim("ref").alias("ref")).distinct()
    w = Window.partitionBy("ref").orderBy("chunk_id")
    # Chunks are chosen by their ids, then the texts of the few are read. What is broadcast is as few as the references of some hits.
    near = chunks.select("chunk_id", F.col("section").alias("ref")).join(F.broadcast(named), "ref").withColumn("n", F.row_number().over(w)).where(F.col("n") <= each)
    few = near.select("ref", "chunk_id").distinct().join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_anti")
    new = chunks.select("chunk_id", F.col("section").alias("ref"), "text").join(F.broadcast(few), ["ref", "chunk_id"])
    return new.groupBy("chunk_id").agg(F.min(F.struct("ref", F.left("text", F.lit(most)).alias("text"))).alias("b")).select("b.ref", "chunk_id", "b.text")


def name_key(c: Column | str) -> Column:
    """Lower case without accents, blanks and hyphens as _."""
    return F.regexp_replace(F.lower(T.without_accents(c)), r"[\s\-]+", "_")


def by_containment(stems: DataFrame, names: DataFrame, stem: str = "stem", name: str = "name") -> DataFrame:
    """Each stem with the first name (in order) whose key contains the stem's, or is contained in it, and has the stem's year if it has
    one: (stem, name, year); the stem itself, blanks for _, where no name fits.

    What is contained begins somewhere in the other, so both sides meet on the contained one's first characters (three at most):
    an equality join in place of one of all pairs.
    """
    s = stems.select(F.col(stem).alias("stem"), name_key(stem).alias("a"), F.nullif(F.regexp_extract(stem, r"(\d{4})", 1), F.lit("")).alias("year")).distinct()
    n = names.select(F.col(name).alias("name"), name_key(name).alias("b")).distinct()
    heads = lambda c: F.left(c, F.lit(3))
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.array(*[F.substr(c, i, F.lit(m)) for m in (1, 2, 3)]))))
    inner = s.withColumn("g", heads("a")).join(n.withColumn("g", F.explode(grams("b"))), "g").where(F.contains("b", F.col("a")))
    outer = s.withColumn("g", F.explode(grams("a"))).join(n.withColumn("g", heads("b")), "g").where(F.contains("a", F.col("b")))
    fit = inner.unionByName(outer).where(F.col("year").isNull() | F.contains("b", F.col("year")))
    best = fit.groupBy("stem").agg(F.min("name").alias("name"))
    return s.join(best, "stem", "left").select("stem", F.coalesce("name", F.replace("stem", F.lit("_"), F.lit(" "))).alias("name"), "year")


def looked_up(requests: DataFrame, tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """Requests with the row of each table that has their key; keys are unique there. Nulls where a table has none."""
    for table, key in tables:
        requests = requests.join(table, key, "left")
    return requests


def relabel(candidates: DataFrame, judge: Callable[[Column, Column], Column], width: int = 10) -> DataFrame:
    """(query, id, window, score): candidates (query, question, id, text, rank) judged in windows of `width` ranks, the higher score of an
    id that stands in several. judge makes a score of the question and the text; a model's judge is an adapter."""
    scored = candidates.select("query", "id", F.floor((F.col("rank") - 1) / width).cast("long").alias("window"), judge(F.col("question"), F.col("text")).alias("score"))
    best = F.max_by("window", F.struct("score", -F.col("window")))
    return scored.groupBy("query", "id").agg(best.alias("window"), F.max("score").alias("score"))
