"""A question answered end to end: hits of any search, what they refer to, one context, and an answer with its sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval as R
from quern.operators.lineage import cut

NOTHING = "No documents indexed yet. Please index documents first."


def _joined(rows: DataFrame, order: str, part: Column, between: str) -> Column:
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("part"))))
    return F.array_join(F.transform(lines, lambda x: x["part"]), between)


def listed_sources(question: Column, context: Column, sources: Column) -> Column:
    """The answer without a model: the sources, one a line."""
    line = lambda s: F.concat(F.lit("- ["), s["name"], F.lit(" §"), s["section"], F.lit("]: "), s["text"])
    return F.concat(F.lit("Related passages:\n\n"), F.array_join(F.transform(sources, line), "\n\n"))


def answered(found: DataFrame, chunks: DataFrame, question: str, answer: Callable[[Column, Column, Column], Column] = listed_sources, each: int = 2, excerpt: int = 300) -> DataFrame:
    """One row (question, answer, context, sources): what a search found, put before a model or listed.

    found (chunk_id, score) are the few hits of a search, ranked by score, then chunk_id; chunks (chunk_id, name, section, refs, text) the
    corpus. The context has the hits' texts under their names, then `each` chunks of every section that a hit refers to. sources
    are the hits: (rank, chunk_id, name, section, score, text cut to `excerpt`). answer makes a text of the question, the
    context and the sources; a model is an adapter of that form. Without hits the answer says that nothing is indexed.
    Chunks are read a few times, each time for a broadcast join with few keys; texts are not shuffled.
    """
    few = found.select("chunk_id", "score").distinct()
    hits = chunks.join(F.broadcast(few), "chunk_id").select("chunk_id", "score", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("section", F.lit("")).alias("section"), "refs", F.coalesce("text", F.lit("")).alias("text"))
    label = F.when(F.col("section") == "", "").otherwise(F.concat(F.lit("§"), "section"))
    hits = cut(hits)  # a search is run once
    hits = hits.withColumns({"_at": F.struct((-F.col("score")).alias("low"), "chunk_id"), "_part": F.concat(F.lit("["), F.trim(F.concat_ws(" ", "name", label)), F.lit("]\n"), "text")})
    source = F.struct("_at", "chunk_id", "name", "section", "score", F.left("text", F.lit(excerpt)).alias("text"))
    main = hits.agg(_joined(hits, "_at", F.col("_part"), "\n\n---\n\n").alias("main"), F.array_sort(F.collect_list(source)).alias("s"))
    named = F.broadcast(R.cross_referenced(hits.select("chunk_id", "refs"), chunks, each))
    named = chunks.select("chunk_id", F.coalesce("name", F.lit("")).alias("name")).join(named, "chunk_id")
    named = named.withColumns({"_at": F.struct("ref", "chunk_id"), "_part": F.concat(F.lit("[§"), "ref", F.lit(" - "), "name", F.lit("]\n"), "text")})
    more = named.agg(_joined(named, "_at", F.col("_part"), "\n\n").alias("more"))
    out = main.crossJoin(more)  # one row by one row
    ranked = F.transform("s", lambda s, i: F.struct((i + 1).cast("long").alias("rank"), *[s[c].alias(c) for c in ("chunk_id", "name", "section", "score", "text")]))
    context = F.when(F.col("more") == "", F.col("main")).otherwise(F.concat("main", F.lit("\n\n---\n\n## Referenced Sections:\n"), "more"))
    out = out.select(F.lit(question).alias("question"), context.alias("context"), ranked.alias("sources"))
    said = F.when(F.size("sources") == 0, NOTHING).otherwise(answer(F.col("question"), F.col("context"), F.col("sources")))
    return out.select("question", said.alias("answer"), "context", "sources")
