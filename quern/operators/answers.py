"""Question answering without a model: understanding, context packing, extractive answers, checks and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


# --- understanding --------------------------------------------------------------------------------------------------


def normalised(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(T.col(c)), r"\s+", " "))


def variants(c: Column | str, synonyms: dict[str, list[str]], most: int = 5) -> Column:
    """The question and what its synonyms make of it, without repeats, in order, `most` at most."""
    q = normalised(c)
    made = [F.when(q.contains(word), F.replace(q, F.lit(word), F.lit(other))) for word, others in synonyms.items() for other in others]
    return F.slice(F.array_distinct(F.filter(F.array(q, *made), lambda v: v.isNotNull())), F.lit(1), F.lit(most))


def domain(c: Column | str, rules: list[tuple[str, list[str]]], default: str = "general") -> Column:
    return T.first_of(normalised(c), rules, default)


def intent(c: Column | str, labels: dict[str, list[str]], default: str) -> Column:
    """(label, confidence): most keyword hits, confidence min(0.5 + 0.1 * hits, 0.95); 0.5 without hits."""
    v = T.votes(T.tokens(c), labels, default)
    return F.struct(v["label"].alias("label"), F.round(F.least(0.5 + 0.1 * F.greatest(v["hits"], F.lit(0)), F.lit(0.95)), 2).alias("confidence"))


# --- context --------------------------------------------------------------------------------------------------------


def packed_context(ranked: DataFrame, budget: int, group: str = "query", rank: str = "rank", text: str = "text") -> DataFrame:
    """Rows of each query that fit into a token budget, best first: the first always, then until one does not fit.

    Rows after the first are first cut to budget // min(rows, 3) tokens.
    """
    w, n = Window.partitionBy(group).orderBy(rank), F.count("*").over(Window.partitionBy(group))
    words = F.split(F.trim(text), r"\s+")
    cap = F.floor(F.lit(budget) / F.least(n, F.lit(3))).cast("int")
    first = F.row_number().over(w) == 1
    rows = ranked.withColumns({"_words": words, "_cap": cap, "_first": first})
    rows = rows.withColumn("packed", F.when(F.col("_first"), F.col(text)).otherwise(F.array_join(F.slice("_words", F.lit(1), F.col("_cap")), " ")))
    rows = rows.withColumn("tokens", T.word_count("packed"))
    run = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_over", F.when((run > budget) & ~F.col("_first"), 1).otherwise(0))
    return rows.withColumn("_stop", F.max("_over").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_stop = 0").drop("_words", "_cap", "_first", "_over", "_stop")


def grouped_context(ranked: DataFrame, query: str, doc: str, rank: str, place: list[str], text: str) -> DataFrame:
    """Per query and document, documents by their first appearance, texts by place within a document."""
    parts = F.array_sort(F.collect_list(F.struct(*place, rank, text)))
    return ranked.groupBy(query, doc).agg(F.min(rank).alias("first"), F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias("context"))


def prompt(question: Column | str, context: Column | str, limit: int = 800) -> Column:
    return F.concat(F.lit("Context:\n"), T.excerpt_at_sentence(context, limit), F.lit("\n\nQuestion: "), T.col(question), F.lit("\nAnswer:"))


def prompt_parts(c: Column | str) -> Column:
    """(context, question) of a prompt."""
    part = lambda p: F.regexp_extract(T.col(c), p, 1)
    return F.struct(part(r"(?s)^Context:\n(.*)\n\nQuestion: ").alias("context"), part(r"(?s)\n\nQuestion: (.*)\nAnswer:").alias("question"))


# --- answers --------------------------------------------------------------------------------------------------------


def sentence_score(question: Column, sentence: Column) -> Column:
    """Share of the question's distinct words that a sentence has."""
    return T.overlap_share(question, sentence)


def extractive_answer(question: Column | str, context: Column | str, intro: Column | str = "According to the sources:", most: int = 5, least: int = 20) -> Column:
    """intro and the best sentences of the context, numbered: by shared words, then order; those over `least` characters."""
    q = T.tokens(question)
    scored = F.transform(T.sentences(context, least), lambda s, i: F.struct((-sentence_score(q, T.tokens(s))).alias("low"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(scored), F.lit(1), F.lit(most))
    lines = F.transform(best, lambda b, i: F.concat((i + 1).cast("string"), F.lit(". "), b["s"]))
    return F.concat(T.col(intro) if isinstance(intro, Column) else F.lit(intro), F.lit("\n"), F.array_join(lines, "\n"))


def answer_parts(c: Column | str, markers: list[str]) -> Column:
    """Sections of a structured answer by their markers, as a map from marker to text; absent ones are ''."""
    ends = "|".join(markers)
    pairs = [x for m in markers for x in (F.lit(m), F.trim(F.regexp_extract(T.col(c), rf"(?s)(?:^|\n){m}:(.*?)(?=\n(?:{ends}):|\z)", 1)))]
    return F.create_map(*pairs)


def answer_in(answer: Column, content: Column, n: int = 4) -> Column:
    """Whether any n-gram of the answer's words stands in the content."""
    return F.arrays_overlap(T.ngrams(T.tokens(answer), n), T.ngrams(T.tokens(content), n))


def unsupported(answer: Column, context: Column, cites: str, least: float = 0.15) -> Column:
    """(low_overlap, missing): whether few of the answer's words are in the context, and references that the context lacks."""
    refs = F.array_distinct(F.regexp_extract_all(answer, F.lit(cites), F.lit(0)))
    return F.struct((T.overlap_share(T.tokens(answer), T.tokens(context)) < least).alias("low_overlap"), F.filter(refs, lambda r: ~F.contains(context, r)).alias("missing"))


def confidence(intent_confidence: Column, sources: Column, parts: Column) -> Column:
    """0.2 intent + 0.3 min(sources / 10, 1) + 0.5 completeness (basis .3, analysis .3, conclusion .2, recommendation .2)."""
    has = lambda k: (F.length(F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))) > 0).cast("double")
    complete = 0.3 * has("basis") + 0.3 * has("analysis") + 0.2 * has("conclusion") + 0.2 * has("recommendation")
    return F.round(F.least(F.lit(1.0), 0.2 * intent_confidence + 0.3 * F.least(sources / 10, F.lit(1.0)) + 0.5 * complete), 3)


def cited(titles: Column, basis: Column, candidates: int = 10, most: int = 5) -> Column:
    """Titles that share a word with the legal basis: of the first `candidates`, `most` at most."""
    words = T.tokens(basis)
    return F.slice(F.filter(F.slice(titles, F.lit(1), F.lit(candidates)), lambda t: F.arrays_overlap(T.tokens(t), words)), F.lit(1), F.lit(most))


def questions_from(rows: DataFrame, templates: list[str], **columns: str) -> DataFrame:
    """Every template filled for every row; the slot {name} takes the column given for it. Repeats of a question drop."""
    made = []
    for t in templates:
        q = F.lit(t)
        for name, c in columns.items():
            q = F.replace(q, F.lit("{" + name + "}"), F.col(c).cast("string"))
        made.append(q)
    out = rows.withColumn("question", F.explode(F.array(*made)))
    return out.withColumn("_key", normalised("question")).dropDuplicates(["_key"]).drop("_key")


def rerank(ranked: DataFrame, score: str = "score", id_col: str = "id", group: str = "query", adapter=None) -> DataFrame:
    """New ranks by a pluggable scorer (DataFrame to DataFrame with the score column); without one, by the score there is."""
    rows = adapter(ranked) if adapter else ranked
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), id_col)).cast("long"))


def dedup_signature(ranked: DataFrame, group: str = "query", rank: str = "rank", text: str = "text", chars: int = 100) -> DataFrame:
    """Of rows of a query whose texts start alike, the best ranked."""
    w = Window.partitionBy(group, F.left(text, F.lit(chars))).orderBy(rank)
    return ranked.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")
