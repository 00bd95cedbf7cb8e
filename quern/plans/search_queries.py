"""Queries of lexical, fuzzy and vector search over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import load
from quern.functions import matching as M
from quern.functions import text as T
from quern.operators import search as S
from quern.plans.registry import register

QUESTION = "the and of reanat the license"
PHRASE = ["of", "the"]
PROBE = "thation onerst"

TOK = r"""tok AS (
  SELECT doc_id, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos, len(ts) AS n FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '') AS ts FROM documents))"""
LEN = r"""len_ AS (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '')) AS n FROM documents)"""
VOCAB = "vocab AS (SELECT term, CAST(count(*) AS BIGINT) AS freq, CAST(count(DISTINCT doc_id) AS BIGINT) AS doc_freq FROM tok GROUP BY term)"
ASKED = "asked AS (SELECT unnest(['the', 'and', 'of', 'reanat', 'license']) AS term, unnest([2, 1, 1, 1, 1]) AS times)"
SCORED = f"""{TOK}, {LEN}, {ASKED},
hit AS (SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
st AS (SELECT count(*) AS n, avg(n) AS avg_len FROM len_),
sc AS (SELECT h.term, h.doc_id, h.tf, ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) AS idf,
         times * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * h.tf * 2.5 / (h.tf + 1.5 * (1 - 0.75 + 0.75 * l.n / greatest(st.avg_len, 1.0))) AS score
       FROM hit h JOIN asked USING (term) JOIN df USING (term) JOIN len_ l USING (doc_id), st)"""


@register("bm25_topk", f"WITH {SCORED} SELECT doc_id, round(sum(score), 4) AS score FROM sc GROUP BY doc_id HAVING round(sum(score), 4) > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return S.bm25(load(spark, d, "documents"), QUESTION, 10)


@register("bm25_explain", f"WITH {SCORED} SELECT a.term, CAST(coalesce(tf, 0) AS BIGINT) AS tf, round(coalesce(idf, 0.0), 6) AS idf, round(coalesce(score, 0.0), 6) AS score FROM asked a LEFT JOIN (SELECT * FROM sc WHERE doc_id = 1) s USING (term)")
def bm25_explain(spark, d):
    return S.bm25_explain(load(spark, d, "documents"), QUESTION, 1)


@register("postings_index", f"WITH {TOK} SELECT term, doc_id, CAST(count(*) AS BIGINT) AS tf, list(CAST(pos AS INTEGER) ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id")
def postings_index(spark, d):
    return S.postings(load(spark, d, "documents"))


@register("vocabulary_stats", f"WITH {TOK}, {VOCAB} SELECT * FROM vocab")
def vocabulary_stats(spark, d):
    return S.vocabulary(load(spark, d, "documents"))


@register("corpus_stats", f"WITH {TOK}, {LEN} SELECT (SELECT count(*) FROM len_) AS documents, round((SELECT avg(n) FROM len_), 6) AS avg_length, (SELECT count(DISTINCT term) FROM tok) AS terms")
def corpus_stats(spark, d):
    return S.corpus_stats(load(spark, d, "documents")).withColumn("avg_length", F.round("avg_length", 6))


@register("boolean_and", f"WITH {TOK} SELECT doc_id FROM tok WHERE term IN ('the', 'license') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def boolean_and(spark, d):
    return S.boolean(load(spark, d, "documents"), every=["the", "license"])


@register("boolean_or", f"WITH {TOK} SELECT DISTINCT doc_id FROM tok WHERE term IN ('license', 'password')")
def boolean_or(spark, d):
    return S.boolean(load(spark, d, "documents"), some=["license", "password"])


@register("boolean_not", f"WITH {TOK} SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM tok WHERE term IN ('the', 'de')")
def boolean_not(spark, d):
    return S.boolean(load(spark, d, "documents"), none=["the", "de"])


PHRASE_SQL = f"WITH {TOK} SELECT a.doc_id, CAST(count(*) AS BIGINT) AS matches FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.doc_id"


@register("phrase_search", PHRASE_SQL)
def phrase_search(spark, d):
    return S.phrase(load(spark, d, "documents"), PHRASE)


@register("phrase_from_postings", PHRASE_SQL)
def phrase_from_postings(spark, d):
    return S.phrase_of_postings(S.postings(load(spark, d, "documents")), PHRASE)


@register("autocomplete", f"WITH {TOK}, {VOCAB} SELECT * FROM vocab WHERE starts_with(term, 'tha') ORDER BY freq DESC, term LIMIT 10")
def autocomplete(spark, d):
    return S.autocomplete(S.vocabulary(load(spark, d, "documents")), "tha", 10)


@register("vocabulary_lookup", f"WITH {TOK}, {VOCAB} SELECT * FROM vocab WHERE term = 'license'")
def vocabulary_lookup(spark, d):
    return S.vocabulary(load(spark, d, "documents")).where(F.col("term") == "license")


@register(
    "fuzzy_terms",
    f"""WITH {TOK}, {VOCAB}, q AS (SELECT unnest(['licens', 'thaton']) AS word), p AS (SELECT *, regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g') AS plain FROM vocab),
    m AS (SELECT word, term, CAST(levenshtein(word, plain) AS BIGINT) AS distance, freq FROM p, q WHERE abs(length(word) - length(term)) <= 2 AND levenshtein(word, plain) <= 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, term) AS rank FROM m) WHERE rank <= 5""",
)
def fuzzy_terms(spark, d):
    """The whole vocabulary; the twin counts bytes, so it measures with one byte for each letter that no word asked for has."""
    return S.fuzzy(S.vocabulary(load(spark, d, "documents")), ["licens", "thaton"], 2, 5)


TRI = r"""tri AS (SELECT item_id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''),
   lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM benchmark),
qry AS (SELECT list_distinct(flatten(list_transform(['thation', 'onerst'], lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS q)"""


@register(
    "trigram_similarity",
    f"WITH {TRI}, s AS (SELECT item_id AS id, round(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q)))::DOUBLE, 6) AS score FROM tri, qry) SELECT * FROM s WHERE score > 0.02 ORDER BY score DESC, id LIMIT 10",
)
def trigram_similarity(spark, d):
    return S.trigram_search(load(spark, d, "benchmark"), PROBE, 0.02, 10, "item_id", "text")


@register("accent_insensitive_search", "SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'eauetre')")
def accent_insensitive_search(spark, d):
    return load(spark, d, "documents").where(F.lower(T.without_accents("text")).contains("eauetre")).select("doc_id")


@register("full_text_match", f"WITH {TOK} SELECT doc_id FROM tok WHERE term IN ('of', 'the', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 3")
def full_text_match(spark, d):
    return S.boolean(load(spark, d, "documents"), every=["of", "the", "and"])


COS = "list_cosine_similarity(CAST({a}.embedding AS DOUBLE[]), CAST({b}.embedding AS DOUBLE[]))"
NEAR = f"SELECT e.vec_id AS id, round({COS.format(a='e', b='q')}, 4) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0"


@register("vector_topk", f"{NEAR} ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, d):
    return S.nearest_to_row(load(spark, d, "embeddings"), 0, 10)


@register("vector_filter", f"{NEAR} AND e.label IN (1, 2) ORDER BY score DESC, id LIMIT 10")
def vector_filter(spark, d):
    v = load(spark, d, "embeddings")
    return S.nearest_to_row(v.where(F.col("label").isin(1, 2) | (F.col("vec_id") == 0)), 0, 10)


@register(
    "knn_join",
    f"""WITH s AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({COS.format(a="a", b="b")}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rank FROM s WHERE score >= 0.5) WHERE rank <= 2""",
)
def knn_join(spark, d):
    v = load(spark, d, "embeddings")
    return S.knn_join(v.where(F.col("vec_id") % 20 == 0), v, 2, 0.5)  # the stated query set of a search: ids divisible by 20, against all rows


LEX = f"lx AS (SELECT doc_id AS id, round(sum(score), 4) AS score FROM sc GROUP BY doc_id HAVING round(sum(score), 4) > 0 ORDER BY 2 DESC, 1 LIMIT 50), lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lx)"
VEC = f"vc AS ({NEAR} ORDER BY score DESC, id LIMIT 50), vec AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vc)"


def _two(spark, d):
    lexical = S.bm25(load(spark, d, "documents"), QUESTION, 50).withColumnRenamed("doc_id", "id")
    return S.ranked(lexical, "score", "id", 50), S.ranked(S.nearest_to_row(load(spark, d, "embeddings"), 0, 50), "score", "id", 50)


@register(
    "hybrid_rrf2",
    f"""WITH {SCORED}, {LEX}, {VEC}, u AS (SELECT id, 'lexical' AS s, rank FROM lex UNION ALL SELECT id, 'vector' AS s, rank FROM vec)
    SELECT id, round(sum(0.5 / (60 + rank)), 6) AS score, min(rank) FILTER (s = 'lexical') AS lexical_rank, min(rank) FILTER (s = 'vector') AS vector_rank FROM u GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
def hybrid_rrf2(spark, d):
    lexical, vector = _two(spark, d)
    return S.fuse([("lexical", 0.5, lexical), ("vector", 0.5, vector)], 20)


@register(
    "hybrid_rrf4",
    f"""WITH {SCORED}, {LEX}, {VEC},
    ln_ AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)),
    src AS (SELECT doc_id AS id, row_number() OVER (ORDER BY c DESC, doc_id) AS rank FROM (SELECT d.doc_id, c FROM documents d JOIN (SELECT source, count(*) AS c FROM documents GROUP BY source) USING (source) ORDER BY c DESC, d.doc_id LIMIT 50)),
    u AS (SELECT id, 'vector' AS s, rank, 0.50 / (60 + rank) AS p FROM vec UNION ALL SELECT id, 'lexical', rank, 0.18 / (60 + rank) FROM lex
          UNION ALL SELECT id, 'long', rank, 0.22 / (60 + rank) FROM ln_ UNION ALL SELECT id, 'source', rank, 0.10 / (60 + rank) FROM src)
    SELECT id, round(sum(p), 6) AS score, min(rank) FILTER (s = 'vector') AS vector_rank, min(rank) FILTER (s = 'lexical') AS lexical_rank,
           min(rank) FILTER (s = 'long') AS long_rank, min(rank) FILTER (s = 'source') AS source_rank FROM u GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
def hybrid_rrf4(spark, d):
    lexical, vector = _two(spark, d)
    docs = load(spark, d, "documents")
    counts = docs.groupBy("source").agg(F.count("*").alias("c"))
    by_source = docs.select("doc_id", "source").join(counts, "source")
    return S.fuse(
        [("vector", 0.50, vector), ("lexical", 0.18, lexical), ("long", 0.22, S.ranked(docs, "n_chars", "doc_id", 50)), ("source", 0.10, S.ranked(by_source, "c", "doc_id", 50))], 20
    )


@register("keep_best_score", f"WITH {SCORED}, l AS (SELECT doc_id AS id, round(sum(score), 4) AS score FROM sc GROUP BY doc_id HAVING round(sum(score), 4) > 0 ORDER BY 2 DESC, 1 LIMIT 50), v AS ({NEAR} ORDER BY score DESC, id LIMIT 50) SELECT id, max(score) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY id")
def keep_best_score(spark, d):
    return S.keep_best([S.bm25(load(spark, d, "documents"), QUESTION, 50).withColumnRenamed("doc_id", "id"), S.nearest_to_row(load(spark, d, "embeddings"), 0, 50)])


@register(
    "blended_scores",
    f"""WITH {SCORED}, l AS (SELECT doc_id AS id, round(sum(score), 4) AS l, 0.0 AS v FROM sc GROUP BY doc_id HAVING round(sum(score), 4) > 0 ORDER BY 2 DESC, 1 LIMIT 50),
    v AS (SELECT id, 0.0 AS l, score AS v FROM ({NEAR} ORDER BY score DESC, id LIMIT 50)), o AS (SELECT id, max(l) AS l, max(v) AS v FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY id)
    SELECT id, round(0.7 * l / (SELECT max(l) FROM o) + 0.3 * v / (SELECT max(v) FROM o), 6) AS score FROM o""",
)
def blended_scores(spark, d):
    return S.blend(S.bm25(load(spark, d, "documents"), QUESTION, 50).withColumnRenamed("doc_id", "id"), S.nearest_to_row(load(spark, d, "embeddings"), 0, 50))


@register(
    "best_rank_per_id",
    f"""WITH {TOK}, a AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN ('the', 'license') GROUP BY ALL),
    r AS (SELECT CASE term WHEN 'the' THEN 0 ELSE 1 END AS variant, doc_id AS id, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_id) AS rank FROM a)
    SELECT id, CAST(min(rank) AS BIGINT) AS rank, CAST(arg_min(variant, rank * 10 + variant) AS INTEGER) AS variant FROM r WHERE rank <= 50 GROUP BY id""",
)
def best_rank_per_id(spark, d):
    counts = S.term_counts(load(spark, d, "documents"), terms=["the", "license"])
    both = None
    for i, term in enumerate(("the", "license")):
        part = S.ranked(counts.where(F.col("term") == term), "tf", "doc_id", 50).withColumn("variant", F.lit(i))
        both = part if both is None else both.unionByName(part)
    return S.best_ranks(both)


@register(
    "match_positions",
    "SELECT doc_id, CAST(len(p) AS BIGINT) AS matches, p AS positions FROM (SELECT doc_id, list_transform(list_filter(range(0, length(text) - 3), lambda i: substr(text, i + 1, 4) = 'that'), lambda i: CAST(i AS INTEGER)) AS p FROM documents WHERE contains(text, 'that')) WHERE len(p) > 0",
)
def match_positions(spark, d):
    rows = load(spark, d, "documents").where(F.col("text").contains("that")).select("doc_id", M.positions("text", "that").alias("positions"))
    return rows.select("doc_id", F.size("positions").cast("long").alias("matches"), "positions")


@register("match_highlight", "SELECT doc_id, regexp_replace(text, '(that(?:hat)*)', '**\\1**', 'g') AS text FROM documents WHERE contains(text, 'that')")
def match_highlight(spark, d):
    return load(spark, d, "documents").where(F.col("text").contains("that")).select("doc_id", M.highlight("text", "that").alias("text"))


@register("match_comparisons")
def match_comparisons(spark, d):
    return M.compare_matchers(load(spark, d, "documents"), "doc_id", "text", "ther", True)
