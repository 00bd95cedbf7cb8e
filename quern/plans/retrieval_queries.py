"""Queries over a stored index, and of what retrieval does around it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.catalog import load
from quern.functions import text as T
from quern.operators import retrieval as R
from quern.operators import search as S
from quern.operators import text_index as I
from quern.operators.lineage import shared_folder
from quern.plans.registry import register
from quern.plans.search_queries import NEAR, QUESTION, SCORED

TOP = "SELECT doc_id, round(sum(score), 4) AS score FROM sc GROUP BY doc_id HAVING round(sum(score), 4) > 0 ORDER BY score DESC, doc_id LIMIT 10"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex[:12]}"


@register("bm25_indexed", f"WITH {SCORED} {TOP}")
def bm25_indexed(spark, d):
    """The index is written and read back; the search reads the buckets of the question's terms alone."""
    path = _folder(spark)
    I.index_all(load(spark, d, "documents"), path)
    return I.search_index(spark, path, QUESTION)


@register("index_merge", f"WITH {SCORED} {TOP}")
def index_merge(spark, d):
    """Three segments: English documents with their texts reversed, the other ones, and the English ones as they are, which count."""
    path, docs = _folder(spark), load(spark, d, "documents").select("doc_id", "text", "lang")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    I.write_segment(docs.where(english).withColumn("text", F.reverse("text")), path)
    I.index_all(docs, path)
    I.write_segment(docs.where(english), path)
    return I.search_index(spark, path, QUESTION)


@register("index_rebuild", f"WITH RECURSIVE good AS (SELECT doc_id FROM labels WHERE quality = 1), {SCORED.replace('FROM documents', 'FROM documents SEMI JOIN good USING (doc_id)')} {TOP}")
def index_rebuild(spark, d):
    """Documents labelled good are active versions, the others replaced ones; every document also has an older active one to be passed over."""
    docs, labels = load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "labels").select("doc_id", "quality").distinct()
    known = docs.join(labels, "doc_id")
    status = F.when(F.col("quality") == 1, "active").otherwise("replaced")
    new = known.select("doc_id", "text", F.lit(2).alias("version"), status.alias("status"))
    old = known.where("quality = 1").select("doc_id", F.reverse("text").alias("text"), F.lit(1).alias("version"), F.lit("active").alias("status"))
    path = _folder(spark)
    I.rebuild(new.unionByName(old), path)
    return I.search_index(spark, path, QUESTION)


def _lexical(spark, d):
    return S.bm25(load(spark, d, "documents"), QUESTION, 50).withColumnRenamed("doc_id", "id")


LISTS = f"l AS (SELECT doc_id AS id, round(sum(score), 4) AS l, 0.0 AS v FROM sc GROUP BY doc_id HAVING round(sum(score), 4) > 0 ORDER BY 2 DESC, 1 LIMIT 50), v AS (SELECT id, 0.0 AS l, score AS v FROM ({NEAR} ORDER BY score DESC, id LIMIT 50))"


@register(
    "retrieval_cascade",
    f"""WITH {SCORED}, {LISTS}, o AS (SELECT id, max(l) AS l, max(v) AS v FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY id),
    b AS (SELECT id, round(0.7 * l / (SELECT max(l) FROM o) + 0.3 * v / (SELECT max(v) FROM o), 6) AS score FROM o)
    SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, 'blended' AS method FROM b ORDER BY score DESC, id LIMIT 10""",
)
def retrieval_cascade(spark, d):
    """Fused search finds nothing here, so the lexical list blended with the vector list answers."""
    vectors = load(spark, d, "embeddings")
    near = lambda: S.nearest_to_row(vectors, 0, 50)
    return R.cascade(hybrid=lambda: near().limit(0), lexical=lambda: _lexical(spark, d), vector=near)


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_LIKE = "round(len(list_intersect({g}, q)) / greatest(len({g}) + len(q) - len(list_intersect({g}, q)), 1)::DOUBLE, 6)"
PROBE = "license token"


@register(
    "hybrid_rrf4_lists",
    f"""WITH q AS (SELECT {_GRAMS.format(f"'{PROBE}'")} AS q, {_GRAMS.format("'src1'")} AS t), vc AS ({NEAR} ORDER BY score DESC, id LIMIT 200), vec AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM vc),
    g AS (SELECT doc_id AS id, {_GRAMS.format("coalesce(text, '')")} AS g, {_GRAMS.format("coalesce(source, '')")} AS h, text, lang FROM documents),
    tri AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, {_LIKE.format(g="g")} AS s FROM g, q) WHERE s > 0.005 QUALIFY rank <= 200),
    tit AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, {_LIKE.format(g="h").replace("q)", "t)").replace("len(q", "len(t")} AS s FROM g, q) WHERE s > 0.15 QUALIFY rank <= 200),
    ph AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT id, max(s) AS s FROM (SELECT id, w, {_LIKE.format(g="wg")} AS s FROM (SELECT id, w, {_GRAMS.format("w")} AS wg FROM (SELECT DISTINCT id, unnest(regexp_extract_all(text, '(?:licen[a-z]+|token)')) AS w FROM g)), q) WHERE s >= 0.3 GROUP BY id) QUALIFY rank <= 200),
    u AS (SELECT id, 'vector' AS s, rank, 0.50 / (60 + rank) AS p FROM vec UNION ALL SELECT id, 'trigram', rank, 0.18 / (60 + rank) FROM tri UNION ALL SELECT id, 'title', rank, 0.22 / (60 + rank) FROM tit UNION ALL SELECT id, 'phrase', rank, 0.10 / (60 + rank) FROM ph),
    f AS (SELECT id, round(sum(p), 6) AS score, min(rank) FILTER (s = 'vector') AS vector_rank, min(rank) FILTER (s = 'trigram') AS trigram_rank, min(rank) FILTER (s = 'title') AS title_rank, min(rank) FILTER (s = 'phrase') AS phrase_rank FROM u GROUP BY id)
    SELECT f.id, round(f.score + CASE WHEN d.lang = 'en' THEN 0.005 ELSE 0.0 END, 6) AS score, vector_rank, trigram_rank, title_rank, phrase_rank FROM f JOIN documents d ON d.doc_id = f.id ORDER BY score DESC, f.id LIMIT 20""",
)
def hybrid_rrf4_lists(spark, d):
    """Vector, text trigrams, title trigrams (of the source) and phrases, each a list of 200, and 0.005 more for roots (English texts)."""
    docs = load(spark, d, "documents")
    # The best are taken before the bar, which is on the same score, so that a text is compared once and not again for the filter.
    like = lambda c, q, least: docs.select(F.col("doc_id").alias("id"), F.round(T.trigram_similarity(F.coalesce(c, F.lit("")), F.lit(q)), 6).alias("s")).orderBy(F.desc("s"), "id").limit(200).where(F.col("s") > least)
    words = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?:licen[a-z]+|token)"), F.lit(0)))).alias("w"))
    phrases = words.select("id", F.round(T.trigram_similarity("w", F.lit(PROBE)), 6).alias("s")).where("s >= 0.3").groupBy("id").agg(F.max("s").alias("s"))
    lists = [
        ("vector", 0.50, S.ranked(S.nearest_to_row(load(spark, d, "embeddings"), 0, 200), "score", "id", 200)), ("trigram", 0.18, S.ranked(like(F.col("text"), PROBE, 0.005), "s", "id", 200)),
        ("title", 0.22, S.ranked(like(F.col("source"), "src1", 0.15), "s", "id", 200)), ("phrase", 0.10, S.ranked(phrases, "s", "id", 200)),
    ]
    fused = S.fuse(lists, 1000)  # four lists of 200
    roots = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", 0.005).otherwise(0.0).alias("more"))
    return fused.join(roots, "id").withColumn("score", F.round(F.col("score") + F.col("more"), 6)).drop("more").orderBy(F.desc("score"), "id").limit(20)


@register(
    "active_first",
    "SELECT id, type, status, rank FROM (SELECT o_orderkey AS id, o_orderpriority AS type, CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'P' THEN 'replaced' ELSE 'active' END AS status, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE replace(lower(type), ' ', '_') IN ('1-urgent', '4-not_specified') ORDER BY status <> 'active', rank LIMIT 50",
)
def active_first(spark, d):
    o = load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "expired").when(F.col("o_orderstatus") == "P", "replaced").otherwise("active")
    # The rank is a price order; a result list has one already.
    rows = S.ranked(o, "o_totalprice", "o_orderkey", o.count()).join(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), status.alias("status")), "id")
    return R.active_first(rows, 50, ["1-urgent", "4-not_specified"]).select("id", "type", "status", "rank")


@register(
    "entity_filters",
    "WITH e AS (SELECT l_orderkey AS id, l_linenumber AS pos, l_returnflag AS type FROM lineitem WHERE l_returnflag IN ('R', 'A')) SELECT id, CASE arg_max(type, (pos, type)) WHEN 'R' THEN 'law' ELSE 'decree' END AS doc_type FROM e GROUP BY id",
)
def entity_filters(spark, d):
    e = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.col("l_returnflag").alias("type"))
    # Of entities at one place the one whose label is last in order counts.
    values = {"R": "law", "A": "decree"}
    return R.filters_of(e.withColumn("start", F.struct("start", "type")), values).withColumnRenamed("doc_id", "id")


WORDS = r"(?:mail[0-9]|licen[a-z]+|passw[a-z]+|token)"
HELD = rf"""ph AS (SELECT chunk_id, phrase, min(rank) AS rank FROM (SELECT doc_id AS chunk_id, unnest(m) AS phrase, generate_subscripts(m, 1) AS rank FROM (SELECT doc_id, regexp_extract_all(text, '{WORDS}') AS m FROM documents)) GROUP BY ALL),
ch AS (SELECT doc_id AS chunk_id, source AS parent_id FROM documents), pa AS (SELECT DISTINCT source AS parent_id, source AS code FROM documents),
tg AS (SELECT DISTINCT doc_id AS chunk_id, concept, confidence FROM (SELECT doc_id, 'quality' AS concept, CASE WHEN quality = 1 THEN 0.9 ELSE 0.2 END::DOUBLE AS confidence FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 0.8 ELSE 0.1 END FROM labels)),
cc AS (SELECT chunk_id, list(concept ORDER BY confidence DESC, concept) AS concepts FROM tg GROUP BY 1)"""


def _held(spark, d):
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    found = docs.select(F.col("doc_id").alias("chunk_id"), F.posexplode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("rank", "phrase"))
    phrases = found.groupBy("chunk_id", "phrase").agg(F.min("rank").alias("rank"))
    parents = docs.select(F.col("source").alias("parent_id"), F.col("source").alias("code"), F.lower("source").alias("short_code")).distinct()
    tag = lambda name, c, high, low: F.struct(F.lit(name).alias("concept"), F.when(F.col(c) == 1, high).otherwise(low).alias("confidence"))
    tags = labels.select(F.col("doc_id").alias("chunk_id"), F.explode(F.array(tag("quality", "quality", 0.9, 0.2), tag("toxic", "toxic", 0.8, 0.1))).alias("t")).select("chunk_id", "t.*").distinct()
    return phrases, docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parent_id")), parents, tags


GRAMS = "list_distinct(list_transform(range(1, length({w}) + 2), lambda i: substr('  ' || {w} || ' ', i, 3)))"


@register(
    "phrase_hits",
    f"""WITH {HELD}, s AS (SELECT DISTINCT phrase, {GRAMS.format(w="lower(phrase)")} AS g, {GRAMS.format(w="'license'")} AS q FROM ph),
    l AS (SELECT phrase, round(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q)))::DOUBLE, 6) AS sim FROM s),
    m AS (SELECT chunk_id, list(DISTINCT phrase ORDER BY phrase) AS phrases, max(sim) AS score FROM ph JOIN l USING (phrase) WHERE contains(lower(phrase), 'license') OR sim >= 0.3 GROUP BY 1)
    SELECT m.chunk_id, pa.code, m.phrases, coalesce(cc.concepts, []) AS concepts, m.score FROM m JOIN ch USING (chunk_id) JOIN pa USING (parent_id) LEFT JOIN cc ON cc.chunk_id = m.chunk_id ORDER BY m.score DESC, m.chunk_id LIMIT 200""",
)
def phrase_hits(spark, d):
    return R.phrase_hits(*_held(spark, d), "license", 200)


@register(
    "concept_hits",
    f"""WITH {HELD}, kp AS (SELECT chunk_id, list(phrase ORDER BY rank, phrase) AS phrases FROM ph GROUP BY 1), m AS (SELECT chunk_id, confidence AS score FROM tg WHERE concept = 'toxic' AND confidence >= 0.3)
    SELECT m.chunk_id, pa.code, coalesce(kp.phrases, []) AS phrases, coalesce(cc.concepts, []) AS concepts, m.score FROM m JOIN ch USING (chunk_id) JOIN pa USING (parent_id) LEFT JOIN cc ON cc.chunk_id = m.chunk_id LEFT JOIN kp ON kp.chunk_id = m.chunk_id ORDER BY m.score DESC, m.chunk_id LIMIT 200""",
)
def concept_hits(spark, d):
    return R.concept_hits(*_held(spark, d), "toxic", 200)


@register(
    "cross_references",
    """WITH h AS (SELECT o_orderkey AS id, [CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR), ' '] AS refs FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS section, o_orderpriority || ' ' || repeat(o_orderstatus, 700) AS text FROM orders),
    n AS (SELECT DISTINCT trim(unnest(refs)) AS ref FROM h), j AS (SELECT ref, c.id, text, row_number() OVER (PARTITION BY ref ORDER BY c.id) AS n FROM n JOIN c ON c.section = n.ref WHERE ref <> '')
    SELECT min(ref) AS ref, id AS chunk_id, left(any_value(text), 600) AS text FROM j WHERE n <= 2 AND id NOT IN (SELECT id FROM h) GROUP BY id""",
)
def cross_references(spark, d):
    o = load(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    hits = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("chunk_id"), F.array(key, (F.col("o_custkey") + 1).cast("string"), F.lit(" ")).alias("refs"))
    chunks = o.select(F.col("o_orderkey").alias("chunk_id"), key.alias("section"), F.concat("o_orderpriority", F.lit(" "), F.repeat("o_orderstatus", F.lit(700))).alias("text"))
    return R.cross_referenced(hits, chunks)


@register(
    "containment_join",
    """WITH s AS (SELECT DISTINCT p_brand || '_' || (1990 + p_size % 30) AS stem FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_type FROM part),
    n AS (SELECT DISTINCT p_brand || ' ' || (1990 + p_size % 25) AS name FROM part), k AS (SELECT stem, regexp_replace(lower(stem), '[\\s\\-]+', '_', 'g') AS a, nullif(regexp_extract(stem, '(\\d{4})', 1), '') AS year FROM s), m AS (SELECT name, regexp_replace(lower(name), '[\\s\\-]+', '_', 'g') AS b FROM n),
    f AS (SELECT stem, min(name) AS name FROM k, m WHERE (contains(b, a) OR contains(a, b)) AND (year IS NULL OR contains(b, year)) GROUP BY 1)
    SELECT k.stem, coalesce(f.name, replace(k.stem, '_', ' ')) AS name, year FROM k LEFT JOIN f USING (stem)""",
)
def containment_join(spark, d):
    p = load(spark, d, "part")
    dated = lambda sep, n: F.concat("p_brand", F.lit(sep), (F.lit(1990) + F.col("p_size") % n).cast("string"))
    stems = p.select(dated("_", 30).alias("stem")).union(p.select("p_brand")).union(p.select("p_type"))
    return R.by_containment(stems, p.select(dated(" ", 25).alias("name")))


@register(
    "request_lookup",
    "WITH r AS (SELECT * FROM (VALUES (1, 3, 2), (2, 5, 99999999)) v(request, c_custkey, s_suppkey)) SELECT CAST(request AS INTEGER) AS request, CAST(r.c_custkey AS BIGINT) AS c_custkey, CAST(r.s_suppkey AS BIGINT) AS s_suppkey, c_mktsegment, s_name FROM r LEFT JOIN customer USING (c_custkey) LEFT JOIN supplier USING (s_suppkey)",
)
def request_lookup(spark, d):
    requests = spark.createDataFrame([(1, 3, 2), (2, 5, 99999999)], "request int, c_custkey long, s_suppkey long")
    customers, suppliers = load(spark, d, "customer").select("c_custkey", "c_mktsegment"), load(spark, d, "supplier").select("s_suppkey", "s_name")
    return R.looked_up(requests, [(customers, "c_custkey"), (suppliers, "s_suppkey")]).select("request", "c_custkey", "s_suppkey", "c_mktsegment", "s_name")


@register(
    "cached_query_vectors",
    "SELECT c.conv_id, c.turn, len(e.embedding) AS dims FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id WHERE role = 'user'",
)
def cached_query_vectors(spark, d):
    """Vectors of questions are computed once and kept by question id; here the table of embeddings is that cache."""
    asked = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn")
    return asked.join(load(spark, d, "embeddings"), F.col("conv_id") == F.col("vec_id")).select("conv_id", "turn", F.size("embedding").cast("long").alias("dims"))


@register(
    "relabelled_gold",
    r"""WITH c AS (SELECT source AS query, doc_id AS id, lang AS question, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    s AS (SELECT query, id, (rank - 1) // 10 AS w, CASE WHEN contains(coalesce(text, ''), 'license') THEN 2 WHEN contains(coalesce(text, ''), 'the') THEN 1 ELSE 0 END AS score FROM c) SELECT query, id, CAST(w AS BIGINT) AS "window", score FROM s""",
)
def relabelled_gold(spark, d):
    """Every document of a source is a candidate, in windows of ten; the judge here is a rule."""
    w = R.Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    rows = load(spark, d, "documents").select(F.col("source").alias("query"), F.col("lang").alias("question"), F.col("doc_id").alias("id"), "text", F.row_number().over(w).alias("rank"))
    rule = lambda q, t: F.when(F.coalesce(t, F.lit("")).contains("license"), 2).when(F.coalesce(t, F.lit("")).contains("the"), 1).otherwise(0)
    return R.relabel(rows, rule)


@register("cross_reference_sections", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, 'mail(\d+)', 1))) AS refs FROM documents WHERE regexp_matches(text, 'mail\d')")
def cross_reference_sections(spark, d):
    return load(spark, d, "documents").where(F.col("text").rlike(r"mail\d")).select("doc_id", T.cross_references("text", r"mail(\d+)").alias("refs"))
