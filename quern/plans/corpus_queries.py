"""Queries of keyed law sections, JSON of several shapes, stems and corpus averages, and questions answered end to end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.catalog import load
from quern.functions import vocabularies as V
from quern.operators import dialogue as Q
from quern.operators import documents as D
from quern.operators import stemming as P
from quern.operators import text_index as I
from quern.operators.lineage import shared_folder
from quern.plans.registry import register
from quern.plans.retrieval_queries import TOP
from quern.plans.search_queries import QUESTION, SCORED
from quern.sources.files import sniffed_records

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

#: Lines of documents under made-up headers: of seven, the first is in a new article, the third and the fifth are clauses, the last two points.
_MADE = """made AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: CASE (i - 1) % 7 WHEN 0 THEN 'Điều ' || ((i - 1) // 7 + 1) || '. Title ' || i || chr(10) || s WHEN 2 THEN '1. first ' || s WHEN 4 THEN '2. second ' || s
    WHEN 5 THEN 'a) one ' || s WHEN 6 THEN 'b) two ' || s ELSE s END), chr(10)) AS text FROM documents)"""


@register(
    "keyed_sections",
    rf"""WITH {_MADE}, l0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM made)),
    l1 AS (SELECT *, regexp_matches(line, '^(?i)Điều\s+\d+') AS ah FROM l0), l2 AS (SELECT *, sum(ah::INT) OVER (PARTITION BY doc_id ORDER BY n) AS i FROM l1),
    l3 AS (SELECT *, NOT ah AND regexp_matches(line, '^\s*\d+\.\s+') AS ch FROM l2 WHERE i > 0), l4 AS (SELECT *, sum(ch::INT) OVER (PARTITION BY doc_id, i ORDER BY n) AS j, sum(ch::INT) OVER (PARTITION BY doc_id, i) AS nc FROM l3),
    l5 AS (SELECT *, CASE WHEN ch THEN regexp_extract(line, '^\s*\d+\.\s+(.*)', 1) || ' ' ELSE line END AS body, regexp_extract(line, '^(?i)Điều\s+(\d+)', 1) AS an, regexp_extract(line, '^(?i)Điều\s+\d+[.:]?\s*(.*)', 1) AS t, regexp_extract(line, '^\s*(\d+)\.', 1) AS cn FROM l4 WHERE NOT (nc > 0 AND j = 0 AND NOT ah)),
    l6 AS (SELECT *, j > 0 AND regexp_matches(body, '^\s*[a-zđ]\)\s+') AS ph FROM l5), l7 AS (SELECT *, sum(ph::INT) OVER (PARTITION BY doc_id, i, j ORDER BY n) AS k, sum(ph::INT) OVER (PARTITION BY doc_id, i, j) AS np FROM l6),
    hd AS (SELECT doc_id, i, max(an) FILTER (ah) AS article, max(t) FILTER (ah) AS title, max(nc) AS nc FROM l7 GROUP BY ALL), cl AS (SELECT doc_id, i, j, max(cn) FILTER (ch) AS clause FROM l7 GROUP BY ALL),
    s AS (SELECT doc_id, i, j, k, max(np) AS np, max(regexp_extract(body, '^\s*([a-zđ])\)', 1)) FILTER (ph) AS point, string_agg(CASE WHEN ph THEN regexp_extract(body, '^\s*[a-zđ]\)\s+(.*)', 1) || ' ' ELSE body END, chr(10) ORDER BY n) AS content FROM l7 WHERE NOT ah GROUP BY ALL),
    o AS (SELECT h.doc_id, h.i, coalesce(s.j, 0) AS j, coalesce(s.k, 0) AS k, article, CASE WHEN h.nc > 0 THEN clause ELSE '' END AS clause, coalesce(point, '') AS point, {_STRIP.format("title")} AS head, {_STRIP.format("coalesce(content, '')")} AS content
      FROM hd h LEFT JOIN s ON s.doc_id = h.doc_id AND s.i = h.i LEFT JOIN cl ON cl.doc_id = h.doc_id AND cl.i = h.i AND cl.j = s.j WHERE (h.nc = 0 OR s.j > 0) AND (coalesce(s.np, 0) = 0 OR s.k > 0))
    SELECT doc_id, [CAST(i - 1 AS INTEGER), CAST(greatest(j - 1, 0) AS INTEGER), CAST(greatest(k - 1, 0) AS INTEGER)] AS at, article, clause, point, CASE WHEN clause = '' THEN head ELSE '' END AS title, content, CASE WHEN point <> '' THEN 3 WHEN clause <> '' THEN 2 ELSE 1 END AS level,
      'dieu_' || article || CASE WHEN clause <> '' THEN '_khoan_' || clause ELSE '' END || CASE WHEN point <> '' THEN '_diem_' || point ELSE '' END AS key,
      CASE WHEN point <> '' THEN 'dieu_' || article || '_khoan_' || clause WHEN clause <> '' THEN 'dieu_' || article END AS parent_key FROM o""",
)
def keyed_sections(spark, d):
    def headed(s, i):
        at = i % 7
        article = F.concat(F.lit("Điều "), F.floor(i / 7).cast("int") + 1, F.lit(". Title "), i + 1, F.lit("\n"), s)
        mark = lambda m: F.concat(F.lit(m), s)
        return F.when(at == 0, article).when(at == 2, mark("1. first ")).when(at == 4, mark("2. second ")).when(at == 5, mark("a) one ")).when(at == 6, mark("b) two ")).otherwise(s)

    docs = load(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), headed), "\n").alias("text"))
    return D.keyed_sections(docs, V.LAW_HEADERS, V.LAW_KEYS, V.LAW_UNTITLED)


@register("json_shapes", "SELECT conv_id, turn, role, text FROM conversations WHERE turn IS NOT NULL")
def json_shapes(spark, d):
    """Conversations written as JSON of three shapes in turn, and read back as records of one schema."""
    turns = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rest = F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda x, i: F.concat(F.lit('"'), i, F.lit('": '), F.to_json(x)))
    sampled = F.concat(F.lit('{"count": '), F.size("t"), F.lit(', "sample": '), F.to_json(F.get("t", F.lit(0))), F.when(F.size(rest) > 0, F.concat(F.lit(", "), F.array_join(rest, ", "))).otherwise(""), F.lit("}"))
    nested = F.concat(F.lit('{"empty": [], "rows": '), F.to_json("t"), F.lit("}"))
    shape = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    payloads = turns.select("conv_id", F.when(shape == 0, F.to_json("t")).when(shape == 1, sampled).otherwise(nested).alias("text"))
    found = sniffed_records(payloads, {"turn": ("long", ["turn"]), "role": ("string", ["speaker", "role"]), "said": ("string", ["text"])}, "turn", "conv_id")
    return found.where("error is null").select("conv_id", "turn", "role", F.col("said").alias("text"))


_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def _leads(spark, d):
    """The first line of each document, as a summary of the whole text."""
    return load(spark, d, "documents").select("doc_id", F.split("text", "\n")[0].alias("candidate"), F.col("text").alias("reference"))


@register(
    "rouge_average",
    f"""WITH p AS (SELECT doc_id, {_WORDS.format("string_split(text, chr(10))[1]")} AS a, {_WORDS.format("text")} AS b FROM documents),
    g AS (SELECT doc_id, 1 AS n, 'a' AS side, unnest(a) AS g FROM p UNION ALL SELECT doc_id, 1, 'b', unnest(b) FROM p UNION ALL SELECT doc_id, 2, 'a', unnest(list_transform(list_zip(a[:-2], a[2:]), lambda x: x[1] || ' ' || x[2])) FROM p
      UNION ALL SELECT doc_id, 2, 'b', unnest(list_transform(list_zip(b[:-2], b[2:]), lambda x: x[1] || ' ' || x[2])) FROM p),
    c AS (SELECT doc_id, n, g, count(*) FILTER (side = 'a') AS x, count(*) FILTER (side = 'b') AS y FROM g WHERE g IS NOT NULL GROUP BY ALL), s AS (SELECT doc_id, n, sum(least(x, y)) AS both_, sum(x) AS x, sum(y) AS y FROM c GROUP BY ALL),
    f AS (SELECT doc_id, n, CASE WHEN x > 0 THEN both_ / x ELSE 0 END AS p, CASE WHEN y > 0 THEN both_ / y ELSE 0 END AS r, CASE WHEN x + y > 0 THEN 2.0 * both_ / (x + y) ELSE 0 END AS f FROM s)
    SELECT count(*) AS pairs, round(avg(coalesce(o.p, 0)), 6) AS rouge1_p, round(avg(coalesce(o.r, 0)), 6) AS rouge1_r, round(avg(coalesce(o.f, 0)), 6) AS rouge1_f, round(avg(coalesce(t.f, 0)), 6) AS rouge2_f
    FROM p LEFT JOIN f o ON o.doc_id = p.doc_id AND o.n = 1 LEFT JOIN f t ON t.doc_id = p.doc_id AND t.n = 2""",
)
def rouge_average(spark, d):
    return P.rouge_average(P.rouge(_leads(spark, d), ["doc_id"], stemmed=False)).drop("rouge_l_f")


@register("rouge_stemmed")
def rouge_stemmed(spark, d):
    found = P.rouge(_leads(spark, d), ["doc_id"])
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "doc_id"])


@register("rouge_stemmed_average")
def rouge_stemmed_average(spark, d):
    return P.rouge_average(P.rouge(_leads(spark, d), ["doc_id"]))


@register(
    "question_answered",
    f"""WITH {SCORED}, top AS ({TOP.replace("LIMIT 10", "LIMIT 5")}),
    ch AS (SELECT doc_id AS id, source AS name, CAST(doc_id % 50 AS VARCHAR) AS section, [CAST(n_chars % 50 AS VARCHAR), CAST((n_chars + 7) % 50 AS VARCHAR)] AS refs, text FROM documents),
    h AS (SELECT ch.*, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ch JOIN top ON doc_id = id), n AS (SELECT DISTINCT unnest(refs) AS ref FROM h),
    x AS (SELECT ref, ch.id, ch.name, ch.text, row_number() OVER (PARTITION BY ref ORDER BY ch.id) AS k FROM n JOIN ch ON section = ref),
    y AS (SELECT id, min(ref) AS ref, any_value(name) AS name, left(any_value(text), 600) AS text FROM x WHERE k <= 2 AND id NOT IN (SELECT id FROM h) GROUP BY id),
    m AS (SELECT string_agg('[' || name || ' §' || section || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS main, string_agg('- [' || name || ' §' || section || ']: ' || left(text, 300), chr(10) || chr(10) ORDER BY rank) AS listed, list(id ORDER BY rank) AS source_ids FROM h),
    r AS (SELECT string_agg('[§' || ref || ' - ' || name || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY ref, id) AS more FROM y)
    SELECT '{QUESTION}' AS question, 'Related passages:' || chr(10) || chr(10) || listed AS answer, main || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Referenced Sections:' || chr(10) || more, '') AS context, source_ids FROM m, r""",
)
def question_answered(spark, d):
    """Documents are indexed, searched, followed along references between made-up sections, and put into one context."""
    docs, path = load(spark, d, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex[:12]}"
    I.index_all(docs, path)
    section = lambda c: (c % 50).cast("string")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("name"), section(F.col("doc_id")).alias("section"), F.array(section(F.col("n_chars")), section(F.col("n_chars") + 7)).alias("refs"), "text")
    found = I.search_index(spark, path, QUESTION, 5).withColumnRenamed("doc_id", "chunk_id")
    return Q.answered(found, chunks, QUESTION).select("question", "answer", "context", F.transform("sources", lambda s: s["chunk_id"]).alias("source_ids"))
