"""Queries over notices written from orders: a head with number, body and dates in words, and typed references in the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import load
from quern.functions import vocabularies as V
from quern.operators import documents as D
from quern.plans.registry import register


def _notices(spark, d):
    """A text for each order. Days run to 33, so some dates do not exist; every third notice never ends; bodies take turns."""
    day = lambda more: F.concat(F.lit("ngày "), F.day("o_orderdate") + more, F.lit(" tháng "), F.month("o_orderdate"), F.lit(" năm "), F.year("o_orderdate") + more)
    body = F.element_at(F.array(F.lit("BỘ Y TẾ"), F.lit("Chính phủ"), F.lit("bưu điện")), (F.col("o_custkey") % 3 + 1).cast("int"))
    end = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("Văn bản này hết hiệu lực từ "), day(2), F.lit(".")))
    text = F.concat(
        F.lit("Số: "), "o_orderkey", F.lit("/TT-BYT\n"), body, F.lit("\nThông báo về đơn hàng "), "o_orderkey", F.lit("\n"), day(1), F.lit("\nTheo Nghị định số "), "o_custkey", F.lit("/NĐ-CP, Điều "),
        F.month("o_orderdate"), F.lit(", Khoản "), F.day("o_orderdate"), F.lit(", Điểm a.\n"), end,
    )
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def _date_sql(more: int) -> str:
    return f"CAST(try_strptime(printf('%04d-%02d-%02d', year(o_orderdate) + {more}, month(o_orderdate), day(o_orderdate) + {more}), '%Y-%m-%d') AS DATE)"


@register(
    "notice_metadata",
    f"""SELECT o_orderkey AS doc_id, 'Thông báo về đơn hàng ' || o_orderkey AS title, o_orderkey || '/TT-BYT' AS number, CASE o_custkey % 3 WHEN 0 THEN 'BỘ Y TẾ' WHEN 1 THEN 'CHÍNH PHỦ' ELSE '' END AS body,
    {_date_sql(1)} AS effective, CASE WHEN o_orderkey % 3 <> 0 THEN {_date_sql(2)} END AS expiry FROM orders""",
)
def notice_metadata(spark, d):
    return D.metadata(_notices(spark, d), V.DOCUMENT_NUMBER, V.ISSUE_DATE, V.EXPIRY_DATE, V.ISSUING_BODIES, V.NO_TITLE)


_HEAD = "'Số: ' || o_orderkey || '/TT-BYT' || chr(10) || CASE o_custkey % 3 WHEN 0 THEN 'BỘ Y TẾ' WHEN 1 THEN 'Chính phủ' ELSE 'bưu điện' END || chr(10) || 'Thông báo về đơn hàng ' || o_orderkey || chr(10) || 'ngày ' || (day(o_orderdate) + 1) || ' tháng ' || month(o_orderdate) || ' năm ' || (year(o_orderdate) + 1) || chr(10) || 'Theo '"


@register(
    "notice_references",
    f"""WITH t AS (SELECT o_orderkey AS doc_id, length({_HEAD}) AS head, [{{'type': 'NGHI_DINH', 'lead': 'Nghị định số ', 'value': o_custkey || '/', 'rest': 'NĐ-CP'}}, {{'type': 'DIEU', 'lead': 'Điều ', 'value': CAST(month(o_orderdate) AS VARCHAR), 'rest': ''}},
        {{'type': 'KHOAN', 'lead': 'Khoản ', 'value': CAST(day(o_orderdate) AS VARCHAR), 'rest': ''}}, {{'type': 'DIEM', 'lead': 'Điểm ', 'value': 'a', 'rest': ''}}] AS r FROM orders),
    u AS (SELECT doc_id, head, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM t), w AS (SELECT *, x."lead" || x.value AS "full" FROM u),
    e AS (SELECT *, head + sum(length("full") + length(x.rest) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 - length(x.rest) AS stop FROM w)
    SELECT doc_id, x.type AS type, x.value AS value, "full", CAST(stop - length("full") AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end" FROM e""",
)
def notice_references(spark, d):
    """Of a decree's number the pattern takes digits and slashes first, so the letters after the slash are left out."""
    return D.typed_values(_notices(spark, d), V.REFERENCES)
