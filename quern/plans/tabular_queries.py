"""Queries over the star schema and events: joins, aggregates, windows, merges, history, features, measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.catalog import load
from quern.operators import metrics as X
from quern.operators import tabular as B
from quern.plans.registry import register

#: Delay of an item: days from order to shipping, less what is usual; the stand-in for minutes late.
USUAL = 60
FACTS_SQL = f"""facts AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, o_custkey, o_orderdate, o_orderpriority, c_nationkey, c_mktsegment,
  CAST(date_diff('day', o_orderdate, l_shipdate) - {USUAL} AS DOUBLE) AS delay, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""


def facts(spark, d):
    """Items with their order and customer. Dimensions are left to adaptive execution: it broadcasts what proves small."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.withColumn("delay", (F.datediff("l_shipdate", "o_orderdate") - USUAL).cast("double")).drop("o_orderkey", "c_custkey")


@register("star_join", f"WITH {FACTS_SQL} SELECT l_orderkey, l_linenumber, n_name, r_name, c_mktsegment, delay FROM facts LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE delay > 100")
def star_join(spark, d):
    n, r = load(spark, d, "nation"), load(spark, d, "region")
    f = facts(spark, d).where("delay > 100").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return f.select("l_orderkey", "l_linenumber", "n_name", "r_name", "c_mktsegment", "delay")


@register("join_to_aggregate", "SELECT o_orderkey, round(a.avg_price, 4) AS avg_price, coalesce(a.n, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, avg(l_extendedprice) AS avg_price, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) a ON o_orderkey = l_orderkey")
def join_to_aggregate(spark, d):
    a = load(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))
    return load(spark, d, "orders").join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "avg_price", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("kpi_block", f"WITH {FACTS_SQL} SELECT round(100 * avg(CASE WHEN delay <= 30 THEN 1.0 ELSE 0.0 END), 2) AS on_time, round(avg(delay), 2) AS avg_delay, count(*) FILTER (delay > 60) AS late, count(*) AS n FROM facts")
def kpi_block(spark, d):
    return facts(spark, d).agg(
        F.round(100 * F.avg((F.col("delay") <= 30).cast("double")), 2).alias("on_time"), F.round(F.avg("delay"), 2).alias("avg_delay"), F.count_if(F.col("delay") > 60).alias("late"), F.count("*").alias("n")
    )


EDGES = [-180, -120, -60, -30, 0, 15, 30, 60, 120, 180, 360]
LABELS = [f"{a}..{b}" for a, b in zip(EDGES, EDGES[1:])]


@register(
    "delay_histogram",
    f"WITH {FACTS_SQL}, b AS (SELECT unnest({EDGES[:-1]}) AS lo, unnest({EDGES[1:]}) AS hi) SELECT lo || '..' || hi AS bucket, count(l_orderkey) AS n FROM b LEFT JOIN facts ON (delay > lo OR (lo = -180 AND delay = lo)) AND delay <= hi GROUP BY lo, hi",
)
def delay_histogram(spark, d):
    """Right-closed bins, the lowest edge included; bins without rows count 0, values outside drop."""
    bucket = F.when(F.col("delay").between(EDGES[0], EDGES[1]), LABELS[0])
    for a, b, label in list(zip(EDGES, EDGES[1:], LABELS))[1:]:
        bucket = bucket.when((F.col("delay") > a) & (F.col("delay") <= b), label)
    counts = facts(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(x,) for x in LABELS], "bucket string")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("monthly_on_time", f"WITH {FACTS_SQL}, m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, round(100 * avg(CASE WHEN delay <= 30 THEN 1.0 ELSE 0.0 END), 1) AS on_time FROM facts GROUP BY 1 ORDER BY 1 DESC LIMIT 12) SELECT * FROM m ORDER BY month")
def monthly_on_time(spark, d):
    m = facts(spark, d).groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(100 * F.avg((F.col("delay") <= 30).cast("double")), 1).alias("on_time"))
    return m.orderBy(F.desc("month")).limit(12).orderBy("month")


@register("top_routes", f"WITH {FACTS_SQL} SELECT c_nationkey AS origin, s_nationkey AS target, round(avg(delay), 4) AS avg_delay, round(100 * avg(CASE WHEN delay > 30 THEN 1.0 ELSE 0.0 END), 4) AS late, count(*) AS n FROM facts JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY avg_delay DESC, origin, target LIMIT 5")
def top_routes(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    g = facts(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("target"))
    return g.agg(F.round(F.avg("delay"), 4).alias("avg_delay"), F.round(100 * F.avg((F.col("delay") > 30).cast("double")), 4).alias("late"), F.count("*").alias("n")).orderBy(F.desc("avg_delay"), "origin", "target").limit(5)


@register("suppliers_having", f"WITH {FACTS_SQL} SELECT l_suppkey, s_name, round(100 * avg(CASE WHEN delay <= 30 THEN 1.0 ELSE 0.0 END), 4) AS on_time, count(*) AS n FROM facts JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING count(*) >= 50 ORDER BY on_time DESC, l_suppkey LIMIT 5")
def suppliers_having(spark, d):
    a = facts(spark, d).groupBy("l_suppkey").agg(F.round(100 * F.avg((F.col("delay") <= 30).cast("double")), 4).alias("on_time"), F.count("*").alias("n")).where("n >= 50")
    return a.join(load(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", "s_name", "on_time", "n").orderBy(F.desc("on_time"), "l_suppkey").limit(5)


@register("sorted_distinct", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY 1")
def sorted_distinct(spark, d):
    return load(spark, d, "customer").where("c_mktsegment is not null").select("c_mktsegment").distinct().orderBy("c_mktsegment")


@register(
    "asof_metric",
    """WITH m AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS month, round(avg(o_totalprice), 4) AS avg_price, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o.o_orderkey, o.o_custkey, m.avg_price, m.n FROM orders o ASOF LEFT JOIN m ON o.o_custkey = m.k AND o.o_orderdate >= m.month""",
)
def asof_metric(spark, d):
    """Each order with its customer's latest monthly figures, those of a month being known from the next one on."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    month = F.add_months(F.trunc("o_orderdate", "MM"), 1).cast("timestamp_ntz").alias("month")
    m = load(spark, d, "orders").groupBy("o_custkey", month).agg(F.round(F.avg("o_totalprice"), 4).alias("avg_price"), F.count("*").alias("n"))
    return B.asof_join(o, m, "o_custkey", "o_orderdate", "month", ["avg_price", "n"]).select("o_orderkey", "o_custkey", "avg_price", "n")


@register("left_anti_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 20")
def left_anti_ids(spark, d):
    return B.missing_keys(load(spark, d, "documents").select("doc_id"), load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").orderBy("doc_id").limit(20)


@register(
    "validation_report",
    """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled,
    round((SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS coverage,
    (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_vector,
    (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS passed""",
)
def validation_report(spark, d):
    """Coverage, orphans and mismatches of derived tables, by one union and two aggregations."""
    docs, labels, vectors = (load(spark, d, t) for t in ("documents", "labels", "embeddings"))
    side = lambda df, c, s: df.select(F.col(c).alias("id"), F.lit(s).alias("s"))
    every = side(docs, "doc_id", "d").unionByName(side(labels, "doc_id", "l")).unionByName(side(vectors, "vec_id", "v"))
    per = every.groupBy("id").agg(*[F.count_if(F.col("s") == s).alias(s) for s in "dlv"])
    sums = per.agg(
        F.sum("d").alias("documents"), F.sum("l").alias("labelled"), F.sum(F.when(F.col("l") > 0, F.col("d")).otherwise(0)).alias("covered"),
        F.sum(F.when(F.col("d") == 0, F.col("l")).otherwise(0)).alias("orphans"), F.sum(F.when(F.col("v") == 0, F.col("d")).otherwise(0)).alias("without_vector"),
    )
    return sums.select("documents", "labelled", F.round(F.try_divide("covered", "documents"), 6).alias("coverage"), "orphans", "without_vector", (F.col("orphans") == 0).alias("passed"))


@register("full_outer_join", "SELECT coalesce(doc_id, vec_id) AS id, n_chars, label FROM documents FULL JOIN embeddings ON doc_id = vec_id")
def full_outer_join(spark, d):
    """All documents and all vectors; the tables differ in size, so unmatched ends are real."""
    a = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return a.join(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id", "full")


@register("semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000)")
def semi_join(spark, d):
    c = load(spark, d, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@register("correlated_best", "SELECT c_custkey, coalesce((SELECT arg_max(o_orderpriority, (o_totalprice, o_orderkey)) FROM orders WHERE o_custkey = c_custkey), 'none') AS priority FROM customer")
def correlated_best(spark, d):
    best = load(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_totalprice", "o_orderkey")).alias("p"))
    return load(spark, d, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("p", F.lit("none")).alias("priority"))


@register("count_per_parent", "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def count_per_parent(spark, d):
    c = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return load(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))


@register("distinct_on_best", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on_best(spark, d):
    return B.first_per_key(load(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 3")
def top_per_group(spark, d):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return B.top_per_key(load(spark, d, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


MODELS = "m(model, mae, rmse, r2) AS (VALUES ('a', 17.1, 21.5, 0.80), ('b', 16.6, 20.8, 0.81), ('c', 14.7, 18.4, 0.85), ('d', 16.6, 22.0, 0.79))"


def _models(spark):
    return spark.createDataFrame([("a", 17.1, 21.5, 0.80), ("b", 16.6, 20.8, 0.81), ("c", 14.7, 18.4, 0.85), ("d", 16.6, 22.0, 0.79)], "model string, mae double, rmse double, r2 double")


@register("average_rank", f"WITH {MODELS} SELECT model, CAST(floor(rank() OVER (ORDER BY mae) + (count(*) OVER (PARTITION BY mae) - 1) / 2.0) AS BIGINT) AS mae_rank, CAST(floor(rank() OVER (ORDER BY r2 DESC) + (count(*) OVER (PARTITION BY r2) - 1) / 2.0) AS BIGINT) AS r2_rank FROM m")
def average_rank(spark, d):
    return _models(spark).select("model", B.average_rank(F.col("mae")).alias("mae_rank"), B.average_rank(F.col("r2"), True).alias("r2_rank"))


@register("model_winner", f"WITH {MODELS}, r AS (SELECT model, rank() OVER (ORDER BY mae) + rank() OVER (ORDER BY rmse) + rank() OVER (ORDER BY r2 DESC) AS total FROM m) SELECT model, CAST(total AS BIGINT) AS total FROM r ORDER BY total, model LIMIT 1")
def model_winner(spark, d):
    rank = lambda c: F.rank().over(Window.orderBy(c))  # noqa: E731  a few models
    return _models(spark).select("model", (rank(F.asc("mae")) + rank(F.asc("rmse")) + rank(F.desc("r2"))).cast("long").alias("total")).orderBy("total", "model").limit(1)


@register("time_split", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN i <= floor(0.7 * n) THEN 'train' WHEN i <= floor(0.85 * n) THEN 'val' ELSE 'test' END AS split FROM r")
def time_split(spark, d):
    return B.time_split(load(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


HASH = "CAST('0x' || substr(md5(doc_id || ':42'), 1, 8) AS BIGINT)"


@register("stratified_sample", "WITH q AS (SELECT lang, greatest(1, round(100 * count(*) / sum(count(*)) OVER ())) AS quota FROM documents GROUP BY lang), r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS i FROM documents) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE i <= quota")
def stratified_sample(spark, d):
    return B.stratified_sample(load(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@register("stratified_split", "WITH r AS (SELECT doc_id, source, percent_rank() OVER (PARTITION BY source ORDER BY md5(doc_id || ':42'), doc_id) AS p FROM documents) SELECT doc_id, source, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split FROM r")
def stratified_split(spark, d):
    p = F.percent_rank().over(Window.partitionBy("source").orderBy(B.hashed("doc_id"), "doc_id"))
    return load(spark, d, "documents").select("doc_id", "source", F.when(p < 0.7, "train").when(p < 0.85, "val").otherwise("test").alias("split"))


@register("hash_split", f"SELECT doc_id, CASE WHEN {HASH} < 3006477107 THEN 'train' WHEN {HASH} < 3650722202 THEN 'val' ELSE 'test' END AS split FROM documents")
def hash_split(spark, d):
    return load(spark, d, "documents").select("doc_id", B.hash_split("doc_id", [("train", 0.7), ("val", 0.15), ("test", 0.15)]).alias("split"))


@register("kfold", f"SELECT doc_id, {HASH} % 5 AS fold FROM documents")
def kfold(spark, d):
    return load(spark, d, "documents").select("doc_id", B.fold("doc_id", 5).alias("fold"))


@register("kfold_stats", f"WITH f AS (SELECT {HASH} % 5 AS fold, avg(n_chars) AS m FROM documents GROUP BY 1) SELECT round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std FROM f")
def kfold_stats(spark, d):
    f = load(spark, d, "documents").groupBy(B.fold("doc_id", 5).alias("fold")).agg(F.avg("n_chars").alias("m"))
    return f.agg(F.round(F.avg("m"), 4).alias("mean"), F.round(F.stddev_samp("m"), 4).alias("std"))


@register(
    "change_history",
    """SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(event_id) OVER w IS NULL AS is_current,
    CASE WHEN lag(event_id) OVER w IS NULL THEN 'insert' WHEN event_type = 'error' THEN 'delete' WHEN lag(event_type) OVER w = 'error' THEN 'restore' ELSE 'update' END AS change_type, event_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def change_history(spark, d):
    return B.change_history(load(spark, d, "events"), "user_id", "ts", "event_id", "event_type", F.col("event_type") == "error")


@register(
    "versions",
    "SELECT user_id, event_id, row_number() OVER w AS version, CASE WHEN lead(ts) OVER w IS NULL THEN 'active' ELSE 'replaced' END AS status, lead(ts) OVER w AS expired_at FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def versions(spark, d):
    e = load(spark, d, "events").where("event_type = 'click'").select("user_id", "event_id", "ts")
    return B.numbered_versions(e, "user_id", ["ts", "event_id"], "ts").drop("ts")


@register("next_version", "SELECT c_custkey, coalesce(max(l_linenumber), 0) + 1 AS version FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def next_version(spark, d):
    o, li = load(spark, d, "orders").select("o_orderkey", "o_custkey"), load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    top = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.max("l_linenumber").alias("v"))
    return load(spark, d, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("version"))


@register("upsert_merge", "WITH s AS (SELECT user_id AS c_custkey, arg_max(event_type, event_id) AS c_mktsegment, max(event_id) AS e FROM events GROUP BY 1) SELECT coalesce(c.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN s ON c.c_custkey = s.c_custkey")
def upsert_merge(spark, d):
    target = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    source = load(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), "event_id")
    return B.merge(target, source, ["c_custkey"], "event_id")


@register("upsert_one_column", "WITH s AS (SELECT user_id AS k, arg_max(event_type, event_id) AS seg, arg_max(value, event_id) AS v FROM events GROUP BY 1) SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(c_acctbal, v) AS c_acctbal FROM customer FULL JOIN s ON c_custkey = k")
def upsert_one_column(spark, d):
    target = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    source = load(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), F.col("value").alias("c_acctbal"), "event_id")
    return B.merge(target, source, ["c_custkey"], "event_id", update=["c_mktsegment"])


@register("insert_or_ignore", "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT vec_id, 'vec' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def insert_or_ignore(spark, d):
    a = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"))
    return B.insert_or_ignore(a, load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("vec").alias("kind")), ["id"])


@register("delete_by_key", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_by_key(spark, d):
    return B.delete_keys(load(spark, d, "documents").select("doc_id", "n_chars"), load(spark, d, "labels").where("quality = 0"), ["doc_id"])


@register("link_missing", "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN -1 END AS label FROM documents) SELECT t.doc_id, coalesce(t.label, e.label) AS label FROM t LEFT JOIN embeddings e ON e.vec_id = t.doc_id")
def link_missing(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, -1).alias("label"))
    return B.fill_missing(t, load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "label")


@register("latest_feedback", "SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id")
def latest_feedback(spark, d):
    return load(spark, d, "events").where(F.col("event_type").isin("click", "error")).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


@register("recent_history", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_history(spark, d):
    return load(spark, d, "events").select("event_id", "ts", "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)


@register("history_stats", "SELECT count(*) AS total, count(*) FILTER (value IS NULL OR event_type = 'error') AS pending, round(avg(abs(value - 20)) FILTER (event_type <> 'error'), 4) AS avg_error, round(100 * avg(CASE WHEN abs(value - 20) <= 30 THEN 1.0 ELSE 0.0 END) FILTER (event_type <> 'error'), 4) AS within_30 FROM events")
def history_stats(spark, d):
    known, e = F.col("event_type") != "error", F.abs(F.col("value") - 20)
    return load(spark, d, "events").agg(
        F.count("*").alias("total"), F.count_if(F.col("value").isNull() | ~known).alias("pending"), F.round(F.avg(F.when(known, e)), 4).alias("avg_error"), F.round(100 * F.avg(F.when(known, (e <= 30).cast("double"))), 4).alias("within_30")
    )


@register(
    "feature_table",
    f"""WITH {FACTS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(quarter(o_orderdate) AS BIGINT) AS quarter, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS weekday,
    CAST(hour(o_orderdate) AS BIGINT) AS hour, CAST(isodow(o_orderdate) >= 6 AS BIGINT) AS is_weekend,
    CAST(CASE WHEN month(o_orderdate) IN (3,4,5) THEN 1 WHEN month(o_orderdate) IN (6,7,8) THEN 2 WHEN month(o_orderdate) IN (9,10,11) THEN 3 ELSE 4 END AS BIGINT) AS season,
    round(ln(1 + coalesce(l_extendedprice, 0)), 6) AS log_price, round(coalesce(l_extendedprice / nullif(l_quantity, 0), 1), 6) AS unit_price, round(l_quantity * p_size / 1e6, 9) AS load,
    greatest(0, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01')) AS age_days, CAST(p_size > 40 AS BIGINT) AS is_large, CASE WHEN delay > 15 THEN 'LATE' WHEN delay < -15 THEN 'EARLY' ELSE 'ON_TIME' END AS status
    FROM facts LEFT JOIN part ON l_partkey = p_partkey""",
)
def feature_table(spark, d):
    f = facts(spark, d).join(load(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return f.select(
        "l_orderkey", "l_linenumber", "l_partkey", *[c.alias(k) for k, c in B.date_parts("o_orderdate").items()],
        F.round(F.log1p(F.coalesce("l_extendedprice", F.lit(0.0))), 6).alias("log_price"),
        F.round(F.coalesce(F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)), F.lit(1.0)), 6).alias("unit_price"),
        F.round(F.col("l_quantity") * F.col("p_size") / 1e6, 9).alias("load"),
        F.greatest(F.lit(0), F.datediff(F.lit("2002-01-01").cast("date"), "o_orderdate")).cast("long").alias("age_days"),
        F.coalesce(F.col("p_size") > 40, F.lit(False)).cast("long").alias("is_large"),
        B.delay_status(F.col("delay")).alias("status"),
    )


@register("label_encode", "WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(p_type, 'Unknown') AS v FROM part)) SELECT p_partkey, p_type, coalesce(code, 0) AS p_type_code FROM part LEFT JOIN c ON coalesce(p_type, 'Unknown') = v")
def label_encode(spark, d):
    p = load(spark, d, "part").select("p_partkey", "p_type")
    return B.encode_labels(p, B.label_codes(p, "p_type"), "p_type")


@register("impute_median", "WITH m AS (SELECT median(e.label) AS m FROM embeddings e), t AS (SELECT d.doc_id, e.label FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id) SELECT doc_id, CAST(coalesce(label, (SELECT median(label) FROM t)) AS DOUBLE) AS label FROM t")
def impute_median(spark, d):
    t = load(spark, d, "documents").select("doc_id").join(load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("double").alias("label")), "doc_id", "left")
    return B.impute_median(t, ["label"])


@register("min_max_ensemble", "WITH n AS (SELECT doc_id, source, CASE WHEN max(n_chars) OVER w - min(n_chars) OVER w < 1e-9 THEN 0.0 ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w)::DOUBLE END AS a, length(source) AS b FROM documents WINDOW w AS (PARTITION BY source)) SELECT doc_id, round((1.0 * a + 1.5 * b) / 2.5, 6) AS score FROM n")
def min_max_ensemble(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", B.min_max(F.col("n_chars"), "source").alias("a"))
    return docs.select("doc_id", F.round((1.0 * F.col("a") + 1.5 * F.length("source")) / 2.5, 6).alias("score"))


PREDICTED = "l_quantity * 1500"


@register(
    "regression_metrics",
    f"""WITH e AS (SELECT l_extendedprice AS y, {PREDICTED} AS p FROM lineitem) SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
    round(1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(avg(abs((y - p) / y)) FILTER (abs(y) > 1e-6) * 100, 4) AS mape,
    round(avg(CASE WHEN abs(y - p) <= 30 THEN 1.0 ELSE 0.0 END) * 100, 4) AS within_30, round(avg(CASE WHEN abs(y - p) <= 60 THEN 1.0 ELSE 0.0 END) * 100, 4) AS within_60 FROM e""",
)
def regression_metrics(spark, d):
    return load(spark, d, "lineitem").agg(*X.regression(F.col("l_extendedprice"), F.expr(PREDICTED)))


@register(
    "residual_summary",
    f"WITH e AS (SELECT l_extendedprice - {PREDICTED} AS e FROM lineitem) SELECT round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(min(e), 4) AS low, round(max(e), 4) AS high, round(quantile_cont(e, 0.25), 4) AS q25, round(quantile_cont(e, 0.5), 4) AS q50, round(quantile_cont(e, 0.75), 4) AS q75 FROM e",
)
def residual_summary(spark, d):
    return X.residuals(load(spark, d, "lineitem"), F.expr(f"l_extendedprice - {PREDICTED}"))


@register("error_breakdown", f"SELECT l_returnflag, l_linestatus, round(avg(abs(l_extendedprice - {PREDICTED})), 4) AS mae, count(*) AS n FROM lineitem GROUP BY 1, 2")
def error_breakdown(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(F.abs(F.expr(f"l_extendedprice - {PREDICTED}"))), 4).alias("mae"), F.count("*").alias("n"))


@register("worst_rows", f"SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - {PREDICTED}), 4) AS error FROM lineitem ORDER BY error DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def worst_rows(spark, d):
    e = F.round(F.abs(F.expr(f"l_extendedprice - {PREDICTED}")), 4)
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", e.alias("error")).orderBy(F.desc("error"), "l_orderkey", "l_linenumber", "l_partkey").limit(10)


@register("latency_percentiles", "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95"))


GUESS = "CASE WHEN d.n_chars > 1200 THEN 1 ELSE 0 END"


def _judged(spark, d):
    docs = load(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1200).cast("int").alias("guess"), F.round(F.col("n_chars") / 100).alias("score"))
    return load(spark, d, "labels").join(docs, "doc_id")


@register("confusion_matrix", f"SELECT quality AS truth, {GUESS} AS predicted, count(*) AS n FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return X.confusion(_judged(spark, d), "quality", "guess")


@register(
    "class_report",
    f"""WITH c AS (SELECT quality AS t, {GUESS} AS p FROM labels JOIN documents d USING (doc_id)), k AS (SELECT unnest([0, 1]) AS label),
    s AS (SELECT label, count(*) FILTER (t = label) AS support, count(*) FILTER (p = label) AS g, count(*) FILTER (t = label AND p = label) AS h FROM k, c GROUP BY label)
    SELECT label, support, round(coalesce(h / nullif(g, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(h / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * h / nullif(g + support, 0)::DOUBLE, 0), 6) AS f1 FROM s""",
)
def class_report(spark, d):
    return X.per_class(X.confusion(_judged(spark, d), "quality", "guess"))


@register(
    "roc_auc",
    "WITH c AS (SELECT quality, round(n_chars / 100.0) AS s FROM labels JOIN documents d USING (doc_id)), b AS (SELECT s, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM c GROUP BY s), w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM b) SELECT round(sum(p * (u + n / 2.0)) / (sum(p) * sum(n)), 6) AS auc FROM w",
)
def roc_auc(spark, d):
    return X.auc(_judged(spark, d), "quality", "score")


@register("class_distribution", "SELECT lang AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 2) AS percent FROM documents GROUP BY lang ORDER BY n DESC, value")
def class_distribution(spark, d):
    return X.distribution(load(spark, d, "documents"), "lang")


@register("null_profile", "SELECT unnest(['doc_id', 'quality', 'vec_id', 'label']) AS \"column\", unnest([0.0, (SELECT round(100 * avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM documents LEFT JOIN labels USING (doc_id)), (SELECT round(100 * avg(CASE WHEN vec_id IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM documents LEFT JOIN embeddings ON doc_id = vec_id), (SELECT round(100 * avg(CASE WHEN label IS NULL THEN 1.0 ELSE 0.0 END), 4) FROM documents LEFT JOIN embeddings ON doc_id = vec_id)]) AS null_percent")
def null_profile(spark, d):
    t = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(load(spark, d, "embeddings").select("vec_id", "label"), F.col("doc_id") == F.col("vec_id"), "left")
    return X.null_shares(t)


@register(
    "ranking_metrics",
    """WITH res AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), gold AS (SELECT source AS query, doc_id AS id, quality AS rel FROM labels JOIN documents USING (doc_id)),
    ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k), g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, id) AS r FROM gold WHERE rel > 0), i AS (SELECT query, k, count(*) AS n, sum(CASE WHEN r <= k THEN (2 ** rel - 1) / log2(r + 1) ELSE 0 END) AS ideal FROM g, ks GROUP BY ALL),
    f AS (SELECT res.query, k, count(*) FILTER (rank <= k AND rel > 0) AS h, min(rank) FILTER (rank <= k AND rel > 0) AS first, sum(CASE WHEN rank <= k THEN (2 ** coalesce(rel, 0) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM res LEFT JOIN gold ON res.query = gold.query AND res.id = gold.id, ks WHERE rank <= 20 GROUP BY ALL)
    SELECT i.query, CAST(i.k AS BIGINT) AS k, round(coalesce(h, 0) / n::DOUBLE, 6) AS recall, CASE WHEN coalesce(h, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(coalesce(h, 0) / i.k::DOUBLE, 6) AS precision, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS mrr, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM i LEFT JOIN f ON i.query = f.query AND i.k = f.k""",
)
def ranking_metrics(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    res = docs.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), "rank")
    gold = load(spark, d, "labels").join(docs, "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), F.col("quality").alias("rel"))
    return X.ranking(res, gold, [1, 3, 5, 10, 20])


@register("nulls_last_sort", "SELECT doc_id, label, n_chars FROM documents LEFT JOIN embeddings ON doc_id = vec_id ORDER BY label DESC NULLS LAST, doc_id")
def nulls_last_sort(spark, d):
    t = load(spark, d, "documents").join(load(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "label", "n_chars")
    return t.orderBy(F.desc_nulls_last("label"), "doc_id")


@register("paged_listing", "WITH f AS (SELECT doc_id, source FROM documents WHERE contains(lower(source), 'rc1')) SELECT doc_id, source, (SELECT count(*) FROM f) AS total FROM f ORDER BY doc_id LIMIT 10 OFFSET 20")
def paged_listing(spark, d):
    f = load(spark, d, "documents").where(F.contains(F.lower("source"), F.lit("rc1"))).select("doc_id", "source")
    return f.orderBy("doc_id").offset(20).limit(10).crossJoin(F.broadcast(f.agg(F.count("*").alias("total"))))  # one row


@register("ordered_aggregates", "SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS priorities, max(o_totalprice) AS top, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS orders FROM orders GROUP BY 1")
def ordered_aggregates(spark, d):
    by_price = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")))
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), F.max("o_totalprice").alias("top"), F.transform(by_price, lambda x: x["o_orderkey"]).alias("orders"))


@register("top_by_count", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def top_by_count(spark, d):
    return load(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(10)


@register("outline", "SELECT p_brand, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 ORDER BY first_id")
def outline(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).orderBy("first_id")


@register("text_by_order", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1")
def text_by_order(spark, d):
    said = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", said.alias("said"))))
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["said"]), "\n").alias("text"))


@register("status_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders")
def status_counts(spark, d):
    return load(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count_if(F.col("o_orderstatus") == "P").alias("failed"))


@register("reject_rates", "SELECT event_type, count(*) AS attempts, count(*) FILTER (value < 5) AS rejected, round(count(*) FILTER (value < 5) / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def reject_rates(spark, d):
    bad = F.count_if(F.col("value") < 5)
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("attempts"), bad.alias("rejected"), F.round(bad / F.count("*"), 6).alias("rate"))


@register("set_operations", "SELECT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels) UNION (SELECT doc_id FROM labels WHERE toxic = 1) EXCEPT SELECT vec_id FROM embeddings WHERE label = 3")
def set_operations(spark, d):
    labels = load(spark, d, "labels")
    both = load(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(labels.select("doc_id"))
    return both.union(labels.where("toxic = 1").select("doc_id")).distinct().exceptAll(load(spark, d, "embeddings").where("label = 3").select("vec_id"))


@register("filter_conversations", "SELECT conv_id, turn, text AS question FROM conversations WHERE role IS NOT NULL AND trim(role) <> '' AND text IS NOT NULL AND trim(text) <> '' AND (starts_with(text, 'T') OR starts_with(text, 'A')) AND NOT starts_with(text, 'The')")
def filter_conversations(spark, d):
    c = load(spark, d, "conversations").where(B.not_blank("role", "text") & B.prefixed("text", ["T", "A"], ["The"]))
    return c.select("conv_id", "turn", F.col("text").alias("question"))


@register("meta_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND (doc_id % 2 = 1 OR source = 'src1')")
def meta_filter(spark, d):
    """An absent key passes: documents of even id carry their source, the others don't."""
    meta = F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))), lambda k, v: v.isNotNull())
    rows = load(spark, d, "documents").select("doc_id", meta.alias("meta"))
    return B.filtered_by_meta(rows, "meta", {"lang": "en", "source": "src1"}, {"en": ["de"]}).select("doc_id")


@register("json_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def json_props(spark, d):
    return load(spark, d, "events").where(F.try_parse_json("props").isNotNull()).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@register("windows_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows_tumbling(spark, d):
    g = B.tumbling(load(spark, d, "events"), "ts", "1 hour", "event_type", aggs=[F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@register("windows_sliding", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (30 * k) MINUTE AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def windows_sliding(spark, d):
    g = B.sliding(load(spark, d, "events"), "ts", "1 hour", "30 minutes", aggs=[F.count("*").alias("n")])
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register(
    "windows_session",
    "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid",
)
def windows_session(spark, d):
    g = B.sessions(load(spark, d, "events"), "ts", "30 minutes", "user_id", aggs=[F.count("*").alias("n")])
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
