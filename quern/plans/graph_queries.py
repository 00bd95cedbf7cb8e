"""Queries over graphs, models and streams in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import load
from quern.operators import graph as G
from quern.operators import learning as L
from quern.operators import reasoner as Z
from quern.operators import tabular as B
from quern.operators.lineage import cut
from quern.plans.registry import register

#: Parts as documents that amend, replace or cite the part of half their number.
EDGES = """edges AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, CASE p_partkey % 3 WHEN 0 THEN 'amends' WHEN 1 THEN 'replaces' ELSE 'cites' END AS type FROM part WHERE p_partkey > 0)"""
NODES = "nodes AS (SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN 'expired' WHEN p_size > 5 THEN 'active' END AS status, p_type AS type FROM part)"


def edges(spark, d):
    p = load(spark, d, "part").where("p_partkey > 0")
    kind = F.when(F.col("p_partkey") % 3 == 0, "amends").when(F.col("p_partkey") % 3 == 1, "replaces").otherwise("cites")
    return p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"), kind.alias("type"))


def nodes(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 45, "expired").when(F.col("p_size") > 5, "active").alias("status"), F.col("p_type").alias("type"))


@register("graph_validity", f"WITH {EDGES}, {NODES}, i AS (SELECT dst AS id, count(*) FILTER (type = 'replaces') AS e, count(*) FILTER (type = 'amends') AS a FROM edges GROUP BY 1) SELECT id, CASE WHEN status = 'expired' THEN 'expired' WHEN e > 0 THEN 'replaced' WHEN a > 0 THEN 'amended' ELSE 'in_force' END AS verdict, CAST(CASE WHEN status IS NULL THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence FROM nodes LEFT JOIN i USING (id)")
def graph_validity(spark, d):
    return G.validity(nodes(spark, d), edges(spark, d), ["replaces"], ["amends"])


WALK = "SELECT id, min(depth) AS depth FROM r GROUP BY id"


#: Nodes that a walk may reach, with their depth; a part's half is smaller than it, so no walk runs in a circle.
BACK = "r AS (SELECT 1 AS id, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.id AND e.type IN ('amends', 'replaces'))"


@register("amendment_chain", f"WITH RECURSIVE {EDGES}, {BACK} SELECT e.src, e.type, CAST(e.dst AS BIGINT) AS dst, CAST(m.depth AS BIGINT) AS depth FROM edges e JOIN (SELECT id, min(depth) AS depth FROM r GROUP BY id) m ON e.dst = m.id WHERE e.type IN ('amends', 'replaces')")
def amendment_chain(spark, d):
    return G.chain(edges(spark, d), 1, ["amends", "replaces"])


@register(
    "related_documents",
    f"""WITH RECURSIVE {EDGES}, f AS (SELECT 40 AS id, 0 AS depth UNION SELECT e.dst, f.depth + 1 FROM f JOIN edges e ON e.src = f.id WHERE f.depth < 2), b AS (SELECT 40 AS id, 0 AS depth UNION SELECT e.src, b.depth + 1 FROM b JOIN edges e ON e.dst = b.id WHERE b.depth < 2)
    SELECT e.src, e.dst, e.type, 'forward' AS direction FROM edges e JOIN f ON e.src = f.id WHERE f.depth < 2 UNION SELECT e.src, e.dst, e.type, 'backward' FROM edges e JOIN b ON e.dst = b.id WHERE b.depth < 2""",
)
def related_documents(spark, d):
    """A part has one half and no node is reached twice, so the edges of the search trees are all edges of the walks."""
    return G.related(edges(spark, d), 40, 2)


@register(
    "shortest_path",
    f"""WITH RECURSIVE {EDGES}, r AS (SELECT max(p_partkey) AS id, 0 AS step, CAST(NULL AS VARCHAR) AS type FROM part UNION SELECT e.dst, r.step + 1, e.type FROM r JOIN edges e ON e.src = r.id WHERE r.id <> 1)
    SELECT CAST(step AS BIGINT) AS step, CAST(id AS BIGINT) AS id, type FROM r""",
)
def shortest_path(spark, d):
    """From the part with the largest number along the edges to part 1."""
    last = load(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return G.shortest_path(edges(spark, d), last, 1)


@register("graph_stats", f"WITH {EDGES}, {NODES} SELECT 'node' AS of, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_stats(spark, d):
    return G.type_counts(nodes(spark, d), edges(spark, d))


@register("top_degree", f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def top_degree(spark, d):
    return G.top_degree(edges(spark, d), 20)


@register("ego_graph", f"WITH RECURSIVE {EDGES}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT 9 AS id, 0 AS depth UNION SELECT b.b, r.depth + 1 FROM r JOIN b ON b.a = r.id WHERE r.depth < 2) SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM r) AND dst IN (SELECT id FROM r)")
def ego_graph(spark, d):
    return G.ego(edges(spark, d), 9, 2)


@register("edge_upsert", "WITH e AS (SELECT o_custkey AS src, o_custkey % 10 AS dst, o_orderstatus AS type, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS evidence, o_orderkey AS k FROM orders) SELECT src, dst, arg_max(type, k) AS type, arg_max(evidence, k) FILTER (evidence IS NOT NULL) AS evidence FROM e GROUP BY 1, 2")
def edge_upsert(spark, d):
    e = load(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 10).alias("dst"), F.col("o_orderstatus").alias("type"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("evidence"), F.col("o_orderkey").alias("k"))
    return G.upsert_edges(e, ["k"])


@register("placeholder_nodes", f"WITH {NODES}, e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT id, type FROM nodes UNION ALL SELECT DISTINCT x, 'unknown' FROM (SELECT src AS x FROM e UNION SELECT dst FROM e) WHERE x NOT IN (SELECT id FROM nodes)")
def placeholder_nodes(spark, d):
    """All parts, and edges from orders to parts: orders whose number is no part's are the bare ends."""
    return G.with_placeholders(nodes(spark, d), load(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@register("graph_entities", r"WITH m AS (SELECT unnest(list_transform(regexp_extract_all(text, '[a-z.0-9]+@[a-z0-9.]+'), lambda x: {'t': 'email', 'n': trim(x)}) || list_transform(regexp_extract_all(text, 'mail[0-9]'), lambda x: {'t': 'host', 'n': trim(x)})) AS x FROM documents) SELECT x.t || ':' || lower(x.n) AS id, x.t AS type, min(x.n) AS name, count(*) AS mentions FROM m GROUP BY 1, 2")
def graph_entities(spark, d):
    return G.entities(load(spark, d, "documents"), {"email": r"[a-z.0-9]+@[a-z0-9.]+", "host": "mail[0-9]"})


_TARGET = "(?:GNU|CC|MIT|Apache)[A-Za-z -]{0,20}[0-9.]*"


@register(
    "graph_relations",
    f"""WITH k AS (SELECT * FROM (VALUES (0, 'licensed', 'Licensed under'), (1, 'worked', 'This work is licensed')) v(turn, type, cue)), m AS (SELECT CAST(doc_id AS VARCHAR) AS src, text, turn, type, cue, string_split(text, cue) AS s FROM documents, k WHERE contains(text, cue)),
    u AS (SELECT * EXCLUDE s, unnest(list_transform(range(1, len(s)), lambda i: CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(cue))) AS position FROM m),
    e AS (SELECT *, substr(text, greatest(position - 50, 0) + 1, position + length(cue) + 200 - greatest(position - 50, 0)) AS evidence FROM u)
    SELECT src, lower(dst) AS dst, type, evidence, position, turn FROM (SELECT *, unnest(list_distinct(regexp_extract_all(evidence, '{_TARGET}'))) AS dst FROM e) x""",
)
def graph_relations(spark, d):
    return G.relations(load(spark, d, "documents"), {"licensed": "Licensed under", "worked": "This work is licensed"}, r"(?:GNU|CC|MIT|Apache)[A-Za-z -]{0,20}[0-9.]*")


@register(
    "question_graph",
    r"""WITH p AS (SELECT q.conv_id || '-' || q.turn AS id, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn - 1 = q.turn WHERE q.role = 'user' AND a.role = 'assistant')
    SELECT 'q:' || id AS src, 'a:' || id AS dst, 'answered_by' AS type FROM p WHERE question IS NOT NULL AND answer IS NOT NULL UNION ALL SELECT 'a:' || id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(answer, '[\p{L}\p{Nd}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{9,}')), lambda x: lower(x)))), 'cites' FROM p""",
)
def question_graph(spark, d):
    c = load(spark, d, "conversations")
    pairs = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("q")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("t"), F.col("text").alias("a")), ["conv_id", "t"])
    return G.question_graph(pairs.withColumn("id", F.concat_ws("-", "conv_id", "t")), "id", "q", "a", r"\b[A-Z][a-z]{9,}\b")


def _training(spark, d):
    from quern.plans.tabular_queries import facts

    rows = facts(spark, d).withColumns(B.date_parts("o_orderdate")).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    found = L.assembled(rows, ["l_quantity", "l_discount", "month", "quarter", "weekday", "season"], "l_extendedprice")
    return cut(found.select("l_orderkey", "l_linenumber", "id", "features", "y"))  # a model passes over its rows many times


@register("model_comparison")
def model_comparison(spark, d):
    rows = _training(spark, d).withColumn("split", B.hash_split("id", [("train", 0.8), ("test", 0.2)]))
    return L.compare(rows.where("split = 'train'"), rows.where("split = 'test'"), L.regressors(10, 4))


@register("cross_validation")
def cross_validation(spark, d):
    return L.cross_validate(_training(spark, d), "id", L.regressors()["linear"], 3)


@register("batch_predictions")
def batch_predictions(spark, d):
    rows = _training(spark, d)
    return L.predictions(L.regressors()["linear"].fit(rows), rows, ["l_orderkey", "l_linenumber"])


@register("principal_components")
def principal_components(spark, d):
    return L.principal(load(spark, d, "embeddings"))


_NAMES = "nm AS (SELECT p_partkey AS id, p_name AS name FROM part)"


def named_nodes(spark, d):
    return nodes(spark, d).join(load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "id")


@register(
    "validity_answers",
    f"""WITH {EDGES}, {NODES}, i AS (SELECT dst AS id, count(*) FILTER (type = 'replaces') AS e, count(*) FILTER (type = 'amends') AS a FROM edges GROUP BY 1), asked AS (SELECT p_partkey AS id FROM part UNION SELECT -1 - p_partkey FROM part),
    v AS (SELECT asked.id, coalesce(p_name, CAST(asked.id AS VARCHAR)) AS name, status, p_partkey IS NULL AS gone, coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM asked LEFT JOIN part ON p_partkey = asked.id LEFT JOIN nodes ON nodes.id = asked.id LEFT JOIN i ON i.id = asked.id)
    SELECT id, 'Is ' || name || ' in force?' AS question, CASE WHEN gone THEN 'No document ' || chr(39) || name || chr(39) || ' is known.' ELSE name || ' is ' || CASE WHEN status = 'expired' THEN 'no longer in force' WHEN e > 0 THEN 'replaced by a later document' WHEN a > 0 THEN 'in force as amended' ELSE 'in force' END || '.' END AS answer,
      CAST(CASE WHEN gone THEN 0 WHEN status IS NULL THEN 0.5 ELSE 0.9 END AS DOUBLE) AS confidence, CASE WHEN gone THEN 0 WHEN status = 'expired' OR e > 0 THEN e ELSE a END AS n_evidence FROM v""",
)
def validity_answers(spark, d):
    """Every part, and as many ids that are none."""
    known = named_nodes(spark, d)
    asked = known.select("id").unionByName(known.select((-1 - F.col("id")).alias("id")))
    return Z.validity_answers(asked, known, edges(spark, d), ["replaces"], ["amends"])


@register(
    "amendments_answer",
    f"""WITH RECURSIVE {EDGES}, {BACK}, {_NAMES}, c AS (SELECT e.src, e.type, e.dst, m.depth FROM edges e JOIN (SELECT id, min(depth) AS depth FROM r GROUP BY id) m ON e.dst = m.id WHERE e.type IN ('amends', 'replaces')),
    s AS (SELECT a.name || ' --' || c.type || '--> ' || b.name AS line, row_number() OVER (ORDER BY depth, src, dst, c.type) AS i FROM c JOIN nm a ON a.id = c.src JOIN nm b ON b.id = c.dst)
    SELECT 'Which documents amend ' || name || '?' AS question, name || ' has ' || (SELECT count(*) FROM c) || ' amending documents.' AS answer, CAST(0.85 AS DOUBLE) AS confidence, (SELECT count(*) FROM c) AS n_evidence, (SELECT list(line ORDER BY i) FROM s WHERE i <= 10) AS steps FROM nm WHERE id = 1""",
)
def amendments_answer(spark, d):
    return Z.amendments_answer(named_nodes(spark, d), edges(spark, d), 1, ["amends", "replaces"])
