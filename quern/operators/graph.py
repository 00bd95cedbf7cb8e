"""Knowledge graphs as two tables: extraction, upserts, validity, and level-by-level traversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.documents import spans
from quern.operators.lineage import cut


#: Nodes of a frontier that is broadcast.
NARROW = 10_000


def entities(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, type, name, mentions): typed matches, one node for each type and lower-case name."""

    def one(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("type"), F.trim(m).alias("name")))

    found = F.concat(*[one(kind, p) for kind, p in patterns.items()])
    each = docs.select(F.explode(found).alias("e")).select("e.*")
    node = F.concat("type", F.lit(":"), F.lower("name"))
    return each.groupBy(node.alias("id"), "type").agg(F.min("name").alias("name"), F.count("*").alias("mentions"))


def relations(docs: DataFrame, triggers: dict[str, str], target: str, before: int = 50, after: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(src, dst, type, evidence, position): around every trigger a window of text; references in it become targets."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def one(turn: int, kind: str, pattern: str) -> Column:
        return F.transform(spans(text, pattern), lambda s: F.struct(F.lit(turn).alias("turn"), F.lit(kind).alias("type"), s["start"].alias("start"), s["end"].alias("end")))

    hits = F.concat(*[one(i, kind, p) for i, (kind, p) in enumerate(triggers.items())])
    rows = docs.select(F.col(id_col).cast("string").alias("src"), text.alias("t"), F.explode(hits).alias("h"))
    first = F.greatest(F.col("h.start") - before, F.lit(0))
    window = F.substr("t", first + 1, F.col("h.end") + after - first)
    each = rows.select("src", "h", window.alias("evidence")).select("src", "h", "evidence", F.explode(F.array_distinct(F.regexp_extract_all("evidence", F.lit(target), F.lit(0)))).alias("dst"))
    return each.select("src", F.lower("dst").alias("dst"), F.col("h.type").alias("type"), "evidence", F.col("h.start").cast("long").alias("position"), F.col("h.turn").alias("turn"))


def upsert_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge for each pair: the last by order gives the type; evidence that a later edge lacks survives from an earlier one."""
    key = F.struct(*order)
    return edges.groupBy("src", "dst").agg(F.max_by("type", key).alias("type"), F.max_by("evidence", F.when(F.col("evidence").isNotNull(), key)).alias("evidence"))


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and, for ends of edges that are none, bare nodes of type unknown."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    bare = ends.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("unknown").alias("type"))
    return nodes.select("id", "type").unionByName(bare)


def validity(nodes: DataFrame, edges: DataFrame, ends: list[str], amends: list[str]) -> DataFrame:
    """(id, status, confidence): expired, replaced, amended or in force by a node's own status and the edges into it, in that order."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("type").isin(*ends)).alias("ended"), F.count_if(F.col("type").isin(*amends)).alias("amended"))
    one = nodes.join(into, "id", "left")
    status = F.when(F.col("status") == "expired", "expired").when(F.col("ended") > 0, "replaced").when(F.col("amended") > 0, "amended").otherwise("in_force")
    return one.select("id", status.alias("verdict"), F.when(F.col("status").isNull(), 0.5).otherwise(0.9).alias("confidence"))


def reach(edges: DataFrame, starts: list, depth: int | None = None, types: list[str] | None = None, reverse: bool = False, both: bool = False, goal=None) -> DataFrame:
    """(id, depth, via, type): nodes within `depth` steps (all that can be reached where that is None), each with the first edge it
    was found by (the smallest of a level); with a goal, no level after the one that holds it.

    Level by level until the frontier is empty: it joins the edges, and nodes seen before drop by an anti join. Each level is
    checkpointed, as the next one needs it twice. A frontier of up to NARROW nodes goes to the edges, which stay where they are;
    a wider one is shuffled with them. Edges and seen nodes never go through the driver.
    """
    spark = edges.sparkSession
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    forward = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type")
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type")
    step = forward.unionByName(back) if both else back if reverse else forward
    kind = edges.schema["src"].dataType
    none = F.lit(None)
    seen = spark.createDataFrame([(s,) for s in starts], f"id {kind.simpleString()}").select("id", F.lit(0).cast("long").alias("depth"), none.cast(kind).alias("via"), none.cast("string").alias("type"))
    front, level, wide = seen, 0, len(starts)
    while depth is None or level < depth:
        level += 1
        ids = front.select(F.col("id").alias("a"))
        ahead = step.join(F.broadcast(ids), "a") if wide <= NARROW else step.hint("merge").join(ids, "a")
        found = ahead.groupBy(F.col("b").alias("id")).agg(F.min(F.struct(F.col("a").alias("via"), "type")).alias("e"))
        front = cut(found.join(seen.select("id").hint("merge"), "id", "left_anti").select("id", F.lit(level).cast("long").alias("depth"), "e.via", "e.type"))
        wide = front.count()
        if not wide:
            break
        seen = cut(seen.unionByName(front)) if level % 8 == 0 else seen.unionByName(front)
        if goal is not None and not front.where(F.col("id") == F.lit(goal)).isEmpty():
            break
    return seen


def chain(edges: DataFrame, start, types: list[str]) -> DataFrame:
    """(src, type, dst, depth): all edges of these types into a node or into what was found before it, whatever the depth; cycles end
    where a node was seen."""
    found = reach(edges, [start], types=types, reverse=True).select(F.col("id").alias("dst"), "depth")
    return edges.where(F.col("type").isin(*types)).join(found, "dst").select("src", "type", "dst", "depth")


def related(edges: DataFrame, start, depth: int = 2) -> DataFrame:
    """(src, dst, type, direction): the edges by which a search along the edges, and another against them, first reach each node
    within `depth` steps. Directions are not mixed: what shares a target with the start is not related by that alone."""
    ahead = reach(edges, [start], depth).where("depth > 0").select(F.col("via").alias("src"), F.col("id").alias("dst"), "type", F.lit("forward").alias("direction"))
    behind = reach(edges, [start], depth, reverse=True).where("depth > 0").select(F.col("id").alias("src"), F.col("via").alias("dst"), "type", F.lit("backward").alias("direction"))
    return ahead.unionByName(behind)


def shortest_path(edges: DataFrame, start, goal) -> DataFrame:
    """(step, id, type): a shortest path along the edges, smallest predecessors first; empty if there is none, of any length.

    The way back follows each node's predecessor: one lookup for each step of the path.
    """
    found = cut(reach(edges, [start], goal=goal))
    path = found.where(F.col("id") == F.lit(goal)).select(F.col("depth").alias("step"), "id", "type", "via")
    at = path.first()  # one row of the path, or none
    while at is not None and at["via"] is not None:
        one = found.where(F.col("id") == F.lit(at["via"])).select(F.col("depth").alias("step"), "id", "type", "via")
        at = one.first()
        path = path.unionByName(one)
    return path.select("step", "id", "type").orderBy("step")


def path_text(path: DataFrame) -> DataFrame:
    """One row: the path as text, ids joined by the relations between them; no row where there is no path."""
    said = F.array_sort(F.collect_list(F.struct("step", F.concat_ws("", F.concat(F.lit(" -["), "type", F.lit("]-> ")), F.col("id").cast("string")).alias("t"))))
    return path.agg(F.array_join(F.transform(said, lambda x: x["t"]), "").alias("path")).where("path <> ''")


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    part = lambda df, s: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(s).alias("of"), "type", "n")
    return part(nodes, "node").unionByName(part(edges, "edge"))


def top_degree(edges: DataFrame, k: int) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(k)


def ego(edges: DataFrame, focus, radius: int = 2) -> DataFrame:
    """The edges among the nodes within `radius` steps of a node."""
    near = reach(edges, [focus], radius, both=True).select("id")
    a, b = near.withColumnRenamed("id", "src"), near.withColumnRenamed("id", "dst")
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")


def question_graph(pairs: DataFrame, id_col: str, question: str, answer: str, target: str) -> DataFrame:
    """Edges of question-answer pairs: question to answer, and answer to the references in it."""
    q, a = F.concat(F.lit("q:"), F.col(id_col).cast("string")), F.concat(F.lit("a:"), F.col(id_col).cast("string"))
    first = pairs.where(F.col(question).isNotNull() & F.col(answer).isNotNull()).select(q.alias("src"), a.alias("dst"), F.lit("answered_by").alias("type"))
    refs = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(target), F.lit(0)), F.lower))
    return first.unionByName(pairs.select(a.alias("src"), F.explode(refs).alias("dst"), F.lit("cites").alias("type")))


def verdict_text(verdict: Column) -> Column:
    return F.when(verdict == "expired", "no longer in force").when(verdict == "replaced", "replaced by a later document").when(verdict == "amended", "in force as amended").otherwise("in force")


