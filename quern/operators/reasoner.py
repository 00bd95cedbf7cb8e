"""Questions to a graph of documents, each answered by a sentence with a fixed confidence and the edges it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import graph as G

# Confidences of answers with and without findings.
TRACED, UNCHANGED = 0.85, 1.0
RELATED, UNRELATED = 0.8, 0.3
LINKED, UNLINKED = 0.7, 0.1
UNKNOWN_ID = 0.0


def _named(nodes: DataFrame, c: str) -> DataFrame:
    return nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))


def _with_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of their ends; an end that is no node, or has no name, goes by its id."""
    rows = edges.join(_named(nodes, "src"), "src", "left").join(_named(nodes, "dst"), "dst", "left")
    return rows.withColumns({f"{c}_name": F.coalesce(f"{c}_name", F.col(c).cast("string")) for c in ("src", "dst")})


def _name_of(nodes: DataFrame, id_) -> str:
    row = nodes.where(F.col("id") == F.lit(id_)).select("name").first()
    return row["name"] if row is not None and row["name"] is not None else str(id_)


def _summed(found: DataFrame, order: list[str], most: int) -> DataFrame:
    """One row (n, steps): how many edges, and the first `most` as lines; the rest stay in the table of edges."""
    line = F.concat("src_name", F.lit(" --"), "type", F.lit("--> "), "dst_name")
    first = found.orderBy(*order).limit(most).withColumn("_i", F.row_number().over(Window.orderBy(*order)))  # `most` rows
    steps = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("line")))), lambda x: x["line"]).alias("steps"))
    return found.agg(F.count("*").alias("n")).crossJoin(steps)  # one row by one row


def _answer(summed: DataFrame, question: str, yes: Column, no: str, confidences: tuple[float, float]) -> DataFrame:
    some = F.col("n") > 0
    return summed.select(F.lit(question).alias("question"), F.when(some, yes).otherwise(no).alias("answer"), F.when(some, confidences[0]).otherwise(confidences[1]).alias("confidence"), F.col("n").alias("n_evidence"), "steps")


def validity_answers(asked: DataFrame, nodes: DataFrame, edges: DataFrame, ends: list[str], amends: list[str]) -> DataFrame:
    """(id, question, answer, confidence, n_evidence): whether each asked document is in force; nodes have id, name, status.

    n_evidence counts the edges the verdict rests on. An id that is no node is answered so, with confidence 0.
    """
    wanted = asked.select("id").distinct()
    known = G.validity(nodes, edges, ends, amends).join(nodes.select("id", "name"), "id").join(wanted, "id", "left_semi")
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count_if(F.col("type").isin(*ends)).alias("ended"), F.count_if(F.col("type").isin(*amends)).alias("amended"))
    rows = wanted.join(known, "id", "left").join(counts, "id", "left")
    name = F.coalesce("name", F.col("id").cast("string"))
    missing = F.col("verdict").isNull()
    said = F.when(missing, F.concat(F.lit("No document '"), name, F.lit("' is known."))).otherwise(F.concat(name, F.lit(" is "), G.verdict_text(F.col("verdict")), F.lit(".")))
    n = F.when(F.col("verdict").isin("expired", "replaced"), F.col("ended")).when(F.col("verdict") == "amended", F.col("amended"))
    return rows.select(
        "id", F.concat(F.lit("Is "), name, F.lit(" in force?")).alias("question"), said.alias("answer"), F.coalesce("confidence", F.lit(UNKNOWN_ID)).alias("confidence"), F.coalesce(n, F.lit(0)).alias("n_evidence")
    )


def amendments_answer(nodes: DataFrame, edges: DataFrame, start, types: list[str], most: int = 10) -> DataFrame:
    """One row (question, answer, confidence, n_evidence, steps): what has changed a document, at any remove."""
    name = _name_of(nodes, start)
    found = _summed(_with_names(G.chain(edges, start, types), nodes), ["depth", "src", "dst", "type"], most)
    yes = F.concat(F.lit(f"{name} has "), F.col("n"), F.lit(" amending documents."))
    return _answer(found, f"Which documents amend {name}?", yes, f"{name} has not been amended.", (TRACED, UNCHANGED))


def related_answer(nodes: DataFrame, edges: DataFrame, start, depth: int = 2, most: int = 10) -> DataFrame:
    """One row as above: the documents within `depth` steps."""
    name = _name_of(nodes, start)
    found = _summed(_with_names(G.related(edges, start, depth), nodes), ["direction", "src", "dst", "type"], most)
    yes = F.concat(F.col("n"), F.lit(f" documents are related to {name}."))
    return _answer(found, f"What is related to {name}?", yes, f"Nothing is related to {name}.", (RELATED, UNRELATED))


def path_answer(nodes: DataFrame, edges: DataFrame, start, goal) -> DataFrame:
    """One row as above: the relations on a shortest path, one step a line."""
    a, b = _name_of(nodes, start), _name_of(nodes, goal)
    before = Window.orderBy("step")  # the steps of one path
    path = G.shortest_path(edges, start, goal).withColumn("src", F.lag("id").over(before)).where("src is not null").select("step", "src", "type", F.col("id").alias("dst"))
    rows = _with_names(path, nodes)
    line = F.concat("src_name", F.lit(" --"), "type", F.lit("--> "), "dst_name")
    found = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("step", line.alias("line"), "type"))).alias("s"))
    found = found.select("n", F.transform("s", lambda x: x["line"]).alias("steps"), F.array_join(F.transform("s", lambda x: x["type"]), " -> ").alias("way"))
    return _answer(found, f"How are {a} and {b} linked?", F.concat(F.lit("By: "), F.col("way")), f"No path leads from {a} to {b}.", (LINKED, UNLINKED))
