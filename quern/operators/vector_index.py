"""A stored vector index: k-means cells as partitions, the nearest cells probed, scores exact, and an exact way by cell bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut

#: Vectors that cells are fitted on at most, cells at most, vectors to a part of a cell, questions to a task.
SAMPLE, MOST_CELLS, PART_ROWS, ASKED = 100_000, 4096, 50_000, 4096


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, unit) of the vectors that have a direction: no nulls, nothing infinite, not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where(F.col("v").isNotNull()).withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return rows.select("id", "v", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of lists of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def build(vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, seed: int = 1) -> int:
    """Writes the index of all vectors under path; returns the number of cells.

    Cells are fitted by k-means on at most `sample` vectors of smallest hashed id; every vector is then put into its nearest
    cell. A cell is a folder; one with many vectors is dealt into parts by id, so that no task has it whole. Beside them stands a
    row for each cell: centre, vectors, parts, and the smallest cosine of a member to the centre. Vectors without a direction
    and those of another length than most are not indexed.
    """
    rows = _usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        raise ValueError("no vector to index")
    rows = rows.where(F.size("v") == sizes["n"])
    wanted = max(1, min(cells or int(sizes["count"] ** 0.5), MOST_CELLS, sizes["count"]))
    chosen = rows if sizes["count"] <= sample else rows.orderBy(F.xxhash64("id")).limit(sample)
    model = KMeans(k=wanted, seed=seed, maxIter=15, distanceMeasure="cosine").fit(chosen.select(array_to_vector("unit").alias("features")))
    centres = np.array(model.clusterCenters())
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = np.divide(centres, norm, out=np.zeros_like(centres), where=norm > 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column(2)) @ centres.T if batch.num_rows else np.zeros((0, len(centres)))
            cell = near.argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])], ["id", "v", "cell", "cosine"])

    put = cut(rows.mapInArrow(assign, "id long, v array<double>, cell int, cosine double"))
    counts = put.groupBy("cell").agg(F.count("*").alias("rows"), F.min("cosine").alias("least")).collect()  # a row for each cell
    spark = vectors.sparkSession
    parts = {r.cell: -(-r.rows // PART_ROWS) for r in counts}
    described = [(r.cell, centres[r.cell].tolist(), r.rows, parts[r.cell], r.least) for r in counts]
    number = F.element_at(F.create_map(*[F.lit(x) for kn in parts.items() for x in kn]), F.col("cell"))
    dealt = put.withColumn("part", F.pmod(F.xxhash64("id"), number).cast("int"))
    dealt.select("id", "v", "part", "cell").repartition(sum(parts.values()), "cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    table = spark.createDataFrame(described, "cell int, centre array<double>, rows long, parts long, least double")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return len(described)


def _cells(spark: SparkSession, path: str) -> list:
    return spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most


def _score(query: list[float]) -> Column:
    from quern.operators.search import cosine

    return F.round(cosine("v", F.array(*[F.lit(float(x)) for x in query])), 4)


def probed(spark: SparkSession, path: str, query: list[float], probes: int) -> list[int]:
    """The numbers of the cells whose centres are nearest to the query."""
    cells = _cells(spark, path)
    near = np.array([c.centre for c in cells]) @ np.array(query, float)
    return [cells[i].cell for i in np.argsort(-near, kind="stable")[:probes]]


def in_cells(spark: SparkSession, path: str, cells: list[int], query: list[float]) -> DataFrame:
    """(id, score) of all vectors of the given cells; only their folders are read."""
    return spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(*cells)).select("id", _score(query).alias("score"))


def search(spark: SparkSession, path: str, query: list[float], k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
    """Top k by cosine (id, score, rank) among the vectors of the `probes` nearest cells.

    With exact, all other cells that may hold a nearer vector are read too: the angle between query and member is at least that
    between query and centre less the widest angle in the cell, so a cell whose bound stays below the k-th score has none.
    """
    norm = float(np.linalg.norm(query))
    if not norm:
        return spark.createDataFrame([], "id long, score double, rank long")
    chosen = probed(spark, path, query, probes)
    top = lambda df: df.orderBy(F.desc("score"), "id").limit(k)
    found = top(in_cells(spark, path, chosen, query))
    if exact:
        found = cut(found)
        scores = [r.score for r in found.select("score").collect()]  # k rows
        bar = min(scores) - 1e-4 if len(scores) == k else -1.0  # scores are rounded
        more = []
        for c in _cells(spark, path):
            away = np.arccos(np.clip(np.dot(c.centre, query) / norm, -1, 1)) - np.arccos(np.clip(c.least, -1, 1))
            if c.cell not in chosen and np.cos(max(0.0, away - 1e-6)) >= bar:
                more.append(c.cell)
        if more:
            found = top(found.unionByName(in_cells(spark, path, more, query)))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))  # k rows


def search_all(questions: DataFrame, path: str, k: int = 10, probes: int = 8, with_self: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): for each row of questions the top k by cosine among the vectors of its `probes` nearest cells.

    Questions go to the parts of their cells; where many ask one cell they are dealt into groups too, so a task compares one
    part of a cell with one group of questions and returns k rows for each. A question's own id is left out unless with_self.
    """
    spark = questions.sparkSession
    cells = _cells(spark, path)
    centres, names = np.array([c.centre for c in cells]), np.array([c.cell for c in cells], np.int32)
    asked = _usable(questions, id_col, vector_col).where(F.size("v") == len(cells[0].centre)).select("id", "unit")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_matrix(batch.column(1)) @ centres.T), axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(names[near.ravel()])], ["query_id", "unit", "cell"])

    routed = cut(asked.mapInArrow(route, "query_id long, unit array<double>, cell int"))
    groups = {r.cell: -(-r["count"] // ASKED) for r in routed.groupBy("cell").count().collect()}  # a row for each cell
    if not groups:
        return spark.createDataFrame([], "query_id long, id long, score double, rank long")
    of = lambda m: F.element_at(F.create_map(*[F.lit(x) for kn in m.items() for x in kn]), F.col("cell"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    parts = {c.cell: c.parts for c in cells}
    left = routed.withColumn("grp", F.pmod(F.xxhash64("query_id"), of(groups))).select("query_id", "unit", "cell", "grp", upto(of(parts)).alias("part"))
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(*groups)).select("id", "v", F.col("cell").alias("own"), F.col("part").cast("long").alias("own_part"))
    right = stored.withColumn("own_grp", upto(F.element_at(F.create_map(*[F.lit(x) for kn in groups.items() for x in kn]), F.col("own"))))

    def compare(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if a.num_rows and b.num_rows:
            ids, order = b.column("id").to_numpy(), None
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            m = _matrix(b.column("v").combine_chunks())[order]
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
            who, u = a.column("query_id").to_numpy(), _matrix(a.column("unit").combine_chunks())
            for at in range(0, len(who), 512):
                s = np.round(u[at : at + 512] @ m.T, 4)
                if not with_self:
                    s[who[at : at + 512][:, None] == ids[None, :]] = -2
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, best, axis=1)
                keep = score > -2
                out[0].append(np.repeat(who[at : at + 512], keep.sum(axis=1)))
                out[1].append(ids[best[keep]])
                out[2].append(score[keep])
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        return pa.table({"query_id": join(out[0], np.int64), "id": join(out[1], np.int64), "score": join(out[2], np.float64)})

    found = left.groupBy("cell", "part", "grp").cogroup(right.groupBy("own", "own_part", "own_grp")).applyInArrow(compare, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
