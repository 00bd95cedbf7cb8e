"""Quality measures as aggregates: ranking, regression, classification, summaries' overlap, profiles."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quern.operators.lineage import in_ranges


def ranking(results: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Per query and k: recall, hit, precision, mrr, ndcg. results (query, id, rank from 1), gold (query, id, rel).

    Gain is 2^rel - 1 over log2(rank + 1); the ideal order is that of the gold's relevances. Queries without results score 0.
    """
    most = max(ks)
    judged = results.where(F.col("rank") <= most).join(gold, ["query", "id"], "left")
    gain = (F.pow(F.lit(2.0), F.coalesce("rel", F.lit(0))) - 1) / F.log2(F.col("rank") + 1)
    hit = F.col("rel").isNotNull() & (F.col("rel") > 0)
    per = []
    for k in ks:
        near = F.col("rank") <= k
        per += [F.sum(F.when(near & hit, 1).otherwise(0)).alias(f"h{k}"), F.min(F.when(near & hit, F.col("rank"))).alias(f"f{k}"), F.sum(F.when(near, gain).otherwise(0.0)).alias(f"d{k}")]
    found = judged.groupBy("query").agg(*per)
    ideal_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "id"))
    best = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("r") + 1)
    ideal = gold.where("rel > 0").withColumn("r", ideal_rank).groupBy("query").agg(F.count("*").alias("n_gold"), *[F.sum(F.when(F.col("r") <= k, best).otherwise(0.0)).alias(f"i{k}") for k in ks])
    both = ideal.join(found, "query", "left")
    rows = F.array(
        *[
            F.struct(
                F.lit(k).cast("long").alias("k"),
                F.round(F.coalesce(f"h{k}", F.lit(0)) / F.col("n_gold"), 6).alias("recall"),
                F.when(F.coalesce(f"h{k}", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("hit"),
                F.round(F.coalesce(f"h{k}", F.lit(0)) / k, 6).alias("precision"),
                F.round(F.coalesce(1 / F.col(f"f{k}"), F.lit(0.0)), 6).alias("mrr"),
                F.round(F.coalesce(F.try_divide(f"d{k}", f"i{k}"), F.lit(0.0)), 6).alias("ndcg"),
            )
            for k in ks
        ]
    )
    return both.select("query", F.explode(rows).alias("m")).select("query", "m.*")


def regression(y: Column, p: Column) -> list[Column]:
    """mae, rmse, r2, mape (targets over 1e-6), within_30, within_60 as aggregates of one pass."""
    e = y - p
    sse, n = F.sum(e * e), F.count("*")
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return [
        F.round(F.avg(F.abs(e)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        F.round(1 - F.try_divide(sse, sst), 6).alias("r2"),
        F.round(F.avg(F.when(F.abs(y) > 1e-6, F.abs(e / y))) * 100, 4).alias("mape"),
        F.round(F.avg((F.abs(e) <= 30).cast("double")) * 100, 4).alias("within_30"),
        F.round(F.avg((F.abs(e) <= 60).cast("double")) * 100, 4).alias("within_60"),
    ]


def quantiles(df: DataFrame, value: Column, shares: dict[str, float]) -> DataFrame:
    """One row of exact percentiles, interpolated between neighbours; null where no row has a value.

    Distinct values are counted and lie in ranges with offsets, so no task holds or sorts them all.
    """
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    placed = in_ranges(counts, "v", "n").select("v", "n", upto.alias("upto"))
    size = df.agg(F.count(value).alias("size"))
    place = lambda q: q * (F.col("size") - 1)
    held = lambda at: F.max(F.when((F.col("upto") - F.col("n") <= at) & (at < F.col("upto")), F.col("v")))
    ends = placed.crossJoin(F.broadcast(size)).groupBy("size").agg(*[f(place(q)) for name, q in shares.items() for f in (lambda p, x=name: held(F.floor(p)).alias(f"low_{x}"), lambda p, x=name: held(F.ceil(p)).alias(f"high_{x}"))])  # one row
    between = lambda name, q: F.when(F.col(f"low_{name}") == F.col(f"high_{name}"), F.col(f"low_{name}")).otherwise((F.ceil(place(q)) - place(q)) * F.col(f"low_{name}") + (place(q) - F.floor(place(q))) * F.col(f"high_{name}"))
    return size.join(ends, "size", "left").select(*[between(name, q).alias(name) for name, q in shares.items()])


def residuals(df: DataFrame, e: Column) -> DataFrame:
    """One row: mean, std, low, high and quartiles of e."""
    one = df.agg(F.round(F.avg(e), 4).alias("mean"), F.round(F.stddev_pop(e), 4).alias("std"), F.round(F.min(e), 4).alias("low"), F.round(F.max(e), 4).alias("high"))
    quarters = quantiles(df, e, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return one.crossJoin(F.broadcast(quarters)).select("mean", "std", "low", "high", *[F.round(q, 4).alias(q) for q in ("q25", "q50", "q75")])


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """precision, recall, f1, support of each class from (truth, predicted, n)."""
    rows = matrix.select(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("c"))
    columns = matrix.select(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("c"))
    sums = rows.unionByName(columns).groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("guessed"), F.sum("c").alias("hits"))
    precision, recall = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("label", "support", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by counts per distinct score: pairs won and half the ties.

    Scores are summed in ranges, each from what lies below it, so no task sees them all.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    below = Window.partitionBy("_part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    won = in_ranges(by, "s", "neg").withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("_before"))
    return won.agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """n and percent of each value, most common first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("percent")).orderBy(F.desc("n"), "value")


def null_shares(df: DataFrame) -> DataFrame:
    """(column, null_percent) of every column, in one pass."""
    one = df.agg(*[F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 4).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_percent")) for c in df.columns])).alias("x")).select("x.*")


@F.pandas_udf(IntegerType())
def _overlap(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else (Counter(a) & Counter(b)).total() for a, b in zip(candidate, reference)], dtype="Int32")


def overlap(candidate: Column, reference: Column) -> Column:
    """Shared n-grams of two arrays counted with their multiplicities."""
    return _overlap(candidate, reference)


def rouge_n(candidate: Column, reference: Column) -> Column:
    """(p, r, f) of the shared n-grams of two arrays of n-grams."""
    return shared_shares(overlap(candidate, reference), F.size(candidate), F.size(reference))


def shared_shares(both: Column, candidate: Column, reference: Column) -> Column:
    """(p, r, f) of how many n-grams are shared, of how many each side has."""
    p, r = F.coalesce(F.try_divide(both, candidate), F.lit(0.0)), F.coalesce(F.try_divide(both, reference), F.lit(0.0))
    return F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f"))


def _longest_common(a, b) -> int:
    """The table's rows as bits, one row at a time: a bit is clear where the row grows. (Hyyro, 2004)"""
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    masks = {}
    for y in places.keys() & set(a):
        bits = bytearray(len(b) // 8 + 1)
        for j in places[y]:
            bits[j >> 3] |= 1 << (j & 7)
        masks[y] = int.from_bytes(bits, "little")
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if mask := masks.get(x):
            up = row & mask
            row = ((row + up) | (row - up)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(IntegerType())
def _longest_common_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None or y is None else _longest_common(x, y) for x, y in zip(a, b)], dtype="Int32")


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of any length; 0 where one is null."""
    return _longest_common_udf(a, b)


def single_gold(results: DataFrame, gold: DataFrame, ks: list[int], words: int = 4) -> DataFrame:
    """One row for queries with one right answer: n, found, mean rank of the found ones, recall and MRR at each k, and the share of
    queries one of whose first 5 and 10 results has `words` of the answer's words in a row.

    results (query, id, rank, text), gold (query, id, answer). Words are lower case and parted by white space; an answer of fewer
    words counts as a whole.
    """
    flat = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")), F.lit(" "))
    said = F.split(F.trim(flat(F.col("answer"))), " ")
    runs = F.when(F.size(said) >= words, F.transform(F.sequence(F.lit(1), F.size(said) - (words - 1)), lambda i: F.array_join(F.slice(said, i, words), " "))).otherwise(F.array(F.trim(flat(F.col("answer")))))
    asked = gold.select("query", F.col("id").alias("gold"), F.filter(runs, lambda r: r != "").alias("runs"))
    each = asked.join(results.select("query", "id", "rank", flat(F.col("text")).alias("t")), "query", "left")
    overlap = F.exists("runs", lambda r: F.contains("t", r))
    per = each.groupBy("query").agg(
        F.min(F.when(F.col("id") == F.col("gold"), F.col("rank"))).alias("at"), *[F.max(F.coalesce(overlap & (F.col("rank") <= k), F.lit(False)).cast("int")).alias(f"o{k}") for k in (5, 10)]
    )
    at = [F.round(F.avg(F.coalesce((F.col("at") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]
    mrr = [F.round(F.avg(F.when(F.col("at") <= k, 1 / F.col("at")).otherwise(0.0)), 6).alias(f"mrr_{k}") for k in ks]
    return per.agg(F.count("*").alias("n"), F.count("at").alias("found"), F.round(F.avg("at"), 6).alias("mean_rank"), *at, *mrr, *[F.round(F.avg(f"o{k}"), 6).alias(f"overlap_{k}") for k in (5, 10)])


def means_per_group(scores: DataFrame, group: str, measures: list[str], digits: int = 4) -> DataFrame:
    """(group, n, mean of every measure, rounded); rows without a group are left out."""
    return scores.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in measures])
