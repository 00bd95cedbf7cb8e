"""Relational operators: as-of joins, keyed merges, versions and history, samples and splits, encodings, windows of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lineage import in_ranges


# --- joins ----------------------------------------------------------------------------------------------------------


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of right's latest row of the same key at or before left_time (null if there is none).

    Both sides go through one window over their union, sorted by time with right before left: one shuffle on the key and no
    range join. Right rows should be unique per key and time.
    """
    columns = left.columns
    a = left.select(*columns, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values], F.lit(None).cast("boolean").alias("_is"))
    b = right.select(
        *[F.col(key).alias(c) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns],
        F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_is"),
    )
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_is"), F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    both = a.unionByName(b).withColumn("_last", last).where("_side = 1")
    return both.select(*columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def filtered_by_meta(df: DataFrame, meta: str, wanted: dict[str, str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows whose map column agrees with every wanted entry; an absent key passes, and aliases of a value count as it."""
    rules = [F.coalesce(F.try_element_at(F.col(meta), F.lit(k)).isin(v, *(aliases or {}).get(v, [])), F.lit(True)) for k, v in wanted.items()]
    return df.where(reduce(lambda a, b: a & b, rules, F.lit(True)))


def not_blank(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.length(F.trim(c)) > 0) for c in names])


def prefixed(name: str, some: list[str], none: list[str] = ()) -> Column:
    """Starts with any of `some` and none of `none`."""
    out = reduce(lambda a, b: a | b, [F.col(name).startswith(p) for p in some])
    return reduce(lambda a, p: a & ~F.col(name).startswith(p), none, out)


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that df has, in that order."""
    return df.select(*[c for c in names if c in df.columns])


# --- merges and history ---------------------------------------------------------------------------------------------


def merge(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None, update: list[str] | None = None) -> DataFrame:
    """Upsert: source rows replace target rows of the same keys; the last source row by `order` wins.

    With update, only those columns take the source's value (where not null); the others keep the target's.
    """
    names = target.columns
    t = target.select("*", F.lit(0).alias("_from"), F.lit(None).cast(source.schema[order].dataType).alias("_order") if order else F.lit(0).alias("_order"))
    s = source.select(*names, F.lit(1).alias("_from"), F.col(order).alias("_order") if order else F.lit(0).alias("_order"))
    if update is None:
        rest = [c for c in names if c not in keys]
        best = F.max_by(F.struct(*rest), F.struct("_from", F.col("_order").isNotNull().alias("set"), "_order"))
        return t.unionByName(s).groupBy(*keys).agg(best.alias("_b")).select(*[c if c in keys else F.col(f"_b.{c}").alias(c) for c in names])
    new = F.struct("_from", "_order")
    agg = [
        (F.coalesce(F.max_by(c, F.when((F.col("_from") == 1) & F.col(c).isNotNull(), new)), F.max_by(c, F.when(F.col("_from") == 0, new))) if c in update
         else F.coalesce(F.max_by(c, F.when(F.col("_from") == 0, new)), F.max_by(c, new))).alias(c)
        for c in names if c not in keys
    ]
    return t.unionByName(s).groupBy(*keys).agg(*agg).select(*names)


def insert_or_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and the source rows whose keys it lacks."""
    return target.unionByName(source.select(*target.columns).join(target.select(*keys).distinct(), keys, "left_anti"))


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def fill_missing(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """target with null values of a column taken from source."""
    new = source.groupBy(key).agg(F.max(value).alias("_new"))
    return target.join(new, key, "left").withColumn(value, F.coalesce(value, "_new")).select(*target.columns)


def numbered_versions(df: DataFrame, key: str, order: list[str], expiry: str) -> DataFrame:
    """Versions of every key in order: version from 1, status active for the last and replaced before, expiry of the replaced."""
    w = Window.partitionBy(key).orderBy(*order)
    after = F.lead(expiry).over(w)
    return df.withColumns({"version": F.row_number().over(w).cast("long"), "status": F.when(after.isNull(), "active").otherwise("replaced"), "expired_at": after})


def change_history(log: DataFrame, key: str, time: str, tie: str, state: str, deleted: Column) -> DataFrame:
    """Slowly changing rows from a change log: valid_from, valid_to (the next change), is_current, change_type."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gone, was_gone = deleted, F.lag(deleted).over(w)
    kind = F.when(F.lag(F.col(tie)).over(w).isNull(), "insert").when(gone, "delete").when(was_gone, "restore").otherwise("update")
    return log.select(
        key, state, F.col(time).alias("valid_from"), F.lead(time).over(w).alias("valid_to"), F.lead(tie).over(w).isNull().alias("is_current"), kind.alias("change_type"), tie
    )


# --- samples, splits, ranks -----------------------------------------------------------------------------------------


def hashed(id_col: str, seed: int = 42) -> Column:
    """A hash to order rows by, the same on every engine that has MD5."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_share(id_col: str, seed: int = 42) -> Column:
    """A whole number from 0 to 2^32 - 1 for every id."""
    return F.conv(F.substr(hashed(id_col, seed), F.lit(1), F.lit(8)), 16, 10).cast("long")


def fold(id_col: str, k: int, seed: int = 42) -> Column:
    return (hash_share(id_col, seed) % k).cast("long")


def hash_split(id_col: str, shares: list[tuple[str, float]], seed: int = 42) -> Column:
    """A named part for every id by its hash alone: no shuffle, and the same id always lands in the same part."""
    out, edge = F.lit(shares[-1][0]), 1.0 - shares[-1][1]
    for name, share in reversed(shares[:-1]):
        out = F.when(hash_share(id_col, seed) < F.lit(int(round(edge * (1 << 32)))), name).otherwise(out)
        edge -= share
    return out


def time_split(df: DataFrame, order: list[str], shares: tuple[float, float] = (0.7, 0.85)) -> DataFrame:
    """train, val and test by time order: the first 70 %, the next 15 % and the rest.

    Rows are range-partitioned by the order, counted per partition and numbered from those offsets, so that no window over
    the whole table puts it into one task. The order must name every row.
    """
    keyed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sizes = keyed.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = sizes.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before")
    out = keyed.join(F.broadcast(offsets), "_p").withColumn("_i", place)
    a, b = F.floor(F.lit(shares[0]) * F.col("_n")), F.floor(F.lit(shares[1]) * F.col("_n"))
    return out.withColumn("split", F.when(F.col("_i") <= a, "train").when(F.col("_i") <= b, "val").otherwise("test")).drop("_p", "_before", "_n", "_i")


def stratified_sample(df: DataFrame, stratum: str, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """About size rows: max(1, round(size * n_g / N)) of every stratum, those with the smallest hashes."""
    counts = df.groupBy(stratum).count()
    quota = counts.select(stratum, F.greatest(F.lit(1), F.round(F.lit(size) * F.col("count") / F.sum("count").over(Window.partitionBy()))).cast("long").alias("_quota"))
    w = Window.partitionBy(stratum).orderBy(hashed(id_col, seed), id_col)
    return df.join(F.broadcast(quota), stratum).withColumn("_i", F.row_number().over(w)).where("_i <= _quota").select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows of a key per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")


def average_rank(value: Column, descending: bool = False) -> Column:
    """Rank over all rows, ties sharing the mean of their places, cut to a whole number. For tables of models and the like."""
    w = Window.orderBy(value.desc() if descending else value.asc())
    ties = F.count("*").over(Window.partitionBy(value))
    return F.floor(F.rank().over(w) + (ties - 1) / 2).cast("long")


# --- features -------------------------------------------------------------------------------------------------------


def date_parts(c: str) -> dict[str, Column]:
    m = F.month(c)
    return {
        "month": m.cast("long"),
        "quarter": F.quarter(c).cast("long"),
        "weekday": F.weekday(c).cast("long"),
        "hour": F.hour(c).cast("long"),
        "is_weekend": (F.weekday(c) >= 5).cast("long"),
        "season": F.when(m.isin(3, 4, 5), 1).when(m.isin(6, 7, 8), 2).when(m.isin(9, 10, 11), 3).otherwise(4).cast("long"),
    }


def minutes_between(later: str, earlier: str) -> Column:
    return (F.unix_micros(F.col(later).cast("timestamp")) - F.unix_micros(F.col(earlier).cast("timestamp"))) / 6e7


def delay_status(c: Column, late: float = 15, early: float = -15) -> Column:
    return F.when(c > late, "LATE").when(c < early, "EARLY").otherwise("ON_TIME")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): classes in sorted order from 0; null counts as Unknown. As many rows as classes."""
    classes = df.select(F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias("value")).distinct()
    return classes.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("long"))


def encode_labels(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """df with <column>_code; classes that codes lacks get 0."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("Unknown"))
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(named, value == F.col("_value"), "left").withColumn(f"{column}_code", F.coalesce("_code", F.lit(0))).drop("_value", "_code")


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = df.agg(*[F.median(c).alias(f"_{c}") for c in columns])  # one row
    return df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def min_max(value: Column, *by: str) -> Column:
    """(x - min) / (max - min) within a group; 0 where the range is next to nothing."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-9, 0.0).otherwise((value - low) / (high - low))


# --- events ---------------------------------------------------------------------------------------------------------


def tumbling(events: DataFrame, time: str, width: str, *keys: str, aggs: list[Column]) -> DataFrame:
    return events.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w"), *keys).agg(*aggs)


def sliding(events: DataFrame, time: str, width: str, step: str, *keys: str, aggs: list[Column]) -> DataFrame:
    return events.groupBy(F.window(F.col(time).cast("timestamp"), width, step).alias("w"), *keys).agg(*aggs)


def sessions(events: DataFrame, time: str, gap: str, *keys: str, aggs: list[Column]) -> DataFrame:
    return events.groupBy(F.session_window(F.col(time).cast("timestamp"), gap).alias("w"), *keys).agg(*aggs)


def delay_bucket(minutes: Column) -> Column:
    """Early by a quarter of an hour or more, on time up to a quarter late, a moderate delay up to an hour, else a severe one."""
    return F.when(minutes <= -15, "EARLY").when(minutes <= 15, "ON_TIME").when(minutes <= 60, "MODERATE_DELAY").when(minutes > 60, "SEVERE_DELAY")


def kept_rows(df: DataFrame, deleted: str | None = None, active: str | None = None) -> DataFrame:
    """Rows that are not marked as deleted and, where named, are marked as active; an unset mark counts as not deleted and not active."""
    rows = df if deleted is None else df.where(F.col(deleted).isNull())
    return rows if active is None else rows.where(F.coalesce(F.col(active), F.lit(False)))


def uploads(files: DataFrame, suffixes: list[str], name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): files whose suffix is allowed, and the others with an error; rows without a name are in neither."""
    suffix = F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/\\\\]*)$", 1), r".(\.[^.]*)$", 1))
    rows = files.where(F.coalesce(F.col(name), F.lit("")) != "").withColumn("suffix", suffix)
    fits = F.col("suffix").isin(*suffixes)
    return rows.where(fits), rows.where(~fits).withColumn("error", F.concat(F.lit("Unsupported file type: "), F.col("suffix")))


def natural_key_ids(target: DataFrame, source: DataFrame, key: str, id_col: str = "id", order: str | None = None) -> DataFrame:
    """source with ids: that of the target's row with the same key (the smallest), one new id for all rows that share a key the target
    lacks, and one for each row without a key. New ids follow the target's largest, by key, then by order."""
    known = target.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min(id_col).alias("_old"))
    rows = source.join(known, key, "left")
    bare = F.coalesce(F.col(key), F.lit("")) == ""
    place = F.when(bare, F.struct(F.lit(1).alias("b"), F.lit("").alias("k"), F.col(order or key).cast("string").alias("o"))).otherwise(F.struct(F.lit(0).alias("b"), F.col(key).cast("string").alias("k"), F.lit("").alias("o")))
    fresh = rows.where("_old is null").withColumn("_place", place)
    places = fresh.select("_place").distinct()
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]
    number = F.row_number().over(Window.partitionBy("_part").orderBy("_place")) + F.col("_before") + F.lit(top)
    numbered = in_ranges(fresh.select("_place").distinct(), "_place").select("_place", number.alias("_new"))
    out = rows.where("_old is not null").withColumn(id_col, F.col("_old").cast("long")).drop("_old")
    return out.unionByName(fresh.join(numbered, "_place").withColumn(id_col, F.col("_new").cast("long")).drop("_old", "_new", "_place"))
