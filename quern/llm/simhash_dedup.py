"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts, tile pairs skipped by population counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components, local_roots
from quern.llm.storage import materialise

SEED = 42
#: Fingerprints to a tile row, and to one side of a comparing task.
TILE, SIDE = 128, 32_768
MASKS = np.array([0xFFFF << s for s in (48, 32, 16, 0)], np.uint64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, each set if over half of the shingle hashes have it; 0 without words.

    Whole text, A-Z lower-cased, split at ASCII white space; a shingle is `words` words joined by a space, and the whole
    sequence where there are fewer. Null counts as empty.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    last = len(parts) - words
    if last <= 0:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.zeros(len(parts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends)), np.uint64, last + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            names = [batch.schema.names[0], "fp", *batch.schema.names[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names)

    return run


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", *longs: str) -> DataFrame:
    """(doc_id, fp and the columns named in longs): the fingerprint of every whole text as a signed 64-bit number; null texts
    count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *longs)
    return rows.mapInArrow(_fingerprints(words), ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in longs)]))


def part_counts(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts of each fingerprint."""
    return np.bitwise_count(prints[:, None] & MASKS[None, :]).astype(np.int16)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b that differ in at most radius bits; of one side (same), pairs i < j in its inner order.

    Rows are ordered by the population counts of their parts. Rows of equal counts make a tile; a run of tiles of the other
    side whose counts differ by more than radius in sum is skipped, as every differing bit moves a count by at most one.
    """
    ca, cb = part_counts(a), part_counts(b)

    def order(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rank = np.lexsort((c[:, 3], c[:, 2], c[:, 1], c[:, 0]))
        sorted_ = c[rank]
        first = np.flatnonzero(np.r_[True, (np.diff(sorted_, axis=0) != 0).any(axis=1)]) if len(c) else np.zeros(0, np.int64)
        return rank, first, np.r_[first[1:], len(c)]

    ra, fa, ta = order(ca)
    rb, fb, tb = (ra, fa, ta) if same else order(cb)
    keys_a, keys_b = ca[ra][fa], cb[rb][fb]
    sorted_a, sorted_b = a[ra], b[rb]
    for t in range(len(fa)):
        near = np.flatnonzero(np.abs(keys_b - keys_a[t]).sum(axis=1) <= radius)
        if same:
            near = near[near >= t]
        if not len(near):
            continue
        index = np.concatenate([np.arange(fb[k], tb[k]) for k in near])
        other = sorted_b[index]
        step = max(1, (1 << 18) // len(other))
        for top in range(fa[t], ta[t], step):
            mine = np.arange(top, min(top + step, ta[t]))
            hit = np.bitwise_count(sorted_a[mine][:, None] ^ other[None, :]) <= radius
            i, j = np.nonzero(hit)
            x, y = mine[i], index[j]
            if same:
                up = x < y
                x, y = x[up], y[up]
            if len(x):
                yield ra[x], rb[y]


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table(
        {
            "high": pa.array([key[0].as_py()], pa.int32()),
            "low": pa.array([key[1].as_py()], pa.int32()),
            "tile": pa.array([key[2].as_py()], pa.int64()),
            "prints": pa.array([table.column("fp").to_numpy().astype("<i8").tobytes()], pa.binary()),
        }
    )


def _compare(radius: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        left = tuple(k.as_py() for k in key[:3])
        same = left == tuple(k.as_py() for k in key[3:])
        is_left = table.column("is_left").to_numpy(zero_copy_only=False)

        def gather(which: bool) -> np.ndarray:
            return np.frombuffer(b"".join(table.filter(pa.array(is_left == which)).column("prints").to_pylist()), "<u8")

        pa_ = gather(True)
        pb = pa_ if same else gather(False)
        shift = 0 if same else len(pa_)
        # Nodes are the fingerprints themselves, as signed numbers; document ids, which may be null, play no part here.
        nodes = (pa_ if same else np.concatenate([pa_, pb])).view("<i8")
        order = np.argsort(nodes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root = np.arange(len(nodes), dtype=np.int64)
        touched = np.zeros(len(nodes), bool)
        xs, ys, held = [], [], 0

        def settle() -> np.ndarray:
            every = np.arange(len(nodes))
            return local_roots(len(nodes), np.concatenate([every, *xs]), np.concatenate([root, *ys]))

        for x, y in close_pairs(pa_, pb, radius, same):
            xs.append(place[x])
            ys.append(place[y + shift])
            touched[xs[-1]] = touched[ys[-1]] = True
            held += len(x)
            if held > 1 << 20:  # the links found so far are kept as roots alone
                root, xs, ys, held = settle(), [], [], 0
        if xs:
            root = settle()
        keep = np.flatnonzero(touched & (root != np.arange(len(nodes))))
        by_place = nodes[order]
        return pa.table({"fp": by_place[keep], "root": by_place[root[keep]]})

    return run


def neighbour_cells(radius: int) -> list[tuple[int, int]]:
    """Steps between cells (population counts of the two halves) that may hold a pair; one of each opposite two."""
    return [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x > 0 or y >= 0)]


def linked_classes(prints: DataFrame, radius: int = 4, side: int = SIDE) -> DataFrame:
    """(fp, root, component) of the distinct fingerprints: root is one fingerprint of all that are reachable from each other,
    component the smallest doc_id that any of them has, null if none has one.

    Fingerprints stand in cells by the population counts of their halves, (0..32, 0..32): at most 1,089 cells, whose sizes
    the driver knows. A cell is dealt into sides of about `side` rows; a task compares two sides of cells at most radius
    apart and returns a forest of the links it found, never the pairs.
    """
    spark = prints.sparkSession
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    celled = classes.withColumns({"high": half(32), "low": half(0)})
    sizes = celled.groupBy("high", "low").count().collect()  # at most 33 x 33
    if not sizes:
        return classes.select("fp", F.col("fp").alias("root"), F.col("rep").alias("component"))
    many = sum(r["count"] for r in sizes)
    sides = {(r["high"], r["low"]): -(-r["count"] // side) for r in sizes}
    tiles = F.create_map(*[F.lit(x) for r in sizes for x in (r["high"] * 33 + r["low"], -(-r["count"] // TILE))])
    per_side = side // TILE
    packed = celled.withColumn("tile", F.pmod(F.xxhash64("fp"), F.element_at(tiles, F.col("high") * 33 + F.col("low")))).groupBy("high", "low", "tile").applyInArrow(
        _pack, "high int, low int, tile long, prints binary"
    )
    packed = materialise(packed, "tiles", rows=many)
    steps = neighbour_cells(radius)
    targets = []
    for (h, low), n in sides.items():
        for x, y in steps:
            other = (h + x, low + y)
            if other in sides:
                targets.append((h, low, *other, n, sides[other]))
    pairs = spark.createDataFrame(targets, "high_a int, low_a int, high_b int, low_b int, n_a long, n_b long")  # at most 33 x 33 x 25 rows
    by_side = packed.withColumn("side", F.floor(F.col("tile") / per_side))
    one = by_side.join(F.broadcast(pairs), (F.col("high") == F.col("high_a")) & (F.col("low") == F.col("low_a"))).select(
        "high_a", "low_a", F.col("side").alias("side_a"), "high_b", "low_b", F.explode(F.expr("sequence(0L, n_b - 1)")).alias("side_b"), F.lit(True).alias("is_left"), "prints"
    )
    own = (F.col("high_a") == F.col("high_b")) & (F.col("low_a") == F.col("low_b"))
    two = by_side.join(F.broadcast(pairs), (F.col("high") == F.col("high_b")) & (F.col("low") == F.col("low_b"))).select(
        "high_a", "low_a", F.explode(F.expr("sequence(0L, n_a - 1)")).alias("side_a"), "high_b", "low_b", F.col("side").alias("side_b"), F.lit(False).alias("is_left"), "prints"
    )
    tasks = one.where(~own | (F.col("side_a") <= F.col("side_b"))).unionByName(two.where(~own | (F.col("side_a") < F.col("side_b"))))
    forest = tasks.groupBy("high_a", "low_a", "side_a", "high_b", "low_b", "side_b").applyInArrow(_compare(radius), "fp long, root long")
    found = connected_components(forest, "fp", "root").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = materialise(classes.join(found, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted", rows=many)
    # Most classes are alone; the others' smallest id goes by their root.
    least = rooted.groupBy("root").agg(F.min("rep").alias("component"))
    return materialise(rooted.join(least, "root").select("fp", "root", "component"), "components", rows=many)


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 lowercase hex digits, component_id) for every row of docs.

    Fingerprints link at radius or fewer differing bits; component_id is the smallest doc_id reachable, itself included.
    Null and empty texts have fingerprint zero and link like any other; very long texts are read whole. Rows without a doc_id
    link others as well; they get the component of their class (null if no doc_id is reachable). Ids are any 64-bit numbers.
    Repeated rows stay, one result each.
    """
    prints = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = linked_classes(prints, radius).select("fp", "component")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, with all columns: that of the group's smallest id.

    Where several rows of a group have that id, the one whose text has the smallest hash stays, and one of equal rows. Rows
    that repeat an id with texts of unlike groups stay, one for each group. Rows with a null id stay, as they name no
    document. An empty table gives an empty result.
    """
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())
    named = docs.where(F.col(id_col).isNotNull())
    prints = materialise(fingerprints(docs.withColumn("_text_key", text_key), words, id_col, text_col, "_text_key"), "fingerprints")
    roots = linked_classes(prints.select("doc_id", "fp"), radius)
    rows = prints.where("doc_id is not null").join(roots, "fp").where("doc_id = component")
    firsts = rows.groupBy("root").agg(F.min(F.struct("doc_id", "_text_key")).alias("first"), F.count("*").alias("copies"))
    kept = materialise(firsts.select(F.col("first.doc_id").alias("_kept_id"), F.col("first._text_key").alias("_kept_key"), F.col("copies").alias("_copies")), "kept")
    met = (named[id_col].cast("long") == kept["_kept_id"]) & (text_key == kept["_kept_key"])
    held = named.join(kept, met).select(*[named[c] for c in docs.columns], kept["_copies"].alias("_rows"))
    once = held.where("_rows = 1").select(*docs.columns)
    if not kept.where("_copies > 1").isEmpty():  # only where an id is repeated are rows gathered
        others = [c for c in docs.columns if c != id_col]
        again = held.where("_rows > 1").withColumn("_text_key", text_key).groupBy(id_col, "_text_key").agg(F.first(F.struct(*others)).alias("_row"))
        once = once.unionByName(again.select(id_col, "_row.*").select(*docs.columns))
    return once.unionByName(docs.where(F.col(id_col).isNull()))
