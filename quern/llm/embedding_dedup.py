"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where the bound leaves a doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quern.llm.components import connected_components, local_roots
from quern.llm.storage import materialise

#: Vectors to a tile, and tiles to a block; a task compares two blocks.
TILE, BLOCK_TILES = 512, 8
STRIPE = 512
LINK_SCHEMA = "rep long, links long, root long"


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the Euclidean norm of what the codes miss, for unit vectors in double precision."""
    scale = np.abs(unit).max(axis=1, initial=0.0) / 127.0
    scale[scale == 0] = 1.0
    code = np.rint(unit / scale[:, None])
    return code.astype(np.int8), scale, np.linalg.norm(unit - code * scale[:, None], axis=1)


class Block:
    """Vectors with the int8 codes, scales, error norms and lengths that their tiles hold."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, scales: np.ndarray, errors: np.ndarray, norms: np.ndarray):
        self.vectors, self.codes, self.scales, self.errors, self.norms = vectors, codes, scales, errors, norms

    @classmethod
    def of(cls, vectors: np.ndarray) -> Block:
        norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        return cls(vectors, *quantise(vectors / norms[:, None]), norms)


def linked_pairs(a: Block, b: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b whose cosine is at least threshold; of one block (same), only pairs i < j.

    With u = s q + e for codes q, |u.v - s_u s_v q_u.q_v| <= |e_u| + (1 + |e_u|) |e_v| for unit vectors: what this bound
    keeps under the threshold is no link, and all others are computed again in double precision.
    """
    exact = np.float32 if a.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay whole numbers
    wide = b.codes.astype(exact).T
    for top in range(0, len(a.codes), STRIPE):
        rows = slice(top, top + STRIPE)
        product = (a.codes[rows].astype(exact) @ wide).astype(np.float64) * (a.scales[rows, None] * b.scales[None, :])
        maybe = product + (a.errors[rows, None] + (1 + a.errors[rows, None]) * b.errors[None, :]) + 1e-9 >= threshold
        if same:
            maybe &= np.arange(len(b.codes))[None, :] > np.arange(top, top + maybe.shape[0])[:, None]
        i, j = np.nonzero(maybe)
        i += top
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            hit = np.einsum("ij,ij->i", a.vectors[x].astype(np.float64), b.vectors[y].astype(np.float64)) / (a.norms[x] * b.norms[y]) >= threshold
            yield x[hit], y[hit]


#: A tile's columns of bytes, and the types of numbers in them.
TILE_COLUMNS = {"reps": "<i8", "copies": "<i8", "codes": "i1", "scales": "<f8", "errors": "<f8", "norms": "<f8"}


def _tile(kind: str):
    """Packs the rows of a tile; vectors keep the type they came in (kind), which doubles are made of where they are needed."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        block = Block.of(flat.reshape(table.num_rows, -1))
        own = {
            "reps": table.column("rep").to_numpy(), "copies": table.column("copies").to_numpy(),
            "codes": block.codes, "scales": block.scales, "errors": block.errors, "norms": block.norms,
        }
        keys = {"label": pa.array([key[0].as_py()], pa.string()), "dim": pa.array([key[1].as_py()], pa.int32()), "tile": pa.array([key[2].as_py()], pa.int64())}
        held = {k: pa.array([own[k].astype(t).tobytes()], pa.binary()) for k, t in TILE_COLUMNS.items()}
        return pa.table({**keys, **held, "vectors": pa.array([flat.tobytes()], pa.binary())})

    return run


def _compare(threshold: float, kind: str):
    """The links of two blocks: how many each row has, and a root for each that stands for all it reaches here. Links are
    settled into roots as they come, so that blocks of like vectors hold no list of their pairs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, left, right = key[1].as_py(), key[2].as_py(), key[3].as_py()
        block = table.column("block").to_numpy()

        def gather(which: int) -> tuple[np.ndarray, np.ndarray, Block]:
            part = table.filter(pa.array(block == which))
            join = lambda name, t: np.frombuffer(b"".join(part.column(name).to_pylist()), t)
            own = {k: join(k, t) for k, t in TILE_COLUMNS.items()}
            return own["reps"], own["copies"], Block(join("vectors", kind).reshape(-1, dim), own["codes"].reshape(-1, dim), own["scales"], own["errors"], own["norms"])

        ra, ca, va = gather(left)
        same = left == right
        rb, cb, vb = (ra, ca, va) if same else gather(right)
        shift = 0 if same else len(ra)
        reps = ra if same else np.concatenate([ra, rb])
        links = np.zeros(len(reps), np.int64)
        order = np.argsort(reps, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        root, xs, ys, held = np.arange(len(reps)), [], [], 0

        def settle() -> np.ndarray:
            return local_roots(len(reps), np.concatenate([np.arange(len(reps)), *xs]), np.concatenate([root, *ys]))

        for x, y in linked_pairs(va, vb, threshold, same):
            np.add.at(links, x, cb[y])
            np.add.at(links, y + shift, ca[x])
            xs.append(place[x])
            ys.append(place[y + shift])
            held += len(x)
            if held > 1 << 20:
                root, xs, ys, held = settle(), [], [], 0
        if xs:
            root = settle()
        keep = np.flatnonzero(links)
        out = {"rep": reps[keep], "links": links[keep], "root": reps[order][root[place[keep]]]}
        return pa.table(out)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row of vectors: its id, n_links (other rows linked directly), component_id (smallest id reachable) and kept.

    Rows are compared when labels are equal and not null, by cosine in double precision, and link at threshold or more.
    Null vectors, zero vectors and vectors with null or non-finite components, and rows without label or id, link with
    nothing: no links, their own component, kept. Vectors of unlike length never link. Equal vectors of a label are one
    class: compared once, counted as often as they stand there (a repeated row links with its other copy). Extra columns
    are ignored. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    # Equal vectors are told by 128 bits of hash, so that each full vector is shuffled once, and once for each distinct one.
    rows = rows.withColumn("usable", usable).withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(5), "embedding", F.lit(3))})
    kind = "<f4" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    named = materialise(rows.select("vec_id", "label", "usable", "h", "g"), "vectors")
    classes = materialise(
        rows.where("usable").groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")),
        "classes",
    )
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles"))
    placed = classes.join(counts, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("h"), "tiles"))
    held = ", ".join(f"{k} binary" for k in TILE_COLUMNS)
    tiles = placed.select("label", "dim", "tile", "embedding", "rep", "copies").groupBy("label", "dim", "tile").applyInArrow(
        _tile(kind), f"label string, dim int, tile long, {held}, vectors binary"
    )
    tiles = materialise(tiles, "tiles").withColumn("block", F.floor(F.col("tile") / BLOCK_TILES))
    blocks = tiles.groupBy("label", "dim").agg((F.max("block") + 1).alias("blocks"))
    pairs = (
        tiles.join(blocks, ["label", "dim"])
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("label", "dim", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", *TILE_COLUMNS, "vectors")
    )
    found = materialise(pairs.groupBy("label", "dim", "left", "right").applyInArrow(_compare(threshold, kind), LINK_SCHEMA), "found")
    component = connected_components(found, "rep", "root").withColumnsRenamed({"node": "rep"})
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    answers = materialise(
        classes.select("label", "h", "g", "rep", "copies").join(links, "rep", "left").join(component, "rep", "left")
        .select(
            "label", "h", "g",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        ),
        "answers",
    )
    linked = named.where("usable").join(answers, ["label", "h", "g"]).select("vec_id", "n_links", "component_id")
    alone = named.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
