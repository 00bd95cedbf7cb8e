"""Running sums and windows over arrays of lengths: Arrow kernels in linear time. Texts stay in the JVM, only lengths travel.

A fold over an array copies what it has gathered at each step; these kernels do not. Inside explode, Spark does not find a kernel
again whose input has a lambda within a lambda; inputs here have none, and a column made by such lambdas is selected first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

RANGES = ArrayType(StructType().add("first", IntegerType()).add("size", IntegerType()))


def _lists(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all arrays in one, where each array begins in them and the last ends); null arrays are empty."""
    sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of neighbours of about `most` in sum, one element at least: what a kernel takes at once of a batch."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


@F.arrow_udf(ArrayType(IntegerType()))
def _sums(lengths: pa.Array) -> pa.Array:
    values, at = _lists(lengths)
    total = np.concatenate([[0], np.cumsum(values)])
    own = total[1:] - np.repeat(total[at[:-1]], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(own.astype(np.int32)), mask=lengths.is_null())


def sums(lengths: Column) -> Column:
    """Of each array of whole numbers the sums up to each of its elements; null for null."""
    return _sums(lengths)


def _windows(sizes: np.ndarray, most: int, carry: Callable[[np.ndarray, int, int], int]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of neighbours of at most `most` in sum, at least one each; carry says where the run after [a, b) may begin,
    and it begins at b where that with the next element would be too much. A step per run."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    a, least = 0, 1
    while a < len(sizes):
        b = max(int(np.searchsorted(total, total[a] + most, "right")) - 1, least)
        yield a, b
        if b >= len(sizes):
            return
        start = carry(total, a, b)
        a, least = (start if total[b + 1] - total[start] <= most else b), b + 1


def _ranges(carry: Callable[[np.ndarray, int, int], int], most: int):
    @F.arrow_udf(RANGES)
    def run(sizes: pa.Array) -> pa.Array:
        values, at = _lists(sizes)
        first, size, ends = [], [], [0]
        for i in range(len(at) - 1):
            for a, b in _windows(values[at[i] : at[i + 1]], most, carry):
                first.append(a)
                size.append(b - a)
            ends.append(len(first))
        rows = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(size, pa.int32())], ["first", "size"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=sizes.is_null())

    return run


def by_size(sizes: Column, most: int, overlap: int = 0) -> Column:
    """Runs (first, size) of neighbours with positive sizes of at most `most` in sum; the last elements of a run, up to `overlap` in
    sum, begin the next one where the next element still fits. An element over `most` is a run of its own."""
    return _ranges(lambda total, a, b: max(a, int(np.searchsorted(total, total[b] - overlap, "left"))), most)(sizes)


def by_count(sizes: Column, most: int, overlap: int = 0) -> Column:
    """As by_size, but `overlap` is how many elements of a run begin the next."""
    return _ranges(lambda total, a, b: max(a, b - overlap), most)(sizes)


def joined(parts: Column, ranges: Column, between: str) -> Column:
    """The parts of each run as one text. The pair is bound once, so that parts are not computed for each run."""
    pair = F.array(F.struct(parts.alias("p"), ranges.alias("r")))
    return F.flatten(F.transform(pair, lambda x: F.transform(x["r"], lambda r: F.array_join(F.slice(x["p"], r["first"] + 1, r["size"]), between))))
