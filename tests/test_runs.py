"""Windows and offsets over arrays of lengths: against plain loops, and in time linear in a text."""

import random
import re
import time

from pyspark.sql import functions as F

from quern.functions import matching as M
from quern.functions import runs as R
from quern.functions import text as T
from quern.operators import documents as D


def packed(sizes, most, overlap, by_count):
    """Runs as lists of places, element by element."""
    done, own = [], []
    for i, n in enumerate(sizes):
        if own and sum(sizes[j] for j in own) + n > most:
            done.append(own)
            tail = []
            for j in reversed(own):
                if (len(tail) + 1 if by_count else sum(sizes[k] for k in tail) + sizes[j]) > overlap:
                    break
                tail.insert(0, j)
            own = tail if sum(sizes[j] for j in tail) + n <= most else []
        own = [*own, i]
    return [*done, own] if own else done


def test_runs_against_loops(spark):
    r = random.Random(5)
    lists = [None, [], [100], [3, 3, 3]] + [[r.choice([1, 2, 3, 7, 20]) for _ in range(r.randint(0, 30))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, n array<int>").repartition(3)
    for most, overlap in ((10, 4), (6, 6), (9, 0), (1, 1)):
        found = df.select("id", R.sums(F.col("n")).alias("s"), R.by_size(F.col("n"), most, overlap).alias("z"), R.by_count(F.col("n"), most, overlap // 2).alias("c")).collect()
        assert len(found) == len(lists)
        for row in found:
            n = lists[row.id]
            if n is None:
                assert row.s is None and row.z is None and row.c is None
                continue
            assert row.s == [sum(n[: i + 1]) for i in range(len(n))]
            for got, by_count, over in ((row.z, False, overlap), (row.c, True, overlap // 2)):
                assert [list(range(x["first"], x["first"] + x["size"])) for x in got] == packed(n, most, over, by_count)


def test_offsets_against_re(spark):
    texts = [None, "", "12", "a12 b3", "x" * 50, "7 77 777é 7", "thatthathat that"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for row in df.select("id", D.spans("t", r"\d+").alias("s"), M.positions("t", "that").alias("p")).collect():
        text = texts[row.id]
        assert (row.s if text is None else [tuple(x) for x in row.s]) == (None if text is None else [(m[0], m.start(), m.end()) for m in re.finditer(r"\d+", text)])
        assert row.p == [m.start() for m in re.finditer("(?=that)", text or "")]


def test_a_text_of_many_sentences(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("Sentence number "), i.cast("string"), F.lit(" says it."))), " ")
    df = spark.range(1).select(text.alias("t"))
    start = time.time()
    row = df.select(F.size(D.sentence_window(T.sentences("t"), 64, 16, 1)).alias("chunks"), D.spans("t", r"\d+").alias("s"), F.size(M.positions("t", "says")).alias("p")).select("chunks", "p", F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    assert row.n == row.p == 100_000 and row.last.value == "100000" and row.last.end - row.last.start == 6
    assert row.chunks == -(-(100_000 - 12) // 9) + 1  # twelve sentences of five words, the last three of them carried on
    assert time.time() - start < 60
