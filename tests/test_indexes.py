"""The stored text and vector indexes: segments, compaction, boolean questions, covers, cells."""

import collections
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import text_index as I
from quern.operators import vector_index as V

WORDS = ["red", "green", "blue", "apple", "pear", "plum", "old", "new"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    return {i: " ".join(rng.choices(WORDS, range(8, 0, -1), k=rng.randrange(0, 25))) for i in range(60)} | {60: None, 61: "", 62: "pear plum", 63: "red " * 300 + "new"}


@pytest.fixture(scope="module")
def segmented(spark, texts, tmp_path_factory):
    """An index of several segments that replace and take away documents, and the texts that are alive in it."""
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    I.write_segment(frame([(i, "old text of another kind") for i in range(30)]), path)
    I.write_segment(frame([(i, t) for i, t in texts.items() if i < 40]), path, gone=frame([(3, None), (29, None)]).select("doc_id"))
    I.write_segment(frame([(i, t) for i, t in texts.items() if i >= 40] + [(5, "changed apple")]), path, gone=frame([(7, None), (39, None)]).select("doc_id"))
    I.write_segment(frame([(5, "changed apple")]), path)
    I.write_segment(frame([(5, "changed apple")]), path, 3)  # a batch may run again
    alive = {i: t for i, t in texts.items() if i not in (7, 39)} | {5: "changed apple"}
    return path, alive


def fits(words, part):
    kind = part[0]
    if kind == "and":
        return fits(words, part[1]) and fits(words, part[2])
    if kind == "or":
        return fits(words, part[1]) or fits(words, part[2])
    if kind == "not":
        return not fits(words, part[1])
    own = part[1].lower().split() if kind == "words" else []
    return any(words[i : i + len(own)] == own for i in range(max(1, len(words) - len(own) + 1))) if own else True


QUESTIONS = [
    "red", "red apple", "red AND (green OR blue) AND NOT plum", '"red red"', '"red green" OR "pear plum"', "NOT red", "NOT (red OR green)", '(("old red" AND NOT new) OR plum) NOT "green blue"',
    "", "AND red OR", "red ) blue", "(red", "nowhere OR plum", "NOT nowhere", "NOT NOT plum", "...", "OR", "red NOT",
]


def test_parse():
    assert I.parse("a b OR NOT (c AND d)") == ("or", ("and", ("words", "a"), ("words", "b")), ("not", ("and", ("words", "c"), ("words", "d"))))
    assert I.parse('"a OR b" NOT c') == ("and", ("words", "a OR b"), ("not", ("words", "c")))
    assert I.parse("") == I.parse("()") == I.parse("NOT") == ("all",) and I.parse("OR x AND") == ("words", "x")


@pytest.mark.parametrize("question", QUESTIONS)
def test_boolean_search(spark, segmented, question):
    path, alive = segmented
    found = sorted(r.doc_id for r in I.boolean_search(spark, path, question).collect())
    tree = I.parse(question if question != "..." else "")
    assert found == sorted(i for i, t in alive.items() if fits((t or "").split(), tree))


def brute_covers(words, terms):
    spans = [(a, b) for a in range(len(words)) for b in range(a, len(words)) if terms <= set(words[a : b + 1])]
    return [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]


@pytest.mark.parametrize("question", ["apple", "red new", "plum pear red", "nowhere red", ""])
def test_cover_density(spark, segmented, question):
    path, alive = segmented
    want = []
    for i, t in alive.items():
        own = brute_covers((t or "").split()[-60:] if i == 63 else (t or "").split(), set(question.split())) if question else []
        if own and i != 63:
            want.append((i, len(own), round(sum(1 / (b - a + 1) for a, b in own), 6)))
    got = [tuple(r) for r in I.cover_density(spark, path, question, 100).collect() if r.doc_id != 63]
    assert got == sorted(want, key=lambda x: (-x[2], x[0]))


def bm25_of(spark, path):
    return {q: [tuple(r) for r in I.search_index(spark, path, q, 100).collect()] for q in ("red apple", "pear plum plum", "old", "changed kind")}


def test_compaction_changes_no_answer(spark, segmented, tmp_path):
    path, alive = segmented
    fresh = f"file://{tmp_path}/fresh"
    I.index_all(spark.createDataFrame(list(alive.items()), "doc_id long, text string"), fresh)
    before = bm25_of(spark, path)
    assert before == bm25_of(spark, fresh) and len(before["red apple"]) > 20
    assert I.collection(spark, path) == I.collection(spark, fresh) == (len(alive), sum(len((t or "").split()) for t in alive.values()))
    assert I.compact(spark, path) == 1 and bm25_of(spark, path) == before
    root = Path(path.removeprefix("file://"))
    assert sorted(p.name for p in root.iterdir()) == ["generation=0", "generation=1"]
    assert I.drop_old(spark, path) == [0] and bm25_of(spark, path) == before
    assert len(list((root / "generation=1" / "stats").glob("segment=*"))) == 1
    assert I.write_segment(spark.createDataFrame([(5, "kind")], "doc_id long, text string"), path) == 1
    assert [r.doc_id for r in I.search_index(spark, path, "kind changed").collect()] == [5]
    I.compact(spark, path)
    assert [r.doc_id for r in I.search_index(spark, path, "kind changed").collect()] == [5]


def test_search_reads_asked_buckets_and_no_documents(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BUCKET_WORDS", 50)
    monkeypatch.setattr(I, "PART_DOCS", 10)
    path = f"file://{tmp_path}/i"
    I.index_all(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path)
    buckets = {p.name for p in (tmp_path / "i/generation=0/postings/segment=0").glob("bucket=*")}
    assert len(buckets) > 4
    term = spark.createDataFrame([("plum",)], "t string").select(I._bucket("t", spark.read.parquet(f"{path}/generation=0/stats").first().buckets)).first()[0]
    files = I.postings_of(spark, path, ["plum"]).inputFiles()
    plan = I.search_index(spark, path, "plum")._jdf.queryExecution().executedPlan().toString()
    assert f"bucket#" in plan and str(term) in plan and "/documents" not in plan and len(files) > 0
    hot = list((tmp_path / "i/generation=0/postings/segment=0").glob("bucket=*/*.parquet"))
    assert len(hot) > len(buckets)  # terms of many documents lie in several files
    assert {r.doc_id for r in I.search_index(spark, path, "red", 100).collect()} == {i for i, t in texts.items() if "red" in (t or "").split()}


# --- vectors --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(32)
    middles = rng.normal(size=(25, 24))
    own = middles[rng.integers(0, 25, 1500)] + rng.normal(size=(1500, 24)) * 0.35
    return np.vstack([own, own[:40], own[:300] * 2])


@pytest.fixture(scope="module")
def stored(spark, vectors, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vectors')}/v"
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vectors)]
    odd = [(9000, None, "c"), (9001, [0.0] * 24, "c"), (9002, [float("nan")] * 24, "c"), (9003, [1.0] * 3, "c"), (9004, [None] * 24, "c"), (9005, [float("inf")] * 24, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cell string")
    old, V.PART_ROWS = V.PART_ROWS, 60
    try:
        assert V.build(df, path, cells=30, sample=500) <= 30
    finally:
        V.PART_ROWS = old
    return path, df


def exact_scores(vectors, q):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(unit @ (np.array(q) / np.linalg.norm(q)), 4)


def test_every_vector_is_indexed_and_probes_read_folders(spark, stored, vectors):
    path, _ = stored
    assert sorted(r.id for r in spark.read.parquet(f"{path}/vectors").select("id").collect()) == list(range(len(vectors)))
    q = vectors[3].tolist()
    cells = V.probed(spark, path, q, 2)
    plan = V.in_cells(spark, path, cells, q)
    read = {f.split("cell=")[1].split("/")[0] for f in plan.select("id", F.input_file_name().alias("f")).select("f").distinct().toPandas()["f"]}
    assert read == {str(c) for c in cells} and max(r.parts for r in spark.read.parquet(f"{path}/cells").collect()) > 1


def test_exact_way_equals_brute_force(spark, stored, vectors):
    path, _ = stored
    rng = np.random.default_rng(33)
    for q in (vectors[10], vectors[700] * 5, rng.normal(size=24)):
        s = exact_scores(vectors, q)
        want = sorted(range(len(s)), key=lambda i: (-s[i], i))[:10]
        got = V.search(spark, path, q.tolist(), 10, probes=1, exact=True).orderBy("rank").collect()
        assert [r.id for r in got] == want and np.allclose([r.score for r in got], s[want], atol=1.1e-4)
    assert V.search(spark, path, [0.0] * 24).count() == 0


def test_recall_of_probed_cells(spark, stored, vectors, monkeypatch):
    monkeypatch.setattr(V, "ASKED", 40)
    path, df = stored
    asked = df.where("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in V.search_all(asked, path, 10, probes=6).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    assert set(got) == set(range(0, len(vectors), 20))
    hits = total = 0
    for i, found in got.items():
        s = exact_scores(vectors, vectors[i])
        s[i] = -2
        bar = np.sort(s)[-10]
        assert len(found) == len(set(found)) == 10 and i not in found
        hits += sum(s[j] >= bar - 1e-4 for j in found)
        total += 10
    assert hits / total >= 0.9
    assert V.search_all(asked.limit(0), path).count() == 0


def test_postings_are_grouped_where_documents_are_read(spark, texts, monkeypatch):
    monkeypatch.setattr(I, "KERNEL_WORDS", 40)
    postings, _ = I._tokenised(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text")
    want = {(w, i, len((t or "").split()), tuple(p for p, x in enumerate(t.split()) if x == w)) for i, t in texts.items() for w in set((t or "").split())}
    assert sorted((r.term, r.doc_id, r.len, tuple(r.positions)) for r in postings.collect()) == sorted(want)
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_replaced_documents_leave_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(I, "MOST_REPLACED", most)
    ids = [0, 1, 62, 63, 64, -1, -64, -65, 2**62, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(i, s) for i in ids for s in (0, 1)], "doc_id long, segment int")
    dead = spark.createDataFrame([(i, 1) for i in ids[::2]] + [(1, 0), (7, 0), (1, 0)], "doc_id long, segment int")
    kept = I._kept(rows, dead)
    assert sorted(tuple(r) for r in kept.collect()) == sorted([(i, 0) for i in ids if i != 1] + [(i, 1) for i in ids[1::2]])
