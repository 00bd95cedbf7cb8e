"""Queries whose work must grow with their input alone: same rows by brute force, and what their plans must not hold."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import dialogue as Q
from quern.operators import documents as D
from quern.operators import graph as G
from quern.operators import phrases as P
from quern.operators import retrieval as R
from quern.operators import search as S
from quern.operators import summarise as U
from quern.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_labels_are_made_where_texts_are_read(spark, sf, monkeypatch):
    monkeypatch.setattr(D, "KERNEL_BYTES", 100)
    rng = random.Random(61)
    bits = ["the", "and", "other", "Điều", "漢字", "😀", " ", "  ", "\n", "\t", " ", "\x0b", "x.", ",", "thé"]
    texts = {i: "".join(rng.choices(bits, k=rng.randrange(0, 30))) for i in range(80)} | {80: None, 81: "", 82: "the", 83: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    own = {i: [(s := rng.randrange(-2, 40), s + rng.randrange(0, 9), rng.choice("XYZ")) for _ in range(rng.randrange(0, 9))] for i in texts}
    given = spark.createDataFrame([(i, *s) for i, ss in own.items() for s in ss], "doc_id long, start long, end long, type string")

    def want(spans_of):
        out = set()
        for i, t in texts.items():
            for at, m in enumerate(re.finditer(r"\S+", t or "", re.ASCII)):
                over = sorted(s for s in spans_of[i] if s[0] < m.end() and s[1] > m.start())
                out.add((i, at, m[0], "O" if not over else f"{'B' if m.start() <= over[0][0] else 'I'}-{over[0][2]}"))
        return out

    got = D.bio_labels(docs, given).collect()
    assert {tuple(r) for r in got} == want(own) and len(got) == len(want(own))
    patterns = {"art": "the", "con": "and|an", "one": "."}
    found = {i: [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, t or "")] for i, t in texts.items()}
    assert {tuple(r) for r in D.bio_labels_of(docs, patterns).collect()} == {tuple(r) for r in D.bio_labels(docs, D.references(docs, patterns)).collect()} == want(found)
    assert "Exchange" not in plan_of(QUERIES["bio_labels"](spark, sf))


def test_words_of_many_texts_are_coded_together(spark):
    texts = [["Ab ab_cd, ÉÉ é x 12", "a b c ...", "ΟΔΟΣ İİ 漢字"], [], ["ab"], ["one\ntwo one", "", "zz"], ["", ""]]
    words = lambda s: [w for w in "".join(c if c.isalnum() else " " for c in s.lower()).split() if len(w) > 1]
    every = sorted({w for t in texts for s in t for w in words(s)} | {"\n"})
    got = list(U._coded(texts))
    assert [n for n, _, _ in got] == [len(t) for t in texts if t]
    for (n, sentence, code), t in zip(got, [t for t in texts if t]):
        assert [[every[c] for c in code[sentence == i]] for i in range(n)] == [words(s) for s in t]
    docs = spark.createDataFrame([(1, "One two three four five. Six seven one two three. Nine ten one eleven two."), (2, None), (3, "Short.")], "doc_id long, text string")
    rows = U.sentence_scores(docs).orderBy("idx").collect()
    assert [(r.doc_id, r.idx, r.sentence[:3]) for r in rows] == [(1, 0, "One"), (1, 1, "Six"), (1, 2, "Nin")]
    unit, tfidf = U._matrix([r.sentence for r in rows])
    want = (U._normal(tfidf) + 1.5 * U._normal(U.power_rank(unit)) + U._normal(U.cluster_scores(unit, 5))) / 3.5
    assert [r.ensemble for r in rows] == [float(x) for x in want] and [r.tfidf for r in rows] == [float(x) for x in tfidf]


def test_referenced_chunks_are_chosen_without_their_texts(spark, tmp_path):
    rows = [(i, f"n{i % 3}", str(i % 5), [str((i + 1) % 5), " "], f"text {i} " * 200) for i in range(40)]
    spark.createDataFrame(rows, "chunk_id long, name string, section string, refs array<string>, text string").write.parquet(f"{tmp_path}/c")
    chunks = spark.read.parquet(f"{tmp_path}/c")
    found = R.cross_referenced(chunks.where("chunk_id in (7, 1)").select("chunk_id", "refs"), chunks)
    assert {tuple(r) for r in found.collect()} == {("2", 2, rows[2][4][:600]), ("3", 3, rows[3][4][:600]), ("3", 8, rows[8][4][:600])}
    assert "ReadSchema: struct<chunk_id:bigint,section:string>" in plan_of(found)  # what is sorted by section
    asked = spark.createDataFrame([(7, 2.0), (1, 2.0)], "chunk_id long, score double")
    runs = spark.sparkContext.accumulator(0)
    one = F.udf(lambda s: (runs.add(1), s)[1], "double").asNondeterministic()
    got = Q.answered(asked.withColumn("score", one("score")).orderBy("chunk_id").limit(2), chunks, "why?").first()
    assert [s.chunk_id for s in got.sources] == [1, 7] and got.context.count("\n[§") == 3 and runs.value == 2


def test_clauses_meet_sentences_where_the_text_is(spark, sf):
    rng = random.Random(62)
    texts = {i: [" ".join(rng.choices(["Ab", "cd", "ef,", "gh", "x1", "漢"], k=rng.randrange(1, 7))) for _ in range(rng.randrange(0, 9))] for i in range(60)}
    rows = spark.createDataFrame([(i, ss, sorted(set(ss[:2]))) for i, ss in texts.items()], "doc_id long, ss array<string>, clauses array<string>")
    words = lambda s: set(re.sub(r"[^\w\s]", " ", s.lower()).split())
    want = set()
    for i, ss in texts.items():
        best = [min((-len(words(c) & words(s)) / max(len(words(c)), 1), at, s, c) for at, s in enumerate(ss)) for c in sorted(set(ss[:2]))]
        good = sorted(b for b in best if -b[0] >= 0.35)[: max(1, int(len(ss) * 0.4 + 0.5))]
        want |= {(i, c, at, s, round(-low, 6)) for low, at, s, c in good}
    assert {tuple(r) for r in U.guided_texts(rows).collect()} == want and want
    scored = rows.select("doc_id", F.posexplode("ss").alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))
    assert {tuple(r) for r in U.guided(scored, rows.select("doc_id", F.explode("clauses").alias("clause"))).collect()} == want
    plan = plan_of(QUERIES["label_guided"](spark, sf))
    assert "Exchange" not in plan and "MapIn" not in plan


def test_all_sentences_of_a_text_are_clauses(spark, tmp_path, monkeypatch):
    rng = random.Random(67)
    texts = {i: [" ".join(rng.choices([f"w{k}" for k in range(30)] + ["Ab", "ab,", "漢", "--"], k=rng.randrange(5, 9))) + "." for _ in range(rng.choice([0, 1, 2, 9, 40]))] for i in range(40)}
    texts[40] = ["One two three four five."] * 3
    texts[41] = [*texts[40], "One two three six seven.", *texts[40], "Eight nine ten six seven."]
    words = lambda s: set(re.sub(r"[^\w\s]", " ", s.lower()).split())
    want = set()
    for i, ss in texts.items():
        best = [min(others) for c in set(ss) if (others := [(-len(words(c) & words(s)) / max(len(words(c)), 1), at, s, c) for at, s in enumerate(ss) if s != c])]
        good = sorted(b for b in best if -b[0] >= 0.35)[: max(1, int(len(ss) * 0.4 + 0.5))]
        want |= {(i, c, at, s, round(-low, 6)) for low, at, s, c in good}
    spark.createDataFrame([(i, " ".join(ss)) for i, ss in texts.items()] + [(None, "A b c d e. A b c d f.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in QUERIES["label_guided"](spark, str(tmp_path)).collect()} == want
    assert any(c in texts[i][len(texts[i]) // 2 :] and c not in texts[i][:2] for i, c, *_ in want)
    ss = pa.array(list(texts.values()), pa.list_(pa.string()))
    own = pa.array([[sorted(words(s)) for s in t] for t in texts.values()], pa.list_(pa.list_(pa.string())))
    whole = U._answers(ss, own).to_pylist()
    monkeypatch.setattr(U, "PAIRS", 50)
    assert U._answers(ss, own).to_pylist() == whole


def test_texts_are_compared_once_by_trigrams(spark):
    def grams(t):
        return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", t.lower()) for i in range(len(w) + 1)}

    rng = random.Random(63)
    texts = {i: "".join(rng.choices(["ab", "c", "é", "漢", "𠀀", "𠀁x", "7", " ", "_", "-", "\n"], k=rng.randrange(0, 25))) for i in range(150)} | {150: None, 151: "", 152: "𠀀"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    question = "ab 𠀀c é7"
    want = {}
    for i, t in texts.items():
        x, y = grams(t or ""), grams(question)
        want[i] = round(len(x & y) / len(x | y), 6) if x | y else 0.0
    got = {r.doc_id: r.s for r in docs.select("doc_id", F.round(T.trigram_similarity("text", F.lit(question)), 6).alias("s")).collect()}
    assert got == want
    found = S.trigram_search(docs, question, 0.15, 20)
    best = sorted(((i, s) for i, s in want.items() if s > 0.15), key=lambda x: (-x[1], x[0]))[:20]
    assert [tuple(r) for r in found.collect()] == best
    assert not any("array_intersect" in line for line in plan_of(found).splitlines() if "Filter" in line)


def test_walks_send_frontiers_and_never_edges(spark, tmp_path, monkeypatch):
    rng = random.Random(64)
    rows = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(420)})
    spark.createDataFrame([(a, b, "t") for a, b in rows], "src long, dst long, type string").write.parquet(f"{tmp_path}/e")
    edges = spark.read.parquet(f"{tmp_path}/e")
    want, front, depth = {5: 0}, {5}, 0
    while front:
        depth += 1
        front = {b for a, b in rows if a in front} - want.keys()
        want |= dict.fromkeys(front, depth)
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (plans.append(plan_of(df)), cut(df))[1])
    for narrow, sent in ((0, 0), (10_000, 1)):
        monkeypatch.setattr(G, "NARROW", narrow)
        plans.clear()
        assert {r.id: r.depth for r in G.reach(edges, [5]).collect()} == want
        levels = [p for p in plans if "LeftAnti" in p]
        assert len(levels) == max(want.values()) + 1 and all(len(re.findall(r"[-+ ]BroadcastExchange", p.split("Initial Plan")[0])) == sent for p in levels)


def test_windows_split_a_text_once(spark, sf):
    plan = QUERIES["chunk_window"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 1


def test_phrases_stay_with_their_documents(spark, monkeypatch):
    rng = random.Random(68)
    made = [(i, rng.choices(["ab", "c", "漢", "dé", "x y", *(f"w{k}" for k in range(12))], k=rng.choice([0, 1, 2, 3, 30]))) for i in range(60)] + [(60, None), (-1, ["ab", "c"])]
    docs = spark.createDataFrame(made, "doc_id long, words array<string>").repartition(3)
    grams = {i: [" ".join(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)] if w else [] for i, w in made}
    df = {g: sum(g in set(gs) for gs in grams.values()) for gs in grams.values() for g in gs}
    want = sorted((i, len(gs), g, gs.count(g), df[g]) for i, gs in grams.items() for g in set(gs) if df[g] >= 2)
    counts = lambda rows, words=10_000: P.exchanged(rows, 3, P.all_counts(2), "all long, phrase string, n long, df long", words)
    for words in (10_000, 4):  # with few words to a block, a partition has many
        found = counts(docs, words).collect()
        assert sorted(map(tuple, found)) == want
    with monkeypatch.context() as m:
        m.setattr(RDD, "partitionBy", lambda self, n, *a, f=RDD.partitionBy: f(self, n + 5, *a))
        assert sorted(map(tuple, counts(docs, 4).collect())) == want
    assert counts(docs.limit(0)).collect() == []
    texts = docs.where("words is not null").select("doc_id", F.array_join("words", " ").alias("text"))
    for made in (D.keyphrase_scores(texts, []), D.keyphrases(texts, [])):
        assert "hashpartitioning" not in plan_of(made) and made.collect()


def test_phrases_of_one_hash_are_told_apart():
    h, more, docs = np.array([5, 9, 9, 2**64 - 1], np.uint64), np.array([0, 1, 2, 255], np.uint8), np.array([1, 2, 3, 70000], np.uint32)
    one = (4, P._packed(np.diff(h, prepend=np.uint64(0)), more, docs))
    two = (2, P._packed(np.diff(h[[1, 2]][:2], prepend=np.uint64(0)), more[[2, 1]], docs[[0, 1]]))
    got = [P._unpacked(x, n, np.uint32)[0].tolist() for x, n in zip(P.answers([one, two, (0, P._packed(h[:0], more[:0], docs[:0]))]), (4, 2, 0))]
    assert got == [[1, 4, 4, 70000], [4, 4], []]
