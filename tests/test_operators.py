"""Small cases with known answers, and properties that hold for any input."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import matching as M
from quern.functions import text as T
from quern.operators import answers as A
from quern.operators import documents as D
from quern.operators import graph as G
from quern.operators import images as I
from quern.operators import metrics as X
from quern.operators import search as S
from quern.operators import summarise as U
from quern.operators import tabular as B


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=40), st.text("ab", min_size=1, max_size=5))
def test_matchers_agree(text, pattern):
    want = [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]
    for matcher in M.MATCHERS.values():
        assert matcher(text, pattern)[0] == want


def test_matcher_tables():
    assert M.prefix_table("ABABCABAB") == [0, 0, 1, 2, 0, 1, 2, 3, 4]
    assert M.last_places("ABCAB") == {"A": 3, "B": 4, "C": 2}


def test_positions_natively(spark):
    cases = [("aaaa", "aa"), ("abcabc", "abc"), ("xyz", "q"), ("", "a"), ("a.b.c", "."), ("đa đa", "đ"), ("ababa", "aba"), ("tail", "il"), ("A b", "a")]
    for text, pattern in cases:
        want = [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]
        assert one(spark, M.positions("t", pattern), t=text) == want, (text, pattern)
    assert one(spark, M.positions("t", "B", True), t="abAB") == [1, 3]
    assert one(spark, M.highlight("t", "aa"), t="xaaay aa") == "x**aaa**y **aa**"
    with pytest.raises(ValueError):
        M.positions("t", "")


def test_bm25_by_hand(spark):
    texts = {1: "cat dog cat", 2: "dog", 3: "bird bird", 4: "cat"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in S.bm25(docs, "cat cat bird", 10).collect()}
    toks = {k: v.split() for k, v in texts.items()}
    avg = sum(map(len, toks.values())) / 4
    want = {}
    for k, ts in toks.items():
        s = 0.0
        for q in ("cat", "cat", "bird"):
            df = sum(q in t for t in toks.values())
            s += math.log((4 - df + 0.5) / (df + 0.5) + 1) * ts.count(q) * 2.5 / (ts.count(q) + 1.5 * (0.25 + 0.75 * len(ts) / avg))
        if s > 0:
            want[k] = round(s, 4)
    assert got == want


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank long")
    got = {r.id: r.score for r in S.fuse([("a", 0.5, a), ("b", 0.5, b)], 10).collect()}
    assert got == {1: round(0.5 / 61, 6), 2: round(0.5 / 62 + 0.5 / 61, 6), 3: round(0.5 / 62, 6)}


def test_knn_join_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [(90, None), (91, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.left_id, r.right_id) for r in S.knn_join(df.where("vec_id < 10"), df, 3, 0.2, block=16).collect()}

    def cos(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = set()
    for i, v in rows[:10]:
        best = sorted(((-round(cos(v, w), 6), j) for j, w in rows if w is not None))[:3]
        want |= {(i, j) for s, j in best if -s >= 0.2}
    assert got == want


def test_trigram_similarity(spark):
    assert one(spark, T.trigram_similarity("a", "b"), a="word", b="word") == 1.0
    assert one(spark, T.trigram_similarity("a", "b"), a="", b="x!") == 0.0
    assert round(one(spark, T.trigram_similarity("a", "b"), a="cat", b="cats"), 6) == round(3 / 6, 6)


def test_text_functions(spark):
    assert one(spark, T.squeeze("t"), t=" a \n\t b!!!!!! ​c") == "a b!!! c"
    assert one(spark, T.clean_lines("t"), t="a\nPage 3\n\n\n\n12/30\nb") == "a\n\nb"
    assert one(spark, T.clean_plain("t", "^END"), t="“x”  y\nEND here\nz") == '"x" y\nEND here'
    assert one(spark, T.sentences("t"), t="A b. C d! E") == ["A b.", "C d!", "E"]
    assert one(spark, T.html_text("t"), t="<p>a</p><script>x</script><nav>n</nav><b>c &amp; d</b>") == "a\nc & d"
    assert one(spark, T.without_accents("t"), t="Đà été") == "Da ete"
    assert one(spark, T.json_object("t"), t='x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, T.json_object("t"), t="nothing") is None
    assert one(spark, T.parents(F.lit("1.2.3"))) == ["1", "1.2"]
    assert one(spark, T.excerpt_at_sentence("t", 10), t="Ab cd. Efghijkl") == "Ab cd."
    assert one(spark, T.dmy_date(F.lit("on 31/02/2020"))) is None


def test_spans_offsets(spark):
    found = one(spark, D.spans("t", r"\d+"), t="a12 b3")
    assert [(s.value, s.start, s.end) for s in found] == [("12", 1, 3), ("3", 5, 6)]
    assert one(spark, D.spans("t", r"\d+"), t="12") [0].end == 2
    assert one(spark, D.spans("t", r"\d+"), t="") == []


def test_chunk_windows(spark):
    parts = [" ".join([f"s{i}"] * n) for i, n in enumerate((5, 4, 3, 12, 2))]
    got = one(spark, D.sentence_window(F.col("p"), 10, 4, 1), p=parts)
    assert got == [f"{parts[0]} {parts[1]}", f"{parts[1]} {parts[2]}", parts[3], parts[4]]
    assert one(spark, D.merged_parts(F.col("p"), 10), p=["aaa", "bbb", "cccccc"]) == ["aaa\n\nbbb", "cccccc"]
    assert one(spark, D.fixed_overlap(F.col("p"), 4, 1), p=["a b", "c d", "e f g h i"]) == ["a b c d", "e f g h", "i"]


def test_sections_and_leaves(spark):
    text = "intro\n# A\nbody a\n## A1\nbody a1\n# B\nbody b"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = D.sections(docs, ["^# ", "^## "])
    got = {(r.doc_id, r.section): (r.level, r.heading, r.parent, r.content) for r in found.collect()}
    assert got[1, 2] == (2, "## A1", 1, "body a1") and got[1, 3] == (1, "# B", None, "body b") and got[1, 0] == (0, None, None, "intro")
    assert {r.section for r in D.leaf_sections(found.where("doc_id = 1")).collect()} == {2}


def test_section_chunks(spark):
    body = "word " * 30
    docs = spark.createDataFrame([(1, f"{body}\nSection 1.2\n{body} see Section 3\nArticle 4\n{body}")], "doc_id long, text string")
    got = D.section_chunks(docs, [r"(?m)^Section (\d+(?:\.\d+)*)$", r"(?m)^Article (\d+)$"]).orderBy("chunk").collect()
    assert [r.section_id for r in got] == ["preamble", "1.2", "4"]
    assert got[1].parents == ["1"] and got[1].xrefs == ["1.2", "3"]


def test_keyphrases_share_no_word(spark):
    docs = spark.createDataFrame([(i, "red apple pie " * 3 + f"x{i} green tea") for i in range(4)], "doc_id long, text string")
    for i in range(4):
        phrases = [r.phrase.split() for r in D.keyphrases(docs, []).where(F.col("doc_id") == i).collect()]
        words = [w for p in phrases for w in p]
        assert len(words) == len(set(words))


def test_ranking_by_hand(spark):
    res = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "query long, id long, rank long")
    gold = spark.createDataFrame([(1, 8, 2), (1, 5, 1), (2, 3, 1)], "query long, id long, rel long")
    got = {(r.query, r.k): r for r in X.ranking(res, gold, [1, 3]).collect()}
    assert got[1, 1].recall == 0 and got[1, 3].recall == 0.5 and got[1, 3].mrr == 0.5 and got[2, 3].hit == 0
    ideal = 3 / math.log2(2) + 1 / math.log2(3)
    assert got[1, 3].ndcg == round((3 / math.log2(3)) / ideal, 6)


def test_longest_common(spark):
    rng = random.Random(2)
    for _ in range(8):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(1, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert one(spark, X.longest_common(F.col("a"), F.col("b")), a=a, b=b) == best[-1][-1]


def test_summaries(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat here. A dog ran over the green hill. The cat sat on the warm mat. Birds fly high in the blue sky."), (2, ""), (3, None)], "doc_id long, text string")
    scored = U.sentence_scores(docs)
    assert scored.count() == 4 and {r.doc_id for r in U.select(scored, least=2).collect()} == {1}
    assert one(spark, U.spread(F.col("i"), 2, 3), i=[5, 4, 1, 0, 9]) == [1, 5, 9]
    assert one(spark, U.position_scores(F.lit(2))) == pytest.approx([1.0, (1 / 1.1 + 0.15) / 1.3])


def test_overlap_and_longest_common_of_long_texts(spark):
    rng = random.Random(4)
    a, b = ([f"w{rng.randrange(80)}" for _ in range(n)] for n in (700, 900))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert one(spark, X.longest_common(F.col("a"), F.col("b")), a=a, b=b) == row[-1]
    assert one(spark, X.overlap(F.col("a"), F.col("b")), a=a, b=b) == sum(min(a.count(w), b.count(w)) for w in set(a))
    words = F.array().cast("array<string>")
    assert one(spark, X.longest_common(words, words)) == 0 and one(spark, X.rouge_n(words, words)["f"]) == 0.0


def _rouge(cand, ref):
    both = sum(min(cand.count(g), ref.count(g)) for g in set(cand))
    return round(2 * both / (len(cand) + len(ref)), 6) if both else 0.0


def test_rouge_of_whole_texts(spark, tmp_path):
    """Texts of 400 words and more, all distinct but few: what stands after the first sixty counts."""
    from quern.plans.text_queries import rouge_scores

    rng = random.Random(6)
    text = lambda n: " ".join(" ".join(f"v{rng.randrange(300)}" for _ in range(9)) + "." for _ in range(n))
    rows = [(i, text(n)) for i, n in enumerate((50, 80, 3))]
    for table, key in (("benchmark", "item_id"), ("documents", "doc_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{table}.parquet")
    got = {r.doc_id: r for r in rouge_scores(spark, str(tmp_path)).collect()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    summaries = {r.doc_id: r.summary.lower().replace(".", " ").split() for r in U.select(U.sentence_scores(docs)).collect()}
    for i, t in rows:
        ref, cand = t.replace(".", " ").split(), summaries[i]
        assert len(cand) > 60 or i == 2
        assert got[i].rouge1 == _rouge(cand, ref) and got[i].rouge2 == _rouge(list(zip(cand, cand[1:])), list(zip(ref, ref[1:])))
        # A summary keeps the order of its text, so all of it is a common subsequence.
        assert got[i].rouge_l == round(2 * len(cand) / (len(cand) + len(ref)), 6)


def test_text_queries_read_the_corpus(spark, tmp_path):
    """Benchmark has one row of other words; all results must come from documents."""
    from quern.plans.registry import QUERIES
    from quern.plans.text_queries import STOP

    rng = random.Random(8)
    text = lambda n: " ".join(" ".join(rng.choice(["ab", "cd", "ef", "gh", "other", "the", "and", "7"]) for _ in range(8)) + "." for _ in range(n))
    rows = [(100 + i, text(n)) for i, n in enumerate((1, 3, 30, 8, 8))]
    rows.append((200, rows[2][1]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Zz yy xx ww vv uu tt. " * 3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {q: QUERIES[q](spark, str(tmp_path)).collect() for q in ("keyphrases_tfidf_documents", "keyphrases", "keyphrase_search", "top_phrases", "bio_labels", "summary_scores", "summaries", "label_guided", "rouge_scores", "match_comparisons")}
    ids = {i for i, _ in rows}
    for q in ("keyphrases", "bio_labels", "summary_scores", "summaries", "rouge_scores"):
        assert {r.doc_id for r in found[q]} == ids, q
    for q in ("keyphrase_search", "label_guided"):
        assert {r.doc_id for r in found[q]} <= ids, q
    assert found["label_guided"] and sum(r.n for r in found["top_phrases"]) > 0
    assert {(r.id, r.matches) for r in found["match_comparisons"]} == {(i, t.count("ther")) for i, t in rows}
    grams = {}
    for i, t in rows:
        w = [x for x in t.replace(".", " ").split() if len(x) > 1 and x not in STOP]
        grams[i] = [" ".join(w[a : a + n]) for n in (1, 2, 3) for a in range(len(w) - n + 1)]
    df = {g: sum(g in set(gs) for gs in grams.values()) for gs in grams.values() for g in gs}
    want = {(i, g): gs.count(g) / len(gs) * (math.log((len(rows) + 1) / (df[g] + 1)) + 1) for i, gs in grams.items() for g in set(gs) if df[g] > 1}
    assert {(r.doc_id, r.phrase): r.score for r in found["keyphrases_tfidf_documents"]} == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("held", [0, 8 << 20])
def test_centrality_of_long_texts_converges(monkeypatch, held):
    """2,400 sentences in a chain: convergence takes more than twenty rounds."""
    monkeypatch.setattr(U, "EDGES_HELD", held, raising=False)
    n = 2400
    unit = np.zeros((n, 40), np.float32)
    rng = np.random.default_rng(3)
    for i in range(n):
        unit[i, [i * 37 // n, i * 37 // n + 1 + rng.integers(2)]] = rng.random(2) + 0.1
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    w = unit @ unit.T
    np.fill_diagonal(w, 0)
    w[w < 0.1] = 0
    step, rank, taken = w.astype(float) / w.sum(axis=0), np.full(n, 1 / n), 0
    for taken in range(100):
        new = 0.15 / n + 0.85 * step @ rank
        if np.abs(new - rank).sum() < 1e-5:
            break
        rank = new
    assert taken > 20
    assert np.abs(U.power_rank(unit) - rank).max() < 1e-9


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 1, "b"), (3, 4, "a"), (9, 8, "a")], "src long, dst long, type string")
    assert {(r.id, r.depth) for r in G.reach(e, [1], 5).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert [r.id for r in G.shortest_path(e, 1, 4).collect()] == [1, 2, 3, 4]
    assert G.shortest_path(e, 1, 8).count() == 0


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, 1, "a " * 8), (1, 2, "b " * 8), (1, 3, "c " * 8)], "query long, rank long, text string")
    assert [(r.rank, r.tokens) for r in A.packed_context(rows, 12).orderBy("rank").collect()] == [(1, 8), (2, 4)]
    p = one(spark, A.prompt_parts(A.prompt(F.lit("why?"), F.lit("because."))))
    assert (p.context, p.question) == ("because.", "why?")
    parts = one(spark, A.answer_parts("t", ["basis", "conclusion"]), t="basis: x\ny\nconclusion: z")
    assert parts == {"basis": "x\ny", "conclusion": "z"}


def test_merge_and_history(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    s = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, o long")
    assert sorted(tuple(r) for r in B.merge(t, s, ["k"], "o").collect()) == [(1, "a"), (2, "y"), (3, "z")]
    assert B.merge(t.limit(0), s.limit(0), ["k"], "o").count() == 0


def test_asof_ties_and_gaps(spark):
    a = spark.createDataFrame([("k", 1), ("k", 5), ("j", 5), (None, 3)], "key string, t long")
    b = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y"), ("j", 6, "z")], "key string, at long, v string")
    got = {(r.key, r.t): r.v for r in B.asof_join(a, b, "key", "t", "at", ["v"]).collect()}
    assert got == {("k", 1): None, ("k", 5): "y", ("j", 5): None, (None, 3): None}


def test_image_fingerprints(spark):
    header = b"P6\n2 2\n255\n"
    red, blue = header + bytes([255, 0, 0] * 4), header + bytes([0, 0, 255] * 4)
    rows = I.fingerprints(spark.createDataFrame([("a", red), ("b", blue), ("c", b"no image")], "path string, content binary")).collect()
    prints = {r.path: r.fingerprint for r in rows}
    assert len(prints["a"]) == 3 * 32 + 16 and prints["a"] != prints["b"] and prints["c"] is None


def test_legal_vocabulary(spark):
    from quern.functions import vocabularies as V

    text = "Người lao động có quyền từ chối. Hồ sơ phải nộp cho cơ quan; trình tự, thủ tục như sau."
    docs = spark.createDataFrame([(1, text), (2, "xin chào"), (3, None)], "doc_id long, text string")
    found = {(r.doc_id, r.concept): r.confidence for r in D.concepts(docs, V.CONCEPTS, V.OTHER_CONCEPT).collect()}
    assert found[2, "khac"] == found[3, "khac"] == 0.5
    assert found[1, "thu_tuc"] == 1.0 and found[1, "quyen_loi"] == 0.5 and (1, "cam_ket") not in found
    vote = one(spark, T.phrase_votes("t", V.DOMAINS, "khac"), t=text)
    assert (vote.label, vote.hits) == ("lao_dong", 2)
    law = "Chương I\nĐiều 1. Phạm vi\n1. Luật này\na) điểm a\nĐiều 2. Đối tượng\nnội dung"
    rows = D.sections(spark.createDataFrame([(1, law)], "doc_id long, text string"), V.LAW_LEVELS).orderBy("section").collect()
    assert [(r.level, r.parent) for r in rows] == [(2, None), (4, 1), (5, 2), (6, 3), (4, 1)] and rows[-1].content == "nội dung"
    assert one(spark, A.variants("t", V.SYNONYMS), t="Bị sa thải")[1] == "bị chấm dứt hợp đồng lao động"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    from quern.plans.registry import QUERIES

    assert "TakeOrderedAndProject" in plan_of(QUERIES["bm25_topk"](spark, sf))
    for name in ("html_to_text", "trigram_similarity", "boolean_and"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
    for name in ("chunk_window", "match_positions", "reference_offsets"):  # lengths go through one kernel for each array, without a shuffle
        plan = plan_of(QUERIES[name](spark, sf))
        assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan and "Exchange" not in plan, name
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(QUERIES["boolean_and"](spark, sf))
    assert "EqualTo(l_returnflag,R)" in plan_of(QUERIES["join_to_aggregate"](spark, sf))


def test_quantiles_are_exact_and_no_aggregate_holds_the_values(spark):
    rng = random.Random(51)
    for size in (0, 1, 2, 7, 500):
        own = [rng.choice([None, rng.randrange(40) / 4, rng.random()]) for _ in range(size)]
        df = spark.createDataFrame([(v,) for v in own], "v double")
        got = X.quantiles(df, F.col("v"), {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0})
        want = df.agg(*[F.percentile("v", q).alias(str(q)) for q in (0.0, 0.25, 0.5, 0.9, 1.0)]).first()
        assert [None if x is None else round(x, 9) for x in got.first()] == [None if x is None else round(x, 9) for x in want]
    assert "percentile" not in X.residuals(df, F.col("v"))._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_and_keywords_are_counted_where_they_are_read(spark, monkeypatch):
    rng = random.Random(52)
    texts = {i: " ".join(rng.choices(["alpha", "beta", "gamma", "the", "delta7", "12"], k=rng.randrange(0, 40))) for i in range(50)} | {50: None, 51: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(D, "KERNEL_WORDS", 30)
    monkeypatch.setattr(D, "OUT_ROWS", 7)
    counts, sizes, firsts = {}, {}, {}
    for i, t in texts.items():
        words = [w for w in (t or "").split() if w not in ("the", "12")]
        grams = [" ".join(words[a : a + n]) for n in (1, 2, 3) for a in range(len(words) - n + 1)]
        sizes[i], counts[i] = len(grams), {g: grams.count(g) for g in grams}
        letters = [w.rstrip("7") for w in words]
        firsts[i] = sorted(set(letters), key=lambda w: (-letters.count(w), letters.index(w)))[:2]
    df = {g: sum(g in c for c in counts.values()) for c in counts.values() for g in c}
    want = {(i, g): round(n / sizes[i] * (math.log((len(texts) + 1) / (df[g] + 1)) + 1), 8) for i, c in counts.items() for g, n in c.items() if df[g] >= 2}
    scored = D.keyphrase_scores(docs, ["the"])
    got = {(r.doc_id, r.phrase): r.score for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-8 for k in want)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # the number of documents
    tags = D.top_keywords(docs, ["the"], 2)
    found = {}
    for r in sorted(tags.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.doc_id, []).append(r.word)
    assert found == {i: ws for i, ws in firsts.items() if ws}
    assert "Aggregate" not in tags._jdf.queryExecution().optimizedPlan().toString()
