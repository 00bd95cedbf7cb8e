"""Records of documents, walks over graphs and retrieval's helpers on small tables made here."""

import unicodedata

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vocabularies as V
from quern.operators import documents as D
from quern.operators import graph as G
from quern.operators import metrics as X
from quern.operators import reasoner as W
from quern.operators import retrieval as R
from quern.operators import search as S
from quern.operators import summarise as Z
from quern.operators import tabular as B

LAW = """Số: 45/2019/QH14
Luật kế toán của cả nước về sổ sách
QUỐC HỘI ban hành ngày 20 tháng 11 năm 2019. Theo Điều 12, Khoản 3 và Điểm b của Nghị định số 12/2020/NĐ-CP; Thông tư 200/2014/TT-BTC
Văn bản này hết hiệu lực từ ngày 31 tháng 02 năm 2030"""


def one(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string")


def test_metadata_and_references(spark):
    got = D.metadata(one(spark, LAW), V.DOCUMENT_NUMBER, V.ISSUE_DATE, V.EXPIRY_DATE, V.ISSUING_BODIES, V.NO_TITLE).first()
    assert (got.title, got.number, got.body, str(got.effective), got.expiry) == ("Luật kế toán của cả nước về sổ sách", "45/2019/QH14", "QUỐC HỘI", "2019-11-20", None)
    empty = D.metadata(one(spark, None), V.DOCUMENT_NUMBER, V.ISSUE_DATE, V.EXPIRY_DATE, V.ISSUING_BODIES, V.NO_TITLE).first()
    assert (empty.title, empty.number, empty.body, empty.effective) == ("1", "", "", None)
    found = {(r.type, r.value): r for r in D.typed_values(one(spark, LAW), V.REFERENCES).collect()}
    assert {("DIEU", "12"), ("KHOAN", "3"), ("DIEM", "b"), ("NGHI_DINH", "12/2020/"), ("THONG_TU", "200/2014/")} <= set(found)
    at = found["NGHI_DINH", "12/2020/"]
    assert LAW[at.start : at.end] == at.full == "Nghị định số 12/2020/"
    labels = D.typed_values(one(spark, "Theo Nghị định số 12/2020/NĐ-CP, khoản 3, 01/02/2020 và Luật Đất đai 2013"), V.ENTITIES).select("doc_id", "type", "start")
    assert {r.type for r in labels.collect()} == {"NGHI_DINH", "KHOAN", "NGAY_THANG", "LUAT"}
    assert R.filters_of(labels, V.ENTITY_FILTERS).first().doc_type == "luat"


def test_sentence_variants_and_cleaning(spark):
    text = "First sentence here. second part stays. Ánh sáng is next! 3 numbers follow\nA new line of text; and a clause. short"
    row = one(spark, text).select(T.sentences_before_capitals("text").alias("a"), T.clauses("text").alias("b"), T.segmented("text").alias("c")).first()
    assert row.a == ["First sentence here. second part stays.", "Ánh sáng is next!", "3 numbers follow", "A new line of text; and a clause. short"]
    assert row.b[-3:] == ["3 numbers follow\nA new line of text;", "and a clause.", "short"] and row.c == text
    raw = ["ﬁne​   text Page 3 of 12 end.... \n\n\n\n Source: x y\nnext", "plain\x07 a\tb   c", None, ""]

    def by_hand(t):
        import re

        t = "".join(c for c in unicodedata.normalize("NFKC", t) if c.isprintable() or c in "\n\t")
        for p, b in ((r"(?i)\bPage\s+\d+\s+of\s+\d+\b", " "), (r"(?i)Source:\s*[^\n]+", " "), (r"\.{3,}", "."), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
            t = re.sub(p, b, t)
        return t.strip()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "id long, t string").select("id", T.clean_contract("t").alias("t")).orderBy("id").collect()
    assert [r.t for r in rows] == [None if t is None else by_hand(t) for t in raw]


def test_pages_sections_tags(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 100), (1, 2, "keep\nPage 9"), (2, 1, "a"), (2, 2, None)], "doc_id long, page int, text string")
    got = {r.doc_id: r for r in D.pages_of(pages, ["^Page"]).collect()}
    assert got[1].text == "x" * 100 + "\nkeep" and not got[1].needs_ocr and got[2].needs_ocr
    s = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "a"), (1, 3, None, "b"), (1, 4, "a", None), (1, 5, None, "a"), (2, 6, None, "a")], "version long, section_id long, key string, parent_key string")
    assert {(r.section_id, r.parent_id) for r in D.with_parents(s).collect()} == {(1, None), (2, 1), (3, 2), (4, None), (5, 4), (6, None)}


def test_walks(spark):
    e = spark.createDataFrame([(i, i + 1, "x") for i in range(12)] + [(50, 3, "y"), (3, 60, "y"), (5, 2, "back")], "src long, dst long, type string")
    assert [r.id for r in G.shortest_path(e, 0, 12).collect()] == list(range(13)) and G.shortest_path(e, 12, 0).count() == 0 and G.shortest_path(e, 50, 2).count() > 0
    assert G.path_text(G.shortest_path(e, 50, 60)).first().path == "50 -[y]-> 3 -[y]-> 60" and G.path_text(G.shortest_path(e, 12, 0)).count() == 0
    near = {(r.src, r.dst, r.direction) for r in G.related(e, 3, 1).collect()}
    assert near == {(3, 4, "forward"), (3, 60, "forward"), (2, 3, "backward"), (50, 3, "backward")}
    up = G.chain(e, 12, ["x", "back"])
    assert {(r.src, r.dst) for r in up.collect()} == {(i, i + 1) for i in range(12)} | {(5, 2)}


def test_cascade_and_filters(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "id long, score double")
    none = spark.createDataFrame([], "id long, score double")
    assert [r.method for r in R.cascade(lambda: t((1, 0.5)), lambda: t((2, 0.4))).collect()] == ["hybrid"]
    assert [(r.id, r.method) for r in R.cascade(lambda: none, lambda: t((2, 0.4)), lambda: t((3, 0.2))).collect()] == [(2, "blended"), (3, "blended")]
    assert [(r.id, r.rank, r.method) for r in R.cascade(vector=lambda: t((3, 0.2), (4, 0.2)), keep=lambda x: x.where("id > 3")).collect()] == [(4, 1, "vector")]
    assert R.cascade() is None and R.cascade(lexical=lambda: none).count() == 0
    rows = spark.createDataFrame([(1, "Nghi dinh", "expired", 1), (2, "nghi_dinh", None, 2), (3, "luat", "active", 3), (4, None, "replaced", 4)], "id long, type string, status string, rank int")
    assert [r.id for r in R.active_first(rows, 9).collect()] == [2, 3, 1, 4] and [r.id for r in R.active_first(rows, 9, ["nghi_dinh"]).collect()] == [2, 1]


def test_names_requests_and_labels(spark):
    names = spark.createDataFrame([("Luật Đất đai 2013",), ("Luật Đất đai 2024",), ("Bộ luật",)], "name string")
    stems = spark.createDataFrame([("dat_dai_2024",), ("bo-luat hinh su",), ("xyz_1999",), ("Dat Dai",)], "stem string")
    got = {r.stem: (r.name, r.year) for r in R.by_containment(stems, names.withColumn("name", T.without_accents(F.translate("name", "ậấộ", "aao")))).collect()}
    assert got["dat_dai_2024"] == ("Luat Dat dai 2024", "2024") and got["bo-luat hinh su"][0] == "Bo luat" and got["xyz_1999"] == ("xyz 1999", "1999") and got["Dat Dai"][0] == "Luat Dat dai 2013"
    c = spark.createDataFrame([("q", "w", 1, "a w", 5), ("q", "w", 1, "a", 15), ("q", "w", 2, "b", 1)], "query string, question string, id long, text string, rank int")
    judged = {r.id: (r.window, r.score) for r in R.relabel(c, lambda q, t: F.when(t.contains(q), 2).otherwise(0)).collect()}
    assert judged == {1: (0, 2), 2: (0, 0)}
    results = spark.createDataFrame([("a", 1, 1, "the quick brown fox jumps"), ("a", 2, 2, "other"), ("b", 5, 1, "none"), ("b", 6, 12, "x the answer y")], "query string, id long, rank int, text string")
    gold = spark.createDataFrame([("a", 2, "Quick  brown fox jumps over"), ("b", 9, "the answer"), ("c", 1, "")], "query string, id long, answer string")
    m = X.single_gold(results, gold, [1, 5]).first()
    assert (m.n, m.found, m.mean_rank, m.recall_1, m.recall_5, m.mrr_5, m.overlap_5, m.overlap_10) == (3, 1, 2.0, 0.0, round(1 / 3, 6), round(0.5 / 3, 6), round(1 / 3, 6), round(1 / 3, 6))


def test_uploads_keys_summaries(spark):
    f = spark.createDataFrame([("a/B.PDF",), ("x.exe",), ("noext",), ("",), (None,), (".txt",)], "name string")
    yes, no = B.uploads(f, [".pdf"])
    assert [r.name for r in yes.collect()] == ["a/B.PDF"] and {(r.name, r.error) for r in no.collect()} == {("x.exe", "Unsupported file type: .exe"), ("noext", "Unsupported file type: "), (".txt", "Unsupported file type: ")}
    target = spark.createDataFrame([(7, "k1"), (4, "")], "id long, number string")
    source = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "c"), ("", "d"), (None, "e")], "number string, title string")
    got = {r.title: r.id for r in B.natural_key_ids(target, source, "number", order="title").collect()}
    assert got["a"] == 7 and got["b"] == got["c"] == 8 and {got["d"], got["e"]} == {9, 10}
    text = "The license covers all work. Nothing else matters here! Another sentence about trees. The work has a license too. Last words come here now."
    row = Z.legal_summaries(one(spark, text), "license work", 2, 1).first()
    assert row.sentences == 5 and len(row.chosen) == 2 and 0 in row.chosen and row.summary.startswith("The license covers")
    assert Z.legal_summaries(one(spark, "Only one sentence here."), "x").first().chosen == [0] and Z.legal_summaries(one(spark, None)).first().summary == ""


def test_questions_are_split_like_texts(spark):
    docs = spark.createDataFrame([(1, "İstanbul café x²"), (2, "other")], "doc_id long, text string")
    assert [r.doc_id for r in S.bm25(docs, "İstanbul CAFÉ x²").collect()] == [1] and S.bm25(docs, "?!").count() == 0


def test_answers_of_the_reasoner(spark):
    nodes = spark.createDataFrame([(1, "Law", "active"), (2, "Decree", "active"), (3, None, None), (4, "Old", "expired"), (5, "Alone", "active")], "id long, name string, status string")
    e = spark.createDataFrame([(2, "amends", 1), (3, "replaces", 2), (4, "cites", 1), (1, "cites", 4), (9, "amends", 3)], "src long, type string, dst long")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (7,), (1,)], "id long")
    got = {r.id: r for r in W.validity_answers(asked, nodes, e, ["replaces"], ["amends"]).collect()}
    assert {i: (r.answer, r.confidence, r.n_evidence) for i, r in got.items()} == {
        1: ("Law is in force as amended.", 0.9, 1), 2: ("Decree is replaced by a later document.", 0.9, 1), 3: ("3 is in force as amended.", 0.5, 1), 4: ("Old is no longer in force.", 0.9, 0),
        5: ("Alone is in force.", 0.9, 0), 7: ("No document '7' is known.", 0.0, 0),
    }
    row = lambda df: tuple(df.first())[1:]
    both = ["amends", "replaces"]
    assert row(W.amendments_answer(nodes, e, 1, both)) == ("Law has 3 amending documents.", 0.85, 3, ["Decree --amends--> Law", "3 --replaces--> Decree", "9 --amends--> 3"])
    assert row(W.amendments_answer(nodes, e, 1, both, most=1))[2:] == (3, ["Decree --amends--> Law"])
    assert row(W.amendments_answer(nodes, e, 5, both)) == ("Alone has not been amended.", 1.0, 0, [])
    assert row(W.related_answer(nodes, e, 4, 1)) == ("2 documents are related to Old.", 0.8, 2, ["Law --cites--> Old", "Old --cites--> Law"])
    assert row(W.related_answer(nodes, e, 5)) == ("Nothing is related to Alone.", 0.3, 0, [])
    assert row(W.path_answer(nodes, e, 3, 4)) == ("By: replaces -> amends -> cites", 0.7, 3, ["3 --replaces--> Decree", "Decree --amends--> Law", "Law --cites--> Old"])
    assert row(W.path_answer(nodes, e, 5, 4)) == ("No path leads from Alone to Old.", 0.1, 0, [])
