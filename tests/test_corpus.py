"""Keyed sections, JSON of several shapes, stems, ROUGE over stems, and questions answered end to end, on small inputs."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import vocabularies as V
from quern.operators import dialogue as Q
from quern.operators import documents as D
from quern.operators import stemming as P
from quern.sources.files import sniffed_records

LAW = """Lời nói đầu
Điều 1. Phạm vi
bỏ đi
  1. Khoản một
tiếp theo

2. Khoản hai
a) điểm a
đ) điểm đ
thêm
ĐIỀU 2:
Tên ở dòng sau
Chỉ có nội dung, 3. không phải khoản
điều 3
1.
a) ngay sau"""


def law(spark, text):
    return [tuple(r) for r in D.keyed_sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), V.LAW_HEADERS, V.LAW_KEYS, V.LAW_UNTITLED).drop("doc_id").orderBy("at").collect()]


def test_keyed_sections(spark):
    got = law(spark, LAW)
    assert [r[1:4] for r in got] == [("1", "1", ""), ("1", "2", "a"), ("1", "2", "đ"), ("2", "", ""), ("3", "", "")]
    assert [r[6] for r in got] == [2, 3, 3, 1, 1]
    assert [r[7] for r in got] == ["dieu_1_khoan_1", "dieu_1_khoan_2_diem_a", "dieu_1_khoan_2_diem_đ", "dieu_2", "dieu_3"]
    assert [r[8] for r in got] == ["dieu_1", "dieu_1_khoan_2", "dieu_1_khoan_2", None, None]
    assert [r[5] for r in got[:4]] == ["Khoản một \ntiếp theo", "điểm a", "điểm đ \nthêm", "Chỉ có nội dung, 3. không phải khoản"]
    # The rest of a header's line may be the next line: it is then the title, and no clause.
    assert got[3][4] == "Tên ở dòng sau" and (got[4][4], got[4][5]) == ("1.", "a) ngay sau")
    assert law(spark, "Điều 4.\n\n5. x") == [([0, 0, 0], "4", "", "", "5. x", "", 1, "dieu_4", None)]


def test_keyed_sections_without_headers(spark):
    assert law(spark, " only text\n1. no article ") == [([0, 0, 0], "", "", "", V.LAW_UNTITLED, "only text\n1. no article", 1, None, None)]
    assert law(spark, None) == law(spark, " \n ") == []
    many = law(spark, "\n".join(f"Điều {i}. t\n" + "\n".join(f"{j}. x{j}" for j in range(40)) for i in range(300)))
    assert len(many) == 12000 and many[-1][7] == "dieu_299_khoan_39" and len({r[7] for r in many}) == 12000


FIELDS = {"q": ("string", ["question"]), "context": ("string", ["context_list", "context"]), "n": ("long", ["n"])}


def sniffed(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "path long, text string")
    return [tuple(r) for r in sniffed_records(rows, FIELDS, "question").orderBy("path", "at").collect()]


def test_json_shapes(spark):
    a, b = {"question": "x", "context": "c", "n": 1}, {"question": "y", "context_list": ["p", "q"], "n": "no number"}
    want = [("x", "c", 1, None), ("y", '["p","q"]', None, None)]
    got = sniffed(spark, json.dumps([a, b]), json.dumps({"count": 2, "sample": a, "0": b, "1": {"other": 1}, "2": [b]}), json.dumps({"meta": {}, "empty": [], "rows": [a, b], "then": [1]}))
    for i, shape in enumerate(["list", "sample", "nested"]):
        assert [r[3:] for r in got if r[0] == i] == want
        assert {r[1] for r in got if r[0] == i} == {shape} and [r[2] for r in got if r[0] == i] == [0, 1]


def test_json_that_cannot_be_read(spark):
    got = sniffed(spark, "{broken", None, "3", '{"a": 1}', '[{"question": "x"}, 7, null, [1]]', "[]", "")
    none = (None, None, None)
    assert [r[3:6] for r in got if r[6]] == [none] * 8
    assert Counter((r[0], r[6]) for r in got) == Counter({(0, "not JSON"): 1, (1, "not JSON"): 1, (2, "unexpected shape"): 1, (3, "unexpected shape"): 1, (4, None): 1, (4, "not a record"): 3, (6, "not JSON"): 1})


# Examples printed with the published rules.
EXAMPLES = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize
bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil a a is is""".split()


def test_stems():
    assert [(w, P.stem(w)) for w in EXAMPLES[::2]] == list(zip(EXAMPLES[::2], EXAMPLES[1::2]))


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def scores(a, b):
    def f(x, y):
        both = (Counter(x) & Counter(y)).total()
        return (both / len(x) if x else 0, both / len(y) if y else 0, 2 * both / (len(x) + len(y)) if both else 0)

    p, r, one = f(a, b)
    return p, r, one, f(list(zip(a, a[1:])), list(zip(b, b[1:])))[2], 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0


def test_rouge_over_stems(spark):
    texts = ["The cats were running, hopping and running", "A cat runs; the hopeful cat hops!", "", None, "generalizations of conditions", "Général conditions of generalization 42 the the"]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    words = lambda t: [P.stem(w) if len(w) > 3 else w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (t or "").lower()).split()]
    found = P.rouge(spark.createDataFrame(pairs, "id long, candidate string, reference string").repartition(3), ["id"])
    got = {r[0]: r[1:] for r in found.collect()}
    want = {i: scores(words(a), words(b)) for i, a, b in pairs}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    mean = P.rouge_average(found).first()
    assert mean[0] == 36 and list(mean[1:]) == pytest.approx([sum(w[k] for w in want.values()) / 36 for k in range(5)], abs=1e-6)
    assert tuple(P.rouge_average(found.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    nulls = spark.createDataFrame([(["cats", None], ), (None,), ([],)], "w array<string>")
    assert nulls.coalesce(1).select(P.stems(F.col("w"))).collect() == [(["cat", None],), (None,), ([],)]


CHUNKS = [(1, "Law", "1.1", ["2", " ", "9"], "first text"), (2, "Code", None, [], "second text"), (3, "Law", "2", None, "z" * 700), (4, "Law", "2", [], "x"), (5, "Law", "2", [], "third of its section"), (6, None, "2.1", ["2"], None)]


def test_answered(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, name string, section string, refs array<string>, text string")
    found = spark.createDataFrame([(2, 1.0), (1, 3.0), (6, 1.0), (99, 5.0)], "chunk_id long, score double")
    r = Q.answered(found, chunks, "why?").first()
    assert [(s["rank"], s["chunk_id"], s["section"]) for s in r.sources] == [(1, 1, "1.1"), (2, 2, ""), (3, 6, "2.1")]
    assert r.context == "[Law §1.1]\nfirst text\n\n---\n\n[Code]\nsecond text\n\n---\n\n[§2.1]\n\n\n---\n\n## Referenced Sections:\n[§2 - Law]\n" + "z" * 600 + "\n\n[§2 - Law]\nx"
    assert r.answer == "Related passages:\n\n- [Law §1.1]: first text\n\n- [Code §]: second text\n\n- [ §2.1]: "
    model = Q.answered(found.where("chunk_id = 2"), chunks, "why?", lambda q, c, s: F.concat(q, F.lit("|"), c, F.lit("|"), F.size(s))).first()
    assert model.answer == "why?|[Code]\nsecond text|1"
    nothing = Q.answered(found.limit(0), chunks, "why?").first()
    assert (nothing.answer, nothing.context, nothing.sources) == (Q.NOTHING, "", [])


def test_rouge_keeps_words_in_arrow(spark):
    pairs = spark.createDataFrame([(1, "a b c a b", "b c a b d"), (2, "", "x"), (3, None, None), (4, "x", "x")], "id long, candidate string, reference string")
    found = P.rouge(pairs, ["id"], stemmed=False)
    assert {r.id: tuple(round(v, 6) for v in r[1:]) for r in found.collect()} == {1: (0.8, 0.8, 0.8, 0.75, 0.8), 2: (0.0,) * 5, 3: (0.0,) * 5, 4: (1.0, 1.0, 1.0, 0.0, 1.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_overlap" not in plan and "_longest_common_udf" not in plan
