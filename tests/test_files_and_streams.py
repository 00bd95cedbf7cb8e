"""Readers, writers and streams on files made here."""

import io
import zipfile

from pyspark.sql import functions as F

from quern.operators import text_index as I
from quern.sources import files, keyed, sinks
from quern.streaming import jobs


def test_read_many_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.html").write_text("<html><body><p>hi</p><script>no</script></body></html>")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert got["a.txt"].text == "plain text" and got["b.html"].text == "hi" and got["c.docx"].text == "one\ntwo"
    assert got["d.docx"].text is None and got["d.docx"].error


def test_texts_csv_json_lists(spark, tmp_path):
    (tmp_path / "x.txt").write_text("l1\nl2")
    assert [tuple(r) for r in files.read_texts(spark, f"file://{tmp_path}").collect()] == [("x", "l1\nl2")]
    (tmp_path / "t.csv").write_text("a,b\n1,2020-01-02 03:04:05\n")
    assert files.read_csv(spark, f"file://{tmp_path}/t.csv", "a int, b timestamp").first().a == 1
    (tmp_path / "r.json").write_text('{"rows": [{"a": 1}, {"a": 2}]}')
    assert files.read_records(spark, f"file://{tmp_path}/r.json", "a int", field="rows").count() == 2
    cells = spark.createDataFrame([(1, "['x', 'y']"), (2, "p; q\nr"), (3, None)], "id long, c string")
    assert sorted(r.value for r in files.list_cells(cells, "id", ["c"]).collect()) == ["p", "q", "r", "x", "y"]
    df, which = files.first_available(lambda: spark.read.parquet("file:///nowhere/at/all"), lambda: cells)
    assert which == 1 and df.count() == 3


def test_image_folder_and_log(spark):
    paths = spark.createDataFrame([("f:/d/cat/1.jpg",), ("f:/d/ant/2.PNG",), ("f:/d/ant/x.txt",)], "path string")
    assert {(r["class"], r.label) for r in files.image_folder(paths).collect()} == {("ant", 0), ("cat", 1)}
    log = [("f", 0, "Model: a"), ("f", 1, "epoch 1 loss=0.5 acc=0.7"), ("f", 2, "model b"), ("f", 3, "Epoch: 2 loss: 0.25")]
    got = files.epoch_log(spark.createDataFrame(log, "file string, at long, line string")).orderBy("epoch").collect()
    assert [(r.model, r.epoch, r.loss, r.accuracy) for r in got] == [("a", 1, 0.5, 0.7), ("b", 2, 0.25, None)]


def test_versioned_merge(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.merge_into(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), path, ["k"])
    sinks.merge_into(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), path, ["k"])
    sinks.delete_from(spark, path, spark.createDataFrame([(1,)], "k long"), ["k"])
    assert sorted(tuple(r) for r in sinks.read_table(spark, path).collect()) == [(2, "c"), (3, "d")]


def test_document_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"{i}.txt").write_text(f"Document {i}. It has two sentences.")
    (src / "empty.txt").write_text(" \n")
    tables = []
    for per in (100, 2):
        out = tmp_path / f"out{per}"
        jobs.start_documents(spark, f"file://{src}", f"file://{out}", f"file://{tmp_path}/cp{per}", per_batch=per).awaitTermination()
        docs = keyed.read(spark, f"file://{out}/documents")
        tables.append((sorted(r.text for r in docs.collect()), sorted((r.chunk, r.text) for r in keyed.read(spark, f"file://{out}/chunks").collect())))
        assert keyed.read(spark, f"file://{out}/dead_letters").count() == 1
    assert tables[0] == tables[1] and len(tables[0][0]) == 5


def test_event_windows_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = f"file://{tmp_path}/events"
    events.repartitionByRange(4, "ts").write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    q = jobs.windowed_counts(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.awaitTermination()
    got = {(r.w.start, r.event_type): r.n for r in spark.table("win").collect()}
    want = {(r.w.start, r.event_type): r.n for r in events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_docx_without_document_part_is_a_dead_letter(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("other.xml", "<a/>")
    row = files.parse(spark.createDataFrame([("x.docx", data.getvalue()), ("y.txt", None)], "path string, content binary")).orderBy("path").collect()
    assert row[0].error and row[1].text is None


def test_bad_bytes_are_replaced(spark):
    row = files.parse(spark.createDataFrame([("a.txt", b"caf\xe9 ok"), ("b.html", b"<p>x\xff</p>")], "path string, content binary")).orderBy("path").collect()
    assert row[0].text == "caf� ok" and row[1].text == "x�" and row[0].error is None


def test_documents_that_shrink_and_files_that_are_repaired(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    run = jobs.store_documents(out, index=True)
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, content binary").selectExpr("path", "current_timestamp() as modificationTime", "length(content) as length", "content")
    long = " ".join(f"Sentence number {i} of a long document with several words in it." for i in range(400)).encode()
    run(batch(("a.txt", long), ("b.pdf", b"broken"), ("c.txt", b"A license here.")), 0)
    chunks = lambda: keyed.read(spark, f"{out}/chunks").count()
    assert chunks() > 2 and keyed.read(spark, f"{out}/dead_letters").count() == 1
    for n in (1, 1, 2, 3, 4):  # a batch may run twice
        run(batch(("a.txt", b"Short now."), ("b.pdf", b"broken")), n)
    assert chunks() == 2 and keyed.read(spark, f"{out}/documents").count() == 2
    assert len(list((tmp_path / "out" / "documents").glob("v*"))) == 3
    run(batch(("b.pdf", b"")), 5)
    assert keyed.read(spark, f"{out}/dead_letters").count() == 1
    docs = {r.path: r.doc_id for r in keyed.read(spark, f"{out}/documents").collect()}
    hits = lambda q: [r.doc_id for r in I.search_index(spark, f"{out}/index", q).collect()]
    assert hits("license") == [docs["c.txt"]] and hits("short") == [docs["a.txt"]] and hits("number") == [] and hits("...") == []


def test_index_segments(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple apple"), (3, None)], "doc_id long, text string")
    assert I.index_all(docs, path) == 0 and I.index_all(docs, path) is None and I.index_all(docs, path, force=True) == 1
    assert [r.doc_id for r in I.search_index(spark, path, "apple red").collect()] == [1, 2]
    I.write_segment(docs.where("doc_id = 2").selectExpr("doc_id", "'blue' as text"), path, gone=docs.where("doc_id = 1").select("doc_id"))
    assert I.search_index(spark, path, "apple").count() == 0 and [r.doc_id for r in I.search_index(spark, path, "blue").collect()] == [2]
    assert sorted(r.doc_id for r in I.live_documents(spark, path).collect()) == [2, 3]


def test_evaluation_and_tags(spark, tmp_path):
    import json

    one = spark.createDataFrame([(3, 0.5)], "n long, mrr double")
    sinks.write_evaluation(one, spark.createDataFrame([("a", 1), ("b", 2)], "source string, n long"), f"file://{tmp_path}/e", "bm25")
    text = "".join(p.read_text() for p in (tmp_path / "e").glob("*.json"))
    assert json.loads(text) == {"method": "bm25", "summary": {"n": 3, "mrr": 0.5}, "groups": [{"source": "a", "n": 1}, {"source": "b", "n": 2}]}
    tags = spark.createDataFrame([(1, "lang", "en")], "doc_id long, name string, value string")
    for value in ("en", "de"):
        sinks.write_tags(tags.withColumn("value", F.lit(value)), f"file://{tmp_path}/tags", ["doc_id", "name"])
    assert [tuple(r) for r in sinks.read_table(spark, f"file://{tmp_path}/tags").collect()] == [(1, "lang", "de")]


def test_keyed_tables_rewrite_only_touched_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    rows = lambda: sorted((tuple(r) for r in keyed.read(spark, path).collect()), key=str)
    files_of = lambda: {p for p in tmp_path.glob("t/rows/*/*/*.parquet")}
    assert keyed.read(spark, path) is None and keyed.delete_from(path, make(), ["k"]) is None
    keyed.merge_into(make(), path, ["k"], buckets=16)
    assert rows() == [] and keyed.merge_into(make(), path, ["k"]) is None
    keyed.merge_into(make(*[(i, "a") for i in range(200)], (None, "n")), path, ["k"], buckets=16)
    before = files_of()
    assert len(rows()) == 201 and len({p.parent.name for p in before}) == 16
    keyed.merge_into(make((7, "b")), path, ["k"])
    assert len({p.parent for p in files_of() - before}) == 1 and len(rows()) == 201 and (7, "b") in rows() and (7, "a") not in rows()
    keyed.delete_from(path, make((7, ""), (999, "")), ["k"])
    assert len(rows()) == 200 and (None, "n") in rows()
    keyed.replace_in(make((8, "x"), (8, "y")), path, make((8, "")), ["k"])
    assert [r for r in rows() if r[0] == 8] == [(8, "x"), (8, "y")] and len(rows()) == 201
    old = spark.read.parquet(f"{path}/v0000000001")  # an earlier version is whole until it expires
    assert old.where("bucket >= 0").count() == 16
    want = rows()
    keyed.expire(spark, path, keep=1)
    assert rows() == want and len(list(tmp_path.glob("t/v*"))) == 1 and len({p.parent for p in files_of()}) == 16
    keyed.rebucket(spark, path, ["k"], 4)
    assert rows() == want and len({p.parent for p in files_of() if p.parent.parent.name == f"write={max(int(q.name.split('=')[1]) for q in tmp_path.glob('t/rows/*'))}"}) == 4
    keyed.merge_into(make(*[(i, "c") for i in range(200)]), path, ["k"])
    assert len(rows()) == 201 and sum(r[1] == "c" for r in rows()) == 200


def test_a_file_rewrites_its_own_bucket(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    run = jobs.store_documents(out)
    batch = lambda *rows: spark.createDataFrame(list(rows), "path string, content binary").selectExpr("path", "current_timestamp() as modificationTime", "length(content) as length", "content")
    run(batch(*[(f"{i}.txt", b"One sentence here.") for i in range(60)]), 0)
    seen = set(tmp_path.glob("out/documents/rows/*/*/*.parquet"))
    run(batch(("5.txt", b"Another sentence now.")), 1)
    assert len(set(tmp_path.glob("out/documents/rows/*/*/*.parquet")) - seen) == 1
    assert keyed.read(spark, f"{out}/documents").count() == 60 and keyed.read(spark, f"{out}/chunks").where("text like 'Another%'").count() == 1
