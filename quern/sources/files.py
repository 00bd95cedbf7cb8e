"""Readers: files of many formats, tables in text formats, logs, image folders, JDBC. Everything stays distributed."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from quern.functions import text as T

FORMATS = {"pdf": "pdf", "docx": "docx", "html": "html", "htm": "html"}


def detect_format(c: Column | str) -> Column:
    """pdf, docx, html or text by the suffix of a file name or URL."""
    suffix = F.lower(F.regexp_extract(T.col(c), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    out = F.lit("text")
    for name, kind in FORMATS.items():
        out = F.when(suffix == name, kind).otherwise(out)
    return out


def _pdf(data: bytes) -> str | None:
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)


def _docx(data: bytes) -> str | None:
    """Paragraph texts of the document part of the package."""
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        root = ElementTree.fromstring(package.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, kind, content in zip(batch["path"], batch["format"], batch["content"]):
            try:
                out.append((path, kind, _pdf(content) if kind == "pdf" else _docx(content), None))
            except Exception as error:  # one broken file must not stop the others; it goes to the dead letters
                out.append((path, kind, None, str(error)[:500]))
        yield pd.DataFrame(out, columns=["path", "format", "text", "error"])


def parse(files: DataFrame) -> DataFrame:
    """(path, format, text, error) of (path, content) rows, batch or streaming; text and HTML in the JVM, the rest by adapters.

    Bad bytes of a text are replaced, so no file stops the others. Text without an adapter here (PDF without its library) is null with an error; callers keep rows with text and write
    the others to a dead-letter table.
    """
    rows = files.select("path", "content", detect_format("path").alias("format"))
    plain = F.make_valid_utf8(F.col("content").cast("string"))  # bad bytes become replacement characters
    native = rows.where(F.col("format").isin("text", "html")).select(
        "path", "format", F.when(F.col("format") == "html", T.html_text(plain)).otherwise(plain).alias("text"), F.lit(None).cast("string").alias("error")
    )
    packed = rows.where(~F.col("format").isin("text", "html")).select("path", "format", "content").mapInPandas(_packed, "path string, format string, text string, error string")
    missing = F.when(F.col("text").isNull() & F.col("error").isNull(), F.lit("no reader for this format")).otherwise(F.col("error"))
    return native.unionByName(packed.withColumn("error", missing))


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content"))


def read_texts(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """(doc_id, text): a file each, its stem as id."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    out = rows.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("doc_id"), F.col("value").alias("text"))
    return out if ids is None else out.where(F.col("doc_id").isin(*ids))


def read_csv(spark: SparkSession, path: str, schema: K.StructType | str) -> DataFrame:
    """A CSV file with a header and an explicit schema."""
    return spark.read.schema(schema).option("header", "true").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd").csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A whole table over JDBC, partitioned by a numeric column if one is named; the table's name is checked, never quoted."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", table):
        raise ValueError(f"not a table name: {table!r}")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def first_available(*readers) -> tuple[DataFrame, int]:
    """The first source that can be read, and which one it was."""
    last: Exception | None = None
    for i, reader in enumerate(readers):
        try:
            df = reader()
            df.schema  # noqa: B018  resolves the source
            return df, i
        except Exception as error:  # the next source is the answer to any failure of this one
            last = error
    raise last or ValueError("no source given")


def read_records(spark: SparkSession, path: str, schema: str, lines: bool = False, field: str | None = None) -> DataFrame:
    """JSON or JSON lines records by schema; with field, the list of records under it."""
    if field is None:
        return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)
    return spark.read.schema(f"{field} array<struct<{schema.replace(' ', ':')}>>").option("multiLine", "true").json(path).select(F.explode(field).alias("r")).select("r.*")


def list_cells(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, column, value) of cells that hold list literals, else of their parts between line ends and semicolons."""
    long = df.select(id_col, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("cell")) for c in columns])).alias("x")).select(id_col, "x.*")
    as_list = F.from_json(F.replace("cell", F.lit("'"), F.lit('"')), "array<string>")
    parts = F.when(F.trim("cell").startswith("["), F.coalesce(as_list, F.split("cell", r"[\n;]"))).otherwise(F.split("cell", r"[\n;]"))
    return long.where("cell is not null").select(id_col, "column", F.explode(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda v: v != "")).alias("value"))


def image_folder(files: DataFrame, classes: list[str] | None = None, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp")) -> DataFrame:
    """(path, class, label) of files in class folders; labels number the class names in order."""
    rows = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix")).where(F.col("suffix").isin(*suffixes))
    if classes is not None:
        rows = rows.where(F.col("class").isin(*classes))
    names = rows.select("class").distinct().withColumn("label", (F.row_number().over(Window.orderBy("class")) - 1).cast("long"))  # as many rows as classes
    return rows.join(F.broadcast(names), "class").select("path", "class", "label")


def epoch_log(lines: DataFrame, file: str = "file", at: str = "at", line: str = "line") -> DataFrame:
    """(model, epoch, loss, accuracy) of a training log: epoch lines belong to the last model named above them in their file."""
    w = Window.partitionBy(file).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    name = F.nullif(F.regexp_extract(line, r"(?i)model[: ]+(\S+)", 1), F.lit(""))
    number = lambda p: F.regexp_extract(line, p, 1)
    rows = lines.withColumn("model", F.last(name, ignorenulls=True).over(w)).where(F.col(line).rlike(r"(?i)epoch[ :]+\d+"))
    return rows.select(
        "model", number(r"(?i)epoch[ :]+(\d+)").cast("long").alias("epoch"), number(r"(?i)loss[ =:]+([0-9.]+)").try_cast("double").alias("loss"), number(r"(?i)acc(?:uracy)?[ =:]+([0-9.]+)").try_cast("double").alias("accuracy")
    )


def sniffed_records(payloads: DataFrame, fields: dict[str, tuple[str, list[str]]], needed: str, id_col: str = "path", text_col: str = "text", sample: str = "sample") -> DataFrame:
    """(id, shape, at, fields..., error) of the records of JSON payloads of three shapes, read without a schema as VARIANT.

    list: every item is a record. sample: an object with a record under `sample` is followed by its other objects that have
    `needed`, in the order of their names. nested: the first list with items, by name, of an object. fields gives each column's type
    and the names it may have in a record; a value of another type is null. What cannot be read is a row with an error
    and no fields: a text that is no JSON, another shape, or an item that is no object.
    """
    v = F.try_parse_json(F.col(text_col))
    rows = payloads.select(F.col(id_col), v.alias("v")).withColumn("kind", F.schema_of_variant("v"))
    items = lambda c: F.try_variant_get(c, "$", "array<variant>")
    inside = lambda c, name: F.try_variant_get(c, f"$['{name}']", "variant")
    record = lambda c: F.schema_of_variant(c).startswith("OBJECT")
    entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    first = F.get(F.filter(F.transform(entries, lambda e: items(e["value"])), lambda x: F.size(x) > 0), F.lit(0))
    rest = F.filter(entries, lambda e: (e["key"] != sample) & record(e["value"]) & inside(e["value"], needed).isNotNull())
    sampled = F.concat(F.array(inside(F.col("v"), sample)), F.transform(rest, lambda e: e["value"]))
    is_object = F.col("kind").startswith("OBJECT")
    rows = rows.withColumn("shape", F.when(F.col("kind").startswith("ARRAY"), "list").when(is_object & inside(F.col("v"), sample).isNotNull(), "sample").when(is_object & first.isNotNull(), "nested"))
    found = F.when(F.col("shape") == "list", items(F.col("v"))).when(F.col("shape") == "sample", sampled).when(F.col("shape") == "nested", first)
    rows = rows.select(id_col, "shape", F.col("kind").isNotNull().alias("read"), F.posexplode_outer(found).alias("at", "item")).where("at is not null or shape is null")
    good = F.coalesce(record(F.col("item")), F.lit(False))
    error = F.when(~F.col("read"), "not JSON").when(F.col("shape").isNull(), "unexpected shape").when(~good, "not a record")
    columns = [F.when(good, F.coalesce(*[F.try_variant_get("item", f"$['{n}']", kind) for n in known])).alias(name) for name, (kind, known) in fields.items()]
    return rows.select(id_col, "shape", F.col("at").cast("long").alias("at"), *columns, error.alias("error"))
