"""Document processing: references with offsets, sections, chunks, tags, keyphrases, duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import runs
from quern.functions import text as T
from quern.operators import phrases as P

#: Folded chunk windows: tokens to a chunk, tokens carried over, tokens below which a windowed chunk is dropped.
MOST, OVERLAP, LEAST = 512, 64, 20

#: Words that a kernel counts at once, and rows that it gives at once.
KERNEL_WORDS, OUT_ROWS = 1_000_000, 200_000
#: Bytes of texts that a kernel labels at once.
KERNEL_BYTES = 4 << 20


# --- spans ----------------------------------------------------------------------------------------------------------


def spans(c: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern as structs (value, start, end), offsets from 0 in characters; null for null.

    Between the matches stand the pieces that split() leaves, so the running sums of their lengths give the offsets.
    """
    text = T.col(c)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    ends = runs.sums(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m)))
    each = F.arrays_zip(values.alias("v"), found.alias("m"), ends.alias("e"))
    return F.transform(each, lambda x: F.struct(x["v"].alias("value"), (x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end")))


def _typed(patterns: dict[str, str], text_col: str) -> Column:
    """All spans of every typed pattern in a text: an array of (type, value, start, end)."""

    def one(kind: str, pattern: str) -> Column:
        return F.transform(spans(text_col, pattern), lambda s: F.struct(F.lit(kind).alias("type"), s["value"].alias("value"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))

    return F.concat(*[one(kind, p) for kind, p in patterns.items()])


def references(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, type, value, start, end) of every typed pattern in every text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(_typed(patterns, text_col)).alias("r")).select("doc_id", "r.*")


def _labels(ids: pa.Array, texts: pa.Array, spans_of: pa.Array) -> pa.RecordBatch:
    """(doc_id, at, token, label) of some texts with their spans (start, end, type) in order."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    at, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64), texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    black = (data != 32) & ((data < 9) | (data > 13))
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    shown = np.concatenate([[False], black, [False]])
    first = np.flatnonzero(shown[1:-1] & (~shown[:-2] | edge[:-1]))
    last = np.flatnonzero(shown[1:-1] & (~shown[2:] | edge[1:])) + 1
    doc = np.searchsorted(at, first, "right") - 1
    a, b = chars[first] - chars[at[doc]], chars[last] - chars[at[doc]]
    # A text's characters and what lies beyond them have places of their own on one line, so that one search finds the spans of all texts.
    length = np.diff(chars[at])
    base = np.concatenate([[0], np.cumsum(length + 2)])
    own = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(spans_of), 0).to_numpy(zero_copy_only=False))
    flat = spans_of.flatten()
    start, end = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    place = lambda x: base[own] + np.clip(x, 0, length[own] + 1)
    furthest = np.maximum.accumulate(place(end)) if len(own) else place(end)
    near = np.searchsorted(furthest, base[doc] + a, "right")  # the first span that ends behind the token's start
    some = np.flatnonzero(near < len(own))
    some = some[place(start)[near[some]] < (base[doc] + b)[some]]
    kinds = pc.struct_field(flat, 2).cast(pa.string()).dictionary_encode()
    names = pa.concat_arrays([pa.array(["O"]), *(pc.binary_join_element_wise(head, kinds.dictionary, "") for head in ("B-", "I-"))])
    code = np.zeros(len(doc), np.int64)
    kind = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[near[some]]
    code[some] = np.where(kind < 0, -1, 1 + kind + len(kinds.dictionary) * (a[some] > start[near[some]]))
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[black]))
    count = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(count), tokens, names.take(pa.array(code, mask=code < 0))], ["doc_id", "at", "token", "label"])


def _labelled(rows: DataFrame) -> DataFrame:
    """bio_labels of (doc_id, text, spans): a text's tokens and spans are met where the row is, tokens are not shuffled."""
    own = F.filter("spans", lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    own = F.array_sort(F.transform(own, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["type"].alias("type"))))
    rows = rows.select("doc_id", "text", own.alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs.slices(sizes, KERNEL_BYTES):
                yield _labels(*(batch.column(i).slice(a, b - a) for i in range(3)))

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, at long, token string, label string")


def bio_labels(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, token, label): white-space tokens labelled B-type, I-type or O by the spans they overlap; of several the first counts."""
    named = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type")).alias("spans"))  # spans of one document
    return _labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(named, "doc_id", "left"))


def bio_labels_of(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bio_labels by a text's own references: found where the text is read, without a shuffle."""
    return _labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _typed(patterns, text_col).alias("spans")))


# --- chunks ---------------------------------------------------------------------------------------------------------


def sentence_window(parts: Column, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Sentences packed into chunks of at most `most` white-space tokens; whole trailing sentences of up to `overlap` tokens
    are carried into the next chunk; chunks under `least` tokens go; a sentence over `most` is a chunk of its own."""
    size = lambda s: F.size(F.split(s, r"\s+"))
    chunks = runs.joined(parts, runs.by_size(F.transform(parts, size), most, overlap), " ")
    return F.filter(chunks, lambda c: size(c) >= least)


def merged_parts(parts: Column, most: int = 1200, gap: int = 2) -> Column:
    """Neighbouring parts joined by blank lines while they fit into `most` characters, separators counted; empty parts go."""
    kept = F.filter(parts, lambda p: p != "")
    return runs.joined(kept, runs.by_size(F.transform(kept, lambda p: F.length(p) + gap), most + gap), "\n" * gap)


def fixed_overlap(parts: Column, words: int, overlap: int) -> Column:
    """Sentences packed to at most `words` words; each chunk starts with the last `overlap` sentences of the one before, where the
    next one fits with them; a sentence with more words is cut to pieces first."""

    def pieces(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / words).cast("int")), lambda i: F.array_join(F.slice(w, i * words + 1, F.lit(words)), " "))

    cut = F.flatten(F.transform(F.transform(parts, lambda s: F.split(s, " ")), pieces))
    whole = lambda n: F.floor((n - 1) / words).cast("int")
    sizes = F.flatten(F.transform(F.transform(parts, lambda s: F.size(F.split(s, " "))), lambda n: F.concat(F.array_repeat(F.lit(words), whole(n)), F.array(n - whole(n) * words))))
    return runs.joined(cut, runs.by_count(sizes, words, overlap), " ")


def sections(docs: DataFrame, levels: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Header-carried sections: (doc_id, section, level, heading, parent, content).

    levels are patterns of header lines from the outermost in. A line belongs to the last header above it; a header's parent
    is the last header of an outer level above it. Lines before any header are section 0 of level 0.
    """
    line = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line")
    rows = docs.select(F.col(id_col).alias("doc_id"), line)
    level = F.lit(None).cast("int")
    for i in range(len(levels), 0, -1):
        level = F.when(F.col("line").rlike(levels[i - 1]), i).otherwise(level)
    w = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("level", level).withColumn("section", F.count("level").over(w))
    ends = [F.max(F.when(F.col("level") <= i, F.col("section"))).over(w).alias(f"s{i}") for i in range(1, len(levels) + 1)]
    rows = rows.select("*", *ends)
    parent = F.lit(None).cast("long")
    for i in range(2, len(levels) + 1):
        parent = F.when(F.col("level") == i, F.col(f"s{i - 1}")).otherwise(parent)
    rows = rows.withColumn("parent", parent)
    lines = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("level").isNull(), F.col("line")).alias("line"))))
    return rows.groupBy("doc_id", "section").agg(
        F.coalesce(F.max("level"), F.lit(0)).cast("long").alias("level"), F.max(F.when(F.col("level").isNotNull(), F.trim("line"))).alias("heading"), F.max("parent").alias("parent"),
        F.trim(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("content"),
    )


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _cut_at(text: Column, pattern: str) -> Column:
    """Pieces (number, head, body) of a text from each header on; pattern has groups of the number and of the rest of the header's line."""
    pieces = F.split(F.regexp_replace(text, pattern, "\x01$1\x02$2\x03"), "\x01")
    piece = lambda p: F.struct(
        F.substring_index(p, "\x02", 1).alias("number"),
        F.substring_index(F.substring_index(p, "\x03", 1), "\x02", -1).alias("head"),
        F.substring_index(p, "\x03", -1).alias("body"),
    )
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), piece)


def keyed_sections(docs: DataFrame, patterns: list[str], names: list[str], untitled: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, article, clause, point, title, content, level, key, parent_key) of laws: their smallest sections, in order of at.

    patterns find headers of articles, of clauses and of points, names make keys. An article with clauses is its clauses, a
    clause with points its points; what stands before the first of them goes, as does what stands before the first article. A
    text without articles is one section named untitled, a blank or null one none. Control characters 1 to 3 are dropped. Each
    level is one pass over its text and one explode: no shuffle, no window.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\x01\x02\x03", "")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    empty = lambda head, body: F.array(F.struct(F.lit("").alias("number"), head.alias("head"), body.alias("body")))
    or_whole = lambda found, head, body: F.when(F.size(found) > 0, found).otherwise(empty(head, body))
    rows = rows.withColumn("a", _cut_at(F.col("text"), patterns[0])).select("doc_id", F.posexplode(or_whole(F.col("a"), F.lit(untitled), F.col("text"))).alias("i", "a"))
    rows = rows.withColumn("text", _strip(F.col("a.body"))).withColumn("c", F.when(F.col("a.number") == "", F.array().cast("array<struct<number:string,head:string,body:string>>")).otherwise(_cut_at(F.col("text"), patterns[1])))
    rows = rows.select("doc_id", "i", F.col("a.number").alias("article"), _strip(F.col("a.head")).alias("title"), F.posexplode(or_whole(F.col("c"), F.lit(""), F.col("text"))).alias("j", "c"))
    rows = rows.withColumn("text", F.when(F.col("c.number") == "", F.col("c.body")).otherwise(_strip(F.concat("c.head", F.lit(" "), "c.body"))))
    rows = rows.withColumn("p", F.when(F.col("c.number") == "", F.array().cast("array<struct<number:string,head:string,body:string>>")).otherwise(_cut_at(F.col("text"), patterns[2])))
    rows = rows.select("doc_id", "i", "j", "article", "title", F.col("c.number").alias("clause"), F.posexplode(or_whole(F.col("p"), F.lit(""), F.col("text"))).alias("k", "p"))
    content = F.when(F.col("p.number") == "", F.col("p.body")).otherwise(F.concat("p.head", F.lit(" "), "p.body"))
    rows = rows.withColumns({"point": F.col("p.number"), "content": _strip(content)})
    steps = [F.concat(F.lit(f"{name}_"), c) for name, c in zip(names, ("article", "clause", "point"))]
    keys = [F.concat_ws("_", *steps[: n + 1]) for n in range(3)]
    level = F.when(F.col("point") != "", 3).when(F.col("clause") != "", 2).otherwise(1)
    by_level = lambda one, two, three: F.when(F.col("level") == 3, three).when(F.col("level") == 2, two).otherwise(one)
    return rows.withColumn("level", level.cast("long")).select(
        "doc_id", F.array("i", "j", "k").alias("at"), "article", "clause", "point", F.when(F.col("level") == 1, F.col("title")).otherwise("").alias("title"), "content", "level",
        by_level(F.when(F.col("article") != "", keys[0]), keys[1], keys[2]).alias("key"), by_level(F.lit(None).cast("string"), keys[0], keys[1]).alias("parent_key"),
    )


def leaf_sections(found: DataFrame) -> DataFrame:
    """Sections of the deepest level that their document has."""
    return found.withColumn("_deep", F.max("level").over(Window.partitionBy("doc_id"))).where("level = _deep").drop("_deep")


def section_chunks(docs: DataFrame, patterns: list[str], least: int = 80, most: int = 1200, near: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, section_id, start, text, parents, xrefs): texts cut at headers of several patterns.

    A header within `near` characters of one that an earlier pattern found is the same header. What stands before the first
    header is the preamble. A section over `most` characters is split into paragraphs that are merged up to `most`; chunks
    under `least` characters go. Group 1 of a pattern is the section's number.
    """

    def found(turn: int, pattern: str) -> Column:
        return F.transform(spans(text_col, pattern, 1), lambda s: F.struct(F.lit(turn).alias("turn"), s["start"].alias("start"), s["value"].alias("id")))

    heads = F.concat(*[found(i, p) for i, p in enumerate(patterns)])
    kept = F.aggregate(
        F.array_sort(heads), F.array().cast("array<struct<turn:int,start:int,id:string>>"),
        lambda h, x: F.when(F.exists(h, lambda k: F.abs(k["start"] - x["start"]) <= near), h).otherwise(F.concat(h, F.array(x))),
    )
    cuts = F.array_sort(F.transform(kept, lambda k: F.struct(k["start"].alias("start"), k["id"].alias("id"))))
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit("preamble").alias("id")))
    cuts = F.when(F.exists(cuts, lambda k: k["start"] == 0), cuts).otherwise(F.concat(first, cuts))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), cuts.alias("cuts"))
    ends = F.concat(F.slice(F.transform("cuts", lambda k: k["start"]), F.lit(2), F.greatest(F.size("cuts") - 1, F.lit(0))), F.array(F.length("text")))
    parts = rows.select("doc_id", "text", F.explode(F.arrays_zip(F.col("cuts").alias("c"), ends.alias("e"))).alias("x")).select(
        "doc_id", F.col("x.c.id").alias("section_id"), F.col("x.c.start").alias("start"), F.trim(F.substr("text", F.col("x.c.start") + 1, F.col("x.e") - F.col("x.c.start"))).alias("text")
    )
    pieces = F.when(F.length("text") <= most, F.array("text")).otherwise(merged_parts(F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != ""), most))
    chunks = parts.select("doc_id", "section_id", "start", F.posexplode(pieces).alias("n", "text")).where(F.length("text") >= least)
    order = Window.partitionBy("doc_id").orderBy("start", "n")
    return chunks.select(
        "doc_id", (F.row_number().over(order) - 1).cast("long").alias("chunk"), "section_id", F.col("start").cast("long").alias("start"), "text",
        T.parents(F.col("section_id")).alias("parents"), T.cross_references("text").alias("xrefs"),
    )


# --- tags and keyphrases --------------------------------------------------------------------------------------------


def top_keywords(docs: DataFrame, stop_words: list[str], k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k commonest runs of three and more letters of each text, stop words out, first seen first among equals."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    words = docs.select(F.col(id_col).alias("doc_id"), F.filter(T.letter_runs(text_col), lambda w: ~F.array_contains(stop, w)).alias("words"))
    schema = f"doc_id {words.schema['doc_id'].dataType.simpleString()}, word string, n long, rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs.slices(sizes, KERNEL_WORDS):
                terms = lists.slice(a, b - a).flatten().dictionary_encode()
                kinds = max(1, len(terms.dictionary))
                row = np.repeat(np.arange(b - a), sizes[a:b])
                key, first, n = np.unique(row * kinds + terms.indices.to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
                order = np.lexsort((first, -n, key // kinds))
                doc = (key // kinds)[order]
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
                best = rank <= k
                own = order[best]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(doc[best])), terms.dictionary.take(pa.array(key[own] % kinds)), pa.array(n[own]), pa.array(rank[best].astype(np.int64))], ["doc_id", "word", "n", "rank"]
                )

    return words.mapInArrow(run, schema)


def concepts(docs: DataFrame, rules: dict[str, list[str]], other: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, concept, confidence): for each concept min(1, 2 * patterns hit / patterns), rounded; (other, 0.5) without any."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = []
    for name, patterns in rules.items():
        hits = reduce(lambda a, b: a + b, [text.rlike(f"(?U){p}").cast("int") for p in patterns])  # letters of any script are word characters
        rows.append(F.struct(F.lit(name).alias("concept"), F.round(F.least(F.lit(1.0), hits / len(patterns) * 2), 3).alias("confidence")))
    found = F.filter(F.array(*rows), lambda r: r["confidence"] > 0)
    none = F.array(F.struct(F.lit(other).alias("concept"), F.lit(0.5).alias("confidence")))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("r")).select("doc_id", "r.*")


def keyphrase_scores(docs: DataFrame, stop_words: list[str], most_words: int = 3, least_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, phrase, score): n-grams of content words by count / all candidates * (ln((N + 1) / (df + 1)) + 1), df at least 2.

    A document's phrases are counted where it is read (ids are unique) and never leave it: only their hashes do.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), T.content_tokens(text_col, stop_words).alias("words"))
    counts = P.exchanged(words, most_words, P.all_counts(least_docs), "all long, phrase string, n long, df long")
    size = docs.agg(F.count("*").alias("docs"))
    score = F.col("n") / F.col("all") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1)
    return counts.crossJoin(F.broadcast(size)).select("doc_id", "phrase", F.round(score, 8).alias("score"))  # one row


def keyphrases(docs: DataFrame, stop_words: list[str], k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, phrase, rank): the k best phrases of a text, none sharing a word with a better one; chosen where the text is read."""
    words = docs.select(F.col(id_col).alias("doc_id"), T.content_tokens(text_col, stop_words).alias("words"))
    return P.exchanged(words, 3, P.best_apart(2, k, docs.count()), "phrase string, rank long")


def distinct_by_signature(docs: DataFrame, chars: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows whose texts start alike, the one with the smallest id; hashed before the shuffle, so texts stay where they are."""
    keys = docs.groupBy(F.md5(F.left(F.coalesce(text_col, F.lit("")), F.lit(chars))).alias("_k")).agg(F.min(id_col).alias(id_col))
    return docs.join(keys.select(id_col), id_col, "left_semi")


def typed_values(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, type, value, full, start, end) of every typed pattern, value being its first group (the whole match without one)."""
    found = references(docs, patterns, id_col, text_col)
    value = F.col("value")
    for kind, pattern in patterns.items():
        if "(" in pattern.replace("(?", ""):
            value = F.when(F.col("type") == kind, F.trim(F.regexp_extract("value", pattern, 1))).otherwise(value)
    return found.select("doc_id", "type", value.alias("value"), F.col("value").alias("full"), "start", "end")


def metadata(docs: DataFrame, number: str, issued: str, ended: str, bodies: list[str], no_title: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, title, number, body, effective, expiry): what the head of a document says of it; '' or null where it says nothing."""
    return docs.select(
        F.col(id_col).alias("doc_id"), T.title_line(text_col, F.col(id_col).cast("string"), no_title).alias("title"), T.first_match(text_col, number, 3000).alias("number"),
        T.first_listed(text_col, bodies, 3000).alias("body"), T.long_date(text_col, issued).alias("effective"), T.long_date(text_col, ended).alias("expiry"),
    )


def with_parents(sections: DataFrame, version: str = "version", key: str = "key", parent_key: str = "parent_key", id_col: str = "section_id") -> DataFrame:
    """sections with parent_id: the id of the last earlier section of the same version that has the parent's key; null if there is none."""
    named = sections.where(F.col(key).isNotNull()).select(F.col(version).alias("_v"), F.col(key).alias("_k"), F.col(id_col).alias("_id"))
    near = sections.join(named, (F.col(version) == F.col("_v")) & (F.col(parent_key) == F.col("_k")) & (F.col("_id") < F.col(id_col)), "left")
    best = near.groupBy(F.col(id_col)).agg(F.max("_id").alias("parent_id"))
    return sections.join(best, id_col)


def tag_rows(tagged: DataFrame, id_col: str, names: list[str]) -> DataFrame:
    """(id, name, value) of the columns that hold something: one row for each tag, arrays one for each element."""
    cell = lambda c: F.col(c) if tagged.schema[c].dataType.typeName() == "array" else F.array(F.col(c))
    named = lambda c: F.transform(cell(c), lambda v: F.struct(F.lit(c).alias("name"), v.cast("string").alias("value")))
    each = F.flatten(F.array(*[named(c) for c in names]))
    return tagged.select(id_col, F.explode(F.filter(each, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("t")).select(id_col, "t.*")


def pages_of(pages: DataFrame, noise: list[str], id_col: str = "doc_id", page: str = "page", text_col: str = "text", least: int = 50, looked: int = 3) -> DataFrame:
    """(doc_id, text, needs_ocr): pages in order without noise lines, joined; a document whose first pages have fewer than `least`
    characters on average needs character recognition, which is an adapter's work."""
    rows = pages.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text_col, F.lit("")).alias("t")))).alias("o"))
    heads = F.slice("o", 1, looked)
    mean = F.aggregate(heads, F.lit(0).cast("long"), lambda a, x: a + F.length(F.trim(x["t"]))) / F.greatest(F.size(heads), F.lit(1))
    return rows.select(id_col, F.array_join(F.transform("o", lambda x: T.drop_noise_lines(x["t"], noise)), "\n").alias("text"), (mean < least).alias("needs_ocr"))
