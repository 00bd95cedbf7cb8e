"""License scans by diagonal voting: word k-gram hashes joined to template positions, counted by offset, merged, verified."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.storage import materialise
from quern.llm.words import words

#: Words to a k-gram; how far apart neighbouring diagonals may be; the share of a template's words that a span must have.
GRAM, REACH, SIMILAR = 5, 8, 0.8
#: Rows of template k-grams, and candidate spans, up to which a table is broadcast (some 20 MB); larger ones are shuffled.
BROADCAST_ROWS = 300_000
#: k-grams to an Arrow batch, and words in a worker's memo of hashes.
BATCH, MEMO = 1 << 16, 1 << 20
SPANS = "array<struct<template:int,low:int,high:int,first:int,last:int>>"
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,similarity:double>>"
)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def rolled(found: Sequence[bytes], k: int, memo: _Hashes) -> np.ndarray:
    """The rolling hash of every k consecutive words, as signed 64-bit numbers."""
    n = len(found) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
    return out.view(np.int64)


def _grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            keys, places, hashes, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, places, hashes)], ["key", "pos", "gram"])

            for key, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                h = rolled(words(text.as_py()), k, memo)
                for at in range(0, len(h), BATCH):
                    part = h[at : at + BATCH]
                    keys.append(np.full(len(part), key, np.int64))
                    places.append(np.arange(at, at + len(part), dtype=np.int32))
                    hashes.append(part)
                    held += len(part)
                    if held >= BATCH:
                        yield out()
                        keys, places, hashes, held = [], [], [], 0
            if held:
                yield out()

    return run


def template_grams(spark: SparkSession, templates: Sequence[tuple[str, str]], k: int = GRAM) -> DataFrame:
    """(gram, template, at): every k-gram of every template (its place in the list) and where it stands."""
    memo, rows = _Hashes(), []
    for n, (_, text) in enumerate(templates):
        rows += [(int(h), n, at) for at, h in enumerate(rolled(words(text), k, memo))]
    table = spark.createDataFrame(rows, "gram long, template int, at int")
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def diagonals(docs: DataFrame, templates: Sequence[tuple[str, str]], k: int = GRAM, text_col: str = "text") -> DataFrame:
    """(key, template, diagonal, votes, first, last): for each text (by its xxhash64) and template, the places of shared
    k-grams by how far the text's place lies behind the template's. A place counts once, however often the text occurs."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    grams = rows.mapInArrow(_grams(k), "key long, pos int, gram long")
    hits = grams.join(template_grams(docs.sparkSession, templates, k), "gram").select("key", "template", (F.col("pos") - F.col("at")).alias("diagonal"), "pos")
    return hits.groupBy("key", "template", "diagonal").agg(F.count_distinct("pos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def candidates(voted: DataFrame, reach: int = REACH) -> DataFrame:
    """(key, spans): the places of templates in each text.

    Diagonals at most `reach` apart are merged into the one with most votes among them (of equals the first), which stands
    for one place of the template with words put in or left out.
    """
    near = Window.partitionBy("key", "template").orderBy("diagonal").rangeBetween(-reach, reach)
    before = Window.partitionBy("key", "template").orderBy("diagonal").rangeBetween(-reach, -1)
    best = voted.select(
        "key", "template", "votes",
        F.max("votes").over(near).alias("most"),
        F.max("votes").over(before).alias("earlier"),
        F.min("diagonal").over(near).alias("low"),
        F.max("diagonal").over(near).alias("high"),
        F.min("first").over(near).alias("first"),
        F.max("last").over(near).alias("last"),
    )
    chosen = best.where((F.col("votes") == F.col("most")) & (F.col("earlier").isNull() | (F.col("earlier") < F.col("votes"))))
    return chosen.groupBy("key").agg(F.collect_list(F.struct("template", "low", "high", "first", "last")).alias("spans"))


def common_words(template: Sequence[bytes], span: Sequence[bytes]) -> int:
    """Length of the longest common subsequence; a row of the table is one number of as many bits as the template has words."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    row = full
    for w in span:
        both = row & masks.get(w, 0)
        row = ((row + both) | (row - both)) & full
    return len(template) - row.bit_count()


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase starts; joined has a blank before each word and one at the end."""
    out, at, counted, n = [], joined.find(phrase), 0, 0
    while at >= 0:
        n += joined.count(b" ", counted, at)
        counted = at
        out.append(n)
        at = joined.find(phrase, at + 1)
    return out


class Scanner:
    """Phrases and candidate spans of whole texts, word by word."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], k: int, similar: float):
        self.templates = [(label, words(text)) for label, text in templates]
        self.phrases = [(b" " + b" ".join(words(text)) + b" ", label) for text, label in phrases]
        self.k, self.similar = k, similar

    def verified(self, found: list[bytes], spans: list[dict]) -> list[tuple[float, int, int, int]]:
        """(similarity, template, start, end) of spans that have enough of their template's words. Of spans that overlap by
        over half of the shorter, the one with more words in common stays."""
        held = []
        for s in spans:
            _, template = self.templates[s["template"]]
            start = max(0, min(s["first"], s["low"]))
            end = min(len(found), max(s["last"] + self.k, s["high"] + len(template)))
            common = common_words(template, found[start:end])
            if template and common >= self.similar * len(template):
                held.append((common, common / len(template), s["template"], int(s["first"]), min(len(found), int(s["last"]) + self.k)))
        held.sort(key=lambda h: (-h[0], -h[1], h[2], h[3]))
        kept: dict[int, list[tuple]] = {}
        out = []
        # Accepted spans are filed under every 256th word they touch, so that a text of many spans is not quadratic.
        for _, share, template, start, end in held:
            files = range(start >> 8, (end >> 8) + 1)
            rivals = {r for f in files for r in kept.get(f, ())}
            if any(2 * (min(end, b) - max(start, a)) > min(end - start, b - a) for a, b in rivals):
                continue
            for f in files:
                kept.setdefault(f, []).append((start, end))
            out.append((share, template, start, end))
        return out

    def scan(self, text: str | None, spans: list[dict] | None) -> dict:
        found = words(text)
        joined = b" " + b" ".join(found) + b" "
        places = [(p, label) for phrase, label in self.phrases for p in phrase_places(joined, phrase)]
        base = {label for _, label in places}
        spans = self.verified(found, spans or [])
        starts = [p for p, _ in places]
        return {
            "n_words": len(found),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {self.templates[t][0] for _, t, _, _ in spans})),
            "score": 1.0 if base else max((s[0] for s in spans), default=0.0),
            "spans": [{"label": self.templates[t][0], "start": a, "end": b, "similarity": share} for share, t, a, b in sorted(spans, key=lambda s: (s[2], s[1]))],
        }


def _scan(templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], k: int, similar: float, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Scanner(templates, phrases, k, similar)
        fields = pa.schema(
            [("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
             ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())])))]
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [{"doc_id": i.as_py()} | tool.scan(t.as_py(), s.as_py()) for i, t, s in zip(*part.columns)]
                yield pa.RecordBatch.from_pylist(rows, fields)

    return run


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], k: int = GRAM, reach: int = REACH, similar: float = SIMILAR,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base columns are about places where all words of a phrase stand one after the other (also where they overlap). Spans are
    verified places of templates: at least `similar` of the template's words stand there in the template's order; one k-gram
    in common makes a candidate, which is only verified on the words of the text itself, so equal hashes of unlike words or
    texts cost time alone. labels has those of phrases and of spans; score is 1 with a phrase, else the highest similarity.
    Null and empty texts have no words and no labels, score 0; very long texts are scanned whole; a null doc_id, repeated
    rows and extra columns change nothing about a row; templates shorter than k words are never found.
    """
    found = materialise(candidates(diagonals(docs, templates, k, text_col), reach), "license-candidates")
    spans = found.withColumnRenamed("key", "_key")
    if (found.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(spans, F.xxhash64("text") == F.col("_key"), "left").select("doc_id", "text", F.col("spans").cast(SPANS).alias("spans"))
    schema = f"doc_id long, {RESULT}"
    return joined.mapInArrow(_scan(list(templates), list(phrases), k, similar, schema), schema)
