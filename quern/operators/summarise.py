"""Extractive summaries: sentence scores by TF-IDF, graph centrality and clusters, joined, selected and measured.

A document's sentences are one row's array; a document is the unit of work, so documents of any number spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from quern.functions import runs
from quern.functions import text as T

SCORES = "doc_id long, idx long, sentence string, tfidf double, textrank double, kmeans double, ensemble double"
#: Runs of two letters and digits at least, and the ends of sentences.
_WORD = re.compile(r"[^\W_]{2,}|\n")
#: Sentences that are given at once.
OUT_ROWS = 20_000
#: Sentences compared at once: a document's similarity matrix is made in stripes, never whole, beyond this.
STRIPE = 512
#: Edges of a document held between rounds (12 bytes each); with more, stripes are made anew in every round.
EDGES_HELD = 8 << 20
#: Words that are compared at once, and pairs of sentences, or of sentences by a shared word, that are counted at once.
KERNEL_WORDS, PAIRS = 1_000_000, 4 << 20


def _coded(texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text, a list of sentences: how many they are, and the sentence and the code of each word; codes are in the words' order.

    Texts go through the pattern and the dictionary together."""
    found = pa.array(_WORD.findall("\n".join(s.replace("\n", " ") for t in texts for s in t).lower()), pa.string()).dictionary_encode()
    order = np.empty(len(found.dictionary), np.int64)
    order[pc.array_sort_indices(found.dictionary).to_numpy()] = np.arange(len(order))
    code, end = found.indices.to_numpy(zero_copy_only=False), pc.index(found.dictionary, "\n").as_py()
    breaks = np.flatnonzero(code == end)
    at = np.concatenate([[-1], breaks, [len(code)]])  # the breaks around each sentence
    code, a = order[code], 0
    for t in texts:
        if t:
            own = at[a : a + len(t) + 1]
            sentence = np.repeat(np.arange(len(t)), np.diff(own) - 1)
            words = np.delete(code[own[0] + 1 : own[-1]], own[1:-1] - own[0] - 1)
            a += len(t)
            yield len(t), sentence, words


def _weights(n: int, sentence: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of smooth-idf weights of unit length, and the plain sums of weights, of n sentences by their words' codes."""
    _, code = np.unique(code, return_inverse=True)
    kinds = int(code.max()) + 1 if len(code) else 1
    cell, times = np.unique(sentence * kinds + code, return_counts=True)
    kind = cell % kinds
    idf = np.log((1 + n) / (1 + np.bincount(kind, minlength=kinds))) + 1
    m = np.zeros((n, kinds), np.float32)
    m.reshape(-1)[cell] = times * idf[kind]
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=m, where=norm > 0)
    return unit, unit.sum(axis=1) / np.maximum(np.bincount(sentence, minlength=n), 1)


def _matrix(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of smooth-idf weights of unit length, and the plain sums of weights."""
    return next((_weights(*x) for x in _coded([sentences])), (np.zeros((0, 1), np.float32), np.zeros(0)))


def power_rank(unit: np.ndarray, edge: float = 0.1, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """Centrality by power iteration over cosines of at least `edge`; the iterate before the last is returned on convergence.

    Sentences without edges pass nothing on. The matrix is applied in stripes, of which only the edges are kept; rounds and
    tolerance are the same at every size.
    """
    n = len(unit)
    if n == 0:
        return np.zeros(0)

    def weights(a: int) -> np.ndarray:
        w = unit[a : a + STRIPE] @ unit.T
        w[np.arange(len(w)), np.arange(a, a + len(w))] = 0
        w[w < edge] = 0
        return w

    whole = weights(0) if n <= STRIPE else None
    held: list | None = []
    if whole is not None:
        degree = whole.sum(axis=1)
    else:
        degree, edges = np.zeros(n), 0
        for a in range(0, n, STRIPE):
            w = weights(a)
            degree[a : a + len(w)] = w.sum(axis=1)
            edges += np.count_nonzero(w)
            if held is not None and edges <= EDGES_HELD:
                i, j = np.nonzero(w)
                held.append((len(w), i.astype(np.int32), j.astype(np.int32), w[i, j]))
            else:
                held = None

    share = damping / np.where(degree > 0, degree, np.inf).astype(float)
    step = None if whole is None else whole * share  # converted once, not in every round

    def applied(rank: np.ndarray) -> np.ndarray:
        if step is not None:
            return step @ rank
        out = rank * share
        if held is None:
            return np.concatenate([weights(a) @ out for a in range(0, n, STRIPE)])
        return np.concatenate([np.bincount(i, v * out[j], size) for size, i, j, v in held])

    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = applied(rank)
        new += (1 - damping) / n
        if np.abs(rank - new).sum() < tolerance:
            break
        rank = new
    return rank


def cluster_scores(unit: np.ndarray, clusters: int, rounds: int = 20) -> np.ndarray:
    """1 / (1 + distance) to the nearest of k-means centres; first centres are evenly spaced sentences, so nothing is random."""
    n = len(unit)
    if n == 0:
        return np.zeros(0)
    centre = unit[np.linspace(0, n - 1, min(clusters, n)).astype(int)].copy()
    squares, double, before = (unit**2).sum(1)[:, None], 2 * unit, None
    for _ in range(rounds):
        d = (squares - double @ centre.T + (centre**2).sum(1)[None, :]).clip(0)
        own = d.argmin(axis=1)
        if before is not None and np.array_equal(own, before):  # the same clusters have the same centres
            break
        before = own
        new = centre.copy()
        for k, rows in ((k, np.flatnonzero(own == k)) for k in range(len(centre))):
            if len(rows):
                new[k] = np.add.reduce(unit[rows], axis=0) / np.float32(len(rows))
        if (np.abs(new - centre) <= 1e-8 + 1e-5 * np.abs(centre)).all():
            break
        centre = new
    return 1 / (1 + np.sqrt(d.min(axis=1)))


def _normal(x: np.ndarray) -> np.ndarray:
    return np.zeros_like(x) if len(x) == 0 or x.max() - x.min() < 1e-9 else (x - x.min()) / (x.max() - x.min())


def sentence_scores(docs: DataFrame, weights: tuple[float, float, float] = (1.0, 1.5, 1.0), clusters: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every sentence of 5 to 80 words with its TF-IDF, centrality and cluster score, and their min-max normalised weighted mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in runs.slices(sizes, OUT_ROWS):
                ids, own = batch.column(0).slice(a, b - a), sizes[a:b]
                sentences, columns = batch.column(1).slice(a, b - a).flatten(), np.zeros((4, own.sum()))
                end = 0
                for n, sentence, code in _coded(batch.column(1).slice(a, b - a).to_pylist()):
                    end += n
                    unit, tfidf = _weights(n, sentence, code)
                    rank, km = power_rank(unit), cluster_scores(unit, clusters)
                    whole = (weights[0] * _normal(tfidf) + weights[1] * _normal(rank) + weights[2] * _normal(km)) / sum(weights)
                    for column, values in zip(columns, (tfidf, rank, km, whole)):
                        column[end - n : end] = values
                idx = np.arange(end) - np.repeat(np.cumsum(own) - own, own)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(b - a), own))), pa.array(idx), sentences, *map(pa.array, columns)], [c.split()[0] for c in SCORES.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), T.sentences_by_words(text_col).alias("ss"))
    return rows.mapInArrow(run, SCORES)


def select(scored: DataFrame, by: str = "ensemble", ratio: float = 0.3, least: int = 5) -> DataFrame:
    """Per document its summary: the best max(least, round(n * ratio)) sentences in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("low"), "idx", "sentence")))
    keep = F.least(F.size("o"), F.greatest(F.lit(least), F.bround(F.size("o") * F.lit(ratio)).cast("int")))
    chosen = F.array_sort(F.transform(F.slice("o", F.lit(1), keep), lambda x: F.struct(x["idx"].alias("idx"), x["sentence"].alias("sentence"))))
    return scored.groupBy("doc_id").agg(ordered.alias("o")).select("doc_id", F.size("o").cast("long").alias("sentences"), F.size(chosen).cast("long").alias("kept"), F.array_join(F.transform(chosen, lambda x: x["sentence"]), " ").alias("summary"))


def position_scores(n: Column) -> Column:
    """1 / (1 + 0.1 i), 0.3 more for the first and 0.15 for the second, over the maximum: an array for n sentences."""
    raw = lambda i: 1 / (1 + 0.1 * i) + F.when(i == 0, 0.3).when(i == 1, 0.15).otherwise(0.0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: raw(i) / 1.3)).otherwise(F.array().cast("array<double>"))


def spread(best_first: Column, gap: int, most: int) -> Column:
    """Indices taken greedily from best to worst, each at least `gap` from those taken before, `most` at most; sorted."""
    start, best_first = F.array().cast("array<bigint>"), F.transform(best_first, lambda i: i.cast("long"))
    return F.array_sort(F.aggregate(best_first, start, lambda h, i: F.when((F.size(h) < most) & ~F.exists(h, lambda k: F.abs(k - i) < gap), F.concat(h, F.array(i))).otherwise(h)))


def guided_texts(texts: DataFrame, least: float = 0.35, share: float = 0.4) -> DataFrame:
    """guided of (doc_id, ss, clauses): a text's sentences and its distinct clauses in order, compared where the row is."""
    bare = F.transform("ss", lambda s, i: F.struct(i.cast("long").alias("idx"), s.alias("sentence")))
    return _guided(texts.select("doc_id", bare.alias("ss"), "clauses"), least, share)


def _guided(rows: DataFrame, least: float, share: float) -> DataFrame:
    """guided of (doc_id, ss, clauses), ss with the place of each sentence; words are told once for each sentence and clause."""
    words = F.struct(
        F.transform("ss", lambda s: F.struct(s["idx"].alias("idx"), s["sentence"].alias("sentence"), F.array_distinct(T.tokens(s["sentence"])).alias("words"))).alias("ss"),
        F.transform("clauses", lambda c: F.struct(c.alias("clause"), F.array_distinct(T.tokens(c)).alias("words"))).alias("clauses"),
    )

    def best(b: Column) -> Column:
        low = lambda c, s: (-F.size(F.array_intersect(c["words"], s["words"])) / F.greatest(F.size(c["words"]), F.lit(1))).alias("low")
        return F.transform(b["clauses"], lambda c: F.array_min(F.transform(b["ss"], lambda s: F.struct(low(c, s), s["idx"].alias("idx"), s["sentence"].alias("sentence"), c["clause"].alias("clause")))))

    cap = F.greatest(F.lit(1), F.round(F.size("ss") * F.lit(share)).cast("int"))
    return _chosen(rows.select("doc_id", cap.alias("cap"), F.flatten(F.transform(F.array(words), best)).alias("best")), least)  # an array of one binds the words


def _chosen(found: DataFrame, least: float) -> DataFrame:
    """The best of (doc_id, cap, best), at most cap of each text, with (low, idx, sentence, clause) in best."""
    good = F.array_sort(F.filter("best", lambda b: -b["low"] >= least))
    return found.select("doc_id", F.explode(F.slice(good, F.lit(1), F.col("cap"))).alias("b")).select("doc_id", "b.clause", "b.idx", "b.sentence", F.round(-F.col("b.low"), 6).alias("score"))


def guided(scored: DataFrame, clauses: DataFrame, least: float = 0.35, share: float = 0.4) -> DataFrame:
    """Sentences that answer clauses: per document and clause the sentence with most of the clause's words, if at least `least`;
    at most share of the sentences. Clauses (doc_id, clause) ride to their document as one array."""
    own = clauses.groupBy("doc_id").agg(F.array_sort(F.collect_set("clause")).alias("clauses"))
    rows = scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("ss")).join(own, "doc_id")
    return _guided(rows, least, share)


def _answers(texts: pa.Array, words: pa.Array) -> pa.Array:
    """Of texts with their sentences and the words of each: for each distinct sentence (its first place) the other sentence of the
    same text that shares most of its words, the first of equals, and minus the share. Work goes by the pairs that share a
    word; of long texts a few sentences at once are held against the rest."""
    n = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    doc, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
    same = texts.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lists = words.flatten()
    terms = lists.flatten().dictionary_encode()
    kinds = max(1, len(terms.dictionary))
    at = np.repeat(np.arange(len(doc)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    at, code = np.divmod(np.unique(at * kinds + terms.indices.to_numpy(zero_copy_only=False)), kinds)  # each word of a sentence once
    size = np.bincount(at, minlength=len(doc))
    begin = np.cumsum(size) - size
    order = np.argsort(doc[at] * kinds + code, kind="stable")  # the sentences of each word of a text, in their order
    _, group, many = np.unique(doc[at] * kinds + code, return_inverse=True, return_counts=True)
    start, members = np.cumsum(many) - many, at[order]
    clauses = np.sort(np.unique(doc * len(doc) + same, return_index=True)[1])
    by_word = np.concatenate([[0], np.cumsum(many[group])])
    cost = np.maximum(n[doc[clauses]], by_word[begin[clauses] + size[clauses]] - by_word[begin[clauses]])
    span = lambda count: np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # noqa: E731  0, 1, .. of each
    found = []
    for a, b in runs.slices(cost, PAIRS):
        own = clauses[a:b]
        cells = n[doc[own]]
        base = np.cumsum(cells) - cells
        posting = np.repeat(begin[own], size[own]) + span(size[own])
        clause, g = np.repeat(np.arange(b - a), size[own]), group[posting]
        other = members[np.repeat(start[g], many[g]) + span(many[g])]
        shared = np.bincount(np.repeat(base[clause], many[g]) + other - first[other], minlength=cells.sum())
        place = span(cells)
        shared[same[np.repeat(first[own], cells) + place] == np.repeat(same[own], cells)] = -1
        best = np.maximum.reduceat(shared * len(doc) + (len(doc) - 1 - place), base)
        shared, place = best // len(doc), len(doc) - 1 - best % len(doc)
        some = shared >= 0
        found.append((own[some], place[some], -shared[some] / np.maximum(size[own[some]], 1)))
    own, place, low = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *found))
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[own], minlength=len(n)))])
    parts = [pa.array(low), pa.array(place), pa.array(own - first[own])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["low", "idx", "clause"]))


@F.arrow_udf(ArrayType(StructType().add("low", DoubleType()).add("idx", LongType()).add("clause", LongType())))
def _answered(texts: pa.Array, words: pa.Array) -> pa.Array:
    count = np.concatenate([[0], np.cumsum(pc.list_value_length(words.flatten()).to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    sizes = np.diff(count[ends]).astype(np.int64)
    return pa.concat_arrays([_answers(texts.slice(a, b - a), words.slice(a, b - a)) for a, b in runs.slices(sizes, KERNEL_WORDS)] or [_answers(texts, words)])


def guided_by_text(texts: DataFrame, least: float = 0.35, share: float = 0.4) -> DataFrame:
    """guided of (doc_id, ss), where every distinct sentence of a text is a clause that the text's other sentences answer. No sentence
    answers itself: its share would be 1, and the best of all would be the beginning of the text again."""
    cap = F.greatest(F.lit(1), F.round(F.size("ss") * F.lit(share)).cast("int"))
    rows = texts.select("doc_id", "ss", cap.alias("cap"), F.transform("ss", lambda s: T.tokens(s)).alias("words"))
    rows = rows.select("doc_id", "ss", "cap", _answered("ss", "words").alias("best"))
    best = F.transform("best", lambda b: F.struct(b["low"].alias("low"), b["idx"].alias("idx"), F.get("ss", b["idx"].cast("int")).alias("sentence"), F.get("ss", b["clause"].cast("int")).alias("clause")))
    return _chosen(rows.select("doc_id", "cap", best.alias("best")), least)


LEGAL_WEIGHTS = (0.4, 0.4, 0.2)


def legal_summaries(docs: DataFrame, question: str = "", k: int = 4, gap: int = 0, weights: tuple[float, float, float] = LEGAL_WEIGHTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, chosen, summary): of sentences that end before capitals the k best by relevance to the question (all alike
    without one), centrality and position, in reading order and more than `gap` apart. Texts of k sentences or fewer are kept whole.
    Of equal sentences the later one is taken first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, ss in zip(batch["doc_id"], batch["ss"]):
                ss = list(ss)
                if len(ss) <= k:
                    out.append((key, len(ss), list(range(len(ss))), " ".join(ss)))
                    continue
                unit, _ = _matrix(ss)
                asked, _ = _matrix([question, *ss])
                relevance = asked[1:] @ asked[0] if question else np.ones(len(ss))
                i = np.arange(len(ss))
                place = (1 / (1 + 0.1 * i) + np.where(i == 0, 0.3, np.where(i == 1, 0.15, 0.0))) / 1.3
                whole = weights[0] * relevance + weights[1] * power_rank(unit) + weights[2] * place
                taken: list[int] = []
                for at in np.argsort(whole, kind="stable")[::-1].tolist():
                    if len(taken) < k and not (gap and any(abs(at - t) <= gap for t in taken)):
                        taken.append(at)
                taken.sort()
                out.append((key, len(ss), taken, " ".join(ss[t] for t in taken)))
            yield pd.DataFrame(out, columns=["doc_id", "sentences", "chosen", "summary"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), T.sentences_before_capitals(text_col).alias("ss"))
    return rows.mapInPandas(run, "doc_id long, sentences long, chosen array<long>, summary string")


def reference_texts(cells: DataFrame, id_col: str, at: list[str], value: str = "value") -> DataFrame:
    """(id, reference): a document's clauses in the order of their place, each once, joined by blanks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*at, value))), lambda x: x[value])
    return cells.groupBy(id_col).agg(F.array_join(F.array_distinct(ordered), " ").alias("reference"))
