"""Quality classifier: an additive model of single features and pairs, boosted in turns, scored by adding bins of lookup tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those whose hashed ids are smallest, whatever the size of the corpus.
TRAIN_ROWS = 20_000
FOLDS, THRESHOLD = 5, 0.3
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, PENALTY = 32, 80, 8, 40, 0.15, 4.0
FEATURES = (
    "log_bytes", "words", "word_bytes", "upper", "digits", "marks", "exclaims", "bars", "odd_bytes", "breaks",
    "distinct_words", "top_word", "repeated_words", "distinct_lines", "top_line", "long_word", "stops", "distinct_pairs",
)

_CLASS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [
        65 <= _b <= 90, 97 <= _b <= 122 or _b >= 128, 48 <= _b <= 57, _b < 128 and _c in "#*@~^_=<>{}[]\\/$%&+", _c == "!", _c == "|",
        _b < 32 and _b not in (9, 10, 13) or _b == 127, _b == 10,
    ]


def text_features(text: str | None) -> list[float]:
    """The numbers of FEATURES for one whole text; null counts as empty, and shares of nothing are 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS
    words = data.lower().split()
    w = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    letters = max(kinds[0] + kinds[1], 1.0)
    pairs = len(set(zip(words, words[1:])))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / w, kinds[0] / letters, kinds[2] / max(n, 1), kinds[3] / max(n, 1), kinds[4] / w,
        kinds[5] / w, kinds[6] / max(n, 1), kinds[7] / w, len(counts) / w, max(counts.values(), default=0) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, len(line_counts) / max(len(lines), 1), sum(map(len, lines)) and max(len(k) * v for k, v in line_counts.items()) / max(n, 1),
        max(map(len, counts), default=0) / 64.0, data.count(b".") / w, pairs / max(len(words) - 1, 1),
    ]


@dataclass
class Model:
    """Lookup tables: edges split a feature into bins; single[j][bin] and pairs[(i, j)][bin, bin] add to the log-odds."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.single):
            total += table[b[:, j]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _newton(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + PENALTY)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where to part bins in two, and what that gains; 0 if nothing does."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0, 0.0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    at = int(gain.argmax())
    return at + 1, float(gain[at])


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the bins of one feature, as a table."""
    out = np.empty(len(g))
    cut, _ = _split(g, h)
    for a, b in ((0, cut), (cut, len(g))):
        if a < b:
            inner, gain = _split(g[a:b], h[a:b])
            inner = inner if gain > 0 else 0
            for c, d in ((a, a + inner), (a + inner, b)):
                if c < d:
                    out[c:d] = _newton(g[c:d].sum(), h[c:d].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two features: the best cut of one, then of the other on either side; with its gain over no cut."""
    best, found = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        cg, ch = np.cumsum(a, axis=0), np.cumsum(b, axis=0)
        for cut in range(1, a.shape[0]):
            parts = ((cg[cut - 1], ch[cut - 1], slice(0, cut)), (cg[-1] - cg[cut - 1], ch[-1] - ch[cut - 1], slice(cut, None)))
            splits = [_split(x, y) for x, y, _ in parts]
            total = sum(s[1] for s in splits) + sum(float(_gain(x.sum(), y.sum())) for x, y, _ in parts)
            if total > best:
                best, table = total, np.empty_like(a)
                for (x, y, rows), (k, _) in zip(parts, splits):
                    table[rows, :k] = _newton(x[:k].sum(), y[:k].sum())
                    table[rows, k:] = _newton(x[k:].sum(), y[k:].sum())
                found = table.T if turned else table
    return found, best - float(_gain(g.sum(), h.sum()))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: in every round each feature in turn gets a shallow tree on the log-loss gradients, added to its table;
    then the pairs that gain most (found on coarse bins) are boosted in turns likewise. Rows of both classes are needed; with
    one class the model is its intercept."""
    model = Model()
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model.intercept = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.single = [np.zeros(n) for n in sizes]
    total = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, n in enumerate(sizes):
            g, h = gradients()
            step = RATE * _tree(np.bincount(b[:, j], g, n), np.bincount(b[:, j], h, n))
            model.single[j] += step
            total += step[b[:, j]]
    g, h = gradients()
    ranked = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            key, shape = b[:, i] // 4 * 8 + b[:, j] // 4, (8, 8)
            ranked.append((_pair_tree(np.bincount(key, g, 64).reshape(shape), np.bincount(key, h, 64).reshape(shape))[1], i, j))
    chosen = [(i, j) for _, i, j in sorted(ranked, reverse=True)[:PAIRS]]
    model.pairs = {(i, j): np.zeros((sizes[i], sizes[j])) for i, j in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h = gradients()
            shape = (sizes[i], sizes[j])
            key = b[:, i] * shape[1] + b[:, j]
            table, _ = _pair_tree(np.bincount(key, g, shape[0] * shape[1]).reshape(shape), np.bincount(key, h, shape[0] * shape[1]).reshape(shape))
            model.pairs[i, j] += RATE * table
            total += RATE * table[b[:, i], b[:, j]]
    return model


def held_out(id_col: str = "doc_id", folds: int = FOLDS) -> Column:
    """True for rows that no model learns from: crc32 of the id as text is a multiple of folds. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([text_features(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))


def _scores(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def _accepted(model: Model, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_matrix(batch.column(at))) >= threshold))

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model fitted on at most `rows` labelled texts outside the held-out fold (a bounded sample by hashed id).

    Labels that are null or belong to no document are ignored; of repeated labels the smallest counts, of repeated
    documents one. Source, language, ids and labels are no features.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = texts.mapInArrow(_features, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"))
    data = found.join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("x", "label").collect()  # rows at most
    return fit(np.array([r["x"] for r in data]).reshape(len(data), len(FEATURES)), np.array([r["label"] for r in data], float))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold). Null texts count as empty;
    repeated rows stay; extra columns are ignored; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scores(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns, whatever their names."""
    return docs.mapInArrow(_accepted(model, threshold, docs.columns.index(text_col)), docs.schema)
