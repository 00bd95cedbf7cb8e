"""Sentence graphs against dense matrices."""

import random

import numpy as np
import pytest

from quern.operators import sentence_graph as G
from quern.operators import summarise as M


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(41)
    vocab = [f"w{i}" for i in range(120)]
    made = lambda n: [" ".join(rng.choices(vocab, [1 / (i + 1) for i in range(120)], k=rng.randrange(3, 14))) for _ in range(n)]
    return {1: made(40), 2: made(9), 3: ["alone here"], 4: ["a b c", "!", "zz yy", "zz yy", "xx"], 5: ["one two", "three four"], None: made(6), 7: ["same words here"] * 12}


def frame(spark, documents):
    return spark.createDataFrame([(d, i, s) for d, ss in documents.items() for i, s in enumerate(ss)], "doc_id long, idx int, sentence string").repartition(4)


def dense(sentences):
    unit = M._matrix(sentences)[0].astype(float)
    sim = unit @ unit.T
    np.fill_diagonal(sim, 0)
    return sim


@pytest.mark.parametrize("least", [0.0, 0.1, 0.5])
def test_similar_pairs(spark, documents, least):
    named = {d: s for d, s in documents.items() if d is not None}
    got = {(r.doc_id, r.i, r.j): r.weight for r in G.similar_pairs(G.sentence_vectors(frame(spark, named)), least).collect()}
    want = {}
    for d, ss in named.items():
        sim = dense(ss)
        want |= {(d, i, j): sim[i, j] for i in range(len(ss)) for j in range(i + 1, len(ss)) if sim[i, j] > 1e-9 and sim[i, j] >= least}
    near = {k for k, v in want.items() if abs(v - least) < 1e-6} if least else set()  # the matrix is of single precision
    assert set(got) - near == set(want) - near and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-5 for k in set(got) & set(want))


def test_text_rank_equals_the_dense_one(spark, documents):
    named = {d: s for d, s in documents.items() if d is not None}
    got = {(r.doc_id, r.idx): r.score for r in G.text_rank(frame(spark, named)).collect()}
    for d, ss in named.items():
        want = M.power_rank(M._matrix(ss)[0])
        assert np.allclose([got[d, i] for i in range(len(ss))], want, atol=2e-5), d
    assert len(got) == sum(map(len, named.values()))


def plain_page_rank(sim, damping=0.85, rounds=200, tolerance=1e-6):
    n = len(sim)
    degree = sim.sum(axis=1)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        out = np.divide(rank, degree, out=np.zeros(n), where=degree > 0)
        new = (1 - damping) / n + damping * (sim @ out + rank[degree == 0].sum() / n)
        if np.abs(new - rank).sum() < n * tolerance:
            return new
        rank = new
    return rank


def test_page_rank_and_strong_edges(spark, documents):
    named = {d: s for d, s in documents.items() if d is not None}
    rows = frame(spark, named)
    pairs = G.similar_pairs(G.sentence_vectors(rows), 0.0)
    got = {(r.doc_id, r.idx): r.score for r in G.page_rank(rows.select("doc_id", "idx"), pairs).collect()}
    shown = {}
    for r in G.strong_edges(rows, pairs).collect():
        shown.setdefault(r.doc_id, {})[r.source, r.target] = (r.weight, r.threshold)
    for d, ss in named.items():
        sim = dense(ss)
        assert np.allclose([got[d, i] for i in range(len(ss))], plain_page_rank(sim), atol=1e-5), d
        n = len(ss)
        flat = sim[np.triu_indices(n, 1)]
        bar = max(np.percentile(flat, 75), 0.05) if n > 1 else 0.05
        want = sorted(((sim[i, j], i, j) for i in range(n) for j in range(i + 1, n) if sim[i, j] >= bar - 1e-6), reverse=True)[: max(4 * n, 50)]
        own = shown.get(d, {})
        assert abs(len(own) - len(want)) <= 1 and all(abs(t - bar) < 1e-3 for _, t in own.values())
        assert {k for k, (w, _) in own.items() if w > bar + 1e-3 and len(want) < max(4 * n, 50)} == {(i, j) for w, i, j in want if w > bar + 1e-3 and len(want) < max(4 * n, 50)}


def test_a_long_text_is_dealt_over_tasks(spark):
    """20,000 sentences of one document whose words are mostly rare: a dense matrix would have 400 million cells."""
    rng = random.Random(42)
    rows = [(1, i, f"common word x{i // 3} y{rng.randrange(9000)} z{i // 2}") for i in range(20_000)]
    pairs = G.similar_pairs(G.sentence_vectors(spark.createDataFrame(rows, "doc_id long, idx int, sentence string")), 0.5)
    got = {(r.i, r.j) for r in pairs.collect()}
    assert {(6 * i, 6 * i + 1) for i in range(3000)} <= got and all(b - a < 20_000 for a, b in got) and len(got) < 200_000


def test_short_texts_by_matrices_equal_the_tables(spark, documents, monkeypatch):
    rows = [(d, s) for d, s in documents.items()] + [(8, []), (9, ["...", "?"]), (10, ["a b", "c d e"])]
    docs = spark.createDataFrame(rows, "doc_id long, ss array<string>").repartition(3)
    ranks, edges = {}, {}
    for most in (0, 9, 1024):
        monkeypatch.setattr(G, "MATRIX_SENTENCES", most)
        ranks[most] = {(r.doc_id, r.idx): r.score for r in G.ranks_of_texts(docs).collect()}
        edges[most] = {(r.doc_id, r.source, r.target): (r.weight, r.threshold) for r in G.edges_of_texts(docs).collect()}
        assert ranks[most].keys() == ranks[0].keys() and all(abs(ranks[most][k] - ranks[0][k]) < 1e-9 for k in ranks[0])
    assert len(ranks[0]) == sum(len(s) for d, s in rows if d is not None)
    for most in (9, 1024):
        heavy = lambda found: {k for k, (w, t) in found.items() if w > t + 1e-3}
        assert heavy(edges[most]) == heavy(edges[0]) and len(edges[most]) == len(edges[0]) > 100
        assert all(abs(edges[most][k][0] - edges[0][k][0]) < 2e-4 and abs(edges[most][k][1] - edges[0][k][1]) < 2e-4 for k in heavy(edges[0]))
    plan = G.edges_of_texts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" in plan
