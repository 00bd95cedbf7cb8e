"""Operators that compare, count, pack and shard, against brute force; and the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import components, embedding_dedup, katz, packing, sharding, simhash_dedup, warc

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 120))) for _ in range(40)]
    near = []
    for t in base[:12]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    texts = [*base, *near, *base[:5], None, "", " \n", "A b", "a  B", "z" * 5000, "word " * 9000]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(3, texts[3], "x", 0), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, size int").repartition(5)


def components_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(7, 7), (300, 200), (300, 201)]
    df = spark.createDataFrame([*edges, (None, 4)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    want = components_of(400, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = components_of(len(rows), links)
    least = collections.defaultdict(lambda: None)
    for r, root in zip(rows, roots):
        ids = [x for x in (least[root], r.doc_id) if x is not None]
        least[root] = min(ids, default=None)
    want = collections.Counter((r.doc_id, f"{p:016x}", least[root]) for r, p, root in zip(rows, prints, roots))
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(docs).collect())
    assert got == want
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_dedup.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {least[x] for x in set(roots)} | {None}


def test_close_pairs_find_every_pair():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 64, 600, np.uint64)
    a = np.unique(np.concatenate([a, a[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), [np.uint64(0), np.uint64(15), np.uint64((1 << 64) - 1)]]))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 4}
    got = {tuple(sorted((int(i), int(j)))) for x, y in simhash_dedup.close_pairs(a, a, 4, True) for i, j in zip(x, y)}
    assert got == want and len(want) > 200
    b = a[::2]
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 4}
    assert {(int(i), int(j)) for x, y in simhash_dedup.close_pairs(a, b, 4, False) for i, j in zip(x, y)} == want


def test_simhash_many_sides(spark):
    """Sides so small that every cell has several: the same components."""
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(150)]
    prints += [p ^ (1 << rng.randrange(64)) for p in prints]
    prints += [prints[0] ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    want = components_of(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = {r.fp: r.component for r in simhash_dedup.linked_classes(df, 4, side=simhash_dedup.TILE).collect()}
    first = {}
    for i, p in enumerate(signed):
        first.setdefault(p, i)
    assert got == {p: want[i] for p, i in first.items()}


def test_simhash_rows_without_id_and_large_ids(spark):
    """A row without an id, one bit away from others, links them and takes nothing from them; ids stay exact above 2^53."""
    big = (1 << 53) + 1
    rows = [(None, 0b1111), (5, 0b111), (7, 0xFFFF0000), (None, 0xF0FF0000 << 24), (big + 2, 0xF0FF0001 << 24), (big, 0xF0FF0001 << 24), (-3, -1), (None, -2), (None, 0x5555 << 40)]
    rows += [(1 << 62, 0b11110111 << 8), (None, 0b11111 << 8), (20, 0b01011 << 8)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.fp: r.component for r in simhash_dedup.linked_classes(df, 4).collect()}
    assert len(got) == len({fp for _, fp in rows})
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ((rows[i][1] ^ rows[j][1]) & (1 << 64) - 1).bit_count() <= 4]
    roots = components_of(len(rows), links)
    least = collections.defaultdict(lambda: None)
    for (doc_id, _), root in zip(rows, roots):
        ids = [x for x in (least[root], doc_id) if x is not None]
        least[root] = min(ids, default=None)
    assert got == {fp: least[root] for (_, fp), root in zip(rows, roots)}
    assert got[0b111] == 5 and got[0xF0FF0001 << 24] == big and got[0x5555 << 40] is None


def test_representatives_keep_every_text(spark):
    rng = random.Random(21)
    long = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(400)) for _ in range(4)]
    near = long[0] + " end"
    assert 0 < (plain_print(long[0]) ^ plain_print(near)).bit_count() <= 4
    rows = [(None, near), (5, long[0]), (7, long[1]), (7, long[2]), (7, long[2]), (9, long[1]), (None, long[3])]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, rows int").repartition(3)
    kept = collections.Counter((r.doc_id, r.text) for r in simhash_dedup.representatives(docs).collect())
    assert kept == collections.Counter([(None, near), (5, long[0]), (7, long[1]), (7, long[2]), (None, long[3])])
    assert {r.component_id for r in simhash_dedup.near_duplicates(docs).collect() if r.doc_id == 5} == {5}


# --- embeddings -----------------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    vectors = [*base, *(base[:20] + rng.normal(size=(20, 16)) * 0.2), *base[:6], base[0] * 3, np.zeros(16)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2, "k") for i, v in enumerate(vectors)]
    rows += [(90, None, 1, "k"), (91, [float("nan")] * 16, 1, "k"), (92, [None] * 16, 1, "k"), (93, [1.0] * 16, None, "k"), (94, [1.0] * 3, 1, "k"), (95, [1.0] * 3, 1, "k"), (0, rows[0][1], 0, "k"), (None, [1.0] * 16, 1, "k"), (96, [], 1, "k"), (97, [float("inf")] * 16, 1, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")

    def fit(r):
        return r[0] is not None and r[1] and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def cos(a, b):
        a, b = np.array(a, float), np.array(b, float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))

    n = len(rows)
    links = [(i, j) for i in range(n) for j in range(i) if fit(rows[i]) and fit(rows[j]) and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.93]
    roots = components_of(n, links)
    degree = collections.Counter(x for pair in links for x in pair)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[roots[i]] = min(least.get(roots[i], r[0]), r[0])
    want = collections.Counter((r[0], degree[i], least.get(roots[i]), r[0] is None or r[0] == least[roots[i]]) for i, r in enumerate(rows))
    got = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(10)
    for _ in range(20):
        a, b = rng.normal(size=(50, 12)) ** 3, rng.normal(size=(60, 12)) ** 3
        b[:30] = a[:30] + rng.normal(size=(30, 12)) * 0.3
        want = {(i, j) for i in range(50) for j in range(60) if a[i] @ b[j] / np.linalg.norm(a[i]) / np.linalg.norm(b[j]) >= 0.9}
        assert {(int(i), int(j)) for x, y in embedding_dedup.linked_pairs(embedding_dedup.Block.of(a), embedding_dedup.Block.of(b), 0.9, False) for i, j in zip(x, y)} == want


# --- language model -------------------------------------------------------------------------------------------------


def test_katz_against_brute_force(docs, monkeypatch):
    monkeypatch.setattr(katz, "PART_ROWS", 40)  # many parts, so that frequent histories are split
    rows = [(r.doc_id, [*katz.words_of(r.text), None]) for r in docs.select("doc_id", "text").collect()]
    teaches = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    uni, bi, after = collections.Counter(), collections.Counter(), collections.Counter()
    for i, ws in rows:
        if teaches(i):
            uni.update(ws)
            for h, w in zip([("start",), *ws], ws):
                bi[h, w] += 1
                after[h] += 1
    total, size = sum(uni.values()), len(uni)
    tally = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.CUT + 2)]
    s1, s2 = katz.discounts(tally(uni)), katz.discounts(tally(bi))
    stays = lambda c, s: c * s[c] if c <= katz.CUT else c - katz.HALF
    unknown = 1 - sum(stays(c, s1) for c in uni.values()) / total
    p1 = lambda w: stays(uni[w], s1) / total if uni[w] else unknown
    weight = {}
    for h in after:
        seen = [w for (g, w) in bi if g == h]
        weight[h] = (1 - sum(stays(bi[h, w], s2) for w in seen) / after[h]) / (1 - sum(map(p1, seen)))
        mass = sum(stays(bi[h, w], s2) for w in seen) / after[h] + weight[h] * (sum(p1(w) for w in uni if w not in seen) + unknown)
        assert mass == pytest.approx(1.0)
    want = []
    for i, ws in rows:
        score = base = 0.0
        for h, w in zip([("start",), *ws], ws):
            score += math.log10(stays(bi[h, w], s2) / after[h] if bi[h, w] else weight.get(h, 1.0) * p1(w))
            base += math.log10((uni[w] + 1) / (total + size + 1))
        want.append((-1 if i is None else i, not teaches(i), len(ws), sum(uni[w] > 0 for w in ws), total, round(base, 4), round(score, 4)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in katz.score(docs).collect()]
    assert sorted(got) == sorted(want)
    assert katz.score(docs.limit(0)).count() == 0


def test_katz_without_training_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = katz.score(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert len(got) == 3 and all(r.held_out and r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)


# --- packing and shards ---------------------------------------------------------------------------------------------


def test_packing(docs):
    got = packing.pack(docs, WORDS).collect()
    tool = packing.word_tokens(WORDS).tool
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tool.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_plans_cover_every_histogram():
    rng = random.Random(11)
    for capacity in (1, 2, 7, 50):
        for _ in range(15):
            histogram = {n: rng.randrange(12) for n in range(1, capacity + 1)}
            groups, share = packing.plan(histogram, capacity)
            found = collections.Counter()
            for items, count in groups:
                assert count > 0 and sum(n * k for n, k in items) <= capacity
                for n, k in items:
                    found[n] += k * count
            assert found == collections.Counter({n: c for n, c in histogram.items() if c})
            assert packing.lower_bound(histogram, capacity) <= sum(c for _, c in groups) <= 1.05 * packing.lower_bound(histogram, capacity) + 2
            assert 0 <= share <= 1
    assert packing.plan({}, 8) == ([], 0.0)


def test_most_pieces_are_placed_by_the_linear_program():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(6.4, 1.0, 6000).astype(int) + 1, 4096).tolist()
    histogram = collections.Counter(lengths)
    for times in (1, 1000):
        table = {n: k * times for n, k in histogram.items()}
        groups, share = packing.plan(table)
        assert share > 0.95 and sum(c for _, c in groups) <= 1.00005 * packing.lower_bound(table) + 1
    mix = packing.configurations(histogram)
    drawn = [mix.lengths[p] for p in mix.draw(4000, np.random.default_rng(5))]
    assert mix.gap < packing.TOLERANCE and all(d.sum() == 4096 for d in drawn)
    per = np.bincount(np.concatenate(drawn), minlength=4097) * mix.copies / len(drawn)
    need = np.array([histogram.get(n, 0) for n in range(4097)])
    tokens = lambda counts: np.bincount(np.arange(4097) // 256, counts * np.arange(4097))
    assert np.abs(tokens(per) - tokens(need)).sum() < 0.06 * tokens(need).sum()


def test_lower_bound_counts_pieces_over_a_half():
    assert packing.lower_bound({3000: 5, 1000: 4}) == 5 and packing.lower_bound({4096: 2, 1: 1}) == 3 and packing.lower_bound({}) == 0
    histogram = {k: 2 for k in range(1000, 4000, 50)}
    assert sum(c for _, c in packing.plan(histogram)[0]) <= packing.lower_bound(histogram) + 2


def test_one_row_repeated_thousands_of_times_is_packed_whole(spark):
    df = spark.range(3000).selectExpr("cast(5 as long) doc_id", "'a b c' text").repartition(3)
    got = packing.pack(df, WORDS).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) == 3000 and len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)


def test_shards_of_one_row_repeated_thousands_of_times(spark):
    df = spark.range(4000).selectExpr("cast(5 as long) doc_id", "'a b c' text").repartition(3)
    got = collections.defaultdict(list)
    for r in sharding.shard_by_bytes(df, range_bytes=500).collect():
        got[r.shard].append(r.slot)
    assert sorted(got) == list(range(8)) and all(sorted(s) == list(range(len(s))) and abs(len(s) - 500) <= 2 for s in got.values())


def test_shards(docs):
    rows = docs.collect()
    got = sharding.shard_by_bytes(docs).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "bytes" and 0 <= r.shard < 8 and r.grown_shard is None for r in got)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


def test_shards_are_near_equal_with_a_hot_text(spark):
    rng = random.Random(12)
    texts = ["same text here"] * 600 + ["".join(rng.choices("abc ", k=rng.randrange(80))) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes = collections.Counter()
    for r in sharding.shard_by_bytes(df, range_bytes=500).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 80


# --- WARC -----------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    long = "<p>é" + "x" * 200
    rows = [(1, "http://a/1", long), (2, None, long), (3, "http://a/3\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (8, "u", long), (9, "u", "z" * 300000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/warc"
    got = {r.page_id: r for r in warc.write_and_read(pages, path).collect()}
    assert set(got) == set(range(1, 10))
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(j for j, _, h in rows if (h or "") == (html or ""))
        again = len(data) >= 100 and first != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.n_requests) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None, 1)
    nested = warc.assemble(warc.read_records(spark, path)).where("metadata.fields['pageId'] = '1'").first()
    assert bytes(nested.response.payload).decode() == long and nested.requests[0].http_head.startswith("GET http://a/1")
    assert warc.write_and_read(pages.limit(0)).count() == 0


def test_warc_null_ids_and_repeated_rows(spark):
    pages = spark.createDataFrame([(None, "u", "a"), (1, "u", "b"), (1, "u", "b")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.record_type, r.payload_bytes) for r in warc.write_and_read(pages).collect())
    assert got == [(0, "response", 1), (1, "response", 1), (1, "response", 1)]


def test_warc_one_row_for_each_row(spark):
    long = "y" * 150
    rows = [(None, "u", "a"), (None, "u", "a"), (None, None, "bb"), (None, "u", long), (1, "u", "c"), (1, "u", "dd"), (1, "u", "dd"), (2, "u", long), (2, "u", long), (2, "v", long), (2, "u", "e" * 120), (3, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    digest = lambda h: hashlib.sha256(h.encode()).hexdigest()
    want = collections.Counter((i, len(h), digest(h), "revisit" if i == 3 else "response", 2 if i == 3 else None, 1) for i, _, h in rows)
    assert collections.Counter(tuple(r) for r in warc.write_and_read(pages).collect()) == want
    # Without every_row only rows alike in all three columns are one, and never those without an id.
    alike = collections.Counter((i, len(h), digest(h)) for i, u, h in [*[r for r in rows if r[0] is None], *{r for r in rows if r[0] is not None}])
    assert collections.Counter(tuple(r)[:3] for r in warc.write_and_read(pages, every_row=False).collect()) == alike


# --- queries and pipeline -------------------------------------------------------------------------------------------


def test_queries_agree_with_sql(spark, sf):
    import duckdb

    from quern.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf)
        want = con.execute(sql)
        at = [[c[0] for c in want.description].index(c) for c in df.columns]
        assert collections.Counter(tuple(r) for r in df.collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall()), name


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = p.quality(spark, docs, sf)
    good = {r.doc_id for r in kept.select("doc_id").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    assert kept.columns == docs.columns and len(good & bad) <= 0.2 * len(bad)
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    texts = {r.doc_id: r.text for r in kept.collect()}
    alone = p.near_duplicates(spark, kept, sf)
    prints = {i: plain_print(t) for i, t in texts.items()}
    ids = sorted(prints)
    roots = components_of(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4])
    assert {r.doc_id for r in alone.collect()} == {ids[r] for r in set(roots)} and alone.columns == docs.columns
    hidden = p.personal_data(spark, alone, sf)
    changed = [r for r in hidden.collect() if r.text != texts[r.doc_id]]
    assert hidden.columns == docs.columns and all(any(c in texts[r.doc_id] for c in "@=0123456789") for r in changed)
    packed = p.pack(spark, hidden, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {ids[r] for r in set(roots)}
    assert p.run(spark, sf).count() == packed.count()


def test_pipeline_stages_on_odd_rows(spark, sf):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, pii_found string, score double, length long, fp string"
    mail = "write to bo.1@mail.example.com " + "x" * 50
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (4, "a b c d e f g"), (4, "quite another text of some words"), (None, "no id 4111111111111111"), (None, None), (5, "w " * 30000)]
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), "clash", 0.5, 7, "z") for i, t in rows], schema)
    for stage in (p.quality, p.near_duplicates, p.personal_data):
        assert stage(spark, docs, sf).columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0
    alone = p.near_duplicates(spark, docs, sf)
    assert sorted((r.doc_id or 0) for r in alone.collect()) == [0, 0, 1, 3, 4, 4, 5]  # 2 is without words like 1; the texts of 4 are unlike
    hidden = p.personal_data(spark, docs, sf).collect()
    assert collections.Counter(r.doc_id for r in hidden) == collections.Counter(i for i, _ in rows) and {r.pii_found for r in hidden} == {"clash"}
    assert all(r.text != mail and r.n_chars == len(mail) for r in hidden if r.doc_id == 3) and all(r.text is None or "4111111111111111" not in r.text for r in hidden)
    packed = p.pack(spark, docs, sf).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(i for i, _ in rows)
    assert p.pack(spark, docs.limit(0), sf).count() == 0
    rejected = p.quality(spark, docs, sf).select("doc_id").collect()
    assert all(sum(r.doc_id == i for r in rejected) in (0, k) for i, k in ((3, 2), (1, 1)))


def test_every_operator_has_a_query():
    from quern.llm.queries import QUERIES

    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)}
