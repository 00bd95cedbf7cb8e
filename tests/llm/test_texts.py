"""License scans, token alignment and ranked search against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import license_scan, license_texts, ranked_search, token_alignment
from quern.llm.words import words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("text", ["", None, "Aé-B2 \x85 x y z İK", "ÀB  c_d'e", "\x00a\x7fb", "漢字 kana", "a" * 5000])
def test_words(text):
    assert [w.decode() for w in words(text)] == plain_words(text)


# --- licenses -------------------------------------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_spans(text, templates, k, reach, similar):
    """(label, similarity) of the verified spans, by comparing every k-gram with every place of every template."""
    doc, held = plain_words(text), []
    for n, (_, template) in enumerate(templates):
        own = plain_words(template)
        votes = collections.defaultdict(list)
        for i in range(len(doc) - k + 1):
            for j in range(len(own) - k + 1):
                if doc[i : i + k] == own[j : j + k]:
                    votes[i - j].append(i)
        for d, places in votes.items():
            near = [e for e in votes if abs(e - d) <= reach]
            if any(len(votes[e]) > len(places) or len(votes[e]) == len(places) and e < d for e in near):
                continue
            first, last = min(min(votes[e]) for e in near), max(max(votes[e]) for e in near)
            start, end = max(0, min(first, min(near))), min(len(doc), max(last + k, max(near) + len(own)))
            common = longest_common(own, doc[start:end])
            if common >= similar * len(own):
                held.append((common, common / len(own), n, first, min(len(doc), last + k)))
    held.sort(key=lambda h: (-h[0], -h[1], h[2], h[3]))
    kept = []
    for h in held:
        if all(2 * (min(h[4], o[4]) - max(h[3], o[3])) <= min(h[4] - h[3], o[4] - o[3]) for o in kept):
            kept.append(h)
    return kept


def damaged(rng, text, every):
    out = text.split()
    for at in range(every, len(out), every):
        out[at] = rng.choice(["", "changed", f"{out[at]} put in"])
    return " ".join(out)


def test_license_scan_is_brute_force(spark):
    rng = random.Random(11)
    noise = lambda n: " ".join(rng.choice(["zeta", "eta", "theta", "the", "license", "under", "mit", "cc"]) for _ in range(n))
    texts = [noise(rng.randrange(1, 60)) for _ in range(12)]
    for _, template in license_texts.TEMPLATES:
        texts += [template, f"{noise(30)} {template.upper()} {noise(9)}", f"{noise(4)}\n * {damaged(rng, template, 17)}", damaged(rng, template, 6), " ".join(template.split()[: len(template.split()) // 2])]
    texts += [f"{license_texts.TEMPLATES[8][1]} {noise(3)} {license_texts.TEMPLATES[10][1]} {license_texts.TEMPLATES[8][1]}", "under the MIT-license under the mit license", "released under the mit license " * 40]
    texts += [None, "", " \n", "x" * 20_000, "Apache License, Version 2", "cc-by-NC cc by nc", noise(6000) + " Licensed under CC BY 4.0. " + noise(50), *texts[12:18]]
    rows = [(i, t, 0, "s") for i, t in enumerate(texts)] + [(None, texts[13], 1, None), (3, texts[13], 2, "label")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, label string").repartition(4)
    found = license_scan.scan(docs, license_texts.TEMPLATES, license_texts.PHRASES)
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9), tuple((s.label, s.start, s.end) for s in sorted(r.spans))) for r in found.collect())
    want = collections.Counter()
    for doc_id, text, _, _ in rows:
        doc = plain_words(text)
        places = [(i, label) for phrase, label in license_texts.PHRASES for i in range(len(doc)) if doc[i : i + len(phrase.split())] == phrase.split()]
        spans = brute_spans(text, license_texts.TEMPLATES, license_scan.GRAM, license_scan.REACH, license_scan.SIMILAR)
        base = {label for _, label in places}
        labels = base | {license_texts.TEMPLATES[s[2]][0] for s in spans}
        starts = [i for i, _ in places]
        score = 1.0 if base else max((s[1] for s in spans), default=0.0)
        want[doc_id, len(doc), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9),
             tuple(sorted((license_texts.TEMPLATES[s[2]][0], s[3], s[4]) for s in spans))] += 1
    assert got == want
    by_text = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    for n, (label, _) in enumerate(license_texts.TEMPLATES):
        assert label in by_text[12 + 5 * n].labels.split(",") and label in by_text[13 + 5 * n].labels.split(",")
    assert license_scan.scan(docs.limit(0), license_texts.TEMPLATES, license_texts.PHRASES).count() == 0


def test_license_candidates_are_few(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i, "Released under the MIT License. " * (i % 3)) for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: (r.n_base, r.labels) for r in license_scan.scan(docs, license_texts.TEMPLATES, license_texts.PHRASES).collect()}
    assert got == {i: (i % 3, "mit" if i % 3 else "") for i in range(9)}


def test_common_words():
    rng = random.Random(12)
    for _ in range(60):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        assert license_scan.common_words(a, b) == longest_common(a, b)


# --- alignment ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(13)
    glue = [" ", "  ", "\n", "\t ", " \n", " ", "　", "\x1c", "\x85", "", "-", "'s ", ", "]
    stems = ["Thntblere", "of", "the", "éçment", "größe", "漢字", "1234", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "é", "👩‍👩‍👧", "​", "don't", "ﬁ", "\x00", "İ", "______", "a" * 70]
    made = ["".join(rng.choice(stems) + rng.choice(glue) for _ in range(rng.randrange(1, 50))) for _ in range(150)]
    return [*made, None, "", " ", "   ", "\n", "a▁b", "▁", "x" * 3000, " lead", "trail ", "the " * 400, *made[:20]]


def tokens_of(text, a, b):
    """(A ids, B ids, A bytes, B bytes) of a whole text by the libraries, or None."""
    if not text:
        return None
    letters = {v: k for k, v in token_alignment.byte_letters().items()}
    assert len(letters) == 256
    back = token_alignment.byte_letters()
    x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
    xa = [bytes(back[c] for c in a.id_to_token(i)) for i in x.ids]
    yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    whole = (" " + text).encode()
    return (x.ids, y, xa, yb) if b"".join(xa) == whole and b"".join(yb) == whole else None


def spread(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


@pytest.mark.parametrize("block", [200, 10**9])
def test_alignment_is_brute_force(spark, odd_texts, monkeypatch, block):
    monkeypatch.setattr(token_alignment, "BLOCK_TOKENS", block)
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, t, i % 3, "g") for i, t in enumerate(odd_texts)] + [(None, odd_texts[0], 1, None), (2, odd_texts[0], 1, "x")]
    links, holders = [], collections.defaultdict(set)
    for n, (_, text, _, _) in enumerate(rows):
        own = []
        if found := tokens_of(text, a, b):
            sa, sb = spread(found[2]), spread(found[3])
            own = [(x, y) for x, (p, q) in zip(found[0], sa) for y, (r, s) in zip(found[1], sb) if max(p, r) < min(q, s)]
        links.append(own)
        for pair in own:
            holders[pair].add(n)
    count = {pair: len(who) for pair, who in holders.items()}
    best = collections.defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    want = collections.Counter()
    for (doc_id, text, _, _), own in zip(rows, links):
        found = tokens_of(text, a, b)
        groups = []
        if found:
            ids, pieces = [], []
            ea, eb = {e for _, e in spread(found[2])}, {e for _, e in spread(found[3])}
            events = sorted([(e, 0, i) for i, (_, e) in zip(found[0], spread(found[2]))] + [(e, 1, i) for i, (_, e) in zip(found[1], spread(found[3]))], key=lambda v: v[0])
            for at, (e, side, i) in enumerate(events):
                (pieces if side else ids).append(str(i))
                if e in ea and e in eb and (at + 1 == len(events) or events[at + 1][0] > e):
                    groups.append(",".join(ids) + "|" + ",".join(pieces))
                    ids, pieces = [], []
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want[doc_id, len(found[0]) if found else 0, len(found[1]) if found else 0, len(groups), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), digest] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, docs int, block string").repartition(3)
    result = token_alignment.align(docs, BYTES, PIECES)
    assert collections.Counter(tuple(r) for r in result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want
    assert any(w[1] == 0 and w[0] is not None for w in want) and max(w[4] for w in want) > 100
    assert token_alignment.align(docs.limit(0), BYTES, PIECES).count() == 0
    assert [tuple(r)[1:] for r in token_alignment.align(docs.where("text is null"), BYTES, PIECES).collect()] == [(0, 0, 0, 0, 0, 0, "")]


# --- ranked search --------------------------------------------------------------------------------------------------


def brute_ranking(rows, items, best=10):
    docs = [(i, collections.Counter(plain_words(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_words = len(docs), sum(n for _, _, n in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_words
            score = 0
            for t in plain_words(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "leaf", "vocabulary", "together"), [(16_384, 64, 200_000, 2000), (50, 8, 200_000, 3), (64, 2, 5, 7), (9, 64, 0, 2000)])
def test_ranked_search_is_brute_force(spark, monkeypatch, block, leaf, vocabulary, together):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("FAN", 3 if leaf < 64 else 8), ("VOCABULARY", vocabulary), ("TOGETHER", together)):
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(80)] + ["Été", "漢"]
    made = lambda n: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=n))
    texts = [made(rng.randrange(1, 90)) for _ in range(150)]
    texts += [*texts[:25], *["same text w3 w40"] * 30, None, "", "!!", "w1 " * 5000]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts)] + [(None, texts[4]), (None, "w79 w78"), (7, "w79 w78")]
    items = [(i, made(rng.randrange(1, 30))) for i in range(12)] + [(20, "nowhere"), (21, None), (22, ""), (23, "W3 same w40 W40"), (None, "w79"), (3, "w5"), (23, "W3 same w40 W40"), (24, "w0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    got = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    found = sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str)
    assert found == brute_ranking(rows, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(docs, empty).count() == 0 == ranked_search.search(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count()
