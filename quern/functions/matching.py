"""Exact matching of a pattern in texts: all overlapping positions natively, and three classic matchers that count comparisons."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import runs
from quern.functions.text import col


def positions(c: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """0-based positions of all matches, overlapping ones too. An empty pattern is an error.

    Look-ahead makes the matches of width nothing, so overlapping ones all part the text, and the lengths between add up.
    """
    if not pattern:
        raise ValueError("empty pattern")
    text = F.lower(col(c)) if ignore_case else col(c)
    want = pattern.lower() if ignore_case else pattern
    parts = F.split(text, f"(?={quoted(want)})", -1)
    cuts = runs.sums(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length))
    return F.when(text.isNull(), F.array().cast("array<int>")).when(F.startswith(text, F.lit(want)), F.concat(F.array(F.lit(0)), cuts)).otherwise(cuts)


def quoted(pattern: str) -> str:
    """A pattern that matches just this text."""
    return re.sub(r"([^\w\s])", r"\\\1", pattern)


def highlight(c: Column | str, pattern: str, mark: str = "**") -> Column:
    """Matches between marks; a run of overlapping matches is one span."""
    return F.regexp_replace(col(c), spans(pattern), f"{mark}$1{mark}")


def spans(pattern: str) -> str:
    """A pattern that matches runs of overlapping matches: the pattern, then any tail by which it overlaps itself."""
    tails = [pattern[len(b) :] for b in (pattern[:n] for n in range(len(pattern) - 1, 0, -1)) if pattern.endswith(b)]
    return f"({quoted(pattern)}(?:{'|'.join(quoted(t) for t in tails)})*)" if tails else f"({quoted(pattern)})"


def naive(text: str, pattern: str) -> tuple[list[int], int]:
    found, compared = [], 0
    for i in range(len(text) - len(pattern) + 1):
        j = 0
        while j < len(pattern):
            compared += 1
            if text[i + j] != pattern[j]:
                break
            j += 1
        if j == len(pattern):
            found.append(i)
    return found, compared


def prefix_table(pattern: str) -> list[int]:
    """For each prefix the length of its longest border."""
    table, k = [0] * len(pattern), 0
    for i in range(1, len(pattern)):
        while k and pattern[i] != pattern[k]:
            k = table[k - 1]
        k += pattern[i] == pattern[k]
        table[i] = k
    return table


def knuth_morris_pratt(text: str, pattern: str) -> tuple[list[int], int]:
    table, found, compared, i, k = prefix_table(pattern), [], 0, 0, 0
    while i < len(text):
        compared += 1
        if text[i] == pattern[k]:
            i, k = i + 1, k + 1
            if k == len(pattern):
                found.append(i - k)
                k = table[k - 1]
        elif k:
            k = table[k - 1]
        else:
            i += 1
    return found, compared


def last_places(pattern: str) -> dict[str, int]:
    return {c: i for i, c in enumerate(pattern)}


def suffix_shifts(pattern: str) -> list[int]:
    """[j]: how far to move on when the part of the pattern from j on has matched."""
    m = len(pattern)
    shift, border = [0] * (m + 1), [0] * (m + 1)
    i, j = m, m + 1
    border[i] = j
    while i:
        while j <= m and pattern[i - 1] != pattern[j - 1]:
            shift[j] = shift[j] or j - i
            j = border[j]
        i, j = i - 1, j - 1
        border[i] = j
    j = border[0]
    for i in range(m + 1):
        shift[i] = shift[i] or j
        if i == j:
            j = border[j]
    return shift


def boyer_moore(text: str, pattern: str) -> tuple[list[int], int]:
    last, shift, m = last_places(pattern), suffix_shifts(pattern), len(pattern)
    found, compared, at = [], 0, 0
    while at <= len(text) - m:
        j = m - 1
        while j >= 0:
            compared += 1
            if text[at + j] != pattern[j]:
                break
            j -= 1
        if j < 0:
            found.append(at)
            at += shift[0]
        else:
            at += max(shift[j + 1], j - last.get(text[at + j], -1))
    return found, compared


MATCHERS = {"naive": naive, "kmp": knuth_morris_pratt, "boyer_moore": boyer_moore}


def compare_matchers(docs: DataFrame, id_col: str, text_col: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Per document and algorithm: how many matches and character comparisons. Null texts count as empty."""
    if not pattern:
        raise ValueError("empty pattern")
    want = pattern.lower() if ignore_case else pattern

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                text = (text or "").lower() if ignore_case else text or ""
                for name, matcher in MATCHERS.items():
                    found, compared = matcher(text, want)
                    rows.append((key, name, len(found), compared))
            yield pd.DataFrame(rows, columns=["id", "algorithm", "matches", "comparisons"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, algorithm string, matches long, comparisons long")
