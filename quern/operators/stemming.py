"""Word stems by Porter's rules (1980), one Arrow kernel over the distinct words of a batch, and ROUGE over stems."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quern.functions import text as T
from quern.operators import metrics as X

# The suffixes of steps 2, 3 and 4 of the published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: A y is a vowel after a consonant.
_VOWEL_RUNS = re.compile(r"v+c")
_CVC = re.compile(r"cvc$")


def _shape(word: str) -> str:
    """c or v for each letter."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How many times a vowel run is followed by a consonant."""
    return len(_VOWEL_RUNS.findall(_shape(word)))


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return bool(_CVC.search(_shape(word))) and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _inflections(word: str) -> str:
    """Step 1: plurals, -ed, -ing, and a final y."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short_end(word)):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
    return word[:-1] + "i" if word.endswith("y") and "v" in _shape(word[:-1]) else word


def stem(word: str) -> str:
    """The stem of a word in lower case; words of two letters or fewer are their own."""
    if len(word) < 3:
        return word
    word = _inflections(word)
    for rules in (STEP_2, STEP_3):
        end = _longest(word, rules)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = _longest(word, STEP_4)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.arrow_udf(ArrayType(StringType()))
def _stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        codes = batch.values.dictionary_encode()
        known = pa.array([None if w is None else stem(w) if len(w) > 3 else w for w in codes.dictionary.to_pylist()], pa.string())
        out = pa.ListArray.from_arrays(batch.offsets, known.take(codes.indices))
        yield pc.if_else(batch.is_valid(), out, pa.scalar(None, out.type))


def stems(words: Column) -> Column:
    """An array of words with each word over three letters as its stem. A batch's words are stemmed once each."""
    return _stems(words)


def rouge_words(c: Column | str) -> Column:
    """Runs of a-z and digits of the text in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(T.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


@F.arrow_udf(StructType().add("one", IntegerType()).add("two", IntegerType()).add("common", IntegerType()))
def _shared(candidates: pa.Array, references: pa.Array) -> pa.Array:
    """What two lists of words share: words, pairs of neighbours, and the longest common subsequence. Words stay in their Arrow
    batch; only the numbers that stand for those of one row are Python objects."""
    one, two, common = [], [], []
    for i in range(len(candidates)):
        a = candidates.slice(i, 1).flatten()
        codes = pa.concat_arrays([a, references.slice(i, 1).flatten()]).dictionary_encode()
        kinds, n = len(codes.dictionary), len(a)
        codes = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        x, y = codes[:n], codes[n:]
        one.append(int(np.minimum(np.bincount(x, minlength=kinds), np.bincount(y, minlength=kinds)).sum()))
        (p, np_), (q, nq) = (np.unique(c[:-1] * kinds + c[1:], return_counts=True) for c in (x, y))
        _, at, other = np.intersect1d(p, q, assume_unique=True, return_indices=True)
        two.append(int(np.minimum(np_[at], nq[other]).sum()))
        common.append(X._longest_common(x.tolist(), y.tolist()))
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (one, two, common)], ["one", "two", "common"])


def rouge(pairs: DataFrame, key: list[str], candidate: str = "candidate", reference: str = "reference", stemmed: bool = True) -> DataFrame:
    """(key, rouge1_p, rouge1_r, rouge1_f, rouge2_f, rouge_l_f) of texts by words, or by their stems; zeros where a text is null or has no word."""
    words = pairs.select(*key, rouge_words(candidate).alias("a"), rouge_words(reference).alias("b"))
    if stemmed:
        words = words.withColumns({"a": stems(F.col("a")), "b": stems(F.col("b"))})
    scored = words.withColumn("s", _shared(F.col("a"), F.col("b")))
    pairs_of = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    one, two = X.shared_shares(F.col("s.one"), F.size("a"), F.size("b")), X.shared_shares(F.col("s.two"), pairs_of("a"), pairs_of("b"))
    scored = scored.withColumns({"one": one, "two": two, "common": F.col("s.common")})
    longest = F.coalesce(2 * F.col("common") / F.nullif(F.size("a") + F.size("b"), F.lit(0)), F.lit(0.0))
    return scored.select(*key, F.col("one.p").alias("rouge1_p"), F.col("one.r").alias("rouge1_r"), F.col("one.f").alias("rouge1_f"), F.col("two.f").alias("rouge2_f"), longest.alias("rouge_l_f"))


def rouge_average(scores: DataFrame) -> DataFrame:
    """(pairs, means of all scores): one row, zeros without pairs."""
    names = [c for c in scores.columns if c.startswith("rouge")]
    return scores.agg(F.count("*").alias("pairs"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names])
