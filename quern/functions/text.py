"""Column expressions over text: cleaning, tokens, n-grams, sentences, references, excerpts. All JVM-side."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN_BREAK = r"[^\p{L}\p{N}_\s]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- cleaning -------------------------------------------------------------------------------------------------------


def squeeze(c: Column | str) -> Column:
    """White space to single blanks, zero-width marks out, four and more of .!? to three, trimmed."""
    out = F.regexp_replace(col(c), r"(?U)\s+", " ")
    out = F.regexp_replace(out, "[​‌‍﻿]", "")
    return F.trim(F.regexp_replace(out, r"([.!?])[.!?]{3,}", "$1$1$1"))


def clean_lines(c: Column | str, collapse_newlines: bool = False) -> Column:
    """Control characters, page-number lines and runs of blank lines out; line structure stays unless collapse_newlines."""
    out = F.regexp_replace(col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(?:[Pp]age|[Tt]rang)?[ \t]*\d{1,4}(?:[ \t]*/[ \t]*\d{1,4})?[ \t]*$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return squeeze(out) if collapse_newlines else F.trim(out)


def clean_answer(c: Column | str) -> Column:
    """White space to single blanks, then control characters out; null gives ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "), r"[\x00-\x1f\x7f]", ""))


def word_count(c: Column | str) -> Column:
    """White-space separated words; 0 for null or blank."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def clean_plain(c: Column | str, stop_line: str | None = None) -> Column:
    """Soft hyphens and not-signs out, quotes straight, dashes plain, blanks squeezed; what follows a line matching stop_line goes."""
    out = F.regexp_replace(col(c), "[¬­]", "")
    out = F.regexp_replace(out, "[“”„]", '"')
    out = F.regexp_replace(F.regexp_replace(out, "[‘’]", "'"), "[–—]", "-")
    lines = F.transform(F.split(out, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " ")))
    if stop_line is not None:
        at = F.array_position(F.transform(lines, lambda s: s.rlike(stop_line)), True)
        lines = F.when(at > 0, F.slice(lines, F.lit(1), at.cast("int"))).otherwise(lines)
    return F.array_join(lines, "\n")


def drop_noise_lines(c: Column | str, patterns: list[str]) -> Column:
    """Lines that match none of the patterns; blank lines stay."""
    keep = lambda s: (F.trim(s) == "") | ~reduce(lambda a, b: a | b, [F.trim(s).rlike(p) for p in patterns])
    return F.array_join(F.filter(F.split(col(c), "\n"), keep), "\n")


def html_text(c: Column | str) -> Column:
    """Text of an HTML page: script, style, header, footer and nav subtrees and comments out, tags to line ends, entities resolved."""
    out = F.regexp_replace(col(c), r"(?s)<!--.*?-->", "")
    for tag in ("script", "style", "header", "footer", "nav"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


#: Letters with marks and what they are without; the language-specific d with stroke counts as d.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçđÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇĐ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncdAAAAAAEEEEIIIIOOOOOUUUUYNCD"


def without_accents(c: Column | str) -> Column:
    return F.translate(col(c), ACCENTED, PLAIN)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t) if c.isprintable() or c in "\n\t"))


def clean_contract(c: Column | str) -> Column:
    """Compatibility forms composed, characters that can't be printed out, page marks and source lines to blanks, runs of dots to
    one, blanks and blank lines squeezed, trimmed. ASCII texts stay in the JVM; only the others are normalised in Arrow batches."""
    plain = F.regexp_replace(col(c), r"[\x00-\x08\x0b-\x1f\x7f]", "")
    out = F.when(col(c).rlike(r"[^\x00-\x7F]"), _nfkc(col(c))).otherwise(plain)
    for pattern, by in ((r"(?i)\bPage\s+\d+\s+of\s+\d+\b", " "), (r"(?i)Source:\s*[^\n]+", " "), (r"\.{3,}", "."), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def segmented(c: Column | str, segmenter: Callable[[Column], Column] | None = None) -> Column:
    """Words that belong together joined by a language's segmenter, an adapter from column to column; without one the text as it is."""
    return col(c) if segmenter is None else segmenter(col(c))


# --- tokens ---------------------------------------------------------------------------------------------------------


def tokens(c: Column | str) -> Column:
    """Lower case, anything but letters, digits and _ to blanks, split at white space."""
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), TOKEN_BREAK, " ")), r"\s+"), lambda t: t != "")


def content_tokens(c: Column | str, stop_words: list[str]) -> Column:
    """Tokens that are no stop words, no numbers and longer than one character."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens(c), lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{N}+$") & ~F.array_contains(stop, t))


def letter_runs(c: Column | str, least: int = 3) -> Column:
    """Lower-case runs of at least `least` letters."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """All n-grams of an array of words, joined by blanks: the array zipped with itself moved on, so that words is evaluated
    a few times and not once for each n-gram."""
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), many)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def ngrams_up_to(words: Column, n: int) -> Column:
    return F.concat(*[ngrams(words, k) for k in range(1, n + 1)])


def sentences(c: Column | str, least_chars: int = 0) -> Column:
    """Sentences that end in . ! or ? before white space, trimmed, longer than least_chars."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s) > least_chars)


#: Capitals that begin a sentence, with the marked ones of the corpus' language: fixed values.
CAPITALS = "A-ZĐÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÉÈẺẼẸÊẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÚÙỦŨỤƯỨỪỬỮỰÝỲỶỸỴ"


def sentences_before_capitals(c: Column | str, least_chars: int = 10) -> Column:
    """Sentences that end in . ! or ? before white space and a capital or digit, and at line ends; trimmed, longer than least_chars."""
    parts = F.split(F.coalesce(col(c), F.lit("")), rf"(?<=[.!?])\s+(?=[{CAPITALS}0-9])|\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > least_chars)


def clauses(c: Column | str) -> Column:
    """Parts that end in . ! ? or ; before white space, trimmed, without empty ones."""
    parts = F.split(F.coalesce(col(c), F.lit("")), r"(?<=[.!?;])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences_by_words(c: Column | str, least: int = 5, most: int = 80) -> Column:
    return F.filter(sentences(c), lambda s: F.size(F.split(s, " ")).between(least, most))


#: Three characters at each place of padded words, of one word: nowhere are the last two of them blanks.
_GRAM = r"(?=(..[^ ]|.[^ ] ))."


def trigrams(c: Column | str) -> Column:
    """Distinct three-character grams of every word, padded with two blanks before and one after."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    padded = F.concat(F.lit("  "), F.array_join(words, "   "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(_GRAM), F.lit(1)))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any. What is used more than once is bound, so that it is computed once."""
    sized = F.transform(F.array(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y"))), lambda p: F.struct(F.size(F.array_intersect(p["x"], p["y"])).alias("both"), (F.size(p["x"]) + F.size(p["y"])).alias("sum")))
    return F.get(F.transform(sized, lambda n: F.when(n["sum"] > n["both"], n["both"] / (n["sum"] - n["both"])).otherwise(0.0)), F.lit(0))


# --- references, excerpts and answers -------------------------------------------------------------------------------


def first_of(c: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule one of whose words the text contains."""
    out = F.lit(default)
    for label, words in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [c.contains(w) for w in words]), label).otherwise(out)
    return out


def votes(words: Column, labels: dict[str, list[str]], default: str) -> Column:
    """(label, hits) with most of its words among `words`; the earlier label wins a tie; default without any hit."""
    scored = F.array(
        *[F.struct((-F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws])))).alias("low"), F.lit(i).alias("turn"), F.lit(label).alias("label")) for i, (label, ws) in enumerate(labels.items())]
    )
    best = F.array_min(scored)
    return F.struct(F.when(best["low"] < 0, best["label"]).otherwise(F.lit(default)).alias("label"), (-best["low"]).cast("long").alias("hits"))


def phrase_votes(c: Column | str, labels: dict[str, list[str]], default: str) -> Column:
    """(label, hits) by phrases that a lower-case text contains; the earlier label wins a tie; default without any hit."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    hits = lambda ws: reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in ws])
    best = F.array_min(F.array(*[F.struct((-hits(ws)).alias("low"), F.lit(i).alias("turn"), F.lit(label).alias("label")) for i, (label, ws) in enumerate(labels.items())]))
    return F.struct(F.when(best["low"] < 0, best["label"]).otherwise(F.lit(default)).alias("label"), (-best["low"]).cast("long").alias("hits"))


def dmy_date(c: Column) -> Column:
    """The first d/m/y or d-m-y date of a text; null where it is none."""
    part = lambda i: F.regexp_extract(c, r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", i)
    return F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "yyyy-M-d")


def first_match(c: Column | str, pattern: str, most: int, cut: int = 50) -> Column:
    """The pattern's first group in the first `most` characters (where the reference values stand), trimmed and cut; '' if absent."""
    return F.left(F.trim(F.regexp_extract(F.left(F.coalesce(col(c), F.lit("")), F.lit(most)), pattern, 1)), F.lit(cut))


def first_listed(c: Column | str, names: list[str], most: int) -> Column:
    """The first of the names, in their order, that the first `most` characters contain in capitals; '' if none."""
    head = F.upper(F.left(F.coalesce(col(c), F.lit("")), F.lit(most)))
    out = F.lit("")
    for name in reversed(names):
        out = F.when(F.contains(head, F.lit(name)), name).otherwise(out)
    return out


def long_date(c: Column | str, pattern: str, most: int = 5000) -> Column:
    """The date whose day, month and year are the groups of the pattern's first match; null where it is none."""
    head = F.left(F.coalesce(col(c), F.lit("")), F.lit(most))
    part = lambda i: F.regexp_extract(head, pattern, i)
    return F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "yyyy-M-d")


def title_line(c: Column | str, fallback: Column, skip: str, least: int = 15, most: int = 500) -> Column:
    """The first line longer than `least` that doesn't match skip, else fallback, cut to `most` characters."""
    fit = F.filter(F.transform(F.split(col(c), "\n"), lambda s: F.trim(s)), lambda s: (F.length(s) > least) & ~s.rlike(skip))
    return F.substr(F.coalesce(F.get(fit, F.lit(0)), fallback), F.lit(1), F.lit(most))


def excerpt(c: Column | str, most: int = 200, mark: str = "...") -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.left(col(c), F.lit(most)), F.lit(mark))).otherwise(col(c))


def excerpt_at_sentence(c: Column | str, most: int = 800) -> Column:
    """At most `most` characters, cut after the last full stop in them if there is one."""
    head = F.left(col(c), F.lit(most))
    whole = F.regexp_extract(head, r"(?s)^(.*\.)", 1)
    return F.when(F.length(col(c)) <= most, col(c)).when(whole != "", whole).otherwise(head)


def overlap_share(a: Column, b: Column) -> Column:
    """Distinct words of a that b has, over the distinct words of a (1 at least)."""
    mine = F.array_distinct(a)
    return F.size(F.array_intersect(mine, b)) / F.greatest(F.size(mine), F.lit(1))


def breadcrumb(*parts: Column | str) -> Column:
    return F.concat_ws(" > ", *[F.nullif(F.trim(col(p)), F.lit("")) for p in parts])


def json_object(c: Column | str) -> Column:
    """JSON text of a judge's reply: fences off, the whole if it parses, else the first {...}; null if neither does."""
    bare = F.trim(F.regexp_replace(col(c), r"```(?:json)?", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare), F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def parents(section: Column) -> Column:
    """'1.2.3' to ['1', '1.2']."""
    parts = F.split(section, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def cross_references(c: Column | str, pattern: str = r"(?:[Ss]ection|§)\s*(\d+(?:\.\d+)*)") -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1))))
