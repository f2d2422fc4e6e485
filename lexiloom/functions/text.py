"""Text functions as column expressions; Arrow functions only where Unicode rules need Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Languages written without spaces, and the shortest answer that counts as leaked.
UNSPACED, FLOOR, FLOOR_UNSPACED = ("ja", "zh"), 3, 2


def squeeze(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s]+", " "))


def norm(c: Column) -> Column:
    """Lower case, everything but letters and digits as one space; runs on the JVM."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def drop_punctuation(c: Column) -> Column:
    """Lower case without punctuation, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\p{P}+", ""), r"\s+", " "))


def strip_edges(c: Column) -> Column:
    """Lower case without punctuation at the ends, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s.,;:!?。．]+|[\s.,;:!?。．]+$", ""), r"\s+", " "))


@F.pandas_udf(StringType())
def norm_exact(c: pd.Series) -> pd.Series:
    """Compatibility forms folded and case folded before norm(); null stays null."""
    def one(x):
        return None if x is None else re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", x).casefold()).strip()

    return c.map(one, na_action="ignore")


def skeleton_vowelless(c: Column) -> Column:
    """Lower case without vowels of the Latin alphabet."""
    return F.regexp_replace(F.lower(c), "[aeiou]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def quoted(c: Column) -> Column:
    """A text as a literal of a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def leaks(needle: Column, text: Column, language: Column) -> Column:
    """Whether an answer of enough characters stands in a text: as a whole word, or anywhere in ja and zh."""
    n, t = F.lower(F.trim(needle)), F.lower(text)
    unspaced = language.isin(*UNSPACED)
    whole = F.regexp_like(t, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), quoted(n), F.lit(r"($|[^\p{L}\p{N}_])")))
    return F.when(unspaced, (F.length(n) >= FLOOR_UNSPACED) & F.contains(t, n)).otherwise((F.length(n) >= FLOOR) & whole)


def mentions(text: Column, subject: Column) -> Column:
    """Whether a text has any word of four or more characters of a subject, or else the whole of it."""
    t, words = F.lower(text), F.filter(F.split(F.lower(subject), " "), lambda w: F.length(w) >= 4)
    return F.when(F.size(words) > 0, F.exists(words, lambda w: F.contains(t, w))).otherwise(F.contains(t, F.lower(subject)))


def ngrams(tokens: Column, n: int | Column) -> Column:
    """All runs of n tokens, as texts; empty where there are fewer.

    tokens should be a column of an inner select, not an expression, or each run evaluates it anew.
    """
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4)


def first_line(c: Column) -> Column:
    """The first line that isn't blank, without spaces at its ends; null where there is none."""
    return F.trim(F.get(F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != ""), F.lit(0)))


def json_object(c: Column) -> Column:
    """From the first brace to the last; null where there is none."""
    x = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(x != "", x)


def template_of(text: Column, subject: Column) -> Column:
    """A question with its subject as [X]."""
    return F.replace(text, subject, F.lit("[X]"))


def fill_template(template: Column, subject: Column) -> Column:
    """A prompt template with the subject put in and the mask left out."""
    return F.rtrim(F.replace(F.replace(template, F.lit("<subject>"), subject), F.lit("<mask>"), F.lit("")))


def answer_letter(prediction: Column, options: list[Column], letters: bool = True) -> Column:
    """The letter that a prediction means: the option's text, the only option that it contains, or the only one
    that contains it (from three characters); with `letters` also a bare letter, or one before a separator. Null
    where none of them tells."""
    names = "ABCDEFGH"[: len(options)]
    p = squeeze(prediction)
    own = [squeeze(o) for o in options]

    def only(hits: list[Column]) -> Column:
        count = sum((F.coalesce(h, F.lit(False)).cast("int") for h in hits), F.lit(0))
        return F.when(count == 1, F.coalesce(*[F.when(h, F.lit(x)) for x, h in zip(names, hits)]))

    exact = F.coalesce(*[F.when(p == o, F.lit(x)) for x, o in zip(names, own)])
    held = only([(F.length(o) > 0) & F.contains(p, o) for o in own])
    holding = only([(F.length(p) >= 3) & F.contains(o, p) for o in own])
    if not letters:
        return F.coalesce(exact, held, holding)
    bare = F.when(F.length(p) == 1, F.when(F.upper(p).isin(*names), F.upper(p)))
    lead = F.upper(F.regexp_extract(p, rf"^\(?([{names.lower()}])[).:\s]", 1))
    return F.coalesce(exact, bare, held, holding, F.when(lead != "", lead))


def is_correct(prediction: Column, gold: Column) -> Column:
    """Whether a prediction is the gold answer, has it as a whole word, or begins with it."""
    p, g = norm(prediction), norm(gold)
    return (g != "") & ((p == g) | F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" "))) | F.startswith(p, g))


def first_replaced(c: Column, old: str, new: str) -> Column:
    """The first occurrence of a text replaced."""
    return F.regexp_replace(c, "^(?s)(.*?)" + re.escape(old), "$1" + new.replace("$", "\\$"))


def scripts() -> dict[str, str]:
    """Pattern classes of the scripts that names are written in."""
    return {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "arabic": r"\p{IsArabic}", "bengali": r"\p{IsBengali}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "han": r"\p{IsHan}", "greek": r"\p{IsGreek}"}


def script_counts(c: Column) -> dict[str, Column]:
    return {k: F.regexp_count(c, F.lit(p)) for k, p in scripts().items()}


def dominant_script(c: Column) -> Column:
    """The script of most letters (the first by name on a tie); null without letters."""
    n = script_counts(c)
    best = F.greatest(*n.values())
    return F.when(best > 0, F.coalesce(*[F.when(n[k] == best, F.lit(k)) for k in sorted(n)]))


def mixed_script(c: Column) -> Column:
    """Whether two letters side by side are of different scripts, one of them Latin."""
    return c.rlike(r"\p{IsLatin}\p{M}*(?=\p{L})[^\p{IsLatin}]|(?=\p{L})[^\p{IsLatin}]\p{M}*\p{IsLatin}")
