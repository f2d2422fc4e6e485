"""Problem 4: responses that do not properly answer their question, with their kind of defect."""

from __future__ import annotations

import difflib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexiloom.llm.consistent import _SCRIPT_OF, canonical, clean, odd_cells, script_of, written_consistently
from lexiloom.llm.grouping import components
from lexiloom.plans.session import checkpointed, is_small, looked_up

#: What stands for no answer.
PLACEHOLDERS = frozenset("none null nil nan n/a na n.a. tbd tba todo unknown undefined blank empty missing xxx".split())
#: Words of an opening (characters where a language writes no spaces), and how alike two openings are.
OPENING, OPENING_CJK, ALIKE = 4, 8, 0.8
#: Bands and hashes a band of the openings' MinHash.
BANDS, ROWS = 12, 3
#: How like its question a copy is.
COPY = 0.85
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_PUNCT = re.compile("[^\\w\u0300-\u036f\u0980-\u09ff]+")


def name_key(text: str, language: str) -> str:
    """A name in its consistent form and in lower case, without white space or punctuation round it."""
    return re.sub(r"\s+", " ", canonical(text, language)).casefold().strip(" \t\n.,;:!?\"'«»“”‘’„()。、，：！？；")


@F.pandas_udf(StringType())
def _name_key_udf(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else name_key(t, lang or "") for t, lang in zip(text, language)], index=text.index, dtype=object)


def key_of(text: Column, language: Column) -> Column:
    """name_key() as a column; clean texts never leave the JVM."""
    return F.coalesce(_name_key_udf(F.when(~clean(text, language), text), language), F.lower(text))


def responses(flat: DataFrame) -> DataFrame:
    """(row_id, field_name, language, question, ids, text, key): the two responses of each row."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("option_a", "answer_text")])
    rows = flat.select("row_id", "language", "question", F.col("option_ids").alias("ids"), F.explode(cells).alias("c"))
    rows = rows.select("row_id", "c.field_name", "language", "question", "ids", F.col("c.text").alias("text"))
    return rows.withColumn("key", key_of(F.col("text"), F.col("language")))


def shown_names(flat: DataFrame) -> DataFrame:
    """(entity, language, text, n, n_rest): how often an option's text stands for its entity, and options b to d alone.

    Counts are combined within tasks, so an entity in a third of all rows costs no more.
    """
    options = F.array(*[F.struct(F.element_at("option_ids", i + 1).alias("entity"), F.lit(int(i > 0)).alias("rest"), F.col(f"option_{c}").alias("text")) for i, c in enumerate("abcd")])
    shown = flat.where("size(option_ids) >= 4").select("language", F.explode(options).alias("o")).select("language", "o.*").where("entity is not null and language is not null and text is not null")
    return shown.groupBy("entity", "language", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("n_rest"))


def names(shown: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity, language, key): what each entity is called in each language.

    The labels, and for each entity and language the text that options b to d show most often (they are
    aligned with option_ids); where those never show it, the most frequent text of option a that occurs
    at least twice.
    """
    n = shown.select("entity", "language", key_of(F.col("text"), F.col("language")).alias("key"), "n_rest", "n").where("key <> ''")
    n = n.groupBy("entity", "language", "key").agg(F.sum("n_rest").alias("n_rest"), F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("entity", "language").orderBy(F.desc("n_rest"), F.desc("n"), "key"))
    top = n.withColumn("best", best).where("best = 1 and (n_rest > 0 or n > 1)").select("entity", "language", "key")
    said = labels.select(F.col("id").alias("entity"), F.explode("labels").alias("language", "text")).where("text is not null and id is not null")
    said = said.select("entity", "language", key_of(F.col("text"), F.col("language")).alias("key")).where("key <> ''")
    return said.union(top).distinct()


def _squeezed(text: str) -> str:
    return _PUNCT.sub("", text.casefold())


def is_copy(text: str, question: str | None, language: str) -> bool:
    """Whether a text gives the question back: as it is, under a heading, or with small changes.

    With no question to compare, a text that asks something counts as one.
    """
    if question is None:
        return any(c in text for c in "?？؟")
    if len(text) < 0.5 * len(question):  # most answers; the consistent form is never twice as long
        return False
    q, t = _squeezed(canonical(question, language)), _squeezed(canonical(text, language))
    if not q or not t:
        return False
    if q in t and len(q) >= 0.6 * len(t):
        return True
    if abs(len(q) - len(t)) > 0.25 * max(len(q), len(t)):
        return False
    m = difflib.SequenceMatcher(None, q, t, autojunk=False)
    return m.quick_ratio() >= COPY and m.ratio() >= COPY


def opening(key: str, language: str, question: str | None = None) -> str:
    """The first words of a response, without what it takes from its question (the subject, as a rule)."""
    cjk = any(script_of(c) in ("Han", "Hiragana", "Katakana") for c in key)
    if question:
        q = name_key(question, language)
        m = difflib.SequenceMatcher(None, key, q, autojunk=False).find_longest_match()
        if m.size >= (3 if cjk else 5):
            key = key[: m.a] + " " + key[m.a + m.size :]
    if cjk:
        return re.sub(r"\s", "", key)[:OPENING_CJK]
    return " ".join([x for w in key.split() if (x := w.strip(".,;:!?،।"))][:OPENING])


def _contains(key: str, name: str) -> bool:
    i = key.find(name)
    while i >= 0:
        j = i + len(name)
        spaced = not any(script_of(c) in ("Han", "Hiragana", "Katakana") for c in (name[0], name[-1]))
        if not spaced or not ((i and key[i - 1].isalnum()) or (j < len(key) and key[j].isalnum())):
            return True
        i = key.find(name, i + 1)
    return False


def _breaks_off(key: str, name: str) -> str | None:
    """What stands before a name that a text breaks off in; None where it doesn't."""
    bare = key.rstrip(" .…-‐–—_")
    if not bare:
        return None
    if name.startswith(bare) and len(bare) < len(name):
        return ""
    cjk = any(script_of(c) in ("Han", "Hiragana", "Katakana") for c in name)
    for n in range(min(len(name) - 1, len(bare)), (1 if cjk else 2), -1):
        if bare.endswith(name[:n]) and (cjk or not bare[-n - 1 : -n].isalnum()):
            return bare[:-n]
    return None


@lru_cache(maxsize=1 << 14)
def _called(names: str) -> dict[str, frozenset[str]]:
    """Keys by language, of an entity's names as lines of language, tab and key."""
    by: dict[str, set[str]] = {}
    for x in names.splitlines():
        language, key = x.split("\t", 1)
        by.setdefault(language, set()).add(key)
    return {k: frozenset(v) for k, v in by.items()}


def classify(language: str, question: str | None, text: str | None, key: str | None, entities: list[dict[str, frozenset[str]]]) -> tuple[str, str]:
    """(kind, frame or opening) of a response, given what the row's entities are called, keys by language.

    Kinds: the defects empty, copy, language and truncated; fine; framed, a name of the row's language
    within a sentence, whose frame is still to be held against the language; and open, which no name
    explains, with its opening.
    """
    bare = canonical(text or "", language)
    if not any(c.isalnum() for c in bare) or bare.strip(" []()<>\"'").casefold() in PLACEHOLDERS:
        return "empty", ""
    if is_copy(text, question, language):
        return "copy", ""
    own = sorted({k for e in entities for k in e.get(language, ())}, key=len, reverse=True)
    if key in own:
        return "fine", ""
    for k in own:
        if _contains(key, k):
            return "framed", key.replace(k, "{}", 1)
    foreign = {k for e in entities for lang, x in e.items() if lang != language for k in x}.difference(own)
    if any(key == name_key(k, language) or _contains(key, k) for k in foreign):
        return "language", ""
    for k in own:
        frame = _breaks_off(key, k)
        if frame is not None:
            return "truncated", frame
    return "open", opening(key, language, question)


_TOLD = StructType([StructField("kind", StringType()), StructField("what", StringType())])


def _written_in_another(key: str, language: str) -> bool:
    """Whether most letters are of a script that the language isn't written in; Latin may be a brand."""
    found = [s for c in key if (s := script_of(c))]
    home = {"Japanese": ("Han", "Hiragana", "Katakana")}.get(_SCRIPT_OF.get(language), (_SCRIPT_OF.get(language, "Latin"),))
    return sum(s in (*home, "Latin") for s in found) * 2 < len(found)


def _classify(language: pd.Series, question: pd.Series, text: pd.Series, key: pd.Series, *names: pd.Series) -> pd.DataFrame:
    out = [classify(lang or "", q, t, k, [_called(x) for x in n if x]) for lang, q, t, k, *n in zip(language, question, text, key, *names)]
    out = [(a, b if a != "open" else ("\t" if _written_in_another(k, lang or "") else "") + b) for (a, b), k, lang in zip(out, key, language)]
    return pd.DataFrame(out, columns=["kind", "what"])


def minhash(shingles: set[str]) -> list[int]:
    """BANDS band values of a set's MinHash."""
    if not shingles:
        return []
    h = np.array([xxhash.xxh64_intdigest(s) for s in shingles], dtype=np.uint64)
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    low = ((h[None, :] * a[:, None]) ^ ((h[None, :] * a[:, None]) >> np.uint64(31))).min(axis=1).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(bytes([i]) + row.tobytes()) >> 1 for i, row in enumerate(low)]


def _shingles(text: str) -> set[str]:
    t = f" {text} "
    return {t[i : i + 3] for i in range(len(t) - 2)}


def _alike(a: str, b: str) -> bool:
    x, y = _shingles(a), _shingles(b)
    return len(x & y) >= ALIKE * len(x | y)


def prefix(shingles: set[str]) -> list[int]:
    """The first hashes of a set in hash order, so many that two sets alike have one of them in common.

    Sets alike share at least ALIKE of the larger one, so the first of their common hashes is among the
    first n - ceil(ALIKE * n) + 1 of either.
    """
    h = sorted(xxhash.xxh64_intdigest(s) >> 1 for s in shingles)
    return h[: len(h) - math.ceil(ALIKE * len(h) - 1e-9) + 1]


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): distinct openings, joined where their MinHash meets and Jaccard verifies it.

    All openings of one band that could be alike are compared: they meet by the band and a hash of their
    prefixes, which splits crowded bands and loses no pair alike; equal openings were one row before.
    """
    @F.pandas_udf("array<struct<band:bigint,at:bigint>>")
    def keys(o: pd.Series) -> pd.Series:
        return o.map(lambda x: [{"band": b, "at": h} for b in minhash(_shingles(x)) for h in prefix(_shingles(x))])

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_alike(x, y) for x, y in zip(a, b)], index=a.index, dtype=bool)

    k = checkpointed(openings.select("opening", F.inline(keys("opening"))))
    linked = k.select("band", "at", F.col("opening").alias("a")).join(k.select("band", "at", F.col("opening").alias("b")), ["band", "at"]).where("a < b").select("a", "b").distinct()
    found = components(linked.where(alike("a", "b")))
    return openings.select("opening").join(found, F.col("opening") == F.col("node"), "left").select("opening", F.coalesce("label", "opening").alias("cluster"))


def response_defects(flat: DataFrame, labels: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(row_id, field_name, defect): each defective response with its one defect.

    A response that is a name in its row's language is sound; that takes one lookup in the names, which
    leaves about a tenth of the cells. Those are held against what the (first four) options' entities are
    called in all languages, and against their question. What no name explains is grouped by its opening;
    openings are clustered by verified MinHash, and a cluster that recurs among unrelated prompts, which
    have no entity in common, is a template of refusals (an unknown name recurs with its entity only), however short it is. Names within a sentence have a frame; a frame belongs to the language that
    uses it most, and a row of another language has the wrong one. Null questions, subjects, options,
    languages and ids are allowed; with a null language only empty, copy and refusal can be told.
    Repeated rows count each. `shown` spares counting shown_names(flat) again.
    """
    called = checkpointed(names(shown_names(flat) if shown is None else shown, labels))
    known = checkpointed(called.select("language", "key").distinct())
    cells = looked_up(responses(flat), known, ["language", "key"], "left_anti")
    lines = checkpointed(called.groupBy("entity").agg(F.concat_ws("\n", F.sort_array(F.collect_set(F.concat_ws("\t", "language", "key")))).alias("names")))  # twelve languages
    fits = is_small(lines)
    for i in range(4):  # the entities of the four options
        cells = looked_up(cells.withColumn("entity", F.get("ids", F.lit(i))), lines.withColumnRenamed("names", f"names_{i}"), ["entity"], "left", fits).drop("entity")
    told = cells.withColumn("c", F.pandas_udf(_classify, _TOLD)("language", "question", "text", "key", *[f"names_{i}" for i in range(4)]))
    told = checkpointed(told.select("row_id", "field_name", "language", "ids", "c.kind", "c.what"))

    open_ = told.where("kind = 'open'").withColumn("foreign", F.col("what").startswith("\t")).withColumn("opening", F.expr("trim(leading '\t' from what)"))
    of_names = checkpointed(called.select(_opening_udf("key", "language").alias("opening")).distinct())
    prompts = checkpointed(looked_up(open_.where("opening <> ''").select("opening", "ids"), of_names, ["opening"], "left_anti"))
    clusters = checkpointed(opening_clusters(prompts.select("opening").distinct()))
    prompts = looked_up(prompts, clusters, ["opening"])
    every = prompts.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    shared = prompts.select("cluster", F.explode(F.array_distinct("ids")).alias("e")).groupBy("cluster", "e").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster").agg(F.max("m").alias("m"))
    templates = every.join(shared, "cluster", "left").where("n > coalesce(m, 0) and n > 1")
    refusals = checkpointed(clusters.join(templates, "cluster", "left_semi").select("opening").withColumn("refusal", F.lit(True)))
    open_ = looked_up(open_, refusals, ["opening"], "left").select("row_id", "field_name", F.when(F.col("refusal"), "refusal").when(F.col("foreign"), "language").alias("defect"))

    framed = told.where("kind = 'framed'")
    use = framed.groupBy("what", "language").agg(F.count(F.lit(1)).alias("n")).groupBy("what").agg(F.max_by("language", F.struct("n", "language")).alias("at_home"))
    framed = looked_up(framed, checkpointed(use), ["what"]).where("at_home <> language").select("row_id", "field_name", F.lit("language").alias("defect"))

    plain = told.where("kind in ('empty', 'copy', 'language', 'truncated')").select("row_id", "field_name", F.col("kind").alias("defect"))
    return plain.union(open_.where("defect is not null")).union(framed)


@F.pandas_udf(StringType())
def _opening_udf(key: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([opening(k, lang) for k, lang in zip(key, language)], index=key.index, dtype=object)


def p2_found(flat: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, field_name): cells that are not in their consistent form, but for defective responses."""
    shown = checkpointed(shown_names(flat))
    return odd_cells(flat, labels, shown, response_defects(flat, labels, shown))


def p2_forms(flat: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_id, field_name, consistent): every name cell in its consistent form; null cells stay null.

    Repeated rows give a row each; a null language is read as one written in Latin letters.
    """
    return written_consistently(flat, labels, shown_names(flat))


def p4_report(flat: DataFrame, labels: DataFrame) -> DataFrame:
    """(language, field_name, defect, n): defects per language and cell."""
    d = response_defects(flat, labels)
    return d.join(flat.select("row_id", "language"), "row_id").groupBy("language", "field_name", "defect").agg(F.count(F.lit(1)).alias("n"))
