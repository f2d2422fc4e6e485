"""Queries that do the whole of what a query with SQL does in part, against brute force."""

import hashlib
import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.operators.bootstrap import CUTS, paired_bootstrap
from lexiloom.plans.sampled import LISTS
from lexiloom.queries import QUERIES
from lexiloom.sources import writers


def written(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_phrases_of_every_length_and_language(spark, tmp_path):
    names = {"Q1": "Rome", "Q2": "University of Upper Mofiri", "Q3": "The Very Long Name of the Old Town Hall", "Q4": "New York", "Q5": "abc", "Q6": None}
    texts = [("en", "At the University of Upper Mofiri, in Rome."), (None, "the very long name of the old town hall; New York"), ("de", "Rome! Rome"), ("xx", "NEW YORK abc"), ("en", None), ("", "Romes university of upper")]
    sf = written(spark, tmp_path, documents=([(i, l, t) for i, (l, t) in enumerate(texts)], "doc_id long, lang string, text string"), entity_labels=([(k, {"en": v, "de": "x"}) for k, v in names.items()], "id string, labels map<string,string>"))
    norm = lambda x: " " + re.sub(r"[^a-z0-9]+", " ", x.lower()).strip() + " "
    want = {k: sum(norm(v) in norm(t) for _, t in texts if t) for k, v in names.items() if v and len(v) >= 4}
    assert want == {"Q1": 2, "Q2": 1, "Q3": 1, "Q4": 2}
    assert {r.id: r.n_docs for r in QUERIES["j17_phrase_join_all"](spark, sf).collect()} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_similarity_of_every_language(spark, tmp_path):
    pairs = [("en", "Rome", "Rom"), ("en", "Café", "Cafe"), ("ja", "日本国", "日本"), ("ru", "Москва", "Moсква"), ("ar", "القاهرة", "قاهرة"), ("bn", "ঢাকা", "ঢাক"), ("zh", "𠮷野家", "吉野家"), ("de", "", ""), ("de", "", "ü"), (None, "é", "e\u0301"), ("xx", "a😀b", "ab"), ("fr", None, "x"), ("fr", "x", None)]
    sf = written(spark, tmp_path, flat=([(i, *p) for i, p in enumerate(pairs)], "row_id long, language string, option_a string, option_b string"))
    want = {i: round(1 - distance(a, b) / max(len(a), len(b)), 6) if a or b else 1.0 for i, (_, a, b) in enumerate(pairs) if a is not None and b is not None}
    assert len(want) == 11 and {r.row_id: r.sim for r in QUERIES["t_similarity_all"](spark, sf).collect()} == want


def test_facts_complete_in_a_stated_list(spark, tmp_path):
    twelve, four = LISTS
    languages = {"f1": twelve, "f2": four, "f3": (*four, "ru", "ja"), "f4": ("en", "de", "es", "ru"), "f5": twelve[1:], "f6": four, "f7": twelve, "f8": four}
    cells = [(f, l) for f, ls in languages.items() for l in ls] + [("f2", "en"), ("f8", "fr")]
    ids = ["Q1", "Q2", "Q3", "Q4"]
    rows = [(i, f, l, None if f == "f8" and l == "fr" and i < len(cells) - 1 else ids, None if f == "f6" and l == "de" else i % 4) for i, (f, l) in enumerate(cells)]
    sf = written(spark, tmp_path, flat=(rows, "row_id long, fact_id string, language string, option_ids array<string>, answer_index long"))
    score = lambda i, o: int(hashlib.md5(f"{i}|{o}".encode()).hexdigest()[:8], 16)
    right = {}
    for i, f, l, o, gold in rows:
        if gold is not None and o:
            right.setdefault(f, {}).setdefault(l, max(range(4), key=lambda x: score(i, x)) == gold)
    want = Counter((",".join(x), sum(r[l] for l in x)) for x in LISTS for r in right.values() if all(l in r for l in x))
    got = {(r.languages, r.k): r.n_facts for r in QUERIES["m2_total_consistency_all"](spark, sf).collect()}
    assert got == want and sum(n for (x, _), n in want.items() if x == ",".join(twelve)) == 2 and sum(n for (x, _), n in want.items() if x == ",".join(four)) == 5


def test_bootstrap_is_paired(spark):
    values = {f"u{i}": {"a": i % 3 / 2, "b": i % 3 / 2, "c": i % 5 / 4, "d": i % 3 / 2 - 1} for i in range(60)}
    for i in range(20, 30):
        del values[f"u{i}"]["c"]
    df = spark.createDataFrame([(u, m, x) for u, v in values.items() for m, x in v.items()], "u string, m string, x double")
    got = {(r.model_a, r.model_b): r for r in paired_bootstrap(df.repartition(5), "u", "x", "m", 300, 7).collect()}
    hashes = {r.u: r.h % 2**64 for r in df.select("u", F.xxhash64("u").alias("h")).distinct().collect()}

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def weight(u, b):
        x = (mix(hashes[u] ^ mix((b + 7 * 0x9E3779B97F4A7C15 + 1) % 2**64)) >> 11) / 2**53
        return sum(x > c for c in CUTS)

    def percentile(x, q):
        at = (len(x) - 1) * q
        i = int(at)
        return x[i] + (x[min(i + 1, len(x) - 1)] - x[i]) * (at - i)

    drawn = {(u, b): weight(u, b) for u in values for b in range(300)}
    assert sum(drawn.values()) / len(drawn) == pytest.approx(1, abs=0.03)
    for a, b in [(m, None) for m in "abcd"] + list(itertools.combinations("abcd", 2)):
        x = {u: v[a] - v.get(b, 0) for u, v in values.items() if a in v and (b is None or b in v)}
        means = sorted(sum(drawn[u, k] * y for u, y in x.items()) / sum(drawn[u, k] for u in x) for k in range(300))
        r = got.pop((a, b))
        assert (r.n, r.point) == (len(x), pytest.approx(sum(x.values()) / len(x)))
        assert (r.low, r.high) == (pytest.approx(percentile(means, 0.025)), pytest.approx(percentile(means, 0.975)))
        assert r.p == (b and pytest.approx(min(1, max(2 * min(sum(m <= 0 for m in means), sum(m >= 0 for m in means)) / 300, 1 / 300))))
        assert b is None or a + b not in ("ab", "ad", "bd") or (r.low, r.high, r.p) == ((0, 0, 1) if b == "b" else (1, 1, 1 / 300))  # the draws are shared
    assert not got


def test_bootstrap_query_takes_facts_of_all_languages(spark, tmp_path):
    cells = [(f"f{i}", l, (i + k) % 3) for i in range(9) for k, l in enumerate(("en", "sw", "zh")) if (i, l) != (0, "zh")] + [(None, "en", 0), ("f1", "en", 0), ("f2", "ja", None)]
    sf = written(spark, tmp_path, flat=([(i, *c) for i, c in enumerate(cells)], "row_id long, fact_id string, language string, answer_index long"))
    got = {(r.lang_a, r.lang_b): (r.n_facts, r.point) for r in QUERIES["d15_bootstrap_paired"](spark, sf).collect()}
    assert got == {("en", None): (9, 0.333333), ("sw", None): (9, 0.333333), ("zh", None): (8, 0.375), ("en", "sw"): (9, 0.0), ("en", "zh"): (8, pytest.approx(-0.125, abs=1e-6)), ("sw", "zh"): (8, pytest.approx(0.0, abs=1e-6))}


def test_latex_table_raises_rather_than_cuts(spark):
    df = spark.range(4).selectExpr("cast(id as string) as k", "id as n")
    assert writers.latex_table(df, "k", 4).count(r"\\") == 4
    with pytest.raises(ValueError):
        writers.latex_table(df, "k", 3)
