import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import consistent, encode, grouping, languages, leaks, overlap, responses
from lexiloom.llm.segment_join import segment_join
from lexiloom.llm.skeleton import skeleton

PARALLEL = "row_id long, fact_id string, subject_id string, property_id string, object_id string, relation string, split string, source string, s string, p string, text string"
REDIRECTS = "old_id string, new_id string, a string, b string"
FLAT = "row_id long, language string, question string, subject string, object string, option_a string, option_b string, option_c string, option_d string, answer_text string, answer_index long, option_ids array<string>, key string, kind string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2])
def test_segment_join_equals_brute_force(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["", "a", None]
    other = [x for b in base if b is not None for x in (b, b[1:], b[:2] + "b" + b[2:], b[::-1])] + [None]
    a, b = (spark.createDataFrame([(x,) for x in y], "text string") for y in (base, other))
    got = {tuple(r) for r in segment_join(a, b, k).collect()}
    assert got == {(x, y, d) for x in set(base) - {None} for y in set(other) - {None} if (d := edits(x, y)) <= k}


def rows_of(spark):
    f = lambda i, fact, s, p, o, split: (i, fact, s, p, o, "r", split, "src", "x", "y", "z")
    return spark.createDataFrame([
        f(1, "Q1|P1|Q9", "Q1", "P1", "Q9", "train"), f(2, "q1/p1/q9", None, "wd:P1", "Q9", "test"), f(3, None, "Q3", "P1", "Q9", "validation"), f(4, "Q5|P1|Q9", "Q4", "P1", "Q9", "train"),
        f(5, None, None, None, None, "test"), f(6, "Q2|P1|Q9", "?", "P1", "Q9", "test"), f(7, "Q1|P1|Q9", "Q1", "P1", "Q8", "test"), f(8, "Q5|P7|Q7", "Q6", "P7", "Q7", None), f(1, "Q1|P1|Q9", "Q1", "P1", "Q9", "train"),
    ], PARALLEL), spark.createDataFrame([("Q2", "Q3", "c", "d"), ("Q3", "Q1", "c", "d"), (None, "Q1", "c", "d")], REDIRECTS)


def test_overlaps(spark):
    parallel, redirects = rows_of(spark)
    assert {tuple(r) for r in overlap.p1_found(parallel, redirects).collect()} == {(1, 2), (1, 3), (1, 6)}
    assert sum(r.n_leaked for r in overlap.p1_report(parallel.where("row_id > 1").union(parallel.limit(1)), redirects).collect()) == 3
    assert overlap.p1_found(parallel.limit(0), redirects.limit(0)).count() == 0


def test_groups(spark):
    parallel, redirects = rows_of(spark)
    got = {tuple(r) for r in grouping.p5_found(parallel, redirects).collect()}
    assert got == {(1, 2), (1, 3), (1, 6), (1, 7), (4, 8)}
    assert grouping.p5_found(parallel.limit(0), redirects.limit(0)).count() == 0
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("z", "z"), (None, "x")], "a string, b string")
    assert {r.label for r in grouping.components(chain).collect()} == {"n000", "x"}


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 900)}" if i % 3 else "hot", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(6000)]
    df = spark.createDataFrame(rows, "group_id string, relation string")
    new = {r.group_id: r.new_split for r in grouping.grouped_splits(df).collect()}
    assert set(new) == {g for g, _ in rows} and set(new.values()) <= set(grouping.SPLITS)
    light = [new[g] for g, _ in rows if g != "hot"]
    total = [new[g] for g, _ in rows]
    assert total.count("train") / len(rows) == pytest.approx(0.8, abs=0.03) and len(light) == 4000
    for r in ("a", "b", "c"):
        own = [new[g] for g, x in rows if x == r]
        assert own.count("validation") / len(own) == pytest.approx(0.1, abs=0.04)
    assert grouping.grouped_splits(df.limit(0)).count() == 0


def test_consistent_form():
    same = {"Moto­r": ("Motor", "de"), "Ｌａｂｓ": ("Labs", "en"), "Рutedаl": ("Putedal", "id"), "á": ("á", "es"), "جزر بوتا": ("جزر بوتا", "ar"), "زیتو": ("زيتو", "ar"), "口ビジス": ("ロビジス", "ja"), "ケレナ自動車工業": ("ケレナ自動車工業", "ja"), "ｼﾞﾌ": ("ジフ", "ja"), "Neu‑X ": ("Neu-X", "de"), "Реcпублика": ("Республика", "ru"), "Β-30": ("Β-30", "en"), "Pepe Labs": ("Pepe Labs", "ru"), "АG": ("AG", "ar"), "是（A）": ("是（A）", "zh"), "র‍্যা": ("র‍্যা", "bn"), "ক‍খ": ("কখ", "bn"), "": ("", "en"), " ": ("", "en")}
    assert {x: consistent.canonical(x, lang) for x, (_, lang) in same.items()} == {x: want for x, (want, _) in same.items()}
    assert all(consistent.canonical(consistent.canonical(x, lang), lang) == want for x, (want, lang) in same.items())


def flat_of(spark):
    en, de = ("Red House", "Blue House", "Green House", "Grey House"), ("Rotes Haus", "Blaues Haus", "Grünes Haus", "Graues Haus")
    rows, n = [], 0
    def add(lang, answer, a=None, q="What is the house of Tom?", ids=("Q1", "Q2", "Q3", "Q4")):  # noqa: E306
        nonlocal n
        n += 1
        o = {"en": en, "de": de}[lang]
        rows.append((n, lang, q, "Tom", "Red House", a if a is not None else o[0], *o[1:], answer, 0, list(ids), "k", "x"))
    for lang, name in (("en", "Red House"), ("de", "Rotes Haus")):
        for _ in range(3):
            add(lang, name)
    cases = {"empty": [None, "", "n/a", "​"], "truncated": ["Red Ho", "The answer is Red H", "Red…"], "copy": ["What is the house of Tom", "Question: What is the house of Tom?"], "language": ["Rotes Haus", "Красный дом из далека"], None: ["RED HOUSE", "It is Red House.", "Rеd House", "Blue House"]}
    want = {}
    for kind, texts in cases.items():
        for t in texts:
            add("en", t)
            want[n] = kind
    for ids in (("Q1", "Q2", "Q3", "Q4"), ("Q5", "Q6", "Q7", "Q8")):
        add("en", "I would rather not answer this question", q=None, ids=ids)
        want[n] = "refusal"
    return spark.createDataFrame(rows, FLAT), want


def test_defects_and_forms(spark):
    flat, want = flat_of(spark)
    names = [(f"Q{i + 1}", {"en": e, "de": d}) for i, (e, d) in enumerate(zip(("Red House", "Blue House", "Green House", "Grey House"), ("Rotes Haus", "Blaues Haus", "Grünes Haus", "Graues Haus")))]
    labels = spark.createDataFrame([*names, ("Q9", None)], "id string, labels map<string,string>")
    found = responses.response_defects(flat, labels)
    got = {r.row_id: r.defect for r in found.where("field_name = 'answer_text'").collect()}
    assert got == {k: v for k, v in want.items() if v}
    odd = responses.p2_found(flat, labels).collect()
    assert [(flat.where(F.col("row_id") == r.row_id).first().answer_text, r.field_name) for r in odd] == [("Rеd House", "answer_text")]
    assert responses.response_defects(flat.limit(0), labels.limit(0)).count() == 0


def test_encoding(spark):
    rows = [(1, "a" * 3000), (2, " " * 900 + "x"), (3, "it's we'll go \n\n on " * 90), (4, None), (5, ""), (6, "日本語の文章。" * 80), (7, "x"), (8, "x"), (9, "so it 😀goes on. " * 60), (9, "so it 😀goes on. " * 60), (None, "no key " * 50), (10, "ab " * 20 + "c" * 400 + " de" * 90)]
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, ids string")
    found = encode.encode_texts(df, chunk=128, overlap=32).collect()
    got = {r.doc_id: list(r.ids) for r in found}
    assert len(found) == len(rows)
    whole = encode._encoding(encode.load_ranks())
    assert got == {k: whole.encode_ordinary(t or "") for k, t in rows}
    assert all(encode.decode(got[k], encode.load_ranks()) == (t or "") for k, t in rows)


def test_search_equals_brute_force():
    rng = random.Random(5)
    text = "".join(rng.choice("abcd") for _ in range(6000))
    patterns = sorted({text[i : i + rng.randint(8, 14)] for i in range(0, 5900, 37)} | {"abcdabcdab"})
    want = {(i, n) for n, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i)}
    assert set(leaks.WuManber(patterns).find(text)) == want


def test_leaks(spark):
    s = "The old mill of Tarin was sold in 1874 for 6,200 crowns."
    words = s.split()
    yes = [s, s.upper(), "<p>" + s.replace(" ", "&nbsp;"), s.replace(" ", "\n> "), s.replace("mill", "mlil"), s.replace("old mill", "mill"), s.replace("was", "was was"), s.replace("o", "о"), "Before. " + s + " After."]
    no = [s.replace("1874", "1875"), s.replace("Tarin", "Belok"), " ".join(words[:6]), s.replace("old mill", "new port"), "", None, string.ascii_letters]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(yes + no)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, s + " Nobody in the town of Tarin ever objected to it."), (2, None), (3, "")], "item_id long, passage string")
    for per_pass in (leaks.ITEMS, 1):
        assert {tuple(r) for r in leaks.leaked_items(docs, items, per_pass).collect()} == {(i, 1) for i in range(len(yes))}
    assert leaks.leaked_items(docs.limit(0), items.limit(0)).count() == 0
    assert skeleton("Ünï-Ｃode") == "unicode"


def test_languages(spark):
    en = ["the cat sat on the mat and looked at the moon", "there was nothing that they could have done about it", "we walked along the river until the evening came", "this house belongs to my brother and his wife"]
    de = ["die katze sitzt auf der matte und sieht den mond", "es gab nichts was sie noch hätten machen können", "wir gingen am fluss entlang bis es abend wurde", "dieses haus gehört meinem bruder und seiner frau"]
    items = spark.createDataFrame([(i, lang, t + ".", t + "?") for lang, x in (("en", en), ("de", de)) for i, t in enumerate(x)], "item_id long, lang string, passage string, question string")
    docs = [(1, "en", ". ".join(en)), (2, "eng", ". ".join(en)), (3, "de", ". ".join(en)), (4, None, ". ".join(de)), (5, "en", ". ".join(en) + ".\n" + de[0] + "."), (6, "xx", "12 34"), (7, None, None), (8, "", ""), (9, "en", "Я живу в этом доме давно."), (10, "en", ". ".join(en) * 40)]
    df = spark.createDataFrame([(*d, "m") for d in docs], "doc_id long, lang string, text string, main string")
    got = {tuple(r) for r in languages.p8_found(df, items).collect()}
    assert got == {(3, "en"), (4, "de"), (5, "de"), (5, "en"), (9, "ru")}
    assert languages.p8_found(df.limit(0), items.limit(0)).count() == 0


@pytest.mark.parametrize(("known", "text"), [("abc ", "abcd "), ("абв ", "абвг "), ("ابت ", "ابتث "), ("কখগ ", "কখগঘ "), ("あいう山川", "あいうえ山川木")])
def test_automaton_equals_brute_force(known, text):
    rng = random.Random(1)
    of = languages.Symbols
    known, text = ("".join(rng.choice(x) for _ in range(n)) for x, n in ((known, 300), (text, 200)))
    k, s = of([known]).flat.tolist(), of([text]).flat.tolist()
    inside = lambda x: any(k[i : i + len(x)] == x for i in range(len(k)))
    n, cur = 1, []
    for c in s:
        if inside(cur + [c]):
            cur.append(c)
        else:
            n, cur = n + 1, [c] if inside([c]) else []
    t = of([text])
    got = languages.Tables({"x": of([known]).flat}).phrases(t.flat, np.zeros(1, np.int64), np.array([len(t.flat)]))
    assert got[0, 0] * len(s) == pytest.approx(n)


def test_symbols_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["", "\n\nAbc. déf!", "日本は、山。 川?", "x" * 900, "<b>Bold</b> &amp; plain", " ", "ЁЖ " * 200, "قَلَم", "是（A）。"]
    alone = [languages.Symbols([t]) for t in texts]
    both = languages.Symbols(texts)
    for n, (t, one) in enumerate(zip(texts, alone)):
        mine = [(a, b, s, c) for i, a, b, s, c in zip(both.text, both.a, both.b, both.script, both.letters) if i == n and c]
        assert mine == [(a, b, s, c) for a, b, s, c in zip(one.a, one.b, one.script, one.letters) if c]
        assert all(b - a <= languages.LONGEST for a, b, _, _ in mine)
    assert languages.detect(languages.Parser({}), []) == [] and languages.detect(languages.Parser({}), ["abc", None or ""]) == [[], []]
