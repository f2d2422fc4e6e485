"""Look-alikes that a text alone can't settle are spelled as most rows spell them; valid names stay."""

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import consistent, responses

FLAT = "row_id long, language string, question string, subject string, option_a string, option_b string, option_c string, option_d string, answer_text string, option_ids array<string>, form string, n long"


def table(spark, cells):
    rows = [(i, lang, None, subject, text, None, None, None, text, ["Q1", "Q2", "Q3", "Q4"], "f", 1) for i, (lang, text, subject) in enumerate(cells)]
    return spark.createDataFrame(rows, FLAT), spark.createDataFrame([("Q1", {"de": "Neu"}), (None, None)], "id string, labels map<string,string>")


def test_forms_are_as_most_rows_spell(spark):
    ja = ["ダム工事", "サッカー二部", "ロシア八景", "キリスト口伝", "口コミ", "ヴィソンへの道", "八ヶ岳", "ナイロ市", "ナイロ市", "ナイ口市", "ギ力ド", "アメリカ", "アメリカ", "アメリ力", "自動車エ業"]
    others = [("ru", "Xe", "Xe"), ("ru", "Сура", "Сура"), ("ru", "Сура", "Сура"), ("ru", "Cypa", "Cypa"), ("de", "Diyarbakır", "Tom"), ("de", "Bılder", "Τom"), ("de", "Bilder", None), ("de", "Bilder", ""), (None, "Ｌab", "x"), ("en", "a " * 30_000, "b")]
    flat, labels = table(spark, [("ja", x, "Tom") for x in ja] + others)
    forms = {(r.row_id, r.field_name): r.consistent for r in responses.p2_forms(flat, labels).collect()}
    want = {"ナイ口市": "ナイロ市", "ギ力ド": "ギカド", "アメリ力": "アメリカ", "自動車エ業": "自動車工業", "Cypa": "Сура", "Bılder": "Bilder", "Ｌab": "Lab", "a " * 30_000: ("a " * 30_000).strip()}
    texts = [*ja, *(t for _, t, _ in others)]
    assert [forms[i, "option_a"] for i in range(len(texts))] == [want.get(t, t) for t in texts]
    odd = {(r.row_id, r.field_name) for r in consistent.odd_cells(flat, labels, responses.shown_names(flat), spark.createDataFrame([], "row_id long, field_name string")).collect()}
    subjects = {texts.index(x) for x in ("Сура", "Bılder")} | {len(ja) + 2}  # Cyrillic and Greek letters in English names
    assert odd == {(i, f) for i, t in enumerate(texts) if t in want for f in ("option_a", "answer_text")} | {(i, "subject") for i in subjects}
    none = flat.limit(0)
    assert responses.p2_forms(none, labels).count() == responses.p2_found(none, labels.limit(0)).count() == 0


@pytest.mark.parametrize("language", ["en", "de", "ru", "ar", "bn", "ja", "zh", None])
def test_clean_texts_are_their_own_form(spark, language):
    texts = ["Red House", "Grün-Weiß", "İx", "ŉa", "Сура 7", "Рер", "مدينة", "زیتو", "ঢাকা শহর", "ড়", "ো", "グ", "自動車工業", "車エ業", "ナ口", "ロシア・二部", "是（A）", "a  b", " a", "Ａ", "", "-", "o'Neil", "カ工業", "二一"]
    df = spark.createDataFrame([(t, language) for t in texts], "t string, l string")
    got = df.select("t", consistent.clean(F.col("t"), F.col("l")).alias("c"), F.lower("t").alias("low")).collect()
    for r in got:
        if r.c:
            assert consistent.settled(r.t, language or "") == (r.t, []) and responses.name_key(r.t, language or "") == r.low
    assert any(r.c for r in got)
