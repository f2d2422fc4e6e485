"""Problem 2: text that looks the same, brought to one form in its characters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexiloom.plans.session import checkpointed, looked_up

#: Letters that look alike, by script, as pairs of Latin letter and the other script's letter.
CYRILLIC = "AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ aа cс dԁ eе hһ iі jј lӏ oо pр qԛ sѕ wԝ xх yу"
GREEK = "AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ aα iι kκ oο pρ uυ vν xχ yγ"
ARMENIAN = "oօ uս nո hհ gց"
CHEROKEE = "AᎪ BᏴ CᏟ DᎠ EᎬ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ ZᏃ"
#: Letters of a language's script that only other languages use, and what they stand for.
ARABIC = str.maketrans("یکہەۀے", "يكهههي")
BENGALI = str.maketrans("ৰৱ", "রব")
LATIN = str.maketrans({"ɑ": "a", "ɡ": "g", "ǀ": "l", "ɩ": "i", "ʋ": "v"})
#: Ideographs and hiragana that look like katakana.
KANA = dict(zip("口力夕卜二工八才へべぺり一", "ロカタトニエハオヘベペリー"))
_HYPHENS = "‐‑−﹣－"
_ABBREVIATION = 4

_SCRIPT_OF = {"de": "Latin", "en": "Latin", "id": "Latin", "pt": "Latin", "sw": "Latin", "es": "Latin", "fr": "Latin", "ru": "Cyrillic", "ar": "Arabic", "bn": "Bengali", "ja": "Japanese", "zh": "Han"}
_RANGES = (
    (0x41, 0x24F, "Latin"), (0x250, 0x2AF, "Latin"), (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x530, 0x58F, "Armenian"), (0x600, 0x77F, "Arabic"), (0x980, 0x9FF, "Bengali"),
    (0x13A0, 0x13FF, "Cherokee"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3005, 0x3007, "Han"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x9FFF, "Han"), (0x20000, 0x3FFFF, "Han"),
)
_ALIKE: dict[str, dict[str, str]] = {}
for _script, _pairs in (("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN), ("Cherokee", CHEROKEE)):
    for _latin, _other in _pairs.split():
        _ALIKE.setdefault(_other, {})["Latin"] = _latin
        _ALIKE.setdefault(_latin, {})[_script] = _other
for _c, _to in list(_ALIKE.items()):  # by way of the Latin letter
    if "Latin" in _to:
        for _s, _x in _ALIKE[_to["Latin"]].items():
            _to.setdefault(_s, _x)
_KANA_CLASS = "゠-ヺーヽヾ" + "".join(KANA)
_KANA_RUN = re.compile(f"[{_KANA_CLASS}]+")
_TRUE_KANA, _ALIKE_KANA = re.compile("[ァ-ヺ]"), re.compile("[" + "".join(KANA) + "]")
_SPECIAL = re.compile(r"[^\S ]+| *[\t\n\r\f\v\x1c-\x1f\x85\u2028\u2029]+ *")


@lru_cache(maxsize=1 << 14)
def script_of(c: str) -> str:
    """The script of a letter; '' for what is no letter."""
    if not unicodedata.category(c).startswith("L"):
        return ""
    n = ord(c)
    return next((s for a, b, s in _RANGES if a <= n <= b), "other")


@lru_cache(maxsize=1 << 14)
def _ordinary(c: str, cjk: bool) -> str:
    """A character in its ordinary width and shape; full-width punctuation is ordinary in CJK text."""
    kind, name = unicodedata.category(c), unicodedata.decomposition(c)
    if 0x2E80 <= ord(c) <= 0x2FDF or (kind[0] in "LN" and not name.startswith(("<super>", "<sub>", "<fraction>", "<circle>"))) or name.startswith("<narrow>"):
        return unicodedata.normalize("NFKC", c) if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c) else c
    if name.startswith("<wide>") and not cjk:
        return unicodedata.normalize("NFKC", c)
    return c


def _needed(text: str, i: int) -> bool:
    """Whether the joiner at i is part of Bengali spelling: between letters, at a virama."""
    around = text[i - 1 : i], text[i + 1 : i + 2]
    return all("ঀ" <= x <= "\u09ff" for x in around if x) and all(around) and "\u09cd" in around


def _visible(text: str) -> str:
    return "".join(
        c for i, c in enumerate(text)
        if not (unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or c in "\u034f\u115f\u1160\u3164\uffa0" or (unicodedata.category(c) == "Cc" and not c.isspace())) or (c in "\u200c\u200d" and _needed(text, i))
    )


def _as(c: str, script: str) -> str | None:
    """The letter of a script that looks like c, with c's accents."""
    if script_of(c) in (script, ""):
        return c
    if script in _ALIKE.get(c, ()):
        return _ALIKE[c][script]
    base, *marks = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", _ALIKE[base][script] + "".join(marks)) if marks and script in _ALIKE.get(base, ()) else None


def _tokens(text: str) -> list[str]:
    """Runs of letters with their marks, and what lies between them; CJK letters are runs of their own."""
    out: list[list[str]] = []
    last = None
    for c in text:
        s = script_of(c)
        kind = last if unicodedata.category(c)[0] == "M" else "cjk" if s in ("Han", "Hiragana", "Katakana") else "letters" if s else "rest"
        if kind == last and out:
            out[-1].append(c)
        else:
            out.append([c])
        last = kind
    return ["".join(x) for x in out]


def _resolve(text: str, home: str, bold: bool) -> tuple[str, list[str]]:
    """Each token in one script, the one in which all of its letters can be written; and tokens left in doubt.

    In Cyrillic text a token of Latin letters that all have a Cyrillic double may be either: it is in doubt,
    and only `bold` rewrites it.
    """
    tokens = _tokens(text)
    own = [{s for c in t if (s := script_of(c))} for t in tokens]
    can = []
    for t, o in zip(tokens, own):
        sets = [{s for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", *o) if _as(c, s) is not None} for c in t if script_of(c)]
        can.append(set.intersection(*sets) if sets else set())
    definite = {next(iter(o)) for t, o, c in zip(tokens, own, can) if len(o) == 1 and home not in c and not (t.isupper() and len(t) <= _ABBREVIATION)}
    doubtful = []
    for i, t in enumerate(tokens):
        if not own[i] or own[i] == {home} or not can[i] or not own[i] & {"Latin", "Cyrillic", "Greek", "Armenian", "Cherokee"}:
            continue
        to = home if home in can[i] else "Latin" if "Latin" in can[i] else "Cyrillic" if "Cyrillic" in can[i] else None
        if to is None or own[i] == {to}:
            continue
        if len(own[i]) == 1:  # the whole token is in another script
            only = next(iter(own[i]))
            if only in definite or (only == "Greek" and len(t) == 1):
                continue
            if only == "Latin" and (home != "Cyrillic" or (t.isupper() and len(t) <= _ABBREVIATION)):
                continue
            if only == "Latin" and not bold:
                doubtful.append(t)
                continue
        tokens[i] = "".join(_as(c, to) or c for c in t)
    return "".join(tokens), doubtful


def _kana(run: str, bold: bool) -> str:
    """Look-alikes between two kana are kana; next to an ideograph or at an end they may be either."""
    if not _TRUE_KANA.search(run):
        return run
    kana = [bool(_TRUE_KANA.match(c)) or c == "ー" for c in run]
    return "".join(KANA.get(c, c) if bold or (0 < i < len(run) - 1 and kana[i - 1] and kana[i + 1]) else c for i, c in enumerate(run))


def _in_form(text: str, language: str, bold: bool) -> tuple[str, list[str]]:
    if text.isascii():
        if text.isprintable() and text[:1] != " " and text[-1:] != " " and _SCRIPT_OF.get(language) != "Cyrillic":
            return text, []
    home = _SCRIPT_OF.get(language, "Latin")
    cjk = home in ("Japanese", "Han")
    text = "".join(_ordinary(c, cjk) for c in text) if not text.isascii() else text
    text = unicodedata.normalize("NFC", _visible(text))
    text = re.sub(f"[{_HYPHENS}]", "-", text)
    text = _SPECIAL.sub(" ", text).strip(" ")
    text = text.translate(ARABIC).translate(BENGALI) if not text.isascii() else text
    text = text.translate(LATIN)
    if bold:
        text = text.replace("ı", "i")
    text, doubtful = _resolve(text, home, bold)
    text = unicodedata.normalize("NFC", text)
    if cjk:
        text = _KANA_RUN.sub(lambda m: _kana(m.group(), bold), re.sub("(?<=[一-鿿])エ(?=[一-鿿])", "工", text))
        doubtful += [x for x in _KANA_RUN.findall(text) if _TRUE_KANA.search(x) and _ALIKE_KANA.search(x)]
    elif "ı" in text:
        doubtful += [x for x in _tokens(text) if "ı" in x]
    return text, doubtful


@lru_cache(maxsize=1 << 17)
def canonical(text: str, language: str) -> str:
    """The form in which texts of a language (a code of two letters; others are read as Latin) are compared.

    Composed letters, ordinary width, plain spaces and hyphens, none at the ends, nothing invisible but
    joiners that Bengali spelling needs, and each token in one script: scripts in which each of its
    letters can be written are intersected over the token, and the language's own is preferred. A token
    wholly in another script is kept where it is a single Greek letter, a Latin abbreviation or brand in
    a text of another script, or where other tokens show that the text is written in that script.
    Whatever may be written in either of two ways is written in one of them, so the result can be no
    name's right spelling: `consistent_forms` gives that.
    """
    return _in_form(text, language, True)[0]


def settled(text: str, language: str) -> tuple[str, list[str]]:
    """(form, doubtful tokens): as canonical(), with tokens left as they are where the text alone can't tell."""
    return _in_form(text, language, False)


@F.pandas_udf(StructType([StructField("form", StringType()), StructField("doubtful", ArrayType(StringType()))]))
def _settled_udf(text: pd.Series, language: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([settled(t, lang or "") for t, lang in zip(text, language)], columns=["form", "doubtful"])


_HAN, _KANA_ONLY = "一-鿿", "".join(KANA)
#: Letters that are in their consistent form whatever stands beside them, by the script of the language, and what may
#: not follow each other all the same. Plain classes and searches only: the length of a text is no depth of recursion.
_CLEAN = {
    "Latin": "A-Za-z0-9À-ÖØ-Þà-öø-ÿ\u0100-\u012f\u0134-\u013e\u0141-\u0148\u014a-\u017e",
    "Cyrillic": "А-Яа-яЁё0-9",
    "Arabic": "A-Za-zء-غف-ي0-9",
    "Bengali": "A-Za-z\u0981-\u0983\u0985-\u09b9\u09bc\u09be-\u09cd0-9",
    "CJK": f"A-Za-zァ-ヺーぁ-ゖ{_HAN}0-9",
}
_BETWEEN = " '·・-"
_NEVER = {"Bengali": "|\u09c7[\u09be\u09d7]|\u09cd\u09bc", "CJK": f"|[{_HAN}]エ[{_HAN}]|(?<![{_HAN}])[{_KANA_ONLY}]|[{_KANA_ONLY}](?![{_HAN}])"}


def clean(text: Column, language: Column) -> Column:
    """Whether a text is of ordinary letters of its language, single spaces, hyphens, apostrophes and middle dots, so
    that it is its own consistent form and its lower case is its key. Decided on the JVM; false decides nothing."""
    def words(script: str) -> Column:
        never = f"^[{_BETWEEN}]|[{_BETWEEN}]$|[{_BETWEEN}]{{2}}{_NEVER.get(script, '')}"
        return text.rlike(f"^[{_CLEAN[script]}{_BETWEEN}]+$") & ~text.rlike(never)

    home = {"ru": "Cyrillic", "ar": "Arabic", "bn": "Bengali", "ja": "CJK", "zh": "CJK"}
    by = None
    for code, script in home.items():
        by = (F if by is None else by).when(language == code, words(script))
    return F.coalesce(by.otherwise(words("Latin")), F.lit(False))


def name_cells(flat: DataFrame) -> DataFrame:
    """(row_id, field_name, language, text): the three name cells of each row; subjects are English."""
    cells = F.array(
        F.struct(F.lit("option_a").alias("field_name"), F.col("language"), F.col("option_a").alias("text")),
        F.struct(F.lit("answer_text").alias("field_name"), F.col("language"), F.col("answer_text").alias("text")),
        F.struct(F.lit("subject").alias("field_name"), F.lit("en").alias("language"), F.col("subject").alias("text")),
    )
    return flat.select("row_id", F.explode(cells).alias("c")).select("row_id", "c.*")


#: Runs of kana and their look-alikes, other words, and what lies between: together they are the text.
_TOKENS = f"[{_KANA_CLASS}]+|[\\p{{L}}\\p{{M}}&&[^{_KANA_CLASS}]]+|[^\\p{{L}}\\p{{M}}]+"


def _token_key(token: Column, language: Column) -> Column:
    """What tokens that look alike have in common, for those that can be in doubt."""
    latin, cyrillic = ("".join(x) for x in zip(*CYRILLIC.split()))
    return (
        F.when(language.isin("ja", "zh"), F.translate(token, "".join(KANA), "".join(KANA.values()))).when(language == "ru", F.translate(token, latin, cyrillic))
        .otherwise(F.replace(token, F.lit("ı"), F.lit("i")))
    )


def unclean_cells(flat: DataFrame) -> DataFrame:
    """The name cells that aren't `clean`, written to the shared folder as they are needed twice."""
    return checkpointed(name_cells(flat).where("text is not null").where(~clean(F.col("text"), F.col("language"))))


def consistent_forms(cells: DataFrame, flat: DataFrame, labels: DataFrame, shown: DataFrame) -> DataFrame:
    """(language, text, form): the consistent form of each distinct text of `cells`, which aren't `clean`.

    What a text alone tells is settled token by token. For tokens in doubt (a kana or an ideograph at the
    edge of a kana run, a Latin token in Cyrillic text whose letters all have doubles, a dotless i) the
    spellings that look alike are counted over the options (`shown`: language, text, n), the subjects and the
    labels, and the most frequent one is the consistent one: a name that everyone writes so stays. On a tie the token
    stays too. Everything runs on distinct texts with their counts.
    """
    is_clean = clean(F.col("text"), F.col("language"))
    cells = cells.groupBy("language", "text").agg(F.count_if(F.col("field_name") != "answer_text").alias("n"))
    cells = checkpointed(cells.repartition(flat.sparkSession.sparkContext.defaultParallelism))  # few bytes, but much to do for each
    subjects = flat.where("subject is not null").groupBy(F.lit("en").alias("language"), F.col("subject").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    said = labels.select(F.explode("labels").alias("language", "text"), F.lit(1).alias("n")).where("text is not null")
    texts = shown.select("language", "text", "n").union(subjects).union(said).where(is_clean).withColumn("clean", F.lit(True)).union(cells.withColumn("clean", F.lit(False)))
    odd = texts.where("not clean").select("language", "text", "n", _settled_udf("text", "language").alias("s")).select("language", "text", "n", "s.form", "s.doubtful")
    odd = checkpointed(odd)
    lang, token = F.col("language"), F.col("token")
    doubts = odd.select("language", F.explode(F.array_distinct("doubtful")).alias("token")).distinct()
    keys = checkpointed(doubts.select("language", _token_key(token, lang).alias("key")).distinct())
    spelled = texts.where("clean").select("language", F.col("text").alias("form"), "n").union(odd.select("language", "form", "n"))
    spelled = spelled.select("language", "n", F.explode(F.regexp_extract_all("form", F.lit(_TOKENS), F.lit(0))).alias("token"))
    spelled = spelled.groupBy("language", "token").agg(F.sum("n").alias("n")).withColumn("key", _token_key(token, lang))
    best = looked_up(spelled, keys, ["language", "key"]).groupBy("language", "key").agg(F.max_by("token", F.struct("n", "token")).alias("best"), F.max("n").alias("most"))
    fixes = looked_up(spelled, keys, ["language", "key"]).join(best, ["language", "key"]).where("token <> best and n < most")
    fixes = checkpointed(fixes.join(doubts, ["language", "token"], "left_semi").select("language", "token", "best"))
    at = odd.where("size(doubtful) > 0").select("language", "text", F.posexplode(F.regexp_extract_all("form", F.lit(_TOKENS), F.lit(0))).alias("i", "token"))
    told = looked_up(at, fixes, ["language", "token"], "left").groupBy("language", "text").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("best", "token").alias("t")))).alias("p"))  # a text's tokens
    told = told.select("language", "text", F.array_join("p.t", "").alias("form"))
    return odd.where("size(doubtful) = 0").select("language", "text", "form").union(told)


def written_consistently(flat: DataFrame, labels: DataFrame, shown: DataFrame) -> DataFrame:
    """(row_id, field_name, consistent): every name cell in its consistent form; null cells stay null."""
    changed = checkpointed(consistent_forms(unclean_cells(flat), flat, labels, shown).where("form <> text").withColumn("language", F.coalesce("language", F.lit(""))))
    cells = name_cells(flat).withColumn("language", F.coalesce("language", F.lit("")))
    return looked_up(cells, changed, ["language", "text"], "left").select("row_id", "field_name", F.coalesce("form", "text").alias("consistent"))


def odd_cells(flat: DataFrame, labels: DataFrame, shown: DataFrame, defective: DataFrame) -> DataFrame:
    """(row_id, field_name): cells that are not in their consistent form, but for those in `defective`."""
    cells = unclean_cells(flat)
    changed = checkpointed(consistent_forms(cells, flat, labels, shown).where("form <> text").select(F.coalesce("language", F.lit("")).alias("language"), "text"))
    odd = looked_up(cells.withColumn("language", F.coalesce("language", F.lit(""))), changed, ["language", "text"], "left_semi").select("row_id", "field_name")
    return odd.join(defective.select("row_id", "field_name"), ["row_id", "field_name"], "left_anti")
