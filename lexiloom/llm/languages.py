"""Problem 8: the language of documents and of their parts, by cross-parsing."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "id", "pt", "ar", "bn", "sw", "es", "ru", "fr", "ja", "zh")
#: What a label may call each language.
LABELS = {
    "en": "eng english", "de": "deu ger german deutsch", "id": "ind indonesian bahasa", "pt": "por portuguese português", "ar": "ara arb arabic العربية", "bn": "ben bengali bangla বাংলা",
    "sw": "swa swh swahili kiswahili", "es": "spa spanish castilian español", "ru": "rus russian русский", "fr": "fra fre french français", "ja": "jpn japanese 日本語", "zh": "zho chi cmn chinese mandarin 中文",
}
#: Labelled text for the automata: at most so many documents and evaluation items of a language, the first
#: SAMPLE_START characters of a document, and SAMPLE_CHARS symbols of a language, a third of them from
#: the items.
SAMPLE_DOCS, SAMPLE_ITEMS, SAMPLE_START, SAMPLE_CHARS = 240, 200, 1_200, 36_000
#: Letters that a full sentence has at least (CJK characters: the second), and the share of the main
#: language's phrases that another language must do with to take a segment from it (in fitting: CLEAR).
FULL, FULL_CJK, LESS, CLEAR = 20, 8, 0.75, 0.55
#: A segment with such a share of kana among its CJK letters is of no language that hardly (KANA_TEXT) writes kana.
KANA, KANA_TEXT = 0.35, 0.01
#: A segment is at most so many characters; segments parsed at a time in a task.
LONGEST, LANES = 300, 20_000
_NAMED = {x: k for k, v in LABELS.items() for x in (k, *v.split())}
_MARKUP = re.compile(r"<[^<>]{1,200}>|&[a-z]{2,8};")
_ENDS = ".!?。！？।؟\n"

#: Scripts, and the language that a script alone speaks for where no labelled text is written in it.
SCRIPTS = ("latin", "cyrillic", "arabic", "bengali", "cjk")
PRIOR = {"cyrillic": "ru", "arabic": "ar", "bengali": "bn", "cjk": "ja"}
#: Symbols: 0 for all that is no letter, then each script's letters without case, accents and vowel marks. Kana
#: are one alphabet, an ideograph is three digits, so the tables stay narrow. _DROP leaves nothing.
_CYRILLIC, _ARABIC, _BENGALI, _KANA, _DIGIT, _BASE, _DROP = 27, 60, 103, 180, 226, 28, 255


def _symbol(n: int) -> int:
    c = chr(n)
    kind = unicodedata.category(c)
    if 0x981 <= n <= 0x9CD and kind[0] in "LM":
        return _BENGALI + n - 0x981
    if kind[0] == "M" and kind != "Me":
        return _DROP
    base = unicodedata.normalize("NFKD", c.casefold())[:1] if kind[0] == "L" or 0x24B6 <= n <= 0x24E9 else ""
    if not base:
        return 0
    b = ord(base)
    if "a" <= base <= "z":
        return b - 96
    if 0x400 <= b <= 0x52F:
        return _CYRILLIC + (b - 0x430 if 0x430 <= b <= 0x44F else 32)
    if 0x600 <= b <= 0x77F:
        return _ARABIC + (b - 0x621 if 0x621 <= b <= 0x64A else 42)
    if 0x3041 <= b <= 0x3096 or 0x30A1 <= b <= 0x30F6:
        return _KANA + _KANA_AT.get(unicodedata.normalize("NFKD", chr(b - 0x60 if b >= 0x30A1 else b))[0], 0)
    return _DIGIT if 0x3400 <= b <= 0x9FFF else 0


_KANA_AT = {c: i for i, c in enumerate("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん")}
_KANA_AT |= dict(zip("ぁぃぅぇぉっゃゅょゎ", (_KANA_AT[c] for c in "あいうえおつやゆよわ")))
_OF = np.array([_symbol(i) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], dtype=np.uint8)
_IS_END = np.zeros(0x10000, dtype=bool)
_IS_END[[ord(c) for c in _ENDS]] = True
#: Class of a symbol: the index of its script, with kana 4 and ideographs 5 apart, 6 for none.
_CLASS = np.full(256, 6, dtype=np.uint8)
for _i, (_a, _b) in enumerate(((1, _CYRILLIC), (_CYRILLIC, _ARABIC), (_ARABIC, _BENGALI), (_BENGALI, _KANA), (_KANA, _DIGIT), (_DIGIT, _DIGIT + _BASE))):
    _CLASS[_a:_b] = _i


def labelled_as(label: str | None) -> str | None:
    """The language that a label names, however spelled; None where it names none of LANGUAGES."""
    return _NAMED.get(re.split(r"[-_ ]", (label or "").strip().casefold())[0])


class Automaton:
    """Suffix automaton of a sequence of symbols, as the ways on from each state."""

    def __init__(self, symbols: np.ndarray):
        ways: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols.tolist():
            cur = len(ways)
            ways.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in ways[p]:
                ways[p][c] = cur
                p = link[p]
            if p >= 0:
                q = ways[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(ways)
                    ways.append(dict(ways[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and ways[p].get(c) == q:
                        ways[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.ways = ways


class Symbols:
    """The symbols of many texts in one array, and where each of their segments lies in it."""

    def __init__(self, texts: list[str]):
        texts = [_MARKUP.sub(lambda m: " " * len(m.group()), t) if "<" in t or "&" in t else t for t in texts]
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        low = np.minimum(code, 0xFFFF)
        end = _IS_END[low] & (code < 0x10000)
        last = end.copy()
        last[:-1] &= ~end[1:]
        stop = np.nonzero(last)[0] + 1
        start = np.concatenate([[0], stop[:-1]])
        long = np.nonzero(stop - start > LONGEST)[0]
        if len(long):
            cuts = [c for i in long for c in _cuts(joined, int(start[i]), int(stop[i]))]
            start = np.sort(np.concatenate([start, cuts])).astype(np.int64)
            stop = np.concatenate([start[1:], [len(code)]])
        self.text = np.searchsorted(begins, start, "right") - 1
        self.a = start - begins[self.text]
        self.b = np.minimum(stop, begins[self.text + 1] - 1) - begins[self.text]

        sym = np.where(code < 0x10000, _OF[low], np.where((code >= 0x20000) & (code < 0x40000), _DIGIT, 0)).astype(np.uint8)
        kind = _CLASS[sym]
        n = np.stack([np.add.reduceat(kind == i, start, dtype=np.int32) for i in range(6)])
        cjk = n[4] + n[5]
        counts = np.stack([np.where(cjk < 4, n[0], (n[0] * 0.4).astype(np.int32)), n[1], n[2], n[3], cjk])
        self.script = np.argmax(counts, axis=0)
        self.letters = counts[self.script, np.arange(len(start))]
        self.kana = n[4] / np.maximum(cjk, 1)

        keep = sym != _DROP
        blank = (sym == 0) & keep
        before = np.zeros(len(sym), dtype=bool)
        before[1:] = blank[:-1]
        keep &= ~(blank & before)
        han = keep & (kind == 5)
        width = keep.astype(np.int64) + 2 * han
        at = np.concatenate([[0], np.cumsum(width)])
        self.flat = np.repeat(sym, width)
        p, v = at[:-1][han], (code[han] % (_BASE**3)).astype(np.int64)
        for i, d in enumerate((v // _BASE**2, v // _BASE % _BASE, v % _BASE)):
            self.flat[p + i] = _DIGIT + d
        self.start, self.length = at[start], at[stop] - at[start]


def _cuts(text: str, a: int, b: int) -> Iterator[int]:
    """Where a long segment is cut: at the last space that fits, or else at the limit."""
    while b - a > LONGEST:
        cut = text.rfind(" ", a + 1, a + LONGEST)
        a = cut if cut > a else a + LONGEST
        yield a


_MISS = 1 << 30


class Tables:
    """The automata of the languages of one script, as one table that all segments are parsed by side by side.

    An entry is the state to go to; where a language has no way on, the phrase ends (bit _MISS) and the
    next one begins with the same symbol.
    """

    def __init__(self, texts: dict[str, np.ndarray]):
        self.languages = list(texts)
        kind = [np.bincount(_CLASS[x], minlength=7) for x in texts.values()]
        self.no_kana = np.array([3 * n[4] < KANA_TEXT * (3 * n[4] + n[5]) for n in kind])
        used = np.unique(np.concatenate(list(texts.values())))
        self.column = np.zeros(256, dtype=np.int32)  # column 0: symbols that no text has
        self.column[used] = np.arange(1, len(used) + 1)
        width, parts, self.roots, base = len(used) + 1, [], [], 0
        for x in texts.values():
            ways = Automaton(self.column[x]).ways
            first = np.full(width, base, dtype=np.int32)
            for c, to in ways[0].items():
                first[c] = base + to * width
            part = np.tile(first | _MISS, (len(ways), 1))
            rows = np.repeat(np.arange(len(ways)), [len(w) for w in ways])
            part[rows, np.fromiter((c for w in ways for c in w), np.int32, len(rows))] = base + width * np.fromiter((to for w in ways for to in w.values()), np.int32, len(rows))
            self.roots.append(base)
            base += part.size
            parts.append(part.ravel())
        self.roots = np.array(self.roots, dtype=np.int32)
        self.table = np.concatenate(parts)

    def phrases(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(segments, languages): phrases a symbol, each phrase the longest match from where the last ended."""
        n, k = len(start), len(self.languages)
        order = np.argsort(-length, kind="stable")
        begin, ordered = start[order], np.sort(length)
        active = n - np.searchsorted(ordered, np.arange(ordered[-1] if n else 0), "right")
        column = self.column[flat]
        state = np.repeat(self.roots[None, :], n, axis=0)
        count = np.zeros((n, k), dtype=np.int32)
        for t, m in enumerate(active):
            to = self.table[state[:m] + column[begin[:m] + t][:, None]]
            count[:m] += to >> 30
            state[:m] = to & (_MISS - 1)
        out = np.empty((n, k))
        out[order] = (count + 1) / np.maximum(length[order], 1)[:, None]
        return out


class Parser:
    """One table for each script: the languages whose labelled text is mostly written in it.

    A language that has none of a segment's letters needs a phrase for each of them, so only the languages
    of the segment's script are parsed; that bound is what a lone language of a script is held against.
    """

    def __init__(self, texts: dict[str, str]):
        by: dict[int, dict[str, np.ndarray]] = {}
        for language in LANGUAGES:
            s = Symbols([texts.get(language) or ""])
            letters = np.bincount(s.script, weights=s.letters, minlength=len(SCRIPTS))
            if letters.any():
                by.setdefault(int(np.argmax(letters)), {})[language] = s.flat[:SAMPLE_CHARS]
        self.tables = {k: Tables(v) for k, v in by.items()}


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    """Built once in a worker, however many tasks it runs."""
    return Parser(dict(texts))


def detect(parser: Parser, texts: list[str], less: float = LESS) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text its segments: (start, end, language, confidence, letters).

    Segments are sentences and lines; longer ones are cut at spaces. A segment's script is that of most of
    its letters (names of another script don't count for more than they are). Its language needs the
    fewest phrases; among the languages of a script, the text's main one, which its segments' phrases vote
    for in proportion to their letters, keeps a segment unless another does with `less` of its phrases. The
    confidence is 1 less the ratio to the next language's phrases; a language that shares its script with no
    other is held against one that needs a phrase for each symbol.
    """
    if not texts:
        return []
    s = Symbols(texts)
    found: list[list] = [[] for _ in texts]
    language, confidence = np.full(len(s.text), "", dtype=object), np.zeros(len(s.text))
    for script, name in enumerate(SCRIPTS):
        at = np.nonzero((s.script == script) & (s.letters > 0))[0]
        if not len(at):
            continue
        if script not in parser.tables:
            language[at] = PRIOR.get(name, "")  # no labelled text: nothing to parse by
            continue
        t = parser.tables[script]
        phrases = np.concatenate([t.phrases(s.flat, s.start[at[i : i + LANES]], s.length[at[i : i + LANES]]) for i in range(0, len(at), LANES)])
        if name == "cjk":
            phrases[(s.kana[at] >= KANA)[:, None] & t.no_kana[None, :]] = 1.0
        own = np.unique(s.text[at], return_inverse=True)[1]
        total = np.stack([np.bincount(own, weights=phrases[:, j] * s.letters[at]) for j in range(len(t.languages))], axis=1)
        rows, main, best = np.arange(len(at)), np.argmin(total, axis=1)[own], np.argmin(phrases, axis=1)
        best = np.where(phrases[rows, best] > less * phrases[rows, main], main, best)
        chosen = phrases[rows, best]
        others = phrases.copy()
        others[rows, best] = np.inf
        language[at] = np.array(t.languages, dtype=object)[best]
        confidence[at] = np.clip(1 - chosen / np.minimum(others.min(axis=1), 1.0 if len(t.languages) == 1 else np.inf), 0, 1)
    for n, a, b, x, c, letters in zip(s.text.tolist(), s.a.tolist(), s.b.tolist(), language, confidence.tolist(), s.letters.tolist()):
        if x:
            found[n].append((a, b, x, c, letters))
    return found


def languages_of(found: list[tuple[int, int, str, float, int]]) -> tuple[str | None, list[str]]:
    """The main language by letters, and the languages of which there is a full sentence."""
    letters: dict[str, int] = {}
    full = set()
    for _, _, lang, _, n in found:
        weight = 3 if lang in ("ja", "zh") else 1
        letters[lang] = letters.get(lang, 0) + n * weight
        if n >= (FULL_CJK if lang in ("ja", "zh") else FULL):
            full.add(lang)
    return (max(letters, key=lambda x: (letters[x], x)) if letters else None), sorted(full)


def labelled_text(documents: DataFrame, items: DataFrame) -> tuple[tuple[str, str], ...]:
    """Labelled text per language, at most SAMPLE_CHARS symbols each are used, for the automata.

    The passages of at most SAMPLE_ITEMS items a language, whose label is right, come first. To them are
    added sentences of at most SAMPLE_DOCS documents labelled with the language, chosen by a hash of their id;
    labels are wrong at times, so only documents are taken whose main language by a parser of the passages
    is the label, without sentences that are clearly (CLEAR) of another. This sample only fits the model;
    every document is then parsed whole. The labels are counted in a scan of `lang` alone, which tells
    what share of the documents of each label a single further scan must pick.
    """
    known: dict[str, list[str]] = {}
    wide = Window.partitionBy("lang").orderBy(F.xxhash64("item_id"), "item_id")
    for lang, text in items.where(F.col("lang").isin(*LANGUAGES)).select("lang", F.concat_ws(" ", "passage", "question").alias("t"), F.row_number().over(wide).alias("r")).where(F.col("r") <= SAMPLE_ITEMS).orderBy("r").select("lang", "t").collect():
        known.setdefault(lang, []).append(text)
    passages = {k: " ".join(v)[: SAMPLE_CHARS // 3] for k, v in known.items()}
    labelled = documents.where(F.col("lang").isin(*LANGUAGES))
    share = {r["lang"]: min(1.0, 4 * SAMPLE_DOCS / r["count"]) for r in labelled.groupBy("lang").count().collect()}  # twelve rows
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = labelled.where(F.lit(False) if not share else F.coalesce(*[F.when(F.col("lang") == k, draw < v) for k, v in sorted(share.items())]))
    picked = picked.where(F.col("text").isNotNull() & (F.length("text") >= 60)).select("doc_id", "lang", F.substring("text", 1, SAMPLE_START).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = picked.withColumn("r", rank).where(F.col("r") <= SAMPLE_DOCS).orderBy("r", "lang").select("lang", "t").collect()
    more: dict[str, list[str]] = {}
    for (lang, text), found in zip(sample, detect(Parser(passages), [r[1] for r in sample], CLEAR)):
        if languages_of(found)[0] == lang:
            more.setdefault(lang, []).extend(text[a:b].strip() for a, b, x, _, _ in found if x == lang)
    more = _own_wordings(more)
    return tuple((k, (passages.get(k, "") + " " + " ".join(more.get(k, [])))[:SAMPLE_CHARS]) for k in LANGUAGES if k in passages or k in more)


def _own_wordings(sentences: dict[str, list[str]]) -> dict[str, list[str]]:
    """Per language its distinct sentences, one for each wording first, then a second for each, and so on.

    A wording is a sentence's first lower-case words, so it has no names. It stays with the language in
    whose sample it is most frequent; what mixed documents bring along from elsewhere is rare here. A sentence of
    a script without case is a wording of its own.
    """
    def wording(x: str) -> str:
        return " ".join([w for w in x.split() if w.islower()][:3]) if x.lower() != x.upper() else x

    count = {k: Counter(map(wording, v)) for k, v in sentences.items()}
    own = {}
    for k, v in sentences.items():
        rounds: Counter = Counter()
        ranked = []
        for x in dict.fromkeys(v):
            w = wording(x)
            if w and all(count[k][w] > c[w] for other, c in count.items() if other != k):
                rounds[w] += 1
                ranked.append((rounds[w], x))
        own[k] = [x for _, x in sorted(ranked, key=lambda r: r[0])]
    return own


def document_languages(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, label, main, full, parts): the languages of every document.

    label: what `lang` names among the twelve, else null. main: the language of most letters, null for
    texts without words (null, empty, numbers only). full: languages of at least a full sentence.
    parts: (start, end, lang, confidence) of each sentence. Documents are parsed where they are read.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(labelled_text(documents, items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(shared.value)
        for b in batches:
            found = detect(parser, [t or "" for t in b["text"]])
            told = [languages_of(f) for f in found]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "label": [labelled_as(x) for x in b["lang"]], "main": [m for m, _ in told], "full": [f for _, f in told],
                "parts": [[{"start": a, "end": e, "lang": x, "confidence": round(c, 4)} for a, e, x, c, _ in f] for f in found],
            })

    return documents.select("doc_id", "lang", "text").mapInPandas(run, "doc_id bigint, label string, main string, full array<string>, parts array<struct<start:int,end:int,lang:string,confidence:double>>")


def p8_found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of documents that are mixed or whose label isn't their main language."""
    d = document_languages(documents, items).where("main is not null and (label is null or label <> main or size(full) > 1)")
    return d.select("doc_id", F.explode(F.when(F.size("full") > 0, F.col("full")).otherwise(F.array("main"))).alias("lang"))


def p8_labels(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the main language of each document with words, its parts' mean confidence."""
    d = document_languages(documents, items).where("main is not null")
    own = F.filter("parts", lambda p: p["lang"] == F.col("main"))
    mean = F.aggregate(own, F.lit(0.0), lambda a, p: a + p["confidence"]) / F.size(own)
    return d.select("doc_id", F.col("main").alias("lang"), F.round(mean, 4).alias("confidence"))


def p8_segments(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, start, end, lang, confidence): each sentence of documents of several languages."""
    d = document_languages(documents, items).where("size(full) > 1")
    return d.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.start", "p.end", "p.lang", "p.confidence")
