"""Problem 7: documents that hold sentences of evaluation passages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.skeleton import borders, skeleton

#: Characters of a block.
BLOCK = 4
#: Items searched for in one pass over the documents; more items take more passes.
ITEMS = 50_000
#: Characters searched at a time, and per lane, in a task.
SLICE, LANE = 2_000_000, 1024
#: Halves of fewer letters would stand almost everywhere: such a sentence is cut in the middle of its
#: letters, and its forms with a word dropped or doubled are patterns of their own.
HALF = 4
#: A dropped word is a slip in sentences of so many words; in shorter ones too little of it is left.
DROPS = 4
#: A run of more letters than any word has is text written without spaces, where words have no borders.
GLUED = 40
#: Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof st sr sra dra jr no nr vol fig pp ca vs al etc bzw hr fr ul г им".split())
_END = re.compile(r"(?<=[.!?])\s+|(?<=[。।！？؟])\s*|\n+")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff]")


class Sentence(NamedTuple):
    item: int
    text: str
    words: tuple[tuple[int, int], ...]  # spans in text


def _goes_on(piece: str) -> bool:
    """Whether the full stop at the end of a piece belongs to an abbreviation or an initial."""
    words = piece.split()
    if not piece.endswith(".") or not words:
        return False
    last = words[-1].strip(".([\"'«“„")
    return (len(last) == 1 and last.isupper()) or last.casefold() in ABBREVIATIONS


def sentences(passage: str) -> list[str]:
    """The sentences of a passage. One or two words on their own (a heading, an abbreviation) go with what
    follows them, or with what stands before them at the end; unspaced scripts have no such fragments."""
    found: list[str] = []
    held = ""
    for piece in _END.split(passage or ""):
        if not piece.strip():
            continue
        held = f"{held} {piece}" if held else piece
        if not _goes_on(held) and (len(held.split()) > 2 or _UNSPACED.search(held)):
            found.append(held)
            held = ""
    if held:
        found[-1:] = [f"{found[-1]} {held}" if found else held]
    return found


def _sentence(item: int, raw: str) -> Sentence:
    """CJK text has no words: there every run of up to four characters (of a quarter of a short sentence)
    is one that can slip."""
    words, text = [], ""
    for w in raw.split():
        s = skeleton(w)
        if s:
            words.append((len(text), len(text) + len(s)))
            text += s
    if 2 * len(_UNSPACED.findall(text)) > len(text):
        words = [(i, i + n) for n in range(1, min(4, max(1, len(text) // 4)) + 1) for i in range(len(text) - n + 1)]
    return Sentence(item, text, tuple(words))


def _one_letter(s: str, t: str) -> bool:
    """t is s but for one letter dropped, added or changed, or two swapped; digits never slip so."""
    if s == t or abs(len(s) - len(t)) > 1:
        return s == t
    a = next((i for i, (x, y) in enumerate(zip(s, t)) if x != y), min(len(s), len(t)))
    if len(s) == len(t):
        swap = s[a + 2 :] == t[a + 2 :] and s[a : a + 2] == t[a : a + 2][::-1]
        return not (s[a] + t[a]).isdecimal() and not s[a].isdecimal() and not t[a].isdecimal() and (s[a + 1 :] == t[a + 1 :] or swap)
    more, less = (s, t) if len(s) > len(t) else (t, s)
    return more[a + 1 :] == less[a:] and not more[a].isdecimal()


def other_forms(s: Sentence) -> Iterator[str]:
    """The sentence with one word dropped or doubled."""
    for a, b in s.words:
        if len(s.words) >= DROPS:
            yield s.text[:a] + s.text[b:]
        if len(s.words) > 1:
            yield s.text[:b] + s.text[a:]


def stands(s: Sentence, text: str, start: int | None, end: int | None) -> Iterator[tuple[int, int]]:
    """Spans in which the sentence stands in text from `start`, or up to `end`, with at most one slipped word."""

    def span(n: int) -> tuple[int, int]:
        return (start, start + n) if start is not None else (end - n, end)

    def there(variant: str) -> bool:
        return text.startswith(variant, start) if start is not None else text.endswith(variant, 0, end)

    n = len(s.text)
    if there(s.text):
        yield span(n)
    for d in (-1, 0, 1) if len(s.words) > 1 else ():
        near = text[start : start + n + d] if start is not None else text[max(0, end - n - d) : end]
        if len(near) == n + d and near != s.text and _one_letter(s.text, near):
            yield span(n + d)
    for variant in other_forms(s):
        if there(variant):
            yield span(len(variant))


class Borders:
    """Where words begin and end in the skeletons of texts, told only for texts in which something was found."""

    def __init__(self, raw: list[str], begins: np.ndarray):
        self.raw, self.begins, self.known = raw, begins, {}

    def whole(self, n: int, text: str, a: int, b: int) -> bool:
        """Whether no word of text n reaches over the ends of [a, b); unspaced scripts and glued text have no words."""
        if n not in self.known:
            at = borders(self.raw[n])
            self.known[n] = None if at is None else [x + int(self.begins[n]) for x in at]
        at = self.known[n]
        if at is None:
            return True
        for p in (a, b):
            i = bisect_left(at, p)
            if i < len(at) and at[i] == p or _UNSPACED.search(text[max(0, p - 1) : p + 1]):
                continue
            if 0 < i < len(at) and at[i] - at[i - 1] <= GLUED:
                return False
        return True


class WuManber:
    """Multi-pattern search: a shift table over blocks, buckets of patterns by their suffix block.

    Every pattern counts with its first m characters, m the shortest pattern's length. At a position the
    block that ends there says how far no pattern can end; where it says 0, the bucket of the block and
    a hash of the whole window select patterns, and comparison with the text confirms each.
    Texts are searched in lanes, all lanes one jump at a time, so each jump is a vector operation.
    """

    def __init__(self, patterns: list[str]):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(BLOCK, self.m)
        blocks = len(patterns) * (self.m - self.block + 1)
        self.bits = min(24, max(12, (16 * blocks).bit_length()))  # of the table's index; a few blocks in a hundred share an entry
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, dtype=np.int32)
        head = np.array([np.frombuffer(p[: self.m].encode("utf-32-le"), dtype=np.uint32) for p in patterns])
        for j in range(self.m - self.block + 1):
            np.minimum.at(self.shift, self._hash([head[:, j + i] for i in range(self.block)]), self.m - self.block - j)
        window = self._window(head.T)
        self.order = np.argsort(window, kind="stable")
        self.window = window[self.order]

    def _hash(self, columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint32)
        for c in columns:
            h = h * np.uint32(0x9E3779B1) + c
        return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - self.bits)

    @staticmethod
    def _window(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            h = h * np.uint64(0x9E3779B97F4A7C15) + c
        return h

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(position, number of the pattern) of every occurrence."""
        if len(text) < self.m:
            return
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        starts = np.arange(0, len(text) - self.m + 1, LANE)
        at, stop = starts, np.minimum(starts + LANE, len(text) - self.m + 1)  # starts of windows
        hits = []
        while len(at):
            last = at + (self.m - self.block)
            jump = self.shift[self._hash([chars[last + i] for i in range(self.block)])]
            hits.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at = np.sort(np.concatenate(hits))
        if not len(at):
            return
        w = self._window([chars[at + i] for i in range(self.m)])
        lo, hi = np.searchsorted(self.window, w, "left"), np.searchsorted(self.window, w, "right")
        for k in np.nonzero(hi > lo)[0]:
            p = int(at[k])
            for x in self.order[lo[k] : hi[k]]:
                if text.startswith(self.patterns[x], p):
                    yield p, int(x)


class Searcher:
    """Sentences cut in two at a word: one slipped word leaves a half whole, whose find is then verified.

    Patterns are searched for in groups of like length, as the shortest of a group decides how far a
    search can jump. Every find must be of whole words.
    """

    def __init__(self, items: list[tuple[int, str]]):
        parts: dict[str, list[tuple[Sentence, bool | None]]] = {}  # True: its head, False: its tail, None: all of it
        for s in {_sentence(i, x) for i, p in items for x in sentences(p)}:
            n = len(s.text)
            if n < 2 or len(s.words) < 2:
                parts.setdefault(s.text, []).append((s, True))
                continue
            cut = min((a for a, _ in s.words), key=lambda a: abs(a - n / 2))
            if min(cut, n - cut) < HALF:
                cut = n // 2
                for variant in other_forms(s):
                    parts.setdefault(variant, []).append((s, None))
            parts.setdefault(s.text[:cut], []).append((s, True))
            parts.setdefault(s.text[cut:], []).append((s, False))
        parts.pop("", None)
        groups: dict[int, list[str]] = {}
        for x in parts:
            groups.setdefault(min(len(x), 31).bit_length(), []).append(x)
        self.parts = parts
        self.groups = [WuManber(x) for _, x in sorted(groups.items())]

    def items(self, keys: list, raw: list[str]) -> Iterator[tuple]:
        """(key, item) of the texts; their skeletons are joined by a character that no skeleton has."""
        texts = [skeleton(t) for t in raw]
        joined = "\x00".join(texts)
        ends = np.cumsum([len(t) + 1 for t in texts])
        border = Borders(raw, ends - [len(t) + 1 for t in texts]) if texts else None
        seen = set()
        for group in self.groups:
            for p, x in group.find(joined):
                n = int(np.searchsorted(ends, p, "right"))
                pattern = group.patterns[x]
                for s, is_head in self.parts[pattern]:
                    if (n, s.item) in seen:
                        continue
                    q = p + len(pattern)
                    spans = [(p, q)] if is_head is None else stands(s, joined, p if is_head else None, None if is_head else q)
                    if any(border.whole(n, joined, a, b) for a, b in spans):
                        seen.add((n, s.item))
                        yield keys[n], s.item


@lru_cache(maxsize=2)
def _searcher(items: tuple[tuple[int, str], ...]) -> Searcher:
    """Built once in a worker, however many tasks it runs."""
    return Searcher(list(items))


def leaked_items(documents: DataFrame, items: DataFrame, per_pass: int = ITEMS) -> DataFrame:
    """(doc_id, item_id): documents that hold a complete sentence of an item's passage.

    A sentence may differ in one word that is dropped (in sentences of at least DROPS words), doubled or off
    by one letter, and in whatever the skeleton leaves out; a word put in another's place is no slip. It
    must stand there in whole words; an abbreviation, a heading or a sentence of one or two words is no
    sentence of its own. Items with a null or empty passage have no sentences, documents with a null or
    empty text hold none; a repeated document or item is found as often as it stands there with its own
    id. Documents stay where they are read: no shuffle; the items, at most `per_pass` in a pass, go to
    all tasks.
    """
    spark = documents.sparkSession
    items = items.select("item_id", "passage").where("item_id is not null and passage is not null")
    passes = max(1, -(-items.count() // per_pass))
    found = None
    for n in range(passes):
        block = tuple((r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).collect())
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            s = _searcher(shared.value)
            for b in batches:
                keys, texts, size, rows = [], [], 0, []
                for k, t in zip(b["doc_id"], b["text"]):
                    if t:
                        keys.append(k)
                        texts.append(t)
                        size += len(t)
                    if size > SLICE:
                        rows += s.items(keys, texts)
                        keys, texts, size = [], [], 0
                rows += s.items(keys, texts)
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        here = documents.select("doc_id", "text").where("text is not null").mapInPandas(search, "doc_id bigint, item_id bigint")
        found = here if found is None else found.union(here)
    return found


def p7_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(benchmark_name, item_id, n_docs): how many documents hold each leaked item."""
    n = leaked_items(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return n.join(items.select("item_id", "benchmark_name"), "item_id").select("benchmark_name", "item_id", "n_docs")
