"""A text reduced to what survives case, spacing, punctuation, markup and the written form of characters."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

#: Letters of other alphabets that look like a Latin letter in upper or lower case, folded.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "i", "κ": "k", "μ": "m", "ν": "n", "ο": "o", "ρ": "p", "τ": "t", "υ": "y", "χ": "x",
    "ی": "ي", "ک": "ك", "ہ": "ه", "ۀ": "ه", "ى": "ي", "ৰ": "র",
    "口": "ロ", "力": "カ", "夕": "タ", "卜": "ト", "二": "ニ", "工": "エ", "八": "ハ", "才": "オ", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ", "り": "リ", "ー": "一",
}
_FOLD = str.maketrans(LOOKALIKES | {"ı": "i", "ß": "ss"})
_TAG = re.compile(r"<[^<>]{1,200}>")
_MARKS = re.compile("[\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670ـ]+")
_DROP = regex.compile(r"[^\p{L}\p{M}\p{Nd}]+")
_DIGIT = regex.compile(r"[^\P{Nd}0-9]")


def _prepared(text: str) -> str:
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).casefold()


def _folded(letters: str) -> str:
    """Letters, marks and digits of prepared text without accents, each look-alike as one letter."""
    if letters.isascii():
        return letters
    letters = unicodedata.normalize("NFC", _MARKS.sub("", letters)).translate(_FOLD)
    return "".join(str(unicodedata.decimal(c)) if c > "\x7f" and c.isdecimal() else c for c in letters) if _DIGIT.search(letters) else letters


def skeleton(text: str) -> str:
    """Letters, marks and digits only: lower case, ASCII digits, no accents, look-alikes as one letter."""
    return _folded(_DROP.sub("", _prepared(text)))


def borders(text: str) -> list[int] | None:
    """The positions in skeleton(text) where words begin and end; None where the words can't be told."""
    at, whole = [0], []
    for word in _DROP.split(_prepared(text)):
        whole.append(_folded(word))
        at.append(at[-1] + len(whole[-1]))
    return at if "".join(whole) == skeleton(text) else None
