"""Words of a text, and tests on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col

# The classes of the Unicode rules for word boundaries (UAX 29), in the notation of Java patterns.
# Classes are tested from left to right; scripts are slow to look up, so frequent letters come before them and ASCII never meets them.
_LETTER = (
    r"[a-zA-ZÀ-ÖØ-öø-ˁЀ-ҁ"
    r"[\p{IsAlphabetic}&&[^\p{IsIdeographic}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{Nd}]]]"
)
_NUMBER = r"[0-9\p{Nd}٫]"
_KATAKANA = r"[[^\x00-\x7F]&&[\p{IsKatakana}〱-〵ーｰ]]"
_CONNECTOR = r"[_‿⁀⁔︳︴﹍-﹏＿]"
_IN_WORDS = r"[:.'··՟״‘’․‧︓﹒﹕＇．：]"
_IN_NUMBERS = r"[,;.';։،؍٬߸‘’․⁄︐︔﹐﹒﹔＇，．；]"
_MARK = r"[\p{M}\p{Cf}&&[^\u200B]]"
_ATTACHED = f"{_MARK}*"
_ALONE = r"[[^\x00-\x7F]&&[\p{IsIdeographic}\p{IsHiragana}]]"
_UNSPACED = r"[[^\x00-\x7F]&&[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
#: Longer words are cut into parts of this many characters.
LONGEST = 255


def _chain(one: str, between: str) -> str:
    """Characters of one class; one mark may stand between two of them. Without such marks they are read in one go."""
    rest = f"{one}[{one}{_MARK}]*+"
    return f"{rest}(?:{between}{_ATTACHED}{rest})*"


_RUN = f"(?:(?:{_chain(_LETTER, _IN_WORDS)}|{_chain(_NUMBER, _IN_NUMBERS)})+|(?:{_KATAKANA}{_ATTACHED})+)"
_LINK = f"(?:{_CONNECTOR}{_ATTACHED})"
#: ASCII letters and digits before something that surely ends a word; most words need no more tests.
_PLAIN = r"[a-zA-Z0-9]++(?=[\x00-\x26\x28-\x2B\x2D\x2F\x3C-\x40\x5B-\x5E\x60\x7B-\x7F]|[.:',;]?(?:[\x00-\x20]|\z))"
#: What a word can start with, as far as ASCII goes.
_START = r"(?=[a-zA-Z0-9_[^\x00-\x7F]])"
_ANY = f"{_LINK}*{_RUN}(?:{_LINK}+{_RUN})*{_LINK}*|{_UNSPACED}{_ATTACHED}(?:{_UNSPACED}{_ATTACHED})*|{_ALONE}{_ATTACHED}"
WORD = f"{_PLAIN}|{_START}(?:{_ANY})"


def tokens(text: Column | str) -> Column:
    """Lower-case words of a text, by the Unicode rules for word boundaries.

    ``192.168.7.9``, ``access_log``, ``can't`` and ``1,204`` are one word each; a hyphen, a slash or a comma after a letter
    ends a word; ideographs are words by themselves, scripts without spaces one word a run.
    """
    words = F.regexp_extract_all(F.lower(as_col(text)), F.lit(f"({WORD})"), 1)

    def parts(word: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(word) - 1) / LONGEST).cast("int"))
        return F.transform(starts, lambda i: F.substring(word, i * LONGEST + 1, LONGEST))

    def cut(found: Column) -> Column:
        return F.when(F.exists(found, lambda w: F.length(w) > LONGEST), F.flatten(F.transform(found, parts))).otherwise(found)

    return F.get(F.transform(F.array(words), cut), F.lit(0))  # named by a list of one, the words are found once


def has_any_word(text: Column | str, query: str) -> Column:
    """True if the text holds at least one word of the query, which is cut into words the same way.

    An empty query matches everything, a query of punctuation only matches nothing. A plain search for the words comes
    first, so most texts are never cut into words.
    """
    if not query:
        return F.lit(True)
    wanted, lower = tokens(F.lit(query)), F.lower(as_col(text))
    somewhere = F.exists(wanted, lambda w: F.contains(lower, w))
    return F.coalesce(somewhere & F.arrays_overlap(tokens(text), wanted), F.lit(False))


def has_word_prefix(text: Column | str, prefix: str) -> Column:
    """True if a word of the text starts with ``prefix``."""
    start = F.lit(prefix.lower())
    found = F.contains(F.lower(as_col(text)), start) & F.exists(tokens(text), lambda w: F.startswith(w, start))
    return F.coalesce(found, F.lit(False))


def is_finite(value: Column | str) -> Column:
    v = as_col(value)
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
