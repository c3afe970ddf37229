"""Quality rules, line first: lines that fail a rule go, then documents that lost too much of their text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, islice
from operator import eq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .frames import for_long_texts, free_name, ship, small_batches

ship(__name__)

#: Characters between words; nothing else separates them.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A line with one of these is boilerplate if it is short.
BOILERPLATE = re.compile(
    r"all rights reserved|cookie|privacy policy|terms of (?:use|service)|click here|sign (?:in|up)|log ?in\b|subscribe|"
    r"enable javascript|lorem ipsum|powered by|back to top|read more|share (?:this|on)|follow us",
    re.IGNORECASE,
)
NAVIGATION = "|»›>•·"
CAPITALS = regex.compile(r"\p{Lu}{2,}")
ENDS = tuple('.!?…:;"”»)')


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the two document rules.

    A line fails if it is boilerplate (a known phrase and at most ``boilerplate_words`` words), navigation (at least
    ``navigation_marks`` separators for each word, or at most ``menu_words`` words without a closing mark), symbols
    (``symbols_per_word``), shouting (runs of capitals or of marks, more than ``shouted`` for each word, of five at least) or
    one word again and again (more than ``repeated`` of its words equal the word before, five at least).
    """

    boilerplate_words: int = 25
    navigation_marks: float = 0.3
    menu_words: int = 2
    symbols_per_word: float = 0.3
    shouted: float = 0.5
    repeated: float = 0.5
    least_kept: float = 0.7
    least_words: int = 20
    most_repeated_percent: int = 30


def line_fails(line: str, words: list[bytes], rules: Rules) -> bool:
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > rules.symbols_per_word * n:
        return True
    if n <= rules.menu_words and not line.rstrip(SPACES).endswith(ENDS):
        return True
    if sum(map(line.count, NAVIGATION)) > max(1, rules.navigation_marks * n):
        return True
    if n <= rules.boilerplate_words and BOILERPLATE.search(line):
        return True
    if n >= 5:
        if sum(map(eq, words, islice(words, 1, None))) > rules.repeated * n:
            return True
        if line.count("!!") + line.count("??") > rules.shouted * n or len(CAPITALS.findall(line)) > rules.shouted * n:
            return True
    return False


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` words (a power of two) that occur twice or more.

    Windows are told apart exactly: a window's number stands for its two halves, whose numbers stand for theirs.
    """
    n = len(words)
    if n <= size:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    span = 1
    while span < size:
        pairs = ids[:-span] * n + ids[span:]
        values, ids, times = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(values) == len(pairs):
            return 0
        span *= 2
    starts = np.flatnonzero(times[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + size] -= 1
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(text: str, rules: Rules) -> tuple:
    """Figures of one text, the base verdict, the final verdict and the cleaned text."""
    words: list[bytes] = []
    seen: set[str] = set()
    kept, duplicates, kept_words = [], 0, 0
    for line in text.split("\n"):
        parts = line.encode("utf-8", "surrogatepass").split()  # runs of characters other than the six of SPACES
        if not parts:
            kept.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        words += parts
        if not line_fails(line, parts, rules):
            kept.append(line)
            kept_words += len(parts)
    again = repeated_words(words)
    n = len(words)
    failed = n < rules.least_words or 100 * again > rules.most_repeated_percent * n
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    keep = not failed and kept_words >= rules.least_kept * n
    cleaned = text if kept_words == n else "\n".join(kept)
    return n, chars, symbols, duplicates, again, failed, keep, kept_words, cleaned


FIGURES = StructType(
    [
        *(StructField(n, LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        *(StructField(n, BooleanType()) for n in ("base_failed", "kept")),
        StructField("kept_words", LongType()),
        StructField("cleaned", StringType()),
    ]
)


def _judged(batches: Iterable[pa.RecordBatch], rules: Rules, kind: pa.StructType) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        rows = [judge(text.as_py() or "", rules) for text in batch.column("text")]
        columns = [pa.array(list(c), kind.field(i).type) for i, c in enumerate(zip(*rows))]
        figures = pa.StructArray.from_arrays(columns, fields=[kind.field(i) for i in range(kind.num_fields)])
        yield pa.record_batch([*batch.columns, figures], [*batch.schema.names, "figures"])


def with_quality(docs: DataFrame, column: str = "quality", rules: Rules = Rules()) -> DataFrame:
    """``docs`` (text and any other columns) with a struct ``column``: figures, verdicts and the cleaned text.

    ``column`` replaces one of that name. A missing or empty text has no words, so it fails. Repeated rows are judged
    alike and all stay; an empty table gives an empty one; other columns pass untouched. Memory: the texts of one Arrow
    batch, the figures of some hundred, the words of one and three integers for each of its words.
    """
    for_long_texts(docs.sparkSession)
    kind = to_arrow_type(FIGURES)
    given = docs.drop(column)
    # names in Python are unimportant and may clash there, so columns travel by place
    places = [f"c{i}" if c != "text" else c for i, c in enumerate(given.columns)]
    sent = given.toDF(*places)
    schema = StructType([*sent.schema.fields, StructField("figures", FIGURES)])
    return sent.mapInArrow(lambda batches: _judged(batches, rules, kind), schema).toDF(*given.columns, column)


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents kept, with failing lines removed and ``n_chars`` counted anew; same columns as ``docs``."""
    q = free_name(docs, "quality")
    kept = with_quality(docs, q, rules).where(F.col(f"{q}.kept"))
    changed = {"text": F.col(f"{q}.cleaned")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(F.col(f"{q}.cleaned")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(changed).select(*docs.columns)
