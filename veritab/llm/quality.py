"""Line-first cleaning: rules per line, then a document rule on what was lost."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import covered, full_windows, hash_words, sliced, split_words, sums, window_hashes

# Characters that may end a sentence or close one that has ended.
SENTENCE_ENDS = ".!?:;…。！？\"'”’»)]"
# Tokens that separate links in menus and trails.
SEPARATORS = frozenset(["|", "/", ">", "»", "›", "·", "•", "::", "-", "–", "—"])
# Phrases of notices that belong to the site and not to the text.
NOTICES = ("lorem ipsum", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript", "click here", "sign up for", "log in to")
SYMBOLS = "#*$%&|<>"

_NOTICE = re.compile("|".join(map(re.escape, NOTICES)), re.IGNORECASE)
_SYMBOL = re.compile("[#*$%&|<>]")
_SHOUT = re.compile(r"[!?]{2,}$")


@dataclass(frozen=True)
class LineRules:
    """Limits. Shares are of a line's words, but for ``max_lost``, of a document's word characters."""

    separator_share: float = 0.2
    symbol_share: float = 0.3
    shout_share: float = 0.3
    min_unended_words: int = 8
    max_lost: float = 0.5
    min_words: int = 20
    max_repeat_share: float = 0.3
    repeat_width: int = 8


def line_fault(line: str, words: list[bytes], rules: LineRules) -> str:
    """The first rule that a line breaks, or ``""``. Lines without words break none."""
    n = len(words)
    if not n:
        return ""
    if "|" in line or n > 2:
        split = sum(w.decode() in SEPARATORS for w in words if len(w) < 4)
        if split and split >= rules.separator_share * n:
            return "navigation"
    if len(_SYMBOL.findall(line)) > rules.symbol_share * n:
        return "symbols"
    if "!!" in line or "?!" in line or "??" in line:
        if sum(bool(_SHOUT.search(w.decode())) for w in words) > rules.shout_share * n:
            return "shouting"
    if _NOTICE.search(line) and n <= 40:
        return "boilerplate"
    if n >= rules.min_unended_words and words[-1].decode()[-1] not in SENTENCE_ENDS and not line.rstrip()[-1:] in SENTENCE_ENDS:
        return "punctuation"
    return ""


_OUT = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("n_lines_removed", pa.int64()), ("kept_chars", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string())]
)


def repeated_places(ids: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a window of ``k`` that is found twice or more in the same text. Equal hashes are confirmed word by word."""
    starts = full_windows(offsets, k)
    if not len(starts):
        return np.zeros(len(ids), bool)
    key = window_hashes(hashes, k)[starts]
    text = np.searchsorted(offsets, starts, "right")
    order = np.argsort(key ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    a, b = order[:-1], order[1:]
    same = np.flatnonzero((key[a] == key[b]) & (text[a] == text[b]))
    a, b = starts[a[same]], starts[b[same]]
    equal = np.ones(len(a), bool)
    for j in range(k):
        equal &= ids[a + j] == ids[b + j]
    hit = np.union1d(a[equal], b[equal])
    return covered(len(ids), hit, k)


def _measure(texts: pa.Array, rules: LineRules) -> pa.RecordBatch:
    texts = texts.cast(pa.string())
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy()
    hashes = hash_words(coded.dictionary)[ids] if len(ids) else np.zeros(0, np.uint64)
    n_words = np.diff(offsets)
    chars = sums(pc.utf8_length(words).to_numpy(), offsets)
    symbols = sum(pc.fill_null(pc.count_substring(texts, s), 0).to_numpy(zero_copy_only=False).astype(np.int64) for s in SYMBOLS)
    repeats = sums(repeated_places(ids, hashes, offsets, rules.repeat_width), offsets)
    failed = (n_words < rules.min_words) | (repeats * 100 > round(100 * rules.max_repeat_share) * n_words)
    dups, removed, kept_chars, clean = [], [], [], []
    for text in texts.to_pylist():
        seen: set[str] = set()
        keep, lost_lines, copies, left = [], 0, 0, 0
        for line in (text or "").split("\n"):
            own = line.encode().split()
            again = bool(own) and line in seen
            copies += again
            if own:
                seen.add(line)
            if own and (again or line_fault(line, own, rules)):
                lost_lines += 1
                continue
            keep.append(line)
            left += len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
        dups.append(copies)
        removed.append(lost_lines)
        kept_chars.append(left)
        clean.append(text if not lost_lines else "\n".join(keep))
    left = np.array(kept_chars, np.int64)
    kept = ~failed & ((chars - left) <= rules.max_lost * chars)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (n_words, chars, symbols, np.array(dups, np.int64), repeats, np.array(removed, np.int64), left, failed, kept)] + [pa.array(clean, pa.string())], schema=_OUT
    )


def clean_lines(df: DataFrame, id_col: str, text_col: str, rules: LineRules = LineRules()) -> DataFrame:
    """``id_col``, the counts, ``base_failed``, the verdict ``kept`` and ``clean_text``, for each row.

    A line is removed that repeats an earlier one of its document, or breaks a rule (`line_fault`): link separators, symbols, shouting, site notices, or a long
    line with no sentence end. A document is rejected if its base counts fail or if the removed lines held over ``max_lost`` of its word characters.

    Null and empty texts have no words, so they fail the base counts; ``clean_text`` of a null stays null. Repeated rows are judged alike. An empty table gives no
    rows. Other columns are ignored, whatever their names. One narrow pass without a shuffle; memory is bounded by a slice of a batch and the longest text.
    """
    rows = df.select(df[id_col].alias("__id"), df[text_col].alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            out = _measure(batch.column("__text"), rules)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *out.columns], names=["__id", *_OUT.names])

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines_removed long, kept_chars long"
    return rows.mapInArrow(run, f"__id {kind}, {counts}, base_failed boolean, kept boolean, clean_text string").withColumnRenamed("__id", id_col)
