"""Counts over whole texts, for the quality operators.

One pass, on Arrow batches and without a Python object per word. Null and empty
texts have zero everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.word_arrays import Group, groups, mix, random_numbers

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bars", "n_bangs", "n_upper",
    "n_letters", "n_digits", "n_beyond_ascii", "n_lines", "n_same_as_last", "n_distinct_words",
)
_U = np.uint64
_PLACES = random_numbers(WINDOW, 307)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the flags are set between each two bounds."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(owners: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    keys = mix(hashes + owners.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    return np.bincount(owners[first], minlength=texts)


def repeated_words(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Flags the words in windows that their text holds twice or more."""
    covered = np.zeros(len(hashes), bool)
    if len(hashes) < WINDOW:
        return covered
    n = len(hashes) - WINDOW + 1
    whole = np.flatnonzero(owners[:n] == owners[WINDOW - 1 :])
    keys = sum(hashes[j : n + j] * _PLACES[j] for j in range(WINDOW))
    keys = mix(keys + mix(owners[:n].astype(np.uint64)))[whole]
    _, at, uses = np.unique(keys, return_inverse=True, return_counts=True)
    step = np.zeros(len(hashes) + 1, np.int64)
    begins = whole[uses[at] > 1]
    step[begins] += 1
    step[begins + WINDOW] -= 1
    return np.cumsum(step[:-1]) > 0


def _lines(group: Group) -> Group:
    """The group with lines that hold a word in place of words."""
    breaks = np.flatnonzero(group.data == 10)
    starts = np.union1d(group.bounds[:-1], breaks + 1)
    starts = starts[starts < len(group.data)]
    ends = np.append(starts[1:], len(group.data))
    closed = np.isin(ends - 1, breaks) & (ends > starts)
    ends = ends - closed
    words_before = np.searchsorted(group.starts, np.stack((starts, ends)))
    held = words_before[1] > words_before[0]
    starts, ends = starts[held], ends[held]
    return Group(group.first, group.data, group.bounds, starts, ends, np.searchsorted(starts, group.bounds))


def counts_of(group: Group) -> np.ndarray:
    """One row per text of the group, one column per name in COUNTS."""
    data, bounds, texts = group.data, group.bounds, len(group.bounds) - 1
    hashes, owners = group.hashes(lower=False), group.text_of_word()
    lines = _lines(group)
    line_owners = lines.text_of_word()
    n_lines = np.diff(lines.word_bounds)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    upper = (data >= 65) & (data <= 90)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])))[: len(hashes)]
    columns = [
        np.diff(group.word_bounds),
        _sums(~space & ((data & 0xC0) != 0x80), bounds),
        _sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), bounds),
        n_lines - _distinct(line_owners, lines.hashes(lower=False), texts),
        _sums(repeated_words(hashes, owners), group.word_bounds),
        _sums(data == ord("|"), bounds),
        _sums(data == ord("!"), bounds),
        _sums(upper, bounds),
        _sums(upper | ((data >= 97) & (data <= 122)), bounds),
        _sums((data >= 48) & (data <= 57), bounds),
        _sums(data >= 0xC0, bounds),
        n_lines,
        _sums(same, group.word_bounds),
        _distinct(owners, hashes, texts),
    ]
    return np.stack([np.asarray(c, np.int64) for c in columns], axis=1)


def text_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of ``df``: ``id`` and the COUNTS as long columns."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [counts_of(group) for group in groups(batch.column(1))]
            table = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, table.T)], names=["id", *COUNTS])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(counted, schema)


#: The statistics that models see, in order.
FEATURES = (
    "symbols_per_word", "dup_line_share", "repeat_share", "bars_per_word", "bangs_per_word", "upper_share",
    "same_as_last_share", "digit_share", "beyond_ascii_share", "log_distinct_share", "log_words", "word_length",
    "words_per_line",
)


def features_of(counts: np.ndarray) -> np.ndarray:
    """The FEATURES of rows of COUNTS; every share of nothing is zero."""
    c = dict(zip(COUNTS, np.asarray(counts, np.float64).reshape(-1, len(COUNTS)).T))

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    columns = [
        np.minimum(share(c["n_symbols"], c["n_words"]), 3),
        share(c["n_dup_lines"], c["n_lines"]),
        share(c["n_repeat_words"], c["n_words"]),
        np.minimum(share(c["n_bars"], c["n_words"]), 3),
        np.minimum(share(c["n_bangs"], c["n_words"]), 3),
        share(c["n_upper"], c["n_letters"]),
        share(c["n_same_as_last"], c["n_words"]),
        np.minimum(share(c["n_digits"], c["word_chars"]), 1),
        np.minimum(share(c["n_beyond_ascii"], c["word_chars"]), 1),
        share(np.log1p(c["n_distinct_words"]), np.log1p(c["n_words"])),  # the plain share falls with length
        np.log1p(c["n_words"]),
        np.minimum(share(c["word_chars"], c["n_words"]), 30),
        np.log1p(share(c["n_words"], c["n_lines"])),
    ]
    return np.stack(columns, axis=1)
