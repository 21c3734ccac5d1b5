"""Counts of whole texts that the quality operators share, from Arrow columns of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import small_batches
from tabweave.llm.textarrays import IS_WHITE, Texts, inside, mix, windows

#: Counts per text, all long.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_bars", "n_wide", "n_distinct_words", "n_long_words", "n_short_words")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _flags(chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars] if isinstance(chars, str) else list(chars)] = True
    return out


_SYMBOL, _UPPER, _LOWER, _DIGIT, _MARK, _BAR = _flags("#*$%&|<>"), _flags(range(65, 91)), _flags(range(97, 123)), _flags("0123456789"), _flags("!?"), _flags("|")


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(True where a key occurs twice or more, True at one place of each distinct key)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, first = np.empty(len(k), bool), np.empty(len(k), bool)
    twice[order], first[order] = same[1:] | same[:-1], ~same[:-1]
    return twice, first


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def count_all(texts: Texts) -> dict[str, np.ndarray]:
    data, words, lines = texts.data, texts.words(), texts.lines()
    white, start = IS_WHITE[data], (data & 0xC0) != 0x80
    hashes, owner = words.hashes(), words.text_of().astype(np.uint64)
    out = {"n_words": words.counts, "word_chars": texts.count(start & ~white)}
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_lower", _LOWER), ("n_digits", _DIGIT), ("n_marks", _MARK), ("n_bars", _BAR)):
        out[name] = texts.count(table[data])
    out["n_wide"] = texts.count(start & (data >= 0x80))
    # lines that have a word; of equal ones in a text all but the first
    dark = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~white, out=dark[1:])
    full = dark[lines.ends] > dark[lines.starts]
    keys = mix(lines.hashes() + lines.text_of().astype(np.uint64) * _ODD)
    first = np.ones(len(keys), bool)
    first[full] = _repeats(keys[full])[1]
    out["n_lines"], out["n_dup_lines"] = _per_text(full, lines.first), _per_text(full & ~first, lines.first)
    # words in three-word windows that their text has twice or more
    ok = np.flatnonzero(inside(words, 3))
    twice, _ = _repeats(mix(windows(hashes, 3)[ok] + owner[ok] * _ODD)) if len(ok) else (np.zeros(0, bool), None)
    step = np.zeros(len(hashes) + 1, np.int64)
    step[ok[twice]] += 1
    step[ok[twice] + 3] -= 1
    out["n_repeat_words"] = _per_text(np.cumsum(step[:-1]) > 0, words.first)
    out["n_distinct_words"] = _per_text(_repeats(mix(hashes + owner * _ODD))[1], words.first)
    size = words.ends - words.starts
    out["n_long_words"], out["n_short_words"] = _per_text(size > 16, words.first), _per_text(size <= 2, words.first)
    return {n: out[n] for n in NAMES}


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    parts = [count_all(t) for _, _, t in Texts.of(column).parts()]
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in NAMES}


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and NAMES of every row of ``docs``; a null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[n], pa.int64()) for n in NAMES)], ["doc_id", *NAMES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in NAMES))


#: Statistics made of the counts: numerator, denominator.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"), "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"), "mark_share": ("n_marks", "n_words"), "bar_share": ("n_bars", "n_words"), "wide_share": ("n_wide", "word_chars"), "distinct_share": ("n_distinct_words", "n_words"),
    "long_share": ("n_long_words", "n_words"), "short_share": ("n_short_words", "n_words"), "line_words": ("n_words", "n_lines"), "lower_share": ("n_lower", "word_chars"),
}


def ratio_columns() -> dict:
    """The statistics as Spark columns; 0 where the denominator is 0."""
    return {name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for name, (a, b) in RATIOS.items()}
