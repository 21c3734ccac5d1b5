"""Substring dedup by difference-cover anchors.

A word goes when a window of ``size`` words that covers it also starts in a document with a smaller doc_id. With the
cover {0, 1, 3} modulo 7, any two places have a common shift under 7 at which both are cover places, so two equal
windows of 13 words share an anchor: 7 words at a cover place of either text. Hence

1. each task hashes words at cover places only (3 of 7) and Spark counts in how many texts an anchor is; a text counts
   once, and a task sends an anchor at most twice, however many of its texts have it;
2. anchors of two or more texts go into a bit filter (two bits each, 32 bits of room per anchor, at most ``most_bits``
   in all), which every task gets; a filter that is too full lets more through and loses nothing;
3. anchors extend: only windows that hold a marked anchor are hashed and sent, once per task with the smallest doc_id
   there, and Spark finds the smallest document of each window;
4. each document gets back the windows of which it is itself the first; its other marked windows go.

Windows are equal when two hashes of 64 bits are, each over word hashes of its own seed; in the last step, where a
document's windows meet those of which it is the first, the first hash and 32 bits of the second.

Cases: null and empty texts have no words; rows that repeat a doc_id are one document for 'smaller' and are cleaned one
by one; a row without doc_id is neither smaller nor larger than any and keeps its words; an empty table gives an empty
result; other columns are not read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import small_batches, store
from tabweave.llm.textarrays import Spans, Texts, inside, mix, windows

SIZE, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = SIZE - PERIOD + 1
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _anchors(words: Spans, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the words, hash) of every anchor of texts that have a window."""
    place = np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)
    n = max(0, len(hashes) - ANCHOR + 1)
    enough = np.repeat(words.counts >= SIZE, words.counts)[:n]
    at = np.flatnonzero(inside(words, ANCHOR) & np.isin(place[:n] % PERIOD, COVER) & enough)
    return at, windows(hashes, ANCHOR, 1)[at]


def _marked(words: Spans, hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Starts of windows that hold an anchor of the filter."""
    at, anchors = _anchors(words, hashes)
    n = len(hashes) - SIZE + 1
    if n <= 0 or not len(at):
        return np.zeros(0, np.int64)
    hit = at[_has(bits, anchors)]
    step = np.zeros(len(hashes) + PERIOD + 1, np.int64)
    np.add.at(step, np.maximum(hit - PERIOD + 1, 0), 1)
    np.add.at(step, hit + 1, -1)
    return np.flatnonzero((np.cumsum(step)[:n] > 0) & inside(words, SIZE))


def _places(anchors: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return anchors & _U(n_bits - 1), anchors >> _U(34) & _U(n_bits - 1)


def _has(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchors), bool)
    for p in _places(anchors, 8 * len(bits)):
        out &= (bits[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _among(row: np.ndarray, one: np.ndarray, two: np.ndarray, known_row: np.ndarray, known_one: np.ndarray, known_two: np.ndarray) -> np.ndarray:
    """True where (row, one, two) is among the known ones."""
    if not len(known_row):
        return np.zeros(len(row), bool)
    known = mix(known_one + known_row.astype(_U) * _ODD)
    order = np.argsort(known)
    key = mix(one + row.astype(_U) * _ODD)
    at = order[np.minimum(np.searchsorted(known, key, sorter=order), len(order) - 1)]
    return (known_one[at] == one) & (known_two[at] == two) & (known_row[at] == row)


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """Anchors that two or more rows have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in Texts.of(batch.column(1)).parts(8 << 20):
                words = texts.words()
                at, anchors = _anchors(words, words.hashes())
                _, first = np.unique(mix(anchors + words.text_of()[at].astype(_U) * _ODD), return_index=True)
                key, n = np.unique(anchors[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

    return rows.mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n >= 2").select("anchor")


def anchor_filter(shared: DataFrame, most_bits: int) -> np.ndarray:
    """The filter's bytes; Spark builds it in pieces of 4 KB."""
    n_bits = 1 << 15
    wanted = 32 * shared.count()
    while n_bits < min(wanted, most_bits):
        n_bits *= 2
    p = F.explode(F.array(F.col("anchor").bitwiseAND(F.lit(n_bits - 1)), F.shiftrightunsigned("anchor", 34).bitwiseAND(F.lit(n_bits - 1)))).alias("p")
    pieces = shared.select(p).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    out = np.zeros(n_bits // 8, np.uint8)
    for r in pieces.toLocalIterator():
        at = (r["piece"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: n_bits // 8 - at]
    return out


def _first_windows(rows: DataFrame, shared) -> DataFrame:
    """(doc_id, firsts, more): hashes of the marked windows of which a document is the smallest holder, and 32 bits of the
    other hash of each, in the same order (an array of pairs would take thrice the room)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, texts in Texts.of(batch.column(1)).parts(8 << 20):
                words = texts.words()
                hashes = words.hashes()
                at = _marked(words, hashes, shared.value)
                one, two, doc = windows(hashes, SIZE, 2)[at], windows(words.hashes(1), SIZE, 3)[at], ids[i:j][words.text_of()[at]].astype(np.int64)
                order = np.lexsort((doc, two, one))
                one, two, doc = one[order], two[order], doc[order]
                new = np.ones(len(one), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(one[new].view(np.int64)), pa.array(two[new].view(np.int64)), pa.array(doc[new])], ["one", "two", "doc_id"])

    found = rows.where(F.col("doc_id").isNotNull()).mapInArrow(run, "one long, two long, doc_id long")
    return found.groupBy("one", "two").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("one").alias("firsts"), F.collect_list(F.shiftright(F.shiftleft("two", 32), 32).cast("int")).alias("more"))


def clean(docs: DataFrame, most_bits: int = 1 << 30) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and kept_text (its kept words, joined by one space)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(anchor_filter(store(_shared_anchors(rows), "anchors"), most_bits))
    firsts = store(_first_windows(rows, shared), "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0), batch.column(2)
            offsets = np.concatenate(([0], np.cumsum(own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            one, two = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            has_id = ids.is_valid().to_numpy(zero_copy_only=False)
            n_words, n_gone, digests, kept = [], [], [], []
            for i, j, texts in Texts.of(batch.column(1)).parts(8 << 20):
                words = texts.words()
                hashes = words.hashes()
                at = _marked(words, hashes, shared.value)
                owner = words.text_of()[at]
                row, part = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1])), slice(offsets[i], offsets[j])
                first = _among(owner, windows(hashes, SIZE, 2)[at], windows(words.hashes(1), SIZE, 3)[at].astype(np.uint32).view(np.int32), row, one[part].view(_U), two[part])
                go = at[~first & has_id[i:j][owner]]
                step = np.zeros(len(hashes) + 1, np.int64)
                step[go] += 1
                step[go + SIZE] -= 1
                keep = np.cumsum(step[:-1]) == 0
                data = texts.data.tobytes()
                for k in range(j - i):
                    a, b = words.first[k], words.first[k + 1]
                    parts = data[texts.offsets[k] : texts.offsets[k + 1]].split()
                    gone = int(b - a - np.count_nonzero(keep[a:b]))
                    left = b" ".join(compress(parts, keep[a:b].tolist()) if gone else parts)
                    n_words.append(int(b - a)), n_gone.append(gone), digests.append(hashlib.sha256(left).hexdigest()), kept.append(left)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = rows.where(F.col("doc_id").isNotNull()).join(firsts, "doc_id", "left").select("doc_id", "text", "firsts", "more")
    every = joined.unionByName(rows.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    return every.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
