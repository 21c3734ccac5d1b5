"""Hierarchical multi-length packing of token sequences.

Tiers are the powers of two up to ``longest``. A document (its ids, then the end id) fills as many whole windows of
the longest tier as it can; what is left is routed to the smallest tier that holds it. Within each Arrow batch of
documents (bounded rows and bytes, no shuffle) every tier, longest first, opens windows of its size with one of its own
documents each, and their gaps are filled from the shorter tiers, then, if these are used up, from documents of the tier
itself, cut where a gap ends. Gaps of the longest tier that nothing was left to fill, under ``longest`` ids together,
stay open for the next batch of the partition and are padding at its end only; the last ids of a shorter tier are cut
into windows of exact powers of two. Sequences of a tier are dealt to step groups in order of the length filled in
their batch, back and forth, which levels the groups.

Cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed one by one; a null doc_id stays
null; an empty table gives no pieces. ``sequence_id`` holds the partition in its high bits and is unique. Packing is
deterministic for one partitioning of the input."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import small_batches
from tabweave.llm.tokens import default_tokenizer, encoder, text_parts

LONGEST = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _overlay(gap_sizes: np.ndarray, piece_sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lay pieces end to end into gaps laid end to end: (gap, piece, length, place in gap, place in piece) of every cut."""
    gap_end, piece_end = np.cumsum(gap_sizes), np.cumsum(piece_sizes)
    total = min(gap_end[-1] if len(gap_end) else 0, piece_end[-1] if len(piece_end) else 0)
    ends = np.unique(np.concatenate((gap_end, piece_end, [total])))
    ends = ends[(ends > 0) & (ends <= total)]
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
    gap, piece = np.searchsorted(gap_end, starts, "right"), np.searchsorted(piece_end, starts, "right")
    return gap, piece, ends - starts, starts - (gap_end - gap_sizes)[gap], starts - (piece_end - piece_sizes)[piece]


def pack(lengths: np.ndarray, longest: int = LONGEST, gaps: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Pieces (doc, start, length, sequence, offset, tier) of documents of positive ``lengths``. ``gaps`` are the open ends of
    windows from before; their pieces have sequences -1, -2, ... The gaps open afterwards are open_sequence and open_size."""
    out: list[tuple[np.ndarray, ...]] = []
    full = lengths // longest
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    n_seq = len(doc)
    out.append((doc, nth * longest, np.full(n_seq, longest), np.arange(n_seq), np.zeros(n_seq, np.int64), np.full(n_seq, longest)))
    rest, at = lengths - full * longest, full * longest

    def fill(order: np.ndarray, seq: np.ndarray, size: np.ndarray, tier: np.ndarray) -> np.ndarray:
        """Lay the rests in ``order`` into the last ``size`` ids of windows; what stays open of each."""
        gap, piece, n, in_gap, in_piece = _overlay(size, rest[order])
        d = order[piece]
        out.append((d, at[d] + in_piece, n, seq[gap], (tier - size)[gap] + in_gap, tier[gap]))
        used = np.bincount(d, n, len(rest)).astype(np.int64)
        at[:], rest[:] = at + used, rest - used
        return size - np.bincount(gap, n, len(size)).astype(np.int64)

    def ordered(low: int, high: int) -> np.ndarray:
        """Documents with a rest over ``low``, up to ``high``, longest first."""
        own = np.flatnonzero((rest > low) & (rest <= high))
        return own[np.lexsort((own, -rest[own]))]

    open_seq = -1 - np.arange(0 if gaps is None else len(gaps))
    open_size = np.zeros(0, np.int64) if gaps is None else gaps
    open_size = fill(np.concatenate((ordered(0, longest // 2), ordered(longest // 2, longest))), open_seq, open_size, np.full(len(open_size), longest))
    tier = longest
    while tier and rest.any():
        head, short, total = ordered(tier // 2, tier), ordered(0, tier // 2), int(rest.sum())
        enough = rest[short].sum() >= len(head) * tier - rest[head].sum()
        # too little for all gaps: only as many windows as the ids fill; further documents of the tier go into the gaps
        n = len(head) if enough else -(-total // tier) if tier == longest else total // tier
        first, order, seq = head[:n], np.concatenate((short, head[n:])), n_seq + np.arange(n)
        n_seq += n
        size = tier - rest[first]
        out.append((first, at[first], rest[first], seq, np.zeros(n, np.int64), np.full(n, tier)))
        at[first], rest[first] = at[first] + rest[first], 0
        left = fill(order, seq, size, np.full(n, tier))
        if tier == longest:
            open_seq, open_size = np.concatenate((open_seq, seq)), np.concatenate((open_size, left))
        if not enough and rest.any():
            total = int(rest.sum())
            sizes = np.array([1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1], np.int64)
            fill(order, n_seq + np.arange(len(sizes)), sizes, sizes)
            n_seq += len(sizes)
        tier //= 2
    p = dict(zip(("doc", "start", "length", "sequence", "offset", "tier"), map(np.concatenate, zip(*out, strict=True)), strict=True))
    return p | {"open_sequence": open_seq[open_size > 0], "open_size": open_size[open_size > 0]}


def step_groups(sequence: np.ndarray, length: np.ndarray, tier: np.ndarray, per_step: int) -> np.ndarray:
    """Step group of every piece: a tier's sequences in order of filled length are dealt back and forth over its groups."""
    n = int(sequence.max(initial=-1)) + 1
    filled, of_tier = np.bincount(sequence, length, n), np.zeros(n, np.int64)
    of_tier[sequence] = tier
    group, base = np.zeros(n, np.int64), 0
    for t in np.unique(of_tier)[::-1]:
        own = np.flatnonzero(of_tier == t)
        own = own[np.lexsort((own, -filled[own]))]
        n_groups = max(1, -(-len(own) // per_step))
        turn, k = np.divmod(np.arange(len(own)), n_groups)
        group[own] = base + np.where(turn % 2, n_groups - 1 - k, k)
        base += n_groups
    return group[sequence]


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, longest: int = LONGEST, per_step: int = 64) -> DataFrame:
    """One row per piece: see the contract's columns, then ``tier`` (the window's size) and ``step_group``."""
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, group_base = encoder(path), TaskContext.get().partitionId() << 36, 0
        end = np.array([end_id], "<u4")
        # windows of earlier batches with an open gap: id, step group, free ids
        open_id, open_group, open_size = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = [], batch.column(1).to_pylist()
            for i, j in text_parts([t or "" for t in texts], 3 << 20):  # the pipeline has little memory left here
                ids += enc.encode_batch([t or "" for t in texts[i:j]])
            lengths = np.array([len(b) // enc.dtype.itemsize + 1 for b in ids], np.int64)
            p = pack(lengths, longest, open_size)
            wide = None
            crc, last = np.empty(len(p["doc"]), np.int64), -1
            for k in np.lexsort((p["start"], p["doc"])).tolist():
                d = int(p["doc"][k])
                if d != last:
                    wide, last = memoryview(np.concatenate((np.frombuffer(ids[d], enc.dtype), end)).astype("<u4")).cast("B"), d
                s = int(p["start"][k]) * 4
                crc[k] = zlib.crc32(wide[s : s + int(p["length"][k]) * 4])
            seq = p["sequence"]
            new, part = seq >= 0, TaskContext.get().partitionId() << 36
            n = int(seq.max(initial=-1)) + 1
            ids_of, group_of = np.concatenate((base + np.arange(n), open_id[::-1])), np.concatenate((np.zeros(n, np.int64), open_group[::-1]))
            groups = step_groups(seq[new], p["length"][new], p["tier"][new], per_step)
            group_of[seq[new]] = part + group_base + groups  # a negative sequence counts from the end
            columns = (batch.column(0).take(pa.array(p["doc"])), p["start"], p["length"], crc, lengths[p["doc"]], ids_of[seq], p["offset"], p["tier"].astype(np.int32), group_of[seq])
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
            base += n
            group_base += int(groups.max(initial=-1)) + 1
            open_id, open_group, open_size = ids_of[p["open_sequence"]], group_of[p["open_sequence"]], p["open_size"]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
