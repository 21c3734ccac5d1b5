"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A document is the multiset of its windows of five words (of all its words if it has fewer). Weights are discretised at
0, 1, 2, 4, 8, ...; every part between two of these that a weight reaches is a Poisson process with the part's width as
rate. A process over more than one weight splits at its first point into two halves: the half that has the point takes
it along, the other goes on from that time, and halves above the weight are dropped. A process over one weight gives its
points, each with a register, which keeps its smallest time. As processes run in order of time, a document leaves
a process with all its halves as soon as it cannot beat the largest register. The same shingle gives the same points in
every document, so two registers agree with a probability equal to the weighted Jaccard similarity.

Documents of equal words are collapsed first. ``BANDS`` bands of ``ROWS`` registers make buckets. First, each document
is compared with the smallest of each of its buckets. Buckets that then still hold more than one class are compared
inside tasks: the members of a bucket's largest class and its other members are dealt to blocks of about ``BLOCK``, each
pair of blocks that can hold members of different classes is one group of bounded size, and every pair of different
classes whose signatures do not rule out the similarity is verified there, in the first bucket that the two share, until
their classes are joined; only links leave the task. So there is no cap, no list of all pairs of a group, and a large
class with a few strangers costs a few copies of it. Verifying adds up the smaller counts of shingle multisets (64-bit
hashes of shingles). Verified links are followed to classes by smallest doc_id, in tables of the shared folder.

A pair of similarity 0.8 shares no band with a probability of 7 in a million, and in an open bucket its signatures rule
it out (they agree five standard deviations less than 0.8 gives) with 2 in a million; nothing else can lose a link.

Joins by print, bucket and hub know how many rows a key has: keys with more than a thousandth of all rows are fewer than
a thousand and are broadcast as pairs of numbers, or salted where their side carries multisets.

Cases: null and empty texts have no words and are copies of one another; rows that share a doc_id are one document
that has the links of all of them; a row without doc_id is not compared and is of no class; an empty table gives an
empty result; the input's other columns pass through ``drop_near_copies``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.exact import join_unique
from tabweave.llm.shared import free_name, small_batches, store
from tabweave.llm.textarrays import Spans, Texts, inside, mix, numbers, windows

SHINGLE, BANDS, ROWS = 5, 30, 5
REGISTERS = BANDS * ROWS
BLOCK, HOT = 1024, 10_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_SEED = numbers(8, 77)


def shingles(words: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, count) of the distinct shingles of each text, in order of text."""
    hashes, owner = words.hashes(), words.text_of()
    at = np.flatnonzero(inside(words, SHINGLE))
    texts, keys = [owner[at]], [windows(hashes, SHINGLE, 4)[at]]
    for n in range(1, SHINGLE):  # short texts: all their words
        short = np.flatnonzero(words.counts == n)
        if len(short):
            texts.append(short), keys.append(windows(hashes, n, 4 + n)[words.first[:-1][short]])
    text, key = np.concatenate(texts), np.concatenate(keys)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], key[first], np.diff(np.append(first, len(key)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64 bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) / (1 << 53)


def signatures(n: int, text: np.ndarray, key: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of ``n`` multisets: (n, registers) smallest times, inf where a multiset is empty."""
    out = np.full(n * registers, np.inf)
    parts, low = [], 0
    while True:  # one process per shingle and part of the weights that it reaches
        width = max(low, 1)
        reach = np.flatnonzero(weight > low)
        if not len(reach):
            break
        size = len(reach)
        parts.append((text[reach], mix(key[reach] + _SEED[:1] * _U(low)), weight[reach], np.full(size, low), np.full(size, width)))
        low += width
    if not parts:
        return out.reshape(n, registers)
    doc, seed, top, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, nth, given = np.zeros(len(doc)), np.zeros(len(doc), _U), np.zeros(len(doc), bool)  # given: its next point is at ``time``
    turn = 0
    while len(doc):
        turn += 1
        limit = out.reshape(n, registers).max(1)
        wide = np.flatnonzero(width > 1)
        unit = np.flatnonzero(width == 1)
        # single weights: their points compete for registers; more at once for the few that go on
        step = 1 if turn <= 3 else 16
        draw = mix(seed[unit, None] + (nth[unit, None] + np.arange(1, step + 1, dtype=_U)) * _ODD)
        gaps = -np.log(_unit(draw)) / registers
        gaps[given[unit], 0] = 0.0
        times = time[unit, None] + np.cumsum(gaps, 1)
        np.minimum.at(out, doc[unit, None] * registers + (mix(draw ^ _SEED[1]) % _U(registers)).astype(np.int64), times)
        # wider ones: the next point lies in one half; the other half goes on from there on its own
        at = mix(seed[wide] ^ _SEED[3])
        first = np.where(given[wide], time[wide], time[wide] - np.log(_unit(at)) / (registers * width[wide]))
        go = first < limit[doc[wide]]
        wide, at, first = wide[go], at[go], first[go]
        half, right = width[wide] // 2, (at & _U(1)).astype(bool)
        halves = [(doc[wide], mix(seed[wide] ^ _SEED[4 + side]), top[wide], low[wide] + side * half, half, first, np.zeros(len(wide), _U), right == bool(side)) for side in (0, 1)]
        rest = (doc[unit], seed[unit], top[unit], low[unit], width[unit], times[:, -1], nth[unit] + _U(step), np.zeros(len(unit), bool))
        doc, seed, top, low, width, time, nth, given = (np.concatenate(x) for x in zip(rest, *halves, strict=True))
        go = (low < top) & (time < out.reshape(n, registers).max(1)[doc])
        doc, seed, top, low, width, time, nth, given = (x[go] for x in (doc, seed, top, low, width, time, nth, given))
    return out.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys; equal in a band when all its registers are."""
    bits = signature.view(_U).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(numbers(BANDS, 78), bits.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out * _ODD + bits[:, :, r])
    return out


def _signed(rows: DataFrame) -> DataFrame:
    """(doc_id, print, bands, short): a 128-bit fingerprint of the words, the band keys (none without words), and a byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in Texts.of(batch.column(1)).parts():
                words = texts.words()
                signature = signatures(len(texts), *shingles(words))
                keys = band_keys(signature).view(np.int64)
                short = (mix(signature.view(_U)) & _U(0xFF)).astype(np.uint8)
                some = words.counts > 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))), pa.int32()), pa.array(keys[some].ravel()))
                data = texts.data.tobytes()
                prints = [hashlib.sha256(b" ".join(data[a:b].split())).digest()[:16] for a, b in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(prints, pa.binary()), bands, pa.array([x.tobytes() for x in short], pa.binary())], ["doc_id", "print", "bands", "short"])

    return rows.mapInArrow(run, "doc_id long, print binary, bands array<long>, short binary")


def _multisets(rows: DataFrame) -> DataFrame:
    """(node, keys, counts): exact shingle multisets as arrays of bytes, sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in Texts.of(batch.column(1)).parts():
                text, key, count = shingles(texts.words())
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                keys = [key[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                counts = [count[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["node", "keys", "counts"])

    return rows.mapInArrow(run, "node long, keys binary, counts binary")


def similarity(keys_a: np.ndarray, counts_a: np.ndarray, keys_b: np.ndarray, counts_b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets given by sorted keys and counts."""
    at = np.searchsorted(keys_b, keys_a)
    at[at == len(keys_b)] = 0
    same = keys_b[at] == keys_a if len(keys_b) else np.zeros(len(keys_a), bool)
    common = int(np.minimum(counts_a[same], counts_b[at[same]]).sum())
    total = int(counts_a.sum()) + int(counts_b.sum()) - common
    return common / total if total else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (hub, node) of at least ``least`` similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ka, ca, kb, cb in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                keep.append(similarity(np.frombuffer(ka, _U), np.frombuffer(ca, np.uint32), np.frombuffer(kb, _U), np.frombuffer(cb, np.uint32)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["hub", "node"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets, "node").withColumnsRenamed({"keys": "k1", "counts": "c1"})
    per = store(pairs.groupBy("hub").agg(F.count("*").alias("n")), "hubs")
    limit = max(HOT, (per.agg(F.sum("n")).first()[0] or 0) // 1000)
    # fewer than a thousand rows; a hot hub's multiset is there once for every ``limit`` of its pairs
    hot = per.where(F.col("n") > limit).select("hub", F.ceil(F.col("n") / limit).cast("int").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    both = both.join(F.broadcast(hot), "hub", "left").withColumn("salt", F.pmod(F.xxhash64("node"), copies).cast("int")).drop("copies")
    hubs = sets.withColumnRenamed("node", "hub").join(per.select("hub"), "hub", "left_semi").join(F.broadcast(hot), "hub", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    both = both.join(hubs, ["hub", "salt"])
    return both.select("hub", "node", "keys", "counts", "k1", "c1").mapInArrow(run, "hub long, node long").distinct()


def _group_links(group: list[tuple], least: float) -> list[tuple[int, int]]:
    """Links between members (band, block, one_block, node, label, short, bands, keys, counts) of different classes, in blocks of their own if not ``one_block``."""
    if len({m[4] for m in group}) < 2:
        return []
    band, one_block = group[0][0], group[0][2]
    block, label = np.array([m[1] for m in group]), np.unique(np.array([m[4] for m in group]), return_inverse=True)[1]
    short, bands = np.frombuffer(b"".join(m[5] for m in group), np.uint8).reshape(len(group), -1), np.array([m[6] for m in group], np.int64)
    need = REGISTERS * (least - 5 * (least * (1 - least) / REGISTERS) ** 0.5)
    firsts, seconds, agreed = [], [], []
    for a in range(0, len(group), 32):
        same = (short[a : a + 32, None, :] == short[None, a:, :]).sum(2)
        i, j = np.nonzero(same >= need)
        n, i, j = same[i, j], i + a, j + a
        go = (i < j) & (label[i] != label[j]) & (one_block | (block[i] != block[j]))
        go[go] = ~(bands[i[go], :band] == bands[j[go], :band]).any(1)
        firsts.append(i[go]), seconds.append(j[go]), agreed.append(n[go])
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    order = np.argsort(-np.concatenate(agreed), kind="stable")
    parent, sets, links = list(range(int(label.max()) + 1)), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        ra, rb = root(int(label[a])), root(int(label[b]))
        if ra == rb:
            continue
        for x in (a, b):
            if x not in sets:
                sets[x] = np.frombuffer(group[x][7], _U), np.frombuffer(group[x][8], np.uint32)
        if similarity(*sets[a], *sets[b]) >= least:
            parent[max(ra, rb)] = min(ra, rb)
            links.append((group[a][3], group[b][3]))
    return links


def _open_links(rest: DataFrame, copies: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(hub, node) links inside stored buckets ``rest`` (band, bucket, node, label, size), each of several classes, between members of different classes."""
    # a bucket's members: those of its largest class, then the others; in it no pair needs a look
    by_label = rest.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy("bucket").agg(F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    sides = main.select("bucket", "main", "size", blocks(F.col("most")).alias("n_main"), blocks(F.col("size") - F.col("most")).alias("n_rest"))
    rows = join_unique(rest.drop("size"), store(sides, "sides"), ["bucket"], "size")
    own = F.col("label") == F.col("main")
    block = F.pmod(F.xxhash64("node"), F.when(own, F.col("n_main")).otherwise(F.col("n_rest"))).cast("int")
    # blocks of the others are numbered from 0, those of the largest class from n_rest on
    dealt = rows.withColumn("block", F.when(own, block + F.col("n_rest")).otherwise(block))
    last = F.when(own, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_main")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "block", "node", "label")
    full = dealt.join(copies.select("node", "short", "bands").join(sets, "node"), "node")
    keys = ["bucket", "low", "high"]
    rows = full.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "band", "block", (F.col("low") == F.col("high")).alias("one"), "node", "label", "short", "bands", "keys", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def links():
            found = _group_links(group, least) if len(group) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["hub", "node"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if row[:3] != key:
                    if group:
                        yield links()
                    key, group = row[:3], []
                group.append(row[3:])
        if group:
            yield links()

    return rows.mapInArrow(run, "hub long, node long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (hub, node) is linked to, over any number of links.

    Rounds of neighbours' smallest label and one jump to the label's label; every round is a stored table."""
    both = store(edges.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(edges.select(F.col("node").alias("a"), F.col("hub").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count("*").alias("n")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = join_unique(both, labels.withColumnRenamed("node", "b"), ["b"], "n").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "n", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = store(step.join(jump, "label", "left").select("node", "n", "old", F.least("label", "far").alias("label")), "labels")
        labels = new.select("node", "label", "n")
        if new.where("old <> label").isEmpty():
            return labels.drop("n")


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the smallest doc_id of its class) and kept (it is that document)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store(_signed(rows), "signed")
    known = signed.where(F.col("doc_id").isNotNull())
    copies = store(known.groupBy("print").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"), F.any_value("short").alias("short"), F.count("*").alias("n")), "copies")
    in_band = copies.select("node", F.posexplode("bands").alias("band", "bucket"))
    full = store(in_band.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("size")).where("hub < last"), "buckets")
    members = store(join_unique(in_band, full.select("bucket", "hub", "size"), ["bucket"], "size"), "members")
    some = members.select("node").distinct()
    sets = store(_multisets(rows.join(some.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select("doc_id", "text")), "sets")
    # copies are links already; a doc_id with several texts is a link between their classes
    same = join_unique(known.select("doc_id", "print"), copies.select("print", "node", "n"), ["print"], "n").where("doc_id <> node").select(F.col("node").alias("hub"), F.col("doc_id").alias("node")).distinct()
    pairs = store(members.where("node <> hub").select("hub", "node").distinct(), "pairs")
    edges = store(_verified(pairs, sets, least), "links")
    placed = members.join(components(edges), "node", "left").select("band", "bucket", "node", "size", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bucket")
    edges = edges.unionByName(store(_open_links(store(placed.join(several, "bucket"), "open"), copies, sets, least), "links"))
    labels = store(components(edges.unionByName(same)), "labels")
    out = signed.select("doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("label", "doc_id").alias("class_id"), (F.col("doc_id").isNull() | (F.coalesce("label", "doc_id") == F.col("doc_id"))).alias("kept"))


def drop_near_copies(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each class."""
    name = free_name(docs, "__gone")
    gone = near_classes(docs, least).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
