"""Exact deduplication by deterministic block naming; DataFrame functions only.

The normalised text (white space deleted, UTF-8) is cut into blocks of ``block`` bytes. Equal blocks get one integer
name: the distinct blocks are sorted over all partitions, by their first ``HEAD`` bytes and then by their 128-bit
fingerprint, which orders them fully, and numbered in that order. Then neighbouring names are paired and the distinct
pairs sorted and named in the same way, level by level, until each text has one name; texts are equal exactly when they
have as many blocks and the same last name. No level compares by hash alone: a block travels to the naming with its
content, and only its 128-bit fingerprint travels back once the naming has shown that no two blocks share one (else the
job goes on with the next seed).

Names come with how often they occur. Keys that hold more than a thousandth of the rows, of which there are fewer than
a thousand, are joined by broadcast and all others by shuffle, so a block, pair or group that a third of the rows share
is never one task's.

Cases: null text counts as empty, all empty texts are one group. Rows that repeat a doc_id are rows of their own; of
rows equal in text, length and doc_id one stays. A null doc_id sorts after every other. An empty table gives an empty
result. Other columns of the input are not read, so their names cannot clash."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import free_name, store, strip_white

BLOCK, HEAD = 1024, 16


def _blocks(norm, block: int):
    """The bytes of ``norm`` in blocks; the outer transform names them once, so that no block strips the text again."""
    cut = lambda data: F.transform(F.sequence(F.lit(1), F.length(data), F.lit(block)), lambda at: F.substring(data, at, F.lit(block)))
    none = F.array().cast("array<binary>")
    return F.transform(F.array(norm.cast("binary")), lambda data: F.when(F.length(data) > 0, cut(data)).otherwise(none))[0]


def _fingerprints(x, seed: int, bits: int):
    """Two seeded 64-bit hashes; ``bits`` under 64 is for tests of the collision path."""
    return [F.xxhash64(F.lit(2 * seed + k), x).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)).alias(f"h{k}") for k in (0, 1)]


def _named(distinct: DataFrame, order: list[str], keep: list[str], label: str) -> DataFrame:
    """``keep`` and name of ``distinct`` rows: names ascend with ``order`` over all partitions."""
    return store(distinct.orderBy(*order).select(*keep, F.monotonically_increasing_id().alias("name")), label)


def _block_names(docs: DataFrame, block: int, bits: int) -> tuple[DataFrame, int]:
    """(h0, h1, n, name) of every distinct block, n telling how often it occurs, and the seed under which no two blocks share (h0, h1)."""
    blocks = docs.select(F.explode(_blocks(strip_white(F.col("text")), block)).alias("block"))
    for seed in count():
        counted = blocks.groupBy(*_fingerprints(F.col("block"), seed, bits), "block").agg(F.count("*").alias("n"))
        distinct = store(counted.select(F.substring("block", 1, HEAD).alias("head"), "h0", "h1", "n"), "distinct")
        names = _named(distinct, ["head", "h0", "h1"], ["h0", "h1", "n"], "names")
        if names.groupBy("h0", "h1").count().where("count > 1").isEmpty():
            return names, seed


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, share: int = 1000, least: int = 10_000) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, stored and with one row per ``keys``, whose column ``n`` tells how many rows have them."""
    limit = max(least, (unique.agg(F.sum(n)).first()[0] or 0) // share)
    hot = unique.where(F.col(n) > limit)  # fewer than ``share`` rows
    if hot.isEmpty():
        return rows.join(unique, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(unique.where(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def _pair_up(level: DataFrame) -> DataFrame:
    """(rid, pos, n, name) of one level from the level below it."""
    even = F.col("pos") % 2 == 0
    pairs = store(
        level.groupBy("rid", "n", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")),
        "pairs",
    )
    names = _named(pairs.groupBy("a", "b").agg(F.count("*").alias("often")), ["a", "b"], ["a", "b", "often"], "pair_names")
    return store(join_unique(pairs, names, ["a", "b"], "often").select("rid", "n", "pos", "name"), "level")


def text_identities(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, size, text_sha256 and the identity (n, name) of its normalised text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names, seed = _block_names(docs, block, bits)
    norm = strip_white(F.col("text"))
    rows = store(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(norm, block), lambda x: F.struct(*_fingerprints(x, seed, bits))).alias("prints"),
        ),
        "texts",
    )
    level = rows.select("rid", F.size("prints").alias("n"), F.posexplode("prints").alias("pos", "print"))
    level = level.select("rid", F.col("n").alias("blocks"), "pos", F.col("print.h0").alias("h0"), F.col("print.h1").alias("h1"))
    level = store(join_unique(level, names, ["h0", "h1"], "n").select("rid", F.col("blocks").alias("n"), "pos", "name"), "level")
    longest, done, width = rows.agg(F.max(F.size("prints"))).first()[0] or 0, [], 1
    while True:
        done.append(level.where(F.col("n") <= width).select("rid", "name"))
        if width >= longest:
            break
        level, width = _pair_up(level.where(F.col("n") > width)), 2 * width
    named = done[0]
    for part in done[1:]:
        named = named.unionByName(part)
    return store(rows.join(named, "rid", "left").select("rid", "doc_id", "size", "text_sha256", F.size("prints").alias("n"), F.coalesce("name", F.lit(-1)).alias("name")), "identities")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the smallest doc_id."""
    rows = text_identities(docs, block, bits)
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    groups = store(rows.groupBy("n", "name").agg(F.count("*").alias("group_size"), best.alias("best")).select("n", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")), "groups")
    return join_unique(rows, groups, ["n", "name"], "group_size").select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of equal texts.

    Rows are found again by doc_id and text; of rows that share both, the longest stays."""
    result = store(exact_duplicates(docs, block), "exact")
    sha, keep_id, keep_sha = (free_name(docs, n) for n in ("__sha", "__keep_id", "__keep_sha"))
    kept = result.where("kept").select(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha))
    rows = docs.withColumn(sha, F.sha2(strip_white(F.col("text").cast("string")).cast("binary"), 256))
    rows = rows.join(kept, (F.col(sha) == F.col(keep_sha)) & F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)), "left_semi")
    if not result.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        # summed up before the shuffle, so that a row that repeats often is not one task's
        rows = rows.groupBy(sha).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.coalesce(F.length("text"), F.lit(-1))).alias("row")).select("row.*")
    return rows.select(*docs.columns)
