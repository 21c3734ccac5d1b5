"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Letters are lower-cased and words are runs of letters. A model of a class gives the probability of each byte of a word
after the word's bytes before it, the end mark included. A word of ``REACH`` bytes or more, as scripts without spaces and
joined words have, is modelled to its end in overlapping pieces: one begins at every character and has ``REACH`` bytes, or
what is left of the word. Pieces that a word has more than once count once in each stretch of ``STRETCH`` bytes, and so do
ends of the word that also begin another piece of the stretch. Counts are discounted absolutely, and what the discount
frees goes to the model below:

* shared: n-grams of up to ``ORDER`` bytes, each counted by its distinct left extensions over the words of both classes;
* ordinary: counts of the ordinary texts, backing off to the shared model;
* toxic: counts of the toxic texts, backing off to the ordinary mixture. Where the toxic class has nothing to say
  the two agree; a context that it saw once or twice says little, as the discount takes most of it.

Toxic texts are ordinary ones but for some words, so a word of a toxic text comes from the toxic model with the
probability ``SHARE`` and else from the ordinary one; each piece of a long word counts as a word here. A text's evidence
is the difference of its two log-likelihoods divided by its length (its modelled bytes, those of several pieces once), and
isotonic regression turns evidence into a probability.

Counting covers every labelled row of folds 0 and 1 (equal texts of one class count once) and is done by Spark with
the bytes themselves as keys; fold 3 calibrates. Only prefixes of words that the toxic class has differ between the
classes, so scoring needs these alone: per prefix a 64-bit hash, its last byte's log-ratio and the log-ratio of
leaving the known prefixes there. The tables grow with the labelled rows. Up to ``most`` prefixes (16 bytes each) they
are one broadcast; beyond that they are cut by their first ``HEAD`` bytes into slices of about that many, and the
texts are read once per slice, which changes no score.

Cases: null and empty texts, and texts without letters, have the lowest evidence; without labelled rows every text
scores 0; a row of labels without doc_id or with a null label is not learned from, and one of several labels of a
doc_id counts; rows without doc_id are in fold 0 and scored like others; repeated rows are scored one by one and equal
texts get equal scores, so ties stay ties; all other columns pass through ``with_toxicity`` untouched, whatever they
are called (its own column is ``__toxicity``, or that with more underscores if the table has one)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.quality import isotonic
from tabweave.llm.shared import fold, free_name, held_out, small_batches, store, with_labels
from tabweave.llm.textarrays import Texts, mix, numbers, range_hashes

ORDER, REACH, HEAD, DISCOUNT, SHARE = 5, 16, 4, 0.75, 0.01
#: Bins of the calibration: evidence on a logarithmic scale from the least that a text can have.
BINS, STEP = 4096, 1e-4
_U = np.uint64
_ROOT, _BYTE = numbers(1, 31)[0], numbers(256, 32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
PART, STRETCH, MOST = 2 << 20, 1 << 16, 1 << 20


def _lower(texts: Texts) -> Texts:
    """ASCII letters and the two-byte capitals U+00C0 to U+00DE in lower case."""
    data = _LOWER[texts.data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[wide] += 32
    return Texts(data, texts.offsets)


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, stretch) of the pieces of stretches of long words: a stretch's pieces begin in data[start:end], their word goes on to ``until``."""
    stretch = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(len(stretch)) + (starts - (np.cumsum(ends - starts) - (ends - starts)))[stretch]
    keep = (data[at] & 0xC0) != 0x80
    at, stretch = at[keep], stretch[keep]
    left = until[stretch] - at
    padded = np.zeros(len(data) + REACH, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    low, high = eight[at], eight[at + 8]
    once = left >= REACH
    whole = np.flatnonzero(once)
    once[whole] = False
    once[whole[np.unique(mix(mix(mix(low[whole]) ^ high[whole]) ^ stretch[whole].astype(_U)), return_index=True)[1]]] = True
    for size in range(1, REACH):  # the last characters, where the stretch does not have them before
        tail = np.flatnonzero(left == size)
        if not len(tail):
            continue
        want, has = np.zeros((2, len(starts)), _U), np.zeros(len(starts), bool)
        want[:, stretch[tail]], has[stretch[tail]] = (low[tail], high[tail]), True
        masks = [_U((1 << 8 * min(max(n, 0), 8)) - 1) for n in (size, size - 8)]
        again = has[stretch] & (left > size) & ((low ^ want[0][stretch]) & masks[0] == 0) & ((high ^ want[1][stretch]) & masks[1] == 0)
        has[stretch[again]] = False
        once[tail] = has[stretch[tail]]
    return at[once], np.minimum(left[once], REACH), stretch[once]


@dataclass
class Words:
    """Pieces of some texts, each with its text and how many bytes it models that no piece before it does; and the distinct
    ones: where one of each stands, how many bytes it has, and how many with the end mark."""

    data: np.ndarray
    owner: np.ndarray
    fresh: np.ndarray
    which: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Iterator[Words]:
        """All pieces, about ``MOST`` at a time."""
        data = _lower(texts).data
        spans = Texts(data, texts.offsets)._spans(_LETTER[data])
        size = spans.ends - spans.starts
        parts = np.where(size < REACH, 1, -(-size // STRETCH))
        until, owner = np.repeat(spans.ends, parts), np.repeat(spans.text_of(), parts)
        starts = np.repeat(spans.starts, parts) + STRETCH * (np.arange(len(until)) - np.repeat(np.cumsum(parts) - parts, parts))
        ends, long = np.minimum(starts + STRETCH, until), np.repeat(size >= REACH, parts)
        work, reached, i = np.cumsum(np.where(long, ends - starts, 1)), 0, 0
        while i < len(starts):
            j = int(np.searchsorted(work, (work[i - 1] if i else 0) + MOST)) + 1
            at, length, of, mark = starts[i:j], ends[i:j] - starts[i:j], owner[i:j], ~long[i:j]
            if not mark.all():
                cut = np.flatnonzero(~mark)
                more = _pieces(data, at[cut], at[cut] + length[cut], until[i:j][cut])
                at, length, of = (np.concatenate((x[mark], y)) for x, y in ((at, more[0]), (length, more[1]), (of, of[cut][more[2]])))
                order = np.argsort(at, kind="stable")
                mark = (np.arange(len(at)) < mark.sum())[order]
                at, length, of = at[order], length[order], of[order]
            i = j
            if not len(at):
                continue
            hashes = range_hashes(data, at, at + length, 0)
            hashes[~mark] = mix(hashes[~mark] ^ _ROOT)
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            fresh = at + length + mark - np.maximum(at, np.concatenate(([reached], (at + length)[:-1])))
            yield cls(data, of, fresh, which, at[first], length[first], (length + mark)[first])
            reached = int(at[-1] + length[-1])

    def byte(self, rows: np.ndarray, place: int) -> np.ndarray:
        """The byte at ``place`` of the distinct pieces ``rows``, all of which have one there; the end mark is 0."""
        at = self.starts[rows] + place
        return np.where(place < self.lengths[rows], self.data[np.minimum(at, len(self.data) - 1)], 0)

    def keys(self) -> pa.Array:
        """The modelled bytes of the distinct pieces: a short word and a 0, or bytes of a long one."""
        first = np.concatenate(([0], np.cumsum(self.sizes)))
        out = np.zeros(first[-1], np.uint8)
        for place in range(int(self.sizes.max(initial=0))):
            rows = np.flatnonzero(self.sizes > place)
            out[first[rows] + place] = self.byte(rows, place)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(out)])


def _next(hashes: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hash of a prefix with one byte more."""
    return mix((hashes ^ _BYTE[byte]) * _BYTE[0])


def prefix_hashes(keys: list[bytes]) -> np.ndarray:
    flat, size = np.frombuffer(b"".join(keys), np.uint8), np.array([len(k) for k in keys], np.int64)
    first, out = np.cumsum(size) - size, np.full(len(keys), _ROOT, _U)
    for place in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > place)
        out[rows] = _next(out[rows], flat[first[rows] + place])
    return out


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, n0, n1): how often the pieces with these modelled bytes are in the ordinary and in the toxic texts of ``rows`` (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) == 1
            for i, j, texts in Texts.of(batch.column(0)).parts(PART):
                for words in Words.of(texts):
                    of = toxic[i:j][words.owner]
                    n = [np.bincount(words.which[of == c], minlength=len(words.sizes)) for c in (False, True)]
                    yield pa.RecordBatch.from_arrays([words.keys(), *(pa.array(x.astype(np.int64)) for x in n)], ["key", "n0", "n1"])

    return rows.select("text", "toxic").mapInArrow(run, "key binary, n0 long, n1 long").groupBy("key").agg(*(F.sum(n).alias(n) for n in ("n0", "n1")))


def _cut(c: Column | str, at: int | Column, size: int | Column) -> Column:
    return F.substring(c, F.lit(at) if isinstance(at, int) else at, F.lit(size) if isinstance(size, int) else size)


def _suffixes(c: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: _cut(c, F.length(c) - k + 1, k))


def _interpolated(n: Column, seen: Column, kinds: Column, below: Column) -> Column:
    """Absolute discounting: the count less the discount, and the rest of the context's mass to ``below``."""
    p = (F.greatest(n - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * below) / F.greatest(seen, F.lit(1))
    return F.when(seen > 0, p).otherwise(below)


def shared_model(words: DataFrame) -> DataFrame:
    """(gram, p): the shared probability of a gram's last byte after its bytes before, for every gram of 1 to ``ORDER``
    bytes in the distinct words, each with a 0 in front. A gram's count is that of its distinct left extensions; the front is one."""
    padded = F.concat(F.lit(b"\0"), F.col("key"))
    ends = F.transform(F.sequence(F.lit(2), F.length(padded)), lambda e: _cut(padded, F.greatest(F.lit(1), e - ORDER), F.least(e, F.lit(ORDER + 1))))
    longest = store(words.select(F.explode(ends).alias("gram")).distinct(), "grams")  # shorter ones begin with the front
    every = longest.select(F.explode(_suffixes("gram")).alias("gram")).distinct()
    extended = every.where(F.length("gram") > 1).select(_cut("gram", 2, F.length("gram") - 1).alias("gram"))
    counts = extended.unionByName(longest.where(F.length("gram") <= ORDER)).groupBy("gram").agg(F.count("*").alias("n"))
    context = Window.partitionBy(_cut("gram", 1, F.length("gram") - 1))  # at most 256 grams
    seen = store(counts.withColumns({"seen": F.sum("n").over(context), "kinds": F.count("*").over(context)}), "gram_counts")
    chain = seen.select("gram", F.explode(_suffixes("gram")).alias("suffix")).join(seen.withColumnRenamed("gram", "suffix"), "suffix")
    levels = chain.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct(F.length("suffix").alias("size"), "n", "seen", "kinds"))).alias("levels"))  # at most ORDER
    return store(levels.select("gram", F.aggregate("levels", F.lit(1 / 256.0), lambda below, x: _interpolated(x["n"], x["seen"], x["kinds"], below)).alias("p")), "shared")


def toxic_prefixes(words: DataFrame) -> DataFrame:
    """(prefix, r, leave): of every prefix that the toxic class has, the log-ratio of its last byte, toxic over ordinary, and the log-ratio of a next byte that the toxic class has not after it."""
    prefixes = F.transform(F.sequence(F.lit(0), F.length("key")), lambda k: _cut("key", 1, k))
    nodes = store(words.select(F.explode(prefixes).alias("prefix"), "n0", "n1").groupBy("prefix").agg(*(F.sum(n).alias(n) for n in ("n0", "n1"))), "prefixes")
    parent = _cut("prefix", 1, F.length("prefix") - 1)
    children = nodes.where(F.length("prefix") > 0).groupBy(parent.alias("parent")).agg(*(F.sum(f"n{c}").alias(f"s{c}") for c in (0, 1)), *(F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)))
    around = store(children.where("s1 > 0"), "around")
    own = nodes.where("n1 > 0")
    padded = F.concat(F.lit(b"\0"), F.col("prefix"))
    gram = _cut(padded, F.greatest(F.lit(1), F.length(padded) - (ORDER - 1)), ORDER)
    inner = own.where(F.length("prefix") > 0).withColumns({"parent": parent, "gram": gram}).join(around, "parent").join(shared_model(words), "gram")
    ordinary = _interpolated(F.col("n0"), F.col("s0"), F.col("k0"), F.col("p"))
    inner = inner.withColumn("ordinary", ordinary).withColumn("toxic", _interpolated(F.col("n1"), F.col("s1"), F.col("k1"), F.col("ordinary")))
    ratios = own.where(F.length("prefix") == 0).select("prefix", F.lit(0.0).alias("r")).unionByName(inner.select("prefix", (F.log("toxic") - F.log("ordinary")).alias("r")))
    leave = around.select(F.col("parent").alias("prefix"), F.log(DISCOUNT * F.col("k1") / F.col("s1")).alias("leave"))
    return ratios.join(leave, "prefix", "left")


def _hashed(prefixes: DataFrame) -> DataFrame:
    """(h, head, r, leave): the prefix's hash, and the hash of its first ``HEAD`` bytes, NULL if it has no more than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            long = np.array([len(k) > HEAD for k in keys], bool)
            h, head = prefix_hashes(keys).view(np.int64), prefix_hashes([k[:HEAD] for k in keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(head, mask=~long), batch.column(1).cast(pa.float32()), batch.column(2).cast(pa.float32())], ["h", "head", "r", "leave"])

    return prefixes.select("prefix", "r", "leave").mapInArrow(run, "h long, head long, r float, leave float")


def log_ratios(words: Words, table: tuple[np.ndarray, ...], part: int, parts: int) -> np.ndarray:
    """Difference of the log-likelihoods of every distinct piece, toxic mixture less ordinary; 0 for pieces of another slice than ``part``."""
    h, r, leave = table
    n = len(words.sizes)
    total, hashes, last = np.zeros(n), np.full(n, _ROOT, _U), np.zeros(n, np.int64)
    if not len(h) or not n:
        return total
    last[:] = np.searchsorted(h, _ROOT)
    rows = np.arange(n)
    if parts > 1:
        head = hashes.copy()
        for place in range(HEAD):
            long = np.flatnonzero(words.sizes > place)
            head[long] = _next(head[long], words.byte(long, place))
        rows = np.flatnonzero(head.view(np.int64) % parts == part)
    for place in range(REACH):
        hashes[rows] = _next(hashes[rows], words.byte(rows, place))
        value, where = np.unique(hashes[rows], return_inverse=True)
        at = np.minimum(np.searchsorted(h, value), len(h) - 1)
        known, at = (h[at] == value)[where], at[where]
        gone = rows[~known]
        total[gone] += leave[last[gone]]
        rows, at = rows[known], at[known]
        total[rows] += r[at]
        last[rows] = at
        rows = rows[words.sizes[rows] > place + 1]
        if not len(rows):
            break
    return np.log1p(SHARE * np.expm1(np.minimum(total, 600.0)))


def _sums(column: pa.Array, table: tuple[np.ndarray, ...], part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(difference of the log-likelihoods, modelled bytes) of each text."""
    sums, sizes = np.zeros(len(column)), np.zeros(len(column), np.int64)
    for i, j, texts in Texts.of(column).parts(PART):
        for words in Words.of(texts):
            sums[i:j] += np.bincount(words.owner, log_ratios(words, table, part, parts)[words.which], j - i)
            sizes[i:j] += np.bincount(words.owner, words.fresh, j - i).astype(np.int64)
    return sums, sizes


@dataclass
class Model:
    """Stored table of ``_hashed`` prefixes in ``parts`` slices, and the calibration curve."""

    prefixes: DataFrame
    parts: int = 1
    curve: np.ndarray = field(default_factory=lambda: np.zeros(BINS))

    def slice(self, part: int) -> tuple[np.ndarray, ...]:
        own = self.prefixes.where(F.col("head").isNull() | (F.pmod("head", F.lit(self.parts)) == part)) if self.parts > 1 else self.prefixes
        t = own.select("h", "r", "leave").toArrow()
        h = t["h"].to_numpy().view(_U)
        order = np.argsort(h)
        return h[order], t["r"].to_numpy()[order], t["leave"].fill_null(0).to_numpy()[order]


def _sums_udf(model: Model, part: int, spark):
    shared, parts = spark.sparkContext.broadcast(model.slice(part)), model.parts

    @F.arrow_udf("struct<s:double,n:long>")
    def run(text: pa.Array) -> pa.Array:
        s, n = _sums(text, shared.value, part, parts)
        return pa.StructArray.from_arrays([pa.array(s), pa.array(n)], ["s", "n"])

    return run


def with_evidence(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the difference of the text's log-likelihoods over its length, NULL without letters.

    Only the text goes to Python. With several slices the sums of a text come from one pass for each and are joined by
    the text's digest, of which each occurs once on that side; Spark splits a digest that many rows share."""
    text = F.col("text").cast("string")
    rate = lambda x: F.when(x["n"] > 0, x["s"] / x["n"])
    if model.parts == 1:
        return docs.withColumn(name, _sums_udf(model, 0, docs.sparkSession)(text)).withColumn(name, rate(F.col(name)))
    key = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    passes = [store(docs.select(key.alias("t"), _sums_udf(model, k, docs.sparkSession)(text).alias("x")).groupBy("t").agg(F.min("x").alias("x")), f"pass{k}") for k in range(model.parts)]
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    sums = every.groupBy("t").agg(F.struct(F.sum("x.s").alias("s"), F.max("x.n").alias("n")).alias("x")).select(F.col("t").alias(f"{name}_t"), rate(F.col("x")).alias(name))
    return docs.withColumn(f"{name}_t", key).join(sums, f"{name}_t").select(*docs.columns, name)


def _bin(e: Column) -> Column:
    """Bin of an evidence; NULL is the lowest."""
    x = F.log2((e - float(np.log1p(-SHARE))) / STEP + 1) * (BINS / 20)
    return F.least(F.lit(BINS - 1), F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0)).cast("int"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 8_000_000) -> Model:
    """Count folds 0 and 1 of the labelled rows, calibrate on fold 3."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = with_labels(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), usable)
    part = fold(F.col("doc_id"))
    learn = rows.where(part.isin(0, 1) & F.col("text").isNotNull())
    words = store(word_counts(learn.groupBy(F.md5("text").alias("t"), "toxic").agg(F.min("text").alias("text"))), "words")
    prefixes = store(_hashed(toxic_prefixes(words)), "toxic_prefixes")
    model = Model(prefixes, max(1, -(-prefixes.count() // most)))
    good, total = np.zeros(BINS), np.zeros(BINS)
    for r in with_evidence(rows.where(part == 3).select("text", "toxic"), model, "e").groupBy(_bin(F.col("e")).alias("bin")).agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).collect():
        good[r["bin"]], total[r["bin"]] = r["y"], r["n"]
    if total.any():
        model.curve = np.clip(isotonic(good, total), 0.0, 1.0)
    return model


def with_toxicity(docs: DataFrame, model: Model, name: str = "__toxicity") -> DataFrame:
    """``docs`` with the column ``name`` (0 to 1)."""
    small_batches(docs.sparkSession)
    return with_evidence(docs, model, name).withColumn(name, F.get(F.lit(model.curve.tolist()), _bin(F.col(name))))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = with_toxicity(rows, fit_toxicity(rows, labels), "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``."""
    name = free_name(docs, "__toxicity")
    return with_toxicity(docs, fit_toxicity(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)
