"""Mixing of sources to target weights by entropy balancing; DataFrame functions only.

Document i of source s gets the rate r_i in (0, 3) that is nearest to 1 in entropy among those with
sum(r_i * size_i) = target_s. The dual has one multiplier per source and gives r = 3 e^t / (2 + e^t), t = lambda_s *
size_i / mean_s, an exponential tilt that flattens at the bound. As documents of one source and size have one rate,
Newton runs on a stored table of (source, size, documents); each iteration is one aggregation by source (safeguarded by
a bracket, at most 60 of them). What reaches the driver is one row per source, and that row alone goes back, as a small
joined table: sources are taken to be few (thousands, not millions). Rates become copies by floor(rate + u) with a number
u from the document's hash, moved by a shift per source that brings the total under its target, and last by single copies
of documents that still fit the gap. Shift and copies are found by binned sums: a document's words are counted in the bin
from which on it is taken, and running totals tell the last bin that fits; two passes of 256 bins, in whole numbers.

Cases: null text has size 0; a null source is a source of its own, last in order; a source of size 0 has target 0;
an empty table gives an empty result; rows that repeat a doc_id get the same number of copies. Columns of the input
keep their names, whatever these are; they travel as one struct beside the operator's own columns."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.llm.shared import WORD, release, store

#: Copies at most; whole numbers of 2^-40 copies stand for rates, draws and shifts; a search is two passes over 256 bins.
MOST, ONE, PASSES, BITS = 3, 40, 2, 8


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: dict[str, int], weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> dict[str, float]:
    """Share all sizes by weight in key order; a target above ``most`` times its source's size stops there, and the excess is shared again."""
    weight = {k: weights[i % len(weights)] for i, k in enumerate(sorted(sizes, key=lambda k: k.encode()))}
    out, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        total = sum(weight[k] for k in free)
        over = {k for k in free if left * weight[k] / total > most * sizes[k]}
        if not over:
            return out | {k: left * weight[k] / total for k in free}
        out |= {k: float(most * sizes[k]) for k in over}
        left -= sum(most * sizes[k] for k in over)
        free -= over
    return out


def _draw(seed: int) -> Column:
    """A number from 0 to 2^40 - 1 by the document."""
    return F.xxhash64(F.lit(seed), F.col("__id")).bitwiseAND(F.lit((1 << ONE) - 1))


def _rate() -> Column:
    """3 e^t / (2 + e^t); an infinite multiplier gives 3, or 0 if negative."""
    t = F.col("__lam") * F.col("__size") / F.col("__mean")
    return F.when(F.col("__lam") == math.inf, F.lit(float(MOST))).when(F.col("__lam") == -math.inf, F.lit(0.0)).otherwise(MOST / (1.0 + (MOST - 1.0) * F.exp(-F.greatest(F.least(t, F.lit(700.0)), F.lit(-700.0)))))


def _level() -> Column:
    """Rate and draw, whose whole part is the number of copies before a shift."""
    return F.floor(_rate() * F.lit(float(1 << ONE))).cast("long") + _draw(1)


def _fits(r: int) -> Column:
    return (F.col("__copies") < MOST) & (F.col("__size") > 0) & (F.col("__size") <= F.col(f"__gap{r}"))


class Mix:
    """A fitted mix: one row of parameters per source."""

    def __init__(self, spark, params: dict[str, dict], rounds: int):
        self.spark, self.params, self.rounds, self.jobs = spark, params, rounds, 0

    def table(self) -> DataFrame:
        rows = [{"__key": k, **{f"__{n}": x for n, x in v.items()}} for k, v in sorted(self.params.items())]
        fields = [("__key", pa.string()), ("__source_size", pa.int64()), *((f"__{n}", pa.float64()) for n in ("target", "mean", "lam")), ("__shift", pa.int64()), *((f"__{n}{r}", kind) for r in range(self.rounds) for n, kind in (("gap", pa.float64()), ("part", pa.int64())))]
        return self.spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema(fields)))

    def join(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with __key) and its source's parameters."""
        return rows.join(self.table(), "__key")

    def apply(self, rows: DataFrame, rounds: int | None = None) -> DataFrame:
        """``rows`` (with __id, __key, __size), its source's parameters and __copies, after ``rounds`` of single copies or all.

        Each round is a projection of its own: one expression of all would double with every round."""
        shifted = F.shiftright(_level() + F.col("__shift"), ONE)
        out = self.join(rows).withColumn("__copies", F.greatest(F.lit(0), F.least(F.lit(MOST), shifted)).cast("long"))
        for r in range(self.rounds if rounds is None else rounds):
            out = out.withColumn("__copies", F.col("__copies") + (_fits(r) & (_draw(2 + r) < F.col(f"__part{r}"))).cast("long"))
        return out

    def collect(self, found: DataFrame) -> dict[str, dict]:
        """The rows of ``found``, at most one per source, by source."""
        self.jobs += 1
        if self.jobs % 4 == 0:
            release(self.spark)
        return {r["__key"]: r.asDict() for r in found.collect()}


def _newton(rows: DataFrame, mix: Mix, steps: int = 60) -> None:
    """Set each source's multiplier; ``rows`` are (__key, __size, __n documents)."""
    size, rate, n = F.col("__size"), F.col("__rate"), F.col("__n")
    bracket = {k: [-math.inf, math.inf] for k, p in mix.params.items()}
    open_ = set()
    for k, p in mix.params.items():
        p["lam"] = math.inf if p["target"] >= MOST * p["source_size"] else 0.0
        if 0 < p["target"] < MOST * p["source_size"]:
            open_.add(k)
    for _ in range(steps):
        if not open_:
            return
        rated = mix.join(rows).withColumn("__rate", _rate())
        found = mix.collect(rated.groupBy("__key").agg(F.sum(n * size * rate).alias("got"), F.sum(n * size * size / F.col("__mean") * rate * (1 - rate / MOST)).alias("slope")))
        for k in sorted(open_):
            p, lam, (lo, hi) = mix.params[k], mix.params[k]["lam"], bracket[k]
            miss = found[k]["got"] - p["target"]
            if abs(miss) <= 1e-7 * p["target"]:
                open_.discard(k)
                continue
            lo, hi = (lo, lam) if miss > 0 else (lam, hi)
            bracket[k] = [lo, hi]
            new = lam - miss / found[k]["slope"] if found[k]["slope"] > 0 else math.nan
            new = max(lam - 8, min(lam + 8, new)) if not math.isnan(new) else math.nan
            if not lo < new < hi:
                new = (lo + hi) / 2 if math.isfinite(lo + hi) else (2 * lam + 1 if miss < 0 else 2 * lam - 1)
            new = float(f"{new:.12g}")
            if new == lam:
                open_.discard(k)
            p["lam"] = new


def _search(needs, mix: Mix, keys: set[str], name: str, room: str, low: int, width: int) -> dict[str, int]:
    """Set parameter ``name`` of each source as far up from ``low`` as the words that it admits fit its ``room``; those words.

    ``needs()`` has rows (parameters, __size, __need): so many words are admitted from the value __need on. Each pass sums
    them in ``2^BITS`` bins of the range, which is 2^width and in the next pass one bin."""
    got: dict[str, int] = {}
    for k in keys:
        mix.params[k][name] = low
    for p in range(1, PASSES + 1):
        bits = width - p * BITS
        at = F.greatest(F.lit(0), F.shiftright(F.col("__need") - F.col(f"__{name}") + F.lit((1 << bits) - 1), bits))
        bins = needs().select("__key", F.col(room).alias("__room"), "__size", at.alias("__bin")).where(F.col("__bin") <= 1 << BITS)
        bins = bins.groupBy("__key", "__room", "__bin").agg(F.sum("__size").alias("__words"))
        words = bins.withColumn("__words", F.sum("__words").over(Window.partitionBy("__key").orderBy("__bin")))
        fits = F.col("__words") <= F.col("__room")
        found = mix.collect(words.groupBy("__key").agg(F.min(F.when(~fits, F.col("__bin"))).alias("over"), F.max(F.when(fits, F.col("__words"))).alias("got")))
        for k in keys:
            over = found[k]["over"] if k in found else None
            mix.params[k][name] += max(0, (1 << BITS if over is None else over - 1)) << bits
            got[k] = found[k]["got"] or 0 if k in found else 0
    return got


def fit_mix(rows: DataFrame, fills: int = 4, near: float = 1e-3) -> Mix:
    """Parameters for ``rows`` (__id, __key, __size; read many times, so stored)."""
    by_size = store(rows.groupBy("__key", "__size").agg(F.count("*").alias("__n")), "by_size")
    found = by_size.groupBy("__key").agg(F.sum(F.col("__n") * F.col("__size")).alias("size"), F.sum("__n").alias("n")).collect()
    sizes = {r["__key"]: int(r["size"]) for r in found}
    goal = targets(sizes)
    mix = Mix(rows.sparkSession, {r["__key"]: {"source_size": sizes[r["__key"]], "target": goal[r["__key"]], "mean": max(1.0, sizes[r["__key"]] / r["n"]), "lam": 0.0, "shift": 0} for r in found}, 0)
    if not found:
        return mix
    _newton(by_size, mix)
    keys = {k for k, p in mix.params.items() if math.isfinite(p["lam"]) and p["target"] > 0}

    def copies() -> DataFrame:
        nth = mix.join(rows).withColumn("__level", _level()).withColumn("__nth", F.explode(F.array(*(F.lit(c) for c in range(1, MOST + 1)))))
        return nth.withColumn("__need", F.shiftleft(F.col("__nth").cast("long"), ONE) - F.col("__level"))

    got = _search(copies, mix, keys, "shift", "__target", -(1 << ONE), ONE + 1) if keys else {}
    for r in range(fills):
        short = {k for k in keys if mix.params[k]["target"] - got[k] > near * mix.params[k]["target"]}
        if not short:
            break
        for k, p in mix.params.items():
            p[f"gap{r}"], p[f"part{r}"] = (p["target"] - got[k] if k in short else 0.0), 0
        mix.rounds = r + 1
        added = _search(lambda r=r: mix.apply(rows, r).where(_fits(r)).withColumn("__need", _draw(2 + r) + 1), mix, short, f"part{r}", f"__gap{r}", 0, ONE)
        for k in short:
            got[k] += added[k]
    return mix


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with __id, __key and __size (its number of words)."""
    return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": source_key(F.col("source")), "__size": F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")})


def mix_plan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies, taken."""
    rows = store(sized(docs).select("__id", "__key", "__size"), "sizes")
    out = fit_mix(rows).apply(rows)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    rows = sized(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text"))
    mix = fit_mix(store(rows.select("__id", "__key", "__size"), "sizes"))
    taken = mix.apply(rows.select("row", "__id", "__key", "__size")).where(F.col("__copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")
