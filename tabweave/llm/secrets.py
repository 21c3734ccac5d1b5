"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The patterns give the base spans. For what they miss, every other run of 20 or more characters of a token alphabet
(letters, digits and ``+/=_.-``) is cut at dots and scored under two second-order character models, one of random
strings and one of ordinary text and identifiers. In a piece, the row of parts between ``/`` and ``=`` with the largest
log-likelihood ratio becomes a span (kind ``markov``) when it has 20 characters and its ratio per character is above a
threshold; what is left of it on either side is tried in the same way.

The models are trained from labelled samples, a DataFrame of (value, label) with label 1 for random strings and 0 for
ordinary identifiers, three quarters of them by the hash of the value; the threshold lies half-way between the
scores that ``false_share`` of the other ordinary ones exceed and of the other random ones miss, and is at least 0. ``default_samples`` makes samples by rule: names that
the running Python's own library uses, joined as programs join them (camelCase, snake_case, paths, packages, versions,
dates, counters, rulers), and strings of a fixed generator over the usual alphabets. Besides, the ordinary model knows
the corpus: the token characters of all documents are counted by Spark, but for runs of 20 or more, which are what is
judged, and the two ordinary models count half each.
A model is a table of 69 x 69 x 69 log-ratios, whatever the corpus.

Cases: a null or empty text has no spans; offsets are code points, end exclusive; spans that start together stand in the
order of kinds; repeated rows and rows without doc_id are scanned one by one like others; other columns are not read;
an empty table gives an empty result."""

from __future__ import annotations

import importlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.shared import small_batches
from tabweave.llm.textarrays import Texts

_KEYS = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", k) for k in _KEYS)
#: Patterns, the group whose length counts, and its least length; the order is that of equal starts.
BASE = {
    "assign": (re.compile(rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_.-"
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)
_SIZE, LEAST = len(ALPHABET) + 1, 20
_LONG = re.compile(r"[A-Za-z0-9+/=_.-]{20,}")
#: Without a key word before it, an assignment or a long run cannot be there; a cheap test for most texts.
_MAYBE = re.compile(r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]|AKIA|[A-Za-z0-9+/=_.-]{20}")
_ORDINARY, _RANDOM, _CORPUS = 0, 1, 2


def _words() -> list[str]:
    """The parts of names in this Python's own library."""
    names = set(sys.stdlib_module_names)
    for module in ("argparse", "asyncio", "calendar", "email.message", "http.client", "logging", "os", "socket", "sqlite3", "ssl", "threading", "unittest", "urllib.request", "xml.dom.minidom", "zipfile"):
        found = importlib.import_module(module)
        names.update(dir(found), *(dir(getattr(found, n)) for n in dir(found) if isinstance(getattr(found, n), type)))
    return sorted({w.lower() for n in names for w in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", n) if len(w) > 1})


def ordinary_samples(spark: SparkSession, strings: int, seed: int) -> DataFrame:
    rng, words = np.random.default_rng(seed), _words()
    title = lambda ws: "".join(w.title() for w in ws)
    number = lambda: str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
    day = lambda mark: f"{rng.integers(1990, 2035)}{mark}{rng.integers(1, 13):02d}{mark}{rng.integers(1, 29):02d}"
    forms = (
        lambda ws: ws[0] + title(ws[1:]), title, "_".join, lambda ws: "_".join(ws).upper(), "-".join, lambda ws: "/" + "/".join(ws), ".".join, "".join,
        lambda ws: "/".join(ws[:-2]) + "/" + title(ws[-2:]) + number(), lambda ws: "/" + "/".join(w + number() for w in ws[:2]) + "/" + "_".join(ws[2:]), lambda ws: "XYZ"[: int(rng.integers(1, 4))] + title(ws),
        lambda ws: "-".join([*ws[:2], number(), number()]) + "." + ws[2], lambda ws: "_".join(day("") for _ in ws), lambda ws: "".join(day("") for _ in ws), lambda ws: "/".join([day("-"), *ws[:2]]),
        lambda ws: str(rng.choice(list(ALPHABET))) * int(rng.integers(20, 80)), lambda ws: ALPHABET[(k := int(rng.integers(0, 62))) :] + ALPHABET[:k], lambda ws: number().zfill(int(rng.integers(8, 30))), lambda ws: "=".join(ws[:2]) + number(),
    )
    values = [forms[i % len(forms)]([words[k] for k in rng.integers(0, len(words), rng.integers(3, 7))]) for i in range(strings)]
    return spark.createDataFrame(pa.table({"value": values, "label": pa.array([_ORDINARY] * len(values), pa.int32())}))


def random_samples(spark: SparkSession, strings: int, seed: int) -> DataFrame:
    rng = np.random.default_rng(seed)
    alphabets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", "0123456789abcdef", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62])
    values = ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(20, 65))) for i in range(strings)]
    return spark.createDataFrame(pa.table({"value": values, "label": pa.array([_RANDOM] * len(values), pa.int32())}))


def default_samples(spark: SparkSession, strings: int = 40_000, seed: int = 11) -> DataFrame:
    """(value, label): ``strings`` of either kind."""
    return ordinary_samples(spark, strings, seed).unionByName(random_samples(spark, strings, seed))


def _steps(code: np.ndarray) -> np.ndarray:
    """Every character with its two predecessors, which are 0 outside the token, as one number."""
    code = np.concatenate(([0, 0], code))
    before, last, now = code[:-2], code[1:-1], code[2:]
    step = (np.where(last > 0, before, 0) * _SIZE + last) * _SIZE + now
    return step[now > 0]


def _short_runs(code: np.ndarray) -> np.ndarray:
    """``code`` without runs of ``LEAST`` or more characters."""
    edges = np.flatnonzero(np.diff(code > 0, prepend=False, append=False))
    long = edges[1::2] - edges[::2] >= LEAST
    step = np.zeros(len(code) + 1, np.int64)
    step[edges[::2][long]] = 1
    step[edges[1::2][long]] -= 1
    return np.where(np.cumsum(step[:-1]) > 0, 0, code)


def _counted(rows: DataFrame) -> DataFrame:
    """(label, step, n) of ``rows`` (value, label), summed per task and then by Spark; at most 69 x 69 x 69 rows a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, texts in Texts.of(batch.column(0)).parts(2 << 20):
                heads = np.zeros(len(texts.data) + len(texts), np.uint8)  # a byte of no token after every value
                heads[np.arange(len(texts.data)) + np.repeat(np.arange(len(texts)), np.diff(texts.offsets))] = texts.data
                owner = np.repeat(labels[i:j], np.diff(texts.offsets) + 1)
                for label in np.unique(labels[i:j]).tolist():
                    sums = total.setdefault(label, np.zeros(_SIZE**3, np.int64))
                    code = np.where(owner == label, _CODE[heads], 0)
                    sums += np.bincount(_steps(_short_runs(code) if label == _CORPUS else code), minlength=_SIZE**3)
        for label, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int64)), pa.array(at), pa.array(sums[at])], ["label", "step", "n"])

    return rows.select(F.col("value").cast("string").alias("value"), F.col("label").cast("long").alias("label")).mapInArrow(run, "label long, step long, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))


@dataclass
class Markov:
    """Log-ratio of every step, random over ordinary, the threshold per character, and its error rates on samples kept for that."""

    steps: np.ndarray
    threshold: float = 0.0
    false_share: float = float("nan")
    missed_share: float = float("nan")

    def each(self, value: str) -> np.ndarray:
        """Log-ratio of every token character."""
        return self.steps[_steps(_CODE[np.frombuffer(value.encode("latin-1", "replace"), np.uint8)])]

    def ratio(self, value: str) -> float:
        """Log-likelihood ratio per character."""
        each = self.each(value)
        return float(each.mean()) if len(each) else 0.0


def _probabilities(counts: np.ndarray, prior: float) -> np.ndarray:
    """P(character | two before), smoothed by P(character | one before), and that by the uniform one."""
    pairs = counts.sum(0)
    one = (pairs + prior / _SIZE) / (pairs.sum(1, keepdims=True) + prior)
    return (counts + prior * one) / (counts.sum(2, keepdims=True) + prior)


def fit_markov(samples: DataFrame, docs: DataFrame | None = None, prior: float = 5.0, false_share: float = 1e-3) -> Markov:
    """Train on three quarters of ``samples`` and on all of ``docs``; set the threshold on the other quarter's strings of ``LEAST`` or more characters."""
    small_batches(samples.sparkSession)
    kept_out = F.pmod(F.xxhash64("value"), F.lit(4)) == 0
    rows = _counted(samples.where(~kept_out).select("value", "label"))
    if docs is not None:
        rows = rows.unionByName(_counted(docs.select(F.col("text").alias("value"), F.lit(_CORPUS).alias("label"))))
    counts = np.zeros((3, _SIZE**3))
    found = rows.toArrow()  # at most three tables of steps
    np.add.at(counts, (found["label"].to_numpy(), found["step"].to_numpy()), found["n"].to_numpy())
    names, random, corpus = (counts[k].reshape(_SIZE, _SIZE, _SIZE) for k in (_ORDINARY, _RANDOM, _CORPUS))
    ordinary = _probabilities(names, prior)
    # where the corpus has nothing it says what the names say
    ordinary = (ordinary + (corpus + prior * ordinary) / (corpus.sum(2, keepdims=True) + prior)) / 2
    model = Markov((np.log(_probabilities(random, prior)) - np.log(ordinary)).ravel())

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([model.ratio(v) for v in batch.column(0).to_pylist()], pa.float64())], ["label", "score"])

    tried = samples.where(kept_out & (F.length("value") >= LEAST)).select("value", F.col("label").cast("long").alias("label")).mapInArrow(scores, "label long, score double")
    quantile = lambda label, share: F.percentile_approx(F.when(F.col("label") == label, F.col("score")), F.lit(share), F.lit(100_000))
    ends = tried.agg(quantile(_ORDINARY, 1 - false_share).alias("ordinary"), quantile(_RANDOM, false_share).alias("random")).first()
    if ends["ordinary"] is not None and ends["random"] is not None:
        model.threshold = max(0.0, (ends["ordinary"] + ends["random"]) / 2)
    over = F.avg((F.col("score") > model.threshold).cast("double")).alias("over")
    rates = {r["label"]: r["over"] for r in tried.groupBy("label").agg(over).collect()}
    model.false_share, model.missed_share = rates.get(_ORDINARY, float("nan")), 1 - rates.get(_RANDOM, float("nan"))
    return model


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    for kind, (pattern, group, least) in BASE.items():
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    order = list(BASE)
    return sorted(out, key=lambda s: (s[0], order.index(s[2])))


def _random_pieces(run: str, at: int, model: Markov) -> Iterator[tuple[int, int]]:
    """Places of the random pieces of a run of token characters that starts at ``at``, in order."""
    for piece in re.finditer(r"[^.]{20,}", run):
        yield from _largest(piece[0], at + piece.start(), model)


def _largest(text: str, at: int, model: Markov) -> Iterator[tuple[int, int]]:
    """The row of parts between ``/`` and ``=`` with the largest log-likelihood ratio, if it is long and random enough; then the same on either side."""
    if len(text) < LEAST:
        return
    score = np.concatenate(([0.0], np.cumsum(model.each(text))))
    parts = [m.span() for m in re.finditer("[^/=]+", text)] or [(0, len(text))]
    low, best = parts[0][0], (-np.inf, 0, 0)
    for start, end in parts:
        low = start if score[start] < score[low] else low
        best = max(best, (score[end] - score[low], low, end))
    total, start, end = best
    if end < len(text) and not text[end:].strip("="):
        end = len(text)  # the padding of a base64 string
    if end - start >= LEAST and total > model.threshold * (end - start):
        yield from _largest(text[:start], at, model)
        yield at + start, at + end
        yield from _largest(text[end:], at + end, model)


def find_spans(text: str, model: Markov | None) -> tuple[list, list]:
    """Base spans, and all spans, of one whole text."""
    if not _MAYBE.search(text):
        return [], []
    base = base_spans(text)
    if model is None:
        return base, base
    more = []
    for m in _LONG.finditer(text):
        for a, b in _random_pieces(m[0], m.start(), model):
            if not any(a < y and x < b for x, y, _ in base):
                more.append((a, b, "markov"))
    return base, sorted(base + more, key=lambda s: (s[0], [*BASE, "markov"].index(s[2])))


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, samples: DataFrame | None = None, model: Markov | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id and ``found``, an array of (kind, start, end, value, base), in order of start."""
    small_batches(docs.sparkSession)
    model = model or fit_markov(samples if samples is not None else default_samples(docs.sparkSession), docs)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                base, spans = find_spans(text, model) if text else ([], [])
                found.append([{"kind": k, "start": a, "end": b, "value": text[a:b], "base": k != "markov"} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kinds)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,value:string,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["base"])
    of_kind = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"))


def mask(docs: DataFrame, replacement: str = "[SECRET]", samples: DataFrame | None = None, model: Markov | None = None) -> DataFrame:
    """doc_id and text with every span replaced; overlapping spans are replaced together."""
    small_batches(docs.sparkSession)
    model = model or fit_markov(samples if samples is not None else default_samples(docs.sparkSession), docs)

    def hide(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, b, _ in find_spans(text, model)[1]:
            if b > at:
                out += [text[at:a], replacement] if a >= at else []
                at = b
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hide(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")
