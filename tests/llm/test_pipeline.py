"""The pipeline on the smallest sample: each stage against a plain version of what it must do to its own input."""

import collections
import itertools
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from tabweave.llm import mixing, tokens, toxicity
from tabweave.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no sample tables")


def _near_classes(rows, least=0.8):
    """Smallest doc_id of each row's class: exact multisets of five words, all pairs."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        sets[r["doc_id"]] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a].total(), sets[b].total()
        if min(x, y) >= least * max(x, y) and (c := (sets[a] & sets[b]).total()) >= least * (x + y - c):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {root(i) for i in sets}


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        given, before = docs, docs.collect()
        docs = corpus_pipeline.store(stage(spark, docs, FOLDER), name)
        after = docs.collect()
        sizes.append(len(after))
        assert name == "packing" or docs.columns == columns
        ids = collections.Counter(r["doc_id"] for r in after)
        if name == "toxicity":
            marked = {r["doc_id"] for r in toxicity.score_toxicity(given, labels).where("predicted = 1").collect()}
            assert marked and ids.keys() == {r["doc_id"] for r in before} - marked
            truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
            clean = [i for i in (r["doc_id"] for r in before) if truth.get(i) == 0]
            assert sum(i in ids for i in clean) >= 0.97 * len(clean)
        if name == "exact_dedup":
            best = {}
            for r in before:
                k = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
                best[k] = max(best.get(k, r), r, key=lambda x: (len(x["text"]), -x["doc_id"]))
            assert ids.keys() == {r["doc_id"] for r in best.values()}
        if name == "minhash_near_dedup":
            assert ids.keys() == _near_classes(before)
        if name == "mixing":
            plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(given).collect()}
            assert ids == {i: n for i, n in plan.items() if n} and max(ids.values()) <= 3
        if name == "packing":
            enc, copies = tokens.Encoder(tokens.default_tokenizer()), collections.Counter(r["doc_id"] for r in before)
            text = {r["doc_id"]: r["text"] for r in before}
            pieces = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in after)
            taken = collections.Counter()
            for (i, start, length, crc), n in pieces.items():
                whole = np.array([*enc.whole.encode(text[i], add_special_tokens=False).ids, 1], "<u4")
                assert crc == zlib.crc32(whole[start : start + length].tobytes())
                taken[i] += n * length
                text_ids = len(whole)
                pieces_of = taken[i] / text_ids
                assert pieces_of <= copies[i]
            assert all(taken[i] == n * (len(enc.whole.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in copies.items())
    assert sizes[0] > sizes[1] > sizes[3] > 0


def test_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
