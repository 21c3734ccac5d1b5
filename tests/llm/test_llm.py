"""The ten operators against plain versions on small tables: nulls, empty texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import dataclasses
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabweave.llm import exact, minhash, mixing, packing, quality, rules, secrets, stats, substrings, tokenfiles, tokens, toxicity
from tabweave.llm.textarrays import Texts, mix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def words(text):
    return WORD.findall((text or "").encode())


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = sentence(rng, 40)
    texts = [None, "", " \n\t", "a b c", "a b c", "ab c", "é ñ x", "word " * 400]
    texts += [sentence(rng, rng.choice([5, 12, 13, 60, 300])) for _ in range(40)]
    texts += [t + "  " for t in texts[10:14]] + [texts[15] + " tail"] * 2
    texts += [sentence(rng, 20) + " " + passage + " " + sentence(rng, 15) for _ in range(12)]
    base = sentence(rng, 120).split()
    for k in range(12):
        near = list(base)
        near[k * 7] = f"edit{k}"
        texts.append(" ".join(near))
    texts.append(sentence(rng, 30_000, 5_000))
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}" if i % 2 else "hot", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[20], (None, texts[20], "en", "s1", 1, "x", "y"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_arrays_match_split(corpus):
    texts = [r[1] for r in corpus]
    t = Texts.of(pa.array(texts, pa.string()))
    spans = t.words()
    got = [bytes(t.data[a:b]) for a, b in zip(spans.starts, spans.ends, strict=True)]
    assert got == [w for x in texts for w in words(x)] and spans.counts.tolist() == [len(words(x)) for x in texts]
    by_hash = {}
    assert all(by_hash.setdefault(int(h), w) == w for h, w in zip(spans.hashes(), got, strict=True)) and len(by_hash) == len(set(got))
    long = Texts.of(pa.array(["x" * (1 << 20) + " y", "x" * (1 << 20)])).words().hashes()
    assert long[0] == long[2] != long[1]


def test_structured_words_do_not_collide():
    """Thue-Morse words and their mirror images, words of one letter and of repeated blocks, under both seeds."""
    made = set()
    for k in range(1, 13):
        w = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << k))
        made |= {w, w.translate(str.maketrans("ab", "ba")), "a" * (1 << k), "b" * (1 << k), "ab" * (1 << (k - 1)), "a" * ((1 << k) - 1) + "b", "b" + "a" * ((1 << k) - 1)}
    made = sorted(made)
    spans = Texts.of(pa.array([" ".join(made), " ".join(made[::-1])])).words()
    for seed in (0, 1):
        h = spans.hashes(seed)
        assert len(set(h.tolist())) == len(made) and h[: len(made)].tolist() == h[len(made) :][::-1].tolist()
    assert not set(spans.hashes(0).tolist()) & set(spans.hashes(1).tolist())


@pytest.mark.parametrize(("bits", "block"), [(64, 64), (64, 3), (2, 1)])
def test_exact(docs, corpus, bits, block, monkeypatch):
    """Also with every key treated as hot, and with eight blocks of one byte in 16 fingerprints, which collide under the first seed."""
    if block == 3:
        whole = exact.join_unique
        monkeypatch.setattr(exact, "join_unique", lambda rows, unique, keys, n: whole(rows, unique, keys, n, share=10**9, least=2))
    if bits == 2:
        docs, corpus = docs.where("doc_id < 7"), [r for r in corpus if r[0] is not None and r[0] < 7]
        assert exact._block_names(docs, block, bits)[1] > 0
    out = exact.exact_duplicates(docs, block=block, bits=bits).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    assert len(out) == len(corpus)
    kept = collections.Counter(r["text_sha256"] for r in out if r["kept"])
    for norm, members in groups.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        rows = [r for r in out if r["text_sha256"] == sha]
        best = min(members)
        assert len(rows) == len(members) and kept[sha] == 1 and {r["group_size"] for r in rows} == {len(members)} and {r["keep_id"] for r in rows} == {None if best[1] else best[2]}


def test_exact_stage_and_empty(docs, empty, corpus):
    left = exact.drop_copies(docs)
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in corpus]
    assert left.columns == docs.columns and left.count() == len(set(norm)) and exact.drop_copies(empty).count() == 0 and exact.exact_duplicates(empty).count() == 0
    clash = exact.drop_copies(docs.withColumnsRenamed({"kept": "__sha", "score": "__keep_id"}))
    assert clash.count() == len(set(norm)) and {r["__sha"] for r in clash.collect()} == {"x"}


def test_mixing(docs, empty, corpus):
    out = mixing.mix_plan(docs).collect()
    assert len(out) == len(corpus) and sum(r["size"] for r in out) == sum(len(words(r[1])) for r in corpus)
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3 for r in out)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_plan(docs).collect()), key=str)
    rows = mixing.mix_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in out)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_rows(empty).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randrange(1, 80)), f"s{min(i % 9, 3)}") for i in range(900)]
    out = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {}
    for r in out:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by)) and all(abs(sum(v) - t) <= 0.01 * t for (_, t), v in by.items())
    assert mixing.targets({"0a": 10, "0b": 1000}) == {"0a": 30.0, "0b": 980.0}


def test_mixing_multipliers_are_a_plain_solution(spark):
    """Each source's multiplier against bisection over its documents; every document of the plan within its bound."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.choice([0, 1, 7, 40, 200])), rng.choice("aab") if i % 3 else None) for i in range(400)]
    sized = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    mix = mixing.fit_mix(sized.select("__id", "__key", "__size"))
    of = collections.defaultdict(list)
    for _, t, s in rows:
        of["1" if s is None else "0" + s].append(len(words(t)))
    goal = mixing.targets({k: sum(v) for k, v in of.items()})
    for k, sizes in of.items():
        mean = sum(sizes) / len(sizes)
        total = lambda lam: sum(3 * x / (1 + 2 * math.exp(-max(-700, min(700, lam * x / mean)))) for x in sizes)
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < goal[k] else (low, mid)
        assert mix.params[k]["target"] == pytest.approx(goal[k]) and mix.params[k]["lam"] == pytest.approx(low, abs=1e-4)


def test_mixing_plans_grow_with_rounds_not_double(spark):
    """The driver holds and compiles these plans; as one nested expression, copies doubled with every round."""
    rows = spark.createDataFrame([(i, "0a", 5) for i in range(40)], "__id long, __key string, __size long").repartition(2)

    def mix(rounds):
        own = {f"{n}{r}": x for r in range(rounds) for n, x in (("gap", 5.0), ("part", 0))}
        return mixing.Mix(spark, {"0a": {"source_size": 200, "target": 200.0, "mean": 5.0, "lam": 0.0, "shift": 0, **own}}, rounds).apply(rows)

    length = [len(mix(n).select("__copies")._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 4, 8)]
    assert length[2] - length[1] < 2.5 * (length[1] - length[0])
    assert mix(8).agg({"__copies": "sum"}).first()[0] == mix(0).agg({"__copies": "sum"}).first()[0]


def test_mixing_searches_are_short(spark):
    """Shift and fills against a plain search over every document; two jobs for each of them."""
    rng = random.Random(8)
    rows = [(i, f"0{'abc'[i % 3]}", rng.choice([0, 1, 30, 400])) for i in range(300)]
    table = spark.createDataFrame(rows, "__id long, __key string, __size long").repartition(3)
    mix = mixing.fit_mix(table)
    out = mix.join(table).select("__id", "__key", "__size", "__target", mixing._level().alias("level"), mixing._draw(2).alias("draw")).collect()
    copies = {r["__id"]: r["__copies"] for r in mix.apply(table).collect()}
    taken = lambda rows, shift: sum(r["__size"] * max(0, min(3, r["level"] + shift >> 40)) for r in rows)
    for k, p in mix.params.items():
        own = [r for r in out if r["__key"] == k]
        if p["lam"] < math.inf:
            assert taken(own, p["shift"]) <= p["target"] < taken(own, p["shift"] + (1 << 25))
            if p.get("gap0"):
                assert p["gap0"] == p["target"] - taken(own, p["shift"])
                fits = [r for r in own if 0 < r["__size"] <= p["gap0"] and r["level"] + p["shift"] >> 40 < 3]
                added = lambda part: sum(r["__size"] for r in fits if r["draw"] < part)  # noqa: B023, E731
                assert added(p["part0"]) <= p["gap0"] and (added(p["part0"] + (1 << 24)) > p["gap0"] or p["part0"] >= 1 << 40)
        assert sum(r["__size"] * copies[r["__id"]] for r in own) <= p["target"] + 1e-6
    assert mix.jobs <= 12 + 2 + 2 * mix.rounds


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, "a b c", "s", "mine", i) for i in range(20)]
    out = mixing.mix_rows(spark.createDataFrame(rows, "doc_id long, text string, source string, __size string, __copies int"))
    assert out.columns == ["doc_id", "text", "source", "__size", "__copies"] and {(r["__size"], r["__copies"] - r["doc_id"]) for r in out.collect()} == {("mine", 0)}


@functools.cache
def _library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def _ids(text, end):
    return _library().encode(text or "", add_special_tokens=False).ids + [end]


def test_encoder_matches_library():
    odd = ["", "a\x1cb", "don't I'LL 3rd ½ x² Σας İx <|endoftext|> <|endoftext|>y <|x", "日本 text　z", "it's ok", "ÀÉ ǅ ª º ﬁ", "a\r\n\n b\tc", "é café"]
    enc = tokens.Encoder(tokens.default_tokenizer(), most_words=3, most_pieces=3)
    for part in (odd, odd[::-1], odd):
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode_batch(part)] == [_ids(t, 0)[:-1] for t in part]


def test_encoder_sends_pieces_once():
    """New pieces go to the library as one string, a full cache keeps what is met again, and the ids are the library's."""
    enc, sent, calls = tokens.Encoder(tokens.default_tokenizer(), most_words=50, most_pieces=50), collections.Counter(), []
    assert enc.encode_batch([]) == []
    library = enc.piece

    class Counting:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            sent.update(x for t in texts for x in t.split("\n"))
            return library.encode_batch_fast(texts, **options)

    enc.piece = Counting()
    for k in range(30):
        texts = [f"  often the,same {' '.join(f'w{k}x{i}, q{chr(97 + i)}{chr(97 + k % 26)}... Σ{i} ΩΑΣ Σ{i}' for i in range(20))}\t\n", "", " ", f"often{k} </w> often the,same <|x"]
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode_batch(texts)] == [_ids(t, 0)[:-1] for t in texts]
    assert sent["often"] == sent["same"] == 1 and len(sent) > 400 and set(calls) == {1}


def test_encoder_matches_library_on_every_character():
    """U+0020 to U+024F alone, before, after and between letters, digits and marks."""
    enc = tokens.Encoder(tokens.default_tokenizer())
    assert enc.by_word
    texts = [f"{c} a{c} {c}b a{c}b A{c}{c}9 3{c} .{c}x it{c}s {c}'LL" for c in map(chr, range(0x20, 0x250))]
    for c, ids, text in zip(range(0x20, 0x250), enc.encode_batch(texts), texts, strict=True):
        assert np.frombuffer(ids, enc.dtype).tolist() == _ids(text, 0)[:-1], hex(c)


def test_packing(docs, empty, corpus):
    pieces = packing.pack_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r), by_seq[r["sequence_id"]].append(r)
    for i, text in {r[0]: r[1] for r in corpus if r[0] is not None}.items():
        ids, at = _ids(text, 1), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and len({(r["tier"], r["step_group"]) for r in seq}) == 1 and (at == seq[0]["tier"] or seq[0]["tier"] == 2048)
    assert packing.pack_documents(empty).count() == 0 and packing.pack_documents(docs).where("doc_id is null").count() >= 2


def test_pack_lengths():
    for seed in range(5):
        lengths = np.random.default_rng(seed).integers(1, 6000, 300)
        p = packing.pack(lengths)
        filled = np.bincount(p["sequence"], p["length"])
        assert np.bincount(p["doc"], p["length"], 300).tolist() == lengths.tolist() and filled.max() <= 2048
        waste = sum(2048 - f for f in filled.astype(int).tolist() if f & (f - 1))
        assert waste <= 0.02 * lengths.sum()
        groups = packing.step_groups(p["sequence"], p["length"], p["tier"], 16)
        assert len(groups) == len(p["sequence"])


def test_pack_just_above_half():
    """Documents of about 1,100 ids only: they fill each other's gaps, and gaps go on to the next batch."""
    rng, gaps, used, n = np.random.default_rng(1), np.zeros(0, np.int64), 0, 0
    for _ in range(4):
        lengths = rng.integers(1025, 1200, 301)
        p = packing.pack(lengths, gaps=gaps)
        assert np.bincount(p["doc"], p["length"]).tolist() == lengths.tolist()
        for q, g in enumerate(gaps):
            own = p["sequence"] == -1 - q
            assert p["length"][own].sum() == g and p["offset"][own].min() == 2048 - g
        gaps, used, n = p["open_size"], used + lengths.sum(), n + p["sequence"].max() + 1
    assert n == -(-used // 2048) and gaps.sum() == n * 2048 - used


def test_pack_tiers():
    """Each tier's windows are opened by its own documents and filled to the end by shorter ones."""
    p = packing.pack(np.array([1500] * 3 + [700] * 4 + [300] * 9 + [90] * 60 + [5] * 700))
    for t in (2048, 1024, 512, 128):
        first = (p["tier"] == t) & (p["offset"] == 0) & (p["length"] > t // 2)
        assert first.any()
        assert all(p["length"][p["sequence"] == q].sum() == t for q in p["sequence"][first])


def test_token_files(docs, empty, corpus):
    shards = tokenfiles.write_shards(docs, shard_tokens=500, partitions=3)
    out = tokenfiles.read_shards(shards).collect()
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(out) == len(rows)
    at, got = 0, sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    want = {r[0]: _ids(r[1], 2) for r in rows if r[0] is not None}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert (r["n_tokens"], r["ids_crc32"]) == (len(want[r["doc_id"]]), zlib.crc32(np.array(want[r["doc_id"]], "<u4").tobytes()))
    nulls = sorted((t or "" for i, t, *_ in corpus if i is None), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is None] == [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in (_ids(t, 2) for t in nulls)]
    assert tokenfiles.read_shards(tokenfiles.write_shards(empty)).count() == 0
    every = [x for r in got for x in (want[r["doc_id"]] if r["doc_id"] is not None else _ids(nulls[r["start"] > 0], 2))]
    some = [2, every[5], 10**6]
    assert dict(map(tuple, tokenfiles.count_ids(shards, some).collect())) == {i: every.count(i) for i in some}
    assert sorted(r["place"] for r in tokenfiles.places_of(shards, some[1]).collect()) == [k for k, x in enumerate(every) if x == some[1]]


def test_wavelet_matrix(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CHUNK", 512)
    for n in (0, 1, 511, 512, 513, 4000):
        x = np.random.default_rng(n).integers(0, 60, n).astype(np.uint16)
        w = tokenfiles.WaveletMatrix(tokenfiles.WaveletMatrix.build(x, 16))
        assert (w.decode() == x).all() and all(w.access(i) == x[i] for i in range(0, n, 97))
        for v in (0, 7, 59, 60_000):
            places = np.flatnonzero(x == v)
            assert w.count(v) == len(places) and w.count(v, n // 3, n) == (x[n // 3 :] == v).sum() and [w.select(v, k) for k in range(min(4, len(places)))] == places[:4].tolist()
        for bad in (lambda: w.select(61, 0), lambda: w.access(n), lambda: w.access(-1)):
            with pytest.raises(IndexError):
                bad()
    w = tokenfiles.WaveletMatrix(w.payload.tobytes())
    w.access(1000)
    assert len(w.open) == 16  # one chunk of each plane is unpacked
    with pytest.raises(ValueError):
        tokenfiles.WaveletMatrix(b"nothing of this kind....")


def test_substrings(docs, empty, corpus):
    first = {}
    for i, t, *_ in sorted((r for r in corpus if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = substrings.clean(docs).collect()
    assert len(out) == len(corpus)
    text = {r[0]: r[1] for r in corpus if r[0] is not None}
    for r in out:
        w = words(text[r["doc_id"]]) if r["doc_id"] is not None else None
        if w is None:
            assert r["n_removed"] == 0
            continue
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r["doc_id"] for p in range(k, k + 13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert sum(r["n_removed"] for r in out) > 400 and substrings.clean(empty).count() == 0


def test_substring_filter_that_is_full_loses_nothing(docs):
    one, two = (sorted(map(str, substrings.clean(docs, most_bits=b).drop("kept_text").collect())) for b in (1 << 15, 1 << 30))
    assert one == two


def _classes(rows, least=0.8):
    sets, ids = {}, sorted({r[0] for r in rows if r[0] is not None})
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if sum((sets[a] & sets[b]).values()) >= least * sum((sets[a] | sets[b]).values()):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_minhash(docs, empty, corpus):
    want = _classes(corpus)
    out = minhash.near_classes(docs).collect()
    assert len(out) == len(corpus) and {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None} == want
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} - {None} == set(want.values()) and minhash.near_classes(empty).count() == 0


def test_minhash_chain_inside_a_bucket(spark, monkeypatch):
    """A chain of near copies, each near its neighbours only, in blocks of two or three members: no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng, rows = random.Random(5), []
    base = sentence(rng, 100, 10**6).split()
    for i in range(25):
        rows.append((i, " ".join(base)))
        base[(4 * i) % 100] = f"e{i}"
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _classes(rows)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    true, same = np.minimum(a, b).sum() / np.maximum(a, b).sum(), []
    for seed in range(30):
        key = mix(np.arange(60, dtype=np.uint64) + np.uint64(1000 * seed))
        s = minhash.signatures(2, np.repeat([0, 1], 60), np.concatenate((key, key)), np.concatenate((a, b)))
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - true) < 0.03


def test_secrets(spark, docs, empty):
    key = "".join(random.Random(2).choices(secrets.ALPHABET[:62], k=40))
    cases = {
        1: "password=abcdef and token: '12345' API_KEY = \"x/y+z.=-9\"", 2: "AKIA" + "A" * 16 + " AKIA" + "B" * 15, 3: "é" + "0123456789abcdef" * 2 + "g", 4: f"see {key} now", 5: None, 6: "", 7: "the quick brown fox wordwordwordwordwordwordword",
        8: "secret=secret=abcdef", 9: 'token = "' + "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae" + '"',
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    samples = secrets.default_samples(spark, 8000)
    model = secrets.fit_markov(samples)
    assert model.false_share < 0.01 and model.missed_share < 0.01
    found = {r["doc_id"]: r for r in secrets.digest(secrets.scan(df, model=model)).collect()}
    assert found[1]["spans"] == "assign:0:15,assign:35:55" and (found[1]["n_assign"], found[2]["n_access"], found[3]["n_hex"]) == (2, 1, 1)
    assert found[2]["spans"].startswith("access:0:20") and found[3]["spans"] == "hex:1:33" and found[4]["spans"] == "markov:4:44" and found[5]["spans"] == found[6]["spans"] == found[7]["spans"] == ""
    assert found[8]["spans"] == "assign:0:20" and found[9]["spans"] == "assign:0:49,hex:9:49" and found[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert {r["doc_id"]: r["text"] for r in secrets.mask(df, model=model).collect()}[4] == "see [SECRET] now"
    assert secrets.scan(docs, samples).count() == docs.count() and secrets.scan(empty, samples).count() == 0
    # a key that the corpus repeats is still random: long runs do not train the ordinary model
    again = spark.createDataFrame([(i, f"see {key} now") for i in range(50)], "doc_id long, text string")
    assert secrets.digest(secrets.scan(again, samples)).where("spans <> 'markov:4:44'").isEmpty()


def test_secret_model_separates(spark):
    """Ordinary long strings of many kinds stay, keys of every usual alphabet are found whole, inside paths and settings too."""
    model = secrets.fit_markov(secrets.default_samples(spark))
    ordinary = [
        "/usr/local/lib/python3/dist/packages", "com/example/project/service/UserServiceImpl2", "XMLHttpRequestEventTargetFactoryBean", "2024010120240102202401032024", "getUserAccountBalanceFromDatabaseConnection", "=" * 37,
        "org.apache.commons.lang3.StringUtils", "the_quick_brown_fox_jumps", "antidisestablishmentarianism", "A" * 30, "2024-01-01/2024-02-03/backup.tar.gz", "0" * 25 + "1", "MAX_CONNECTIONS_PER_HOST_LIMIT",
    ]
    for text in ordinary:
        assert [x for x in secrets.find_spans(f"a {text}, b", model)[1] if x[2] == "markov"] == [], text
    rng = random.Random(8)
    for alphabet in (secrets.ALPHABET[:62], secrets.ALPHABET[:64], secrets.ALPHABET[:62] + "-_", secrets.ALPHABET[26:62]):
        for n in (24, 32, 48):
            key = "".join(rng.choices(alphabet, k=n))
            assert secrets.find_spans(f"a {key}, b", model)[1] == [(2, 2 + n, "markov")], key
    key = "".join(rng.choices(secrets.ALPHABET[:62], k=32))
    assert secrets.find_spans(f"https://host.example/path/to/{key}", model)[1] == [(29, 61, "markov")]


def test_base_spans_match_a_plain_scan():
    """Random texts over the patterns' own characters, against each pattern as the contract words it."""
    rng = random.Random(4)
    bits = ["password", "PassWd", "secret", "tokenToken", "api_key", "APIkey", "apikey", '"', "'", " ", "  ", ":", "=", "x", "AKIA", "AKIA" + "A9" * 8, "0123456789abcdef" * 2, "abcdef", "é", "\n", "/+_.-", "A" * 7, "9" * 12]
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        want = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.base_spans(text) == [(a, b, kind) for a, _, b, kind in sorted(want)] == secrets.find_spans(text, None)[0]


def test_counts(docs, corpus):
    got = collections.Counter(tuple(r) for r in stats.with_counts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = collections.Counter()
    for i, t, *_ in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = {g for g, n in collections.Counter(grams).items() if n > 1}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len({p for k, g in enumerate(grams) if g in often for p in (k, k + 1, k + 2)})] += 1
    assert got == want


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 5 == 0, i % 4 == 0
        w = sentence(rng, rng.randrange(60, 120), 3000).split()
        if bad:
            w = [x + rng.choice(["###", "$$$"]) for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["blorfex", "blorfing", "grumpt", "Blorfed"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _accuracy(out, labels, column, label):
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = [r for r in out.collect() if "held_out" not in out.columns or r["held_out"]]
    assert all(("score" not in out.columns) or 0 <= r["score"] <= 1 for r in rows)
    return sum(int(r[column]) == truth[r["doc_id"]] for r in rows) / len(rows)


def test_quality_and_rules(labelled, docs, empty):
    data, labels = labelled
    assert _accuracy(quality.score_quality(data, labels), labels, "predicted", "quality") > 0.95
    assert _accuracy(rules.judge(data, labels), labels, "kept", "quality") > 0.95
    none = labels.limit(0)
    for f in (quality.score_quality, rules.judge):
        assert f(docs, none).count() == docs.count() and f(empty, labels).count() == 0
    assert rules.judge(docs, none).where("n_words < 50 and kept").count() == 0


def _plain_ridge(data, labels):
    """Weights and calibration curve from all rows in one place."""
    import pandas as pd

    counts = stats.with_counts(data).toPandas().merge(labels.select("doc_id", "quality").toPandas(), on="doc_id").sort_values("doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i in counts["doc_id"]])
    x = quality.design(pa.RecordBatch.from_pandas(pd.DataFrame(counts), preserve_index=False))
    train, test, y = fold < 2, fold == 3, counts["quality"].to_numpy(float)
    fourier = quality.Fourier(x[train].mean(0), np.sqrt(np.maximum((x[train] ** 2).mean(0) - x[train].mean(0) ** 2, 1e-6)))
    z = fourier(x)
    penalty = 1e-3 * np.diag([1.0] * 256 + [0.0])
    weights = np.linalg.lstsq(z[train].T @ z[train] / train.sum() + penalty, z[train].T @ y[train] / train.sum(), rcond=None)[0]
    bins = quality.to_bin(z[test] @ weights)
    return z @ weights, quality.isotonic(np.bincount(bins, y[test], quality.BINS), np.bincount(bins, minlength=quality.BINS)), counts["doc_id"].tolist()


def test_quality_is_plain_ridge(labelled):
    """Partition sums give the raw scores of one plain fit, and every score is the curve at its bin."""
    data, labels = labelled
    raw, curve, ids = _plain_ridge(data, labels)
    model = quality.fit_quality(stats.with_counts(data), labels)
    batch = pa.RecordBatch.from_pandas(stats.with_counts(data).toPandas().sort_values("doc_id"), preserve_index=False)
    assert np.allclose(model.raw(batch), raw, atol=1e-6) and np.allclose(model.curve, curve, atol=0.05) and (np.diff(model.curve) >= -1e-12).all()
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(data, labels).collect()}
    assert np.allclose([got[i] for i in ids], model.score(batch), atol=1e-9)


def test_rules_learn_planted_conjunctions():
    """Two planted rules, one of two thresholds, and noise that no rule may follow."""
    rng = np.random.default_rng(2)
    n = 4000
    table = {s: rng.random(n) for s in rules.STATISTICS}
    a, b, c = (table[s] for s in rules.STATISTICS[1:4])
    bad = ((a > 0.8) & (b < 0.3)) | (c > 0.9)
    found = rules.learn(table, ~bad, rng.random(n) < 0.3)
    covered = np.zeros(n, bool)
    for rule in found:
        covered |= rules._covers(rule, table, n)
    assert (covered & bad).sum() >= 0.93 * bad.sum() and (covered & ~bad).sum() <= 0.01 * (~bad).sum()
    noise = rng.random(n) < 0.3
    assert rules.learn(table, ~noise, rng.random(n) < 0.3) == []


def test_rules_base_and_verdict(spark, docs, corpus, labelled):
    """base_failed from plain counts, and the conditional expression against the rules applied one after another."""
    table = stats.with_counts(docs).withColumns(stats.ratio_columns())
    list_ = [[rules.Condition("n_words", True, 60.0), rules.Condition("repeat_share", False, 0.5)], [rules.Condition("n_words", False, 3.0)]]
    for r in table.withColumn("kept_", rules.verdict(list_)).collect():
        assert r["kept_"] == (not (r["n_words"] >= 60 and r["repeat_share"] < 0.5) and not r["n_words"] < 3)
    for r in rules.judge(docs, labelled[1]).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_isotonic():
    assert np.allclose(quality.isotonic(np.array([0, 3, 0, 4.0]), np.array([4, 4, 0, 4.0])), [0, 0.75, 0.875, 1]) and np.allclose(quality.isotonic(np.array([4, 0.0]), np.array([4, 4.0])), 0.5)


def _kneser_ney(texts, toxic, text, d=0.75, share=0.01):
    """A text's evidence, counted plainly."""
    letters = lambda t: re.findall(r"[^\W\d_]+", t.lower())

    def steps(w):
        w = (w.encode() + b"\0")[:16]
        return [(w[:i], w[i : i + 1]) for i in range(len(w))]

    own, grams = [collections.Counter(), collections.Counter()], set()
    for t, y in {(t, y) for t, y in zip(texts, toxic, strict=True)}:
        for w in letters(t):
            own[y].update(steps(w))
            grams |= {(b"\0" + c + x)[-6:] for c, x in steps(w)}
    seen, kinds = ([collections.Counter(), collections.Counter()] for _ in range(2))
    for y in (0, 1):
        for (c, _), n in own[y].items():
            seen[y][c] += n
            kinds[y][c] += 1
    shared, around, level = {}, {}, {g for g in grams if len(g) == 6}
    for size in range(5, 0, -1):
        shared[size] = collections.Counter([g[1:] for g in level] + [g for g in grams if len(g) == size])
        around[size] = collections.defaultdict(lambda: [0, 0])
        for g, n in shared[size].items():
            around[size][g[:-1]][0] += n
            around[size][g[:-1]][1] += 1
        level = set(shared[size])
    mixed = lambda n, s, t, p: (max(n - d, 0) + d * t * p) / s if s else p
    total = length = 0
    for w in letters(text):
        logs = [0.0, 0.0]
        for c, x in steps(w):
            p, history = 1 / 256, b"\0" + c
            for size in range(1, min(len(history) + 1, 5) + 1):
                g = (history + x)[-size:]
                p = mixed(shared[size][g], *around[size].get(g[:-1], (0, 0)), p)
            ordinary = mixed(own[0][c, x], seen[0][c], kinds[0][c], p)
            logs[0] += math.log(ordinary)
            logs[1] += math.log(mixed(own[1][c, x], seen[1][c], kinds[1][c], ordinary))
            length += 1
        total += math.log((1 - share) * math.exp(logs[0]) + share * math.exp(logs[1])) - logs[0]
    return total / length if length else None


def test_toxicity_is_plain_kneser_ney(spark):
    """Evidence of whole texts against plain counting, with the prefixes in one table and in three slices."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéfgh") for _ in range(rng.randrange(1, 7)))
    bad = ["zorgfex", "Zorgfing", "quumpt", "zorg", "x" * 15, "x" * 16, "x" * 40, "ÀÉx"]
    texts, toxic = [], []
    for i in range(200):
        w = [word() for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(bad)
        texts.append(", ".join(w))
        toxic.append(int(i % 4 == 0))
    texts[3] = texts[7] = texts[0]
    data = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "12 !"), (903, "the zorgfex is quumptier"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (903, None)], "doc_id long, toxic int")
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 in (0, 1)]
    model = toxicity.fit_toxicity(data, labels)
    want = {}
    for parts in (1, 3):
        rows = toxicity.with_evidence(data, dataclasses.replace(model, parts=parts), "e").collect()
        assert len(rows) == data.count()
        for r in rows[:: 1 if parts == 1 else 7]:
            t = r["text"] or ""
            if t not in want:
                want[t] = _kneser_ney([texts[i] for i in learn], [toxic[i] for i in learn], t)
            assert r["e"] is None if want[t] is None else abs(r["e"] - want[t]) < 1e-6, (parts, t)
    sliced = toxicity.fit_toxicity(data, labels, most=300)
    assert sliced.parts > 2 and np.array_equal(sliced.curve, model.curve)


def _long_word_pieces(word):
    """Pieces of a word of 16 bytes or more and its bytes that they cover, by trying every character."""
    data, seen, covered, pieces = word.encode(), [], set(), []
    for at in (len(word[:k].encode()) for k in range(len(word))):
        piece = data[at : at + 16]
        if not any(s.startswith(piece) for s in seen):
            pieces.append(piece)
            covered |= set(range(at, at + len(piece)))
        seen.append(piece)
    return pieces, len(covered)


def test_toxicity_pieces_of_long_words(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aé毒字ab1 ") for _ in range(rng.randrange(0, 90))) for _ in range(300)] + ["x" * 40, "x" * 15, "毒字典" * 30 + "毒字", "", "毒" * 5 + "é", "ab" * 16 + "é"]
    for most in (toxicity.MOST, 40, 1):
        monkeypatch.setattr(toxicity, "MOST", most)
        got, fresh, want, covered = collections.Counter(), np.zeros(len(texts), np.int64), collections.Counter(), [0] * len(texts)
        for words in toxicity.Words.of(Texts.of(pa.array(texts))):
            keys = words.keys().to_pylist()
            got.update((i, keys[k]) for i, k in zip(words.owner.tolist(), words.which.tolist(), strict=True))
            np.add.at(fresh, words.owner, words.fresh)
        for i, w in ((i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W\d_]+", t)):
            pieces, n = _long_word_pieces(w) if len(w.encode()) >= 16 else ([w.encode() + b"\0"], len(w.encode()) + 1)
            want.update((i, p) for p in pieces)
            covered[i] += n
        assert got == want and fresh.tolist() == covered
    monkeypatch.setattr(toxicity, "STRETCH", 33)  # the last stretch has half a character
    assert sum(int(w.fresh.sum()) for w in toxicity.Words.of(Texts.of(pa.array(["ab" * 16 + "é"])))) > 16


def test_toxicity_reads_texts_without_spaces(spark):
    """An expression far inside one unbroken word counts as one at its beginning does."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        w = [chr(0x4E00 + rng.randrange(300)) for _ in range(60)]
        if i % 3 == 0:
            k = rng.randrange(20, 57)
            w[k : k + 3] = rng.choice(["毒毒語", "悪悪語"])
        rows.append((i, "".join(w)))
        labels.append((i, int(i % 3 == 0)))
    data, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(data, labels)
    assert _accuracy(toxicity.score_toxicity(data, labels), labels, "predicted", "toxic") > 0.95
    inside = rows[1][1][:40] + "毒毒語" + rows[1][1][40:]
    e = {r["doc_id"]: r["e"] for r in toxicity.with_evidence(spark.createDataFrame([(1, rows[1][1]), (2, inside), (3, inside[:43])], "doc_id long, text string"), model, "e").collect()}
    assert e[2] > e[1] and e[3] > e[1]


def test_toxicity(labelled, docs, empty):
    data, labels = labelled
    assert _accuracy(toxicity.score_toxicity(data, labels), labels, "predicted", "toxic") > 0.93
    out = toxicity.drop_toxic(docs, labels.limit(0))
    assert out.columns == docs.columns and out.count() == docs.count() and toxicity.score_toxicity(empty, labels).count() == 0
    clash = toxicity.drop_toxic(docs.withColumn("__toxicity", F.lit("mine")), labels.limit(0))
    assert clash.columns == [*docs.columns, "__toxicity"] and clash.select("__toxicity").distinct().first()[0] == "mine"
