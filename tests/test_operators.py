import hmac
import random
from hashlib import sha256

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabweave.functions import messages as M
from tabweave.functions import scalars as S
from tabweave.operators import changelog, checks, health, idempotency, ids
from tabweave.plans.errors import InvalidArgument
from tabweave.plans.model import Model


def test_snowflake(spark):
    row = spark.range(1).select(ids.pack(F.lit(ids.EPOCH + 12345), F.lit(37), F.lit(0)).alias("id")).select("id", ids.time_of(F.col("id")), ids.worker_of(F.col("id")), ids.sequence_of(F.col("id"))).first()
    assert row == ((12345 << 22) | (37 << 12), ids.EPOCH + 12345, 37, 0)
    for ms, worker in ((ids.EPOCH - 1, 0), (ids.EPOCH + (1 << 41), 0), (ids.EPOCH, 1024)):
        with pytest.raises(PySparkException):
            spark.range(1).select(ids.pack(F.lit(ms), F.lit(worker), F.lit(0))).collect()


def test_sequence_spills_into_next_millisecond(spark):
    rows = spark.range(4100).select("id", F.lit(0).alias("w"), F.lit(ids.EPOCH + 2000).alias("ms")).union(spark.sql(f"SELECT 9999L, 0, {ids.EPOCH + 2001}"))
    out = {r["id"]: (r["t"] - ids.EPOCH, r["s"]) for r in ids.assign(rows, "ms", "w", ["id"], "v").select("id", ids.time_of(F.col("v")).alias("t"), ids.sequence_of(F.col("v")).alias("s")).collect()}
    assert out[4095] == (2000, 4095) and out[4096] == (2001, 0) and out[9999] == (2001, 4) and len(set(out.values())) == 4101


def test_segments(spark):
    empty = spark.createDataFrame([], "biz_tag string, max_id long, step int")
    seg = ids.init_segment(ids.init_segment(empty, "a", 100, 10), "a", 0, 5)
    assert seg.first() == ("a", 100, 5)
    rows, after = ids.allocate(spark.range(11).withColumn("biz", F.lit("a")), seg, "biz", ["id"], "new")
    assert [r["new"] for r in rows.orderBy("id").collect()] == list(range(101, 112)) and after.first()["max_id"] == 115
    end = spark.createDataFrame([("a", (1 << 63) - 2, 1)], empty.schema)
    assert ids.allocate(spark.range(1).withColumn("biz", F.lit("a")), end, "biz", ["id"], "new")[0].first()["new"] == (1 << 63) - 1
    with pytest.raises(PySparkException):
        ids.allocate(spark.range(2).withColumn("biz", F.lit("a")), end, "biz", ["id"], "new")[0].collect()
    with pytest.raises(InvalidArgument):
        ids.init_segment(empty, "a", -1)


@pytest.mark.parametrize("wide", [False, True])
def test_allocate_many_rows(spark, wide):
    """400,000 rows, four fifths of one tag, no tag and a tag without a segment among them: ids are unique, dense and complete."""
    rows = spark.range(400_000).select(F.xxhash64("id").alias("o"), F.when(F.col("id") % 5 < 4, "a").when(F.col("id") % 1000 == 999, F.lit(None)).when(F.col("id") % 1000 == 994, "new").otherwise("b").alias("tag"), "id")
    rows = rows.withColumn("pad", F.repeat(F.lit("x"), 50)) if wide else rows
    seg = spark.createDataFrame([("a", 10, 100), ("b", 20, 7), ("c", 5, 3)], "biz_tag string, max_id long, step int")
    out, after = ids.allocate(rows, seg, "tag", ["o"], "new_id")
    per = {r["tag"]: r for r in out.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("new_id").alias("d"), F.min("new_id").alias("low"), F.max("new_id").alias("high")).collect()}
    n = {r["tag"]: r["count"] for r in rows.groupBy("tag").count().collect()}
    assert {t: r["n"] for t, r in per.items()} == n and per[None]["d"] == 0
    for tag, start in (("a", 10), ("b", 20), ("new", 0)):
        assert (per[tag]["d"], per[tag]["low"], per[tag]["high"]) == (n[tag], start + 1, start + n[tag])
    before = out.alias("x").where("tag = 'b'").selectExpr("o", "new_id", "lag(o) OVER (ORDER BY new_id) AS prev")
    assert before.where("prev > o").isEmpty()
    assert {r["biz_tag"]: r["max_id"] for r in after.collect()} == {"a": 10 + 100 * -(-n["a"] // 100), "b": 20 + 7 * -(-n["b"] // 7), "c": 5, "new": 1000}


def test_assign_across_partitions(spark):
    """One worker with most rows and full milliseconds: the same slots as numbering one after another."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("w"), (F.lit(ids.EPOCH) + F.floor(F.col("id") / 9000)).alias("ms"))
    got = {r["id"]: r["v"] for r in ids.assign(rows, "ms", "w", ["id"], "v").collect()}
    last = {0: -1, 1: -1}
    for i in range(30_000):
        w = int(i % 10 == 0)
        last[w] = max(last[w] + 1, (i // 9000) * ids.PER_MS)
        assert got[i] == (last[w] // ids.PER_MS << 22) | (w << 12) | last[w] % ids.PER_MS


def _plain_breaker(rows, threshold=3):
    failures = until = 0
    for t, ok in rows:
        if ok:
            failures = until = 0
        elif (until > 0 and t >= until) or failures + 1 >= threshold:
            failures, until = 0, t + health.EJECTION_NS
        else:
            failures += 1
    return failures, until


def test_folds_of_a_hot_key(spark):
    """A key with most rows lies in every partition; one that never succeeds is never forgotten; both are exact."""
    rng = random.Random(4)
    rows = [(k, i, rng.randrange(10**9) if rng.random() < 0.9 else rng.randrange(50), i * 4_000_000_000, k != "never" and rng.random() < 0.2, rng.choice("xy")) for i in range(3000) for k in ("hot", "never", f"k{i % 7}") if k != "never" or i < 900]
    df = spark.createDataFrame(rows, "k string, o int, ns long, t long, ok boolean, e string").repartition(5)
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    average, carried = {}, {}
    for k, rs in by.items():
        a, c, end = health.START_NS, health.START_NS, None
        for r in rs:
            a = int(0.8 * a + 0.2 * r[2])
            c, end = int(0.8 * (c if end == r[5] else health.START_NS) + 0.2 * r[2]), r[5]
        average[k], carried[k] = a, (end, c)
    assert dict(map(tuple, health.ewma(df, ["k"], "o", "ns").collect())) == average
    assert {r["k"]: (r["endpoint"], r["ewma"]) for r in health.carry_over(df, ["k"], "o", "e", "ns").collect()} == carried
    assert {r["k"]: (r["failures"], r["ejected_until"]) for r in health.breaker(df, ["k"], "o", "t", F.col("ok")).collect()} == {k: _plain_breaker([(r[3], r[4]) for r in rs]) for k, rs in by.items()}


def test_worker_lease(spark):
    w = spark.createDataFrame([(0, 100), (1, 90), (2, 40_000)], "worker_id int, updated_at long")
    assert ids.lease_candidate(w, 20_000).first() == (1, True) and ids.lease_candidate(w, 5_000).first() == (3, False)


def test_changelog_guards(spark):
    changes = spark.createDataFrame([("a", "PUT", 1, 20), ("a", "PUT", 2, 19), ("b", "PUT", 3, 21), ("b", "DELETE", 0, 22)], "k string, op string, v int, revision long")
    assert changelog.latest(changes, ["k"], "revision", "op").collect() == [("a", "PUT", 1, 20)]
    snap = spark.createDataFrame([("c", 9, 0)], "k string, v int, revision long")
    assert sorted(r["k"] for r in changelog.apply_changes(snap, 20, changes, ["k"], "revision", "op").collect()) == ["c"]


def test_instances(spark):
    cases = [("s", "i", "http://h:80", True), ("s", "i", "http://h", False), ("s", "i", "https://h:1", False), ("s", "i", "http://h:80/", False), ("s", "i", "http://u@h:80", False), ("..", "i", "http://h:1", False), ("a/b", "i", "http://h:1", False), (" ", "i", "http://h:1", False), ("s", "i", "http://[::1]:8", True)]
    df = spark.createDataFrame(cases, "s string, i string, e string, ok boolean").select("ok", changelog.valid(F.col("s"), F.col("i"), F.col("e"), F.create_map(F.lit("a"), F.lit("b"))).alias("v"))
    assert all(r["ok"] == r["v"] for r in df.collect())
    puts = spark.createDataFrame([("k", "PUT", '{"version":1,"service":"s","id":"i","endpoint":"http://h:1","metadata":{}}', 5), ("k", "PUT", "junk", 6)], "k string, op string, value string, revision long")
    state, bad = changelog.watched(puts, "value", ["k"], "revision", "op")
    assert state.first()["revision"] == 5 and bad.first() == (1, 6)


def test_health(spark):
    df = spark.createDataFrame([("a", 1, 0, 20_000_000, False), ("a", 2, 1, 30_000_000, False), ("a", 3, 2, 10, False), ("b", 1, 0, 1, False), ("b", 2, 5, 1, True)], "k string, o int, t long, ns long, ok boolean")
    e = 10_000_000
    for x in (20_000_000, 30_000_000, 10):
        e = int(0.8 * e + 0.2 * x)
    assert health.ewma(df, ["k"], "o", "ns").where("k = 'a'").first()["ewma"] == e
    assert {r["k"]: (r["failures"], r["ejected_until"]) for r in health.breaker(df, ["k"], "o", "t", F.col("ok")).collect()} == {"a": (0, 2 + health.EJECTION_NS), "b": (0, 0)}
    probe = spark.createDataFrame([("a", 1, 0, False), ("a", 2, 60_000_000_000, False)], "k string, o int, t long, ok boolean")
    assert health.breaker(probe, ["k"], "o", "t", F.col("ok"), threshold=1).first()["ejected_until"] == 60_000_000_000 + health.EJECTION_NS


def test_pick_of_two(spark):
    inst = spark.createDataFrame([("s", "a", 10, 0, 0, False), ("s", "b", 5, 0, 0, False), ("s", "c", 1, 0, 10**6, False)], "svc string, id string, ewma long, inflight int, ejected_until long, half_open boolean")
    req = spark.range(200).withColumn("svc", F.lit("s"))
    assert {r["id2"] for r in health.pick_of_two(req, inst, "id", "svc", F.lit(5)).toDF("id", "svc", "id2", "e").collect()} == {"b"}
    out = health.pick_of_two(req, inst.withColumn("ejected_until", F.col("ewma") + 100), "id", "svc", F.lit(5)).toDF("id", "svc", "id2", "e").first()
    assert out["id2"] == "c" and out["e"]


def test_pick_of_two_needs_no_draw(spark):
    """Services of one instance, of none that may be drawn but two, and of which every one is ejected."""
    inst = [("one", "a", 10, 0, 0, False), ("gone", "b", 5, 0, 10**6, False), ("gone", "c", 1, 0, 10**5, False), ("gone", "d", 1, 0, 10, True)] + [("rare", f"r{i:03d}", 100 - i, 0, 0 if i in (40, 70) else 10**6, False) for i in range(100)]
    inst = spark.createDataFrame(inst, "svc string, id string, ewma long, inflight int, ejected_until long, half_open boolean")
    req = spark.range(90).withColumn("svc", F.element_at(F.array(F.lit("one"), F.lit("gone"), F.lit("rare")), (F.col("id") % 3 + 1).cast("int")))
    got = health.pick_of_two(req, inst, "id", "svc", F.lit(5)).toDF("id", "svc", "picked", "gone").groupBy("svc", "picked", "gone").count().collect()
    assert sorted(map(tuple, got)) == [("gone", "c", True, 30), ("one", "a", False, 30), ("rare", "r070", False, 30)]


def test_token_bucket(spark):
    df = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate((0, 0, 0, 1, 1))], "k string, o int, t double")
    assert health.token_bucket(df, ["k"], "o", "t", 1.0, 2).first() == ("k", 3, 2, 0.0)


def test_idempotency(spark):
    df = spark.createDataFrame([("n", "k", 1, False), ("n", "k", 2, True), ("n", "k", 3, True), ("m", "k", 4, True), ("n", "K", 5, True), ("n", "k", 6, False)], "ns string, key string, o int, ok boolean")
    out = {r["o"]: r["outcome"] for r in idempotency.outcomes(df, "ns", "key", "o", F.col("ok")).collect()}
    assert out == {1: "rolled_back", 2: "committed", 3: "conflict", 4: "committed", 5: "committed", 6: "conflict"}
    done = spark.createDataFrame([("n", "k")], "ns string, key string")
    assert {r["o"]: r["outcome"] for r in idempotency.outcomes(df, "ns", "key", "o", F.col("ok"), done).collect()}[2] == "conflict"


def test_registry_rules(spark):
    rows = spark.createDataFrame([(0, 10_000), (0, 10_001), (1, 10_000)], "active int, now long").select(changelog.lease_alive(F.lit(7_000), 2_500, F.col("now")).alias("alive"), changelog.idle(F.col("active"), F.lit(0), F.col("now"), 10_000).alias("idle")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, True), (True, False)]
    changes = spark.createDataFrame([("a", "PUT", 1), ("b", "PUT", 2), ("a", "DELETE", 3)], "service string, op string, revision long")
    state = spark.createDataFrame([("b", 2)], "service string, revision long")
    assert changelog.statistics(changes, state, "op").first().asDict() == {"puts": 2, "deletes": 1, "revision": 3, "instances": 1, "services": 1}
    assert spark.createDataFrame([("1213",), ("1062",), (None,)], "c string").select(ids.retryable(F.col("c")).alias("r"), ids.duplicate_key(F.col("c")).alias("d")).collect() == [(True, False), (False, True), (False, False)]
    p = spark.range(5000).select(idempotency.record_partition(F.lit("n"), F.col("id").cast("string")).alias("p")).distinct().count()
    assert p == idempotency.PARTITIONS


def test_messages(spark):
    hdr = "headers array<struct<key:string,value:binary>>"
    rec = spark.createDataFrame([(2, 12, b"k", b"v", [("a", b"1"), ("a", b"2")], None), (2, 13, b"k", b"v", None, None)], f"partition int, offset long, key binary, value binary, {hdr}, timestamp timestamp")
    rows = M.from_log_records(rec).orderBy("offset").collect()
    assert rows[0]["id"] == "2:12" and rows[0]["headers"] == {"a": b"2"} and rows[1]["headers"] == {}
    dead = M.dead_letters(M.from_log_records(rec), "orders", "g", F.lit(2), F.lit("poison"), F.lit("2026-01-01").cast("timestamp")).orderBy("offset").first()
    assert dead["topic"] == "orders.dlq" and dead["headers"][M.DEAD_LETTER_PREFIX + M.DEAD_LETTER_HEADERS[2]] == b"2:12" and dead["headers"][M.DEAD_LETTER_PREFIX + M.DEAD_LETTER_HEADERS[3]] == b"2" and dead["headers"]["a"] == b"2" and len(dead["headers"]) == 7
    table = [(1, True, True, "accept"), (3, False, True, "release"), (4, False, True, "reject"), (4, False, False, "release")]
    df = spark.createDataFrame(table, "d int, ok boolean, dlq boolean, want string").select("want", M.ack_decision(F.col("ok"), F.col("d"), F.col("dlq"), 4).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_stream_codec(spark):
    raw = spark.createDataFrame([("5-0", {"v": b"1", "key": b"", "body": b"x", "headers": b"null", "timestamp": b"0"}), ("1-0", {}), ("2-0", {"v": b"2", "key": b"", "body": b"", "headers": b"", "timestamp": b"0"})], "id string, fields map<string,binary>")
    out = {r["id"]: r for r in M.decode_stream(raw).select("id", "error", "message", F.unix_millis("message.timestamp").alias("ms")).collect()}
    assert out["5-0"]["ms"] == 5 and out["5-0"]["message"]["body"] == b"x" and out["1-0"]["message"] is None and "version" in out["2-0"]["error"]
    bad = {r["id"]: r["body"] for r in M.unreadable(M.decode_stream(raw), "t", "g", F.current_timestamp()).collect()}
    assert bad["1-0"] == b"null" and b'"v":"2"' in bytes(bad["2-0"])


def test_commit_prefix(spark):
    df = spark.createDataFrame([("t", 0, 1, False), ("t", 0, 2, True), ("t", 0, 3, False), ("t", 1, 5, True), ("t", 2, 7, False)], "topic string, partition int, offset long, bad boolean")
    assert sorted(map(tuple, M.commit_prefix(df, F.col("bad")).collect())) == [("t", 0, 1), ("t", 2, 7)]


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(S.hmac_sha256(F.lit(b"key"), F.lit(b"some message"))).first()[0] == hmac.new(b"key", b"some message", sha256).hexdigest()
    assert one.select(S.hmac_sha256(F.lit(b"k" * 100), F.lit(b""))).first()[0] == hmac.new(b"k" * 100, b"", sha256).hexdigest()
    assert one.select(S.backoff_ms(F.lit(10_000), 100, 9_000)).first()[0] == 9_000 and "\n" not in one.select(S.base64_url(F.lit(b"x" * 600))).first()[0]
    assert one.select(S.base_url(F.lit(" https://a.b/c// "))).first()[0] == "https://a.b/c" and one.select(S.base_url(F.lit("ftp://a"))).first()[0] is None


def test_checks(spark):
    m = Model.of("t", ("id", "int64", "pk"), ("s", "string", "size=5"))
    assert checks.schema_differences(m, spark.range(1).withColumn("x", F.lit(1)).schema) == ["s: missing", "x: extra"]
    assert checks.duplicates(spark.createDataFrame([(1,), (1,), (None,), (None,)], "a int"), ["a"]).collect() == [(1, 2)]
    assert checks.missing_references(spark.createDataFrame([(1,), (9,), (None,)], "a int"), "a", spark.range(3), "id").collect() == [(9, 1)]
