import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabweave.functions import messages as M
from tabweave.plans.errors import InvalidArgument
from tabweave.sources import resources
from tabweave.streaming import delivery, state
from tabweave.streaming.options import SubscribeOptions


def _messages(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).cast("string").cast("binary").alias("key"), F.concat(F.lit("m"), F.col("id")).cast("binary").alias("body"), F.create_map(F.lit("h"), F.lit(b"1")).alias("headers"), F.lit("2026-01-01").cast("timestamp").alias("timestamp"))


def test_subscribe_retries_and_dead_letters(spark, tmp_path):
    folder = f"{tmp_path}/topic"
    delivery.publish(_messages(spark, 6), folder)

    def handler(message):
        if message["body"] == b"m3":
            raise ValueError("poison")

    options = SubscribeOptions(max_retries=1, backoff_min_ms=1, backoff_max_ms=2)
    for _ in range(2):  # a restart finds nothing new
        q = delivery.subscribe(delivery.topic(spark, folder), "orders", "g", handler, f"{tmp_path}/cp", f"{tmp_path}/out", f"{tmp_path}/dead", options, available_now=True)
        q.awaitTermination(120)
    out = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(out) == 6 and out["3"]["calls"] == 2 and not out["3"]["ok"] and out["1"]["ok"]
    dead = spark.read.parquet(f"{tmp_path}/dead").collect()
    assert len(dead) == 1 and dead[0]["topic"] == "orders.dlq" and dead[0]["headers"][M.DEAD_LETTER_PREFIX + M.DEAD_LETTER_HEADERS[4]] == b"poison"


def test_order_is_numeric(spark):
    ids_ = ["2:9", "2:10", "10:1", "2:100", "7-2", "7-11"]
    df = spark.createDataFrame([(i,) for i in ids_], "id string").orderBy(delivery.id_order(F.col("id")))
    assert [r["id"] for r in df.collect()] == ["2:9", "2:10", "2:100", "7-2", "7-11", "10:1"]


def test_start_latest(spark, tmp_path):
    folder, o = f"{tmp_path}/topic", SubscribeOptions(start_offset="latest", max_retries=0)
    delivery.publish(_messages(spark, 3), folder)
    time.sleep(1.1)
    for n in (0, 2):
        if n:
            delivery.publish(_messages(spark, 2).withColumn("id", F.concat(F.lit("9"), "id")), folder)
        delivery.subscribe(delivery.topic(spark, folder), "t", "late", lambda m: None, f"{tmp_path}/cp", f"{tmp_path}/out", f"{tmp_path}/dead", o, available_now=True).awaitTermination(120)
        found = spark.read.schema(delivery._HANDLED).parquet(f"{tmp_path}/out").count() if n else 0
        assert found == n


def test_share_group(spark, tmp_path):
    folder, tally = f"{tmp_path}/topic", f"{tmp_path}/tally"
    Path(tally).mkdir()
    delivery.publish(_messages(spark, 6), folder, batch_size=2)

    def handler(message):
        n = int(message["id"])
        with open(f"{tally}/{n}", "a") as f:
            f.write("x")
        if n == 3 or n == 4 and len(Path(f"{tally}/4").read_text()) < 3:
            raise ValueError("poison")

    delivery.subscribe_shared(delivery.topic(spark, folder), "orders", "s", handler, f"{tmp_path}/cp", f"{tmp_path}/out", f"{tmp_path}/dead", SubscribeOptions(share_attempts=3), available_now=True).awaitTermination(180)
    out = {r["id"]: (r["ok"], r["calls"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {"0": (True, 1), "1": (True, 1), "2": (True, 1), "3": (False, 3), "4": (True, 3), "5": (True, 1)}
    assert [r["id"] for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == ["3"]


def test_field_stream(spark, tmp_path):
    src = f"{tmp_path}/src"
    good = {"v": b"1", "key": b"k", "headers": b"null", "timestamp": b"0"}
    spark.createDataFrame([("1-0", {}), ("2-0", good | {"body": b"ok"}), ("3-0", good | {"body": b"bad"})], "id string, fields map<string,binary>").write.parquet(src)
    stream = spark.readStream.schema("id string, fields map<string,binary>").parquet(src)

    def handler(message):
        if message["body"] == b"bad":
            raise ValueError("poison")

    o = SubscribeOptions(backoff_min_ms=1, backoff_max_ms=1, delivery_attempts=2)
    blocked = Path(tmp_path, "dead")
    blocked.write_text("a file where the folder should be")
    start = lambda: delivery.subscribe_fields(stream, "f", "g", handler, f"{tmp_path}/cp", f"{tmp_path}/acks", f"{tmp_path}/dead", o, available_now=True)
    with pytest.raises(Exception):
        start().awaitTermination(120)
    assert not Path(tmp_path, "acks").exists()  # nothing is acknowledged before the dead letters are written
    calls = []

    def again():
        calls.append(1)
        if len(calls) == 2:
            blocked.unlink()
        return start()

    assert delivery.keep_running(again, o) == 1
    assert {r["id"]: r["route"] for r in spark.read.parquet(f"{tmp_path}/acks").collect()} == {"1-0": "dead_letter", "2-0": "ack", "3-0": "dead_letter"}
    dead = {r["id"]: r for r in spark.read.parquet(f"{tmp_path}/dead").collect()}
    assert dead.keys() == {"1-0", "3-0"} and dead["1-0"]["body"] == b"null" and dead["3-0"]["headers"][M.DEAD_LETTER_PREFIX + M.DEAD_LETTER_HEADERS[3]] == b"2"


def test_options():
    o = SubscribeOptions().with_(batch_size=5)
    assert o.for_log().max_retries == 3 and o.for_stream().delivery_attempts == 5 and o.for_log(share=True).share_attempts == 4
    for bad in ({"batch_size": 0}, {"max_retries": -1}, {"start_offset": "middle"}, {"backoff_min_ms": 10**6}):
        with pytest.raises(InvalidArgument):
            SubscribeOptions(**bad)
    for bad in (lambda: SubscribeOptions(queue_depth=1).for_log(), lambda: SubscribeOptions(max_retries=1).for_stream(), lambda: SubscribeOptions(max_retries=1).for_log(True), lambda: SubscribeOptions(share_attempts=1).for_log(), lambda: SubscribeOptions(share_attempts=5).for_log(True), lambda: SubscribeOptions(pending_idle_s=1).for_stream()):
        with pytest.raises(InvalidArgument):
            bad()


def _run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_keyed_state(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([("a", 1, 0, 20_000_000, False), ("a", 2, 1, 10, True), ("b", 3, 0, 10, False)], "k string, seq long, at_ns long, latency long, ok boolean").write.parquet(src)
    stream = spark.readStream.schema("k string, seq long, at_ns long, latency long, ok boolean").parquet(src)
    _run(state.health(stream, "k", threshold=1), "update", tmp_path, "health")
    got = {r["k"]: (r["ewma"], r["failures"], r["ejected_until"]) for r in spark.table("health").collect()}
    assert got == {"a": (int(0.8 * 12_000_000 + 0.2 * 10), 0, 0), "b": (int(0.8 * 10_000_000 + 2), 0, 30_000_000_000)}
    _run(state.first_only(stream, ["k"]), "append", tmp_path, "firsts")
    assert spark.table("firsts").count() == 2


def test_latest_state(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.createDataFrame([("a", "PUT", 1.0, 5), ("a", "PUT", 2.0, 4), ("b", "DELETE", 0.0, 7)], "k string, op string, v double, revision long").write.parquet(src)
    _run(state.latest_state(spark.readStream.schema("k string, op string, v double, revision long").parquet(src), "k", "v"), "update", tmp_path, "latest")
    assert {r["k"]: (r["op"], r["v"], r["revision"]) for r in spark.table("latest").collect()} == {"a": ("PUT", 1.0, 5), "b": ("DELETE", 0.0, 7)}


def test_resources(spark, tmp_path):
    r = resources.Resources()
    r.set("a", 5)
    assert r.get(int, "a") == 5 and r.get_or_create(str, "s", lambda: "x") == "x" and r.get_or_create(str, "s", lambda: "y") == "x"
    with pytest.raises(InvalidArgument):
        r.set("a", 6)
    r.close()
    with pytest.raises(InvalidArgument):
        r.set("b", 1)
    spark.range(3).write.parquet(f"{tmp_path}/p")
    assert resources.register_all(spark, {"p": {"path": f"{tmp_path}/p"}}) == ["p"] and spark.table("p").count() == 3
    with pytest.raises(Exception):
        resources.register_all(spark, {"ok": {"path": f"{tmp_path}/p"}, "zz": {"path": f"{tmp_path}/none"}})
    assert not spark.catalog.tableExists("ok")
    with pytest.raises(InvalidArgument):
        resources.prepare(spark, {"format": "jdbc", "url": "x"})
    assert resources.jdbc_options("mysql", "h", 3306, "d", "t", "u", "p", "id", 0, 9, 4)["numPartitions"] == "4"
