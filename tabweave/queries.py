"""Driver queries of the typed layer and the data operators, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import messages as M
from tabweave.functions import scalars as S
from tabweave.models import CONVERSATIONS, CUSTOMER, EVENTS, LINEITEM, ORDERS, PART, SUPPLIER, catalog
from tabweave.operators import changelog, checks, health, idempotency, ids, mutate
from tabweave.plans.expr import And, Not, Or
from tabweave.plans.named import Declared, Mode, NamedQueries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def typed(name: str, table: str, build, sql: str) -> None:
    """A query of the typed layer: ``build`` gets the table's query."""
    QUERIES[name] = lambda spark, folder: build(catalog(spark, folder).query(table))
    ORACLE_SQL[name] = sql


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


o, c, p, e, s, li = ORDERS.c, CUSTOMER.c, PART.c, EVENTS.c, SUPPLIER.c, LINEITEM.c
_O, _C, _P = "SELECT * FROM orders", "SELECT * FROM customer", "SELECT * FROM part"
_S, _E = "SELECT * FROM supplier", "SELECT * FROM events"
_DAY, _END = datetime(1997, 1, 1), datetime(1998, 1, 1)

typed("scan_projection", "nation", lambda q: q.all(), "SELECT n_nationkey, n_name, n_regionkey FROM nation")
typed("first_by_order", "orders", lambda q: q.order(o.o_totalprice.desc(), o.o_orderkey.asc()).limit(7).first(), f"{_O} ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 1")
typed("first_keeps_offset", "orders", lambda q: q.order(o.o_orderkey.asc()).offset(5).first(), f"{_O} ORDER BY o_orderkey LIMIT 1 OFFSET 5")
typed("get_by_pk", "orders", lambda q: q.get(7), f"{_O} WHERE o_orderkey = 7")
typed("get_by_key", "conversations", lambda q: q.get(3, 1), "SELECT * FROM conversations WHERE conv_id = 3 AND turn = 1")
typed("count_where", "lineitem", lambda q: q.where(li.l_returnflag.eq("R")).order(li.l_tax.asc()).limit(3).count(), "SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'")
typed("exists_where", "lineitem", lambda q: q.where(li.l_quantity.gt(49.0)).exists(), "SELECT EXISTS(SELECT 1 FROM lineitem WHERE l_quantity > 49) AS exists")
typed("exists_none", "lineitem", lambda q: q.where(li.l_quantity.lt(-1.0)).exists(), "SELECT EXISTS(SELECT 1 FROM lineitem WHERE l_quantity < -1) AS exists")
typed("where_appends", "orders", lambda q: q.where(o.o_orderstatus.eq("O")).where(o.o_totalprice.gt(200000.0)).all(), f"{_O} WHERE o_orderstatus = 'O' AND o_totalprice > 200000")
typed("pred_eq", "orders", lambda q: q.where(o.o_orderstatus.eq("P")).all(), f"{_O} WHERE o_orderstatus = 'P'")
typed("pred_ne", "orders", lambda q: q.where(o.o_orderstatus.ne("P")).all(), f"{_O} WHERE o_orderstatus <> 'P'")
typed("pred_in", "customer", lambda q: q.where(c.c_nationkey.in_(1, 3, 5)).all(), f"{_C} WHERE c_nationkey IN (1, 3, 5)")
typed("pred_in_empty", "customer", lambda q: q.where(c.c_nationkey.in_()).all(), f"{_C} WHERE 1 = 0")
typed("pred_not_in", "customer", lambda q: q.where(c.c_nationkey.not_in(1, 3, 5)).all(), f"{_C} WHERE c_nationkey NOT IN (1, 3, 5)")
typed("pred_not_in_empty", "customer", lambda q: q.where(c.c_nationkey.not_in()).all(), f"{_C} WHERE 1 = 1")
for _name, _op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    typed(f"pred_{_name}", "part", lambda q, n=_name: q.where(getattr(p.p_size, n)(25)).all(), f"{_P} WHERE p_size {_op} 25")
    typed(f"pred_string_{_name}", "part", lambda q, n=_name: q.where(getattr(p.p_brand, n)("Brand#3")).all(), f"{_P} WHERE p_brand {_op} 'Brand#3'")
    typed(f"pred_time_{_name}", "orders", lambda q, n=_name: q.where(getattr(o.o_orderdate, n)(_DAY)).all(), f"{_O} WHERE o_orderdate {_op} TIMESTAMP '1997-01-01'")
typed("pred_between", "part", lambda q: q.where(p.p_size.between(10, 20)).all(), f"{_P} WHERE p_size BETWEEN 10 AND 20")
typed("pred_between_reversed", "part", lambda q: q.where(p.p_size.between(20, 10)).all(), f"{_P} WHERE p_size BETWEEN 20 AND 10")
typed("pred_time_between", "orders", lambda q: q.where(o.o_orderdate.between(_DAY, _END)).all(), f"{_O} WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01'")
typed("pred_like", "part", lambda q: q.where(p.p_type.like("%O_O%")).all(), rf"{_P} WHERE p_type LIKE '%O_O%' ESCAPE '\'")
typed("pred_and_or_not", "customer", lambda q: q.where(Or(And(c.c_acctbal.gt(5000.0), c.c_mktsegment.eq("BUILDING")), Not(c.c_nationkey.lte(20)))).all(), f"{_C} WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR NOT (c_nationkey <= 20)")
typed("pred_empty_and", "customer", lambda q: q.where(And()).all(), f"{_C} WHERE true")
typed("pred_empty_or", "customer", lambda q: q.where(Or()).all(), f"{_C} WHERE false")
typed("order_multi", "customer", lambda q: q.order(c.c_mktsegment.asc(), c.c_acctbal.desc(), c.c_custkey.asc()).limit(40).all(), f"{_C} ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey LIMIT 40")
typed("limit", "part", lambda q: q.order(p.p_partkey.desc()).limit(9).all(), f"{_P} ORDER BY p_partkey DESC LIMIT 9")
typed("limit_offset", "part", lambda q: q.order(p.p_retailprice.asc(), p.p_partkey.asc()).limit(9).offset(11).all(), f"{_P} ORDER BY p_retailprice, p_partkey LIMIT 9 OFFSET 11")
typed("offset_only", "supplier", lambda q: q.order(s.s_suppkey.asc()).offset(3).all(), f"{_S} ORDER BY s_suppkey OFFSET 3")


def _with_null_price(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose price is NULL unless a supplier has their number: the files have no NULLs of their own."""
    known = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_acctbal").alias("__b"))
    return read(spark, folder, "part").join(known, "p_partkey", "left").withColumn("p_retailprice", F.when(F.col("__b").isNotNull(), F.col("p_retailprice"))).drop("__b")


_NULLED = "SELECT p.* REPLACE (CASE WHEN s_suppkey IS NOT NULL THEN p_retailprice END AS p_retailprice) FROM part p LEFT JOIN supplier ON s_suppkey = p_partkey"


def typed_null(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, folder: build(catalog(spark, folder).bind(lambda _: _with_null_price(spark, folder)).query("part"))
    ORACLE_SQL[name] = f"WITH t AS ({_NULLED}) {sql}"


typed_null("pred_is_null", lambda q: q.where(p.p_retailprice.is_null()).all(), "SELECT * FROM t WHERE p_retailprice IS NULL")
typed_null("pred_is_not_null", lambda q: q.where(p.p_retailprice.is_not_null()).all(), "SELECT * FROM t WHERE p_retailprice IS NOT NULL")
typed_null("null_rows_drop", lambda q: q.where(p.p_retailprice.ne(0.0)).all(), "SELECT * FROM t WHERE p_retailprice <> 0")
typed_null("null_kept_by_empty_not_in", lambda q: q.where(p.p_retailprice.not_in()).count(), "SELECT count(*) AS count FROM t")
typed_null("order_nulls", lambda q: q.order(p.p_retailprice.desc(), p.p_partkey.asc()).limit(30).all(), "SELECT * FROM t ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 30")
typed_null("delete_keeps_null", lambda q: mutate.delete(q.where(p.p_retailprice.gt(0.0))).table, "SELECT * FROM t WHERE NOT coalesce(p_retailprice > 0, false)")

# Mutations
typed("insert_row", "supplier", lambda q: mutate.create(q.model, q.source, {"s_name": "new", "s_nationkey": 0}, s.s_acctbal.use_default()).table, f"{_S} UNION ALL SELECT max(s_suppkey) + 1, 'new', 0, 0.0 FROM supplier")
typed("update_set", "supplier", lambda q: mutate.update(q.where(s.s_acctbal.lt(0.0)), s.s_name.set("debtor")).table, "SELECT * REPLACE (CASE WHEN s_acctbal < 0 THEN 'debtor' ELSE s_name END AS s_name) FROM supplier")
typed("update_add_sub", "part", lambda q: mutate.update(q.where(p.p_size.gt(40)), p.p_size.add(5), p.p_retailprice.sub(1.0)).table, "SELECT * REPLACE (CASE WHEN p_size > 40 THEN p_size + 5 ELSE p_size END AS p_size, CASE WHEN p_size > 40 THEN p_retailprice - 1 ELSE p_retailprice END AS p_retailprice) FROM part")
typed("update_set_null", "supplier", lambda q: mutate.update(q.where(s.s_suppkey.between(2, 5)), s.s_nationkey.set_null()).table, "SELECT * REPLACE (CASE WHEN s_suppkey BETWEEN 2 AND 5 THEN NULL ELSE s_nationkey END AS s_nationkey) FROM supplier")
typed("update_affected", "part", lambda q: mutate.update(q.where(p.p_size.gt(40)), p.p_size.set(0)).affected(), "SELECT count(*) AS affected FROM part WHERE p_size > 40")
typed("update_all_allowed", "supplier", lambda q: mutate.update(q.allow_all(), s.s_acctbal.set(0.0)).table, "SELECT * REPLACE (CAST(0 AS DOUBLE) AS s_acctbal) FROM supplier")
typed("update_by_pk", "supplier", lambda q: mutate.update_by_key(q, (3,), s.s_acctbal.add(10.0)).touched, "SELECT * REPLACE (s_acctbal + 10 AS s_acctbal) FROM supplier WHERE s_suppkey = 3")
typed("delete_where", "customer", lambda q: mutate.delete(q.where(c.c_acctbal.lt(0.0))).table, f"{_C} WHERE NOT (c_acctbal < 0)")
typed("delete_affected", "customer", lambda q: mutate.delete(q.where(c.c_acctbal.lt(0.0))).affected(), "SELECT count(*) AS affected FROM customer WHERE c_acctbal < 0")
typed("delete_by_key", "conversations", lambda q: mutate.delete_by_key(q, (3, 1)).table, "SELECT * FROM conversations WHERE NOT (conv_id = 3 AND turn = 1)")


@query("""SELECT coalesce(o.s_suppkey, n.k) AS s_suppkey, CASE WHEN o.s_suppkey IS NULL THEN 'added' ELSE o.s_name END AS s_name, CASE WHEN o.s_suppkey IS NULL THEN 1 ELSE o.s_nationkey END AS s_nationkey,
       CASE WHEN n.k IS NOT NULL THEN 1.5 ELSE o.s_acctbal END AS s_acctbal FROM supplier o FULL JOIN (SELECT p_partkey * 2 AS k FROM part) n ON o.s_suppkey = n.k""")
def upsert(spark, folder):
    new = read(spark, folder, "part").select((F.col("p_partkey") * 2).alias("s_suppkey"), F.lit("added").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.5).alias("s_acctbal"))
    return mutate.upsert(read(spark, folder, "supplier"), new, ["s_suppkey"], ["s_acctbal"]).table


# Named SQL: the text is Spark's own; the layer checks parameters and modes
_BLOCKS = """-- orders of one status
-- name: ByStatus
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND ':x' <> 'y'::string -- :ignored
-- name: Largest
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
-- name: InList
SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (:nations) /* :no */
-- name: RevenueBySegment
SELECT c_mktsegment, count(*) AS n_orders, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= :since GROUP BY c_mktsegment
"""
_DECLARED = {"ByStatus": Declared(Mode.MANY, ("status",)), "Largest": Declared(Mode.ONE), "InList": Declared(Mode.MANY, ("nations",)), "RevenueBySegment": Declared(Mode.MANY, ("since",))}


def named(spark: SparkSession, folder: str) -> NamedQueries:
    for t in ("customer", "orders"):
        read(spark, folder, t).createOrReplaceTempView(t)
    return NamedQueries(spark, _BLOCKS, _DECLARED)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def named_many(spark, folder):
    return named(spark, folder).run("ByStatus", status="F")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def named_one(spark, folder):
    return named(spark, folder).run("Largest")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (2, 4, 6)")
def named_slice_in(spark, folder):
    return named(spark, folder).run("InList", nations=[2, 4, 6])


@query("SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY c_mktsegment")
def named_join_agg(spark, folder):
    return named(spark, folder).run("RevenueBySegment", since=_DAY).withColumn("revenue", F.col("revenue").cast("decimal(28,2)"))


# Messages: events as records of a log with 8 partitions
def records(spark: SparkSession, folder: str) -> DataFrame:
    ev = read(spark, folder, "events")
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value"))
    headers = F.array(header("type", F.lit("old")), header("type", F.col("event_type")), header("user", F.col("user_id").cast("string")))
    return ev.select(F.lit("events").alias("topic"), F.pmod("user_id", F.lit(8)).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), headers.alias("headers"), F.col("ts").cast("timestamp").alias("timestamp"), "event_type")


@query("SELECT (user_id % 8)::VARCHAR || ':' || event_id AS id, user_id::VARCHAR AS key, props AS body, event_type AS type, 2::BIGINT AS n_headers FROM events")
def msg_decode(spark, folder):
    m = M.from_log_records(records(spark, folder))
    return m.select("id", F.col("key").cast("string").alias("key"), F.col("body").cast("string").alias("body"), F.element_at("headers", "type").cast("string").alias("type"), F.size("headers").cast("long").alias("n_headers"))


@query("SELECT (user_id % 8)::VARCHAR || ':' || event_id AS id, event_id FROM events")
def msg_id(spark, folder):
    return records(spark, folder).select(M.message_id(F.col("partition"), F.col("offset")).alias("id"), F.col("offset").alias("event_id"))


@query("SELECT event_id::VARCHAR || '-0' AS id, user_id::VARCHAR AS key, props AS body, event_type AS type, epoch_ns(ts) // 1000 AS us FROM events")
def msg_codec_round_trip(spark, folder):
    m = read(spark, folder, "events").select(F.concat(F.col("event_id").cast("string"), F.lit("-0")).alias("id"), F.col("user_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("body"), F.create_map(F.lit("type"), F.col("event_type").cast("binary")).alias("headers"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC").alias("timestamp"))
    d = M.decode_stream(M.encode_stream(m)).select("message.*")
    return d.select("id", F.col("key").cast("string").alias("key"), F.col("body").cast("string").alias("body"), F.element_at("headers", "type").cast("string").alias("type"), F.unix_micros("timestamp").alias("us"))


@query("SELECT event_id::VARCHAR || '-7' AS stream_id, event_id AS ms FROM events")
def stream_id_time(spark, folder):
    return read(spark, folder, "events").select(F.concat(F.col("event_id").cast("string"), F.lit("-7")).alias("stream_id")).withColumn("ms", M.stream_id_ms(F.col("stream_id")))


@query("SELECT event_id, 'events.dlq' AS topic, 'g' AS source_group, (user_id % 8)::VARCHAR || ':' || event_id AS source_id, (1 + event_id % 5)::VARCHAR AS delivery_count, 'poison' AS error, 8::BIGINT AS n_headers FROM events WHERE event_type = 'error'")
def msg_dlq_headers(spark, folder):
    m = M.from_log_records(records(spark, folder).where("event_type = 'error'"))
    d = M.dead_letters(m, "events", "g", F.pmod("offset", F.lit(5)) + 1, F.lit("poison"), F.lit(_DAY))
    h = lambda n: F.element_at("headers", M.DEAD_LETTER_PREFIX + M.DEAD_LETTER_HEADERS[n]).cast("string")
    return d.select(F.col("offset").alias("event_id"), "topic", h(1).alias("source_group"), h(2).alias("source_id"), h(3).alias("delivery_count"), h(4).alias("error"), F.size("headers").cast("long").alias("n_headers"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'accept' WHEN 1 + event_id % 5 < 4 THEN 'release' WHEN event_id % 2 = 0 THEN 'reject' ELSE 'release' END AS decision FROM events""")
def ack_decision(spark, folder):
    return read(spark, folder, "events").select("event_id", M.ack_decision(F.col("event_type") != "error", F.pmod("event_id", F.lit(5)) + 1, F.pmod("event_id", F.lit(2)) == 0, 4).alias("decision"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'ack' WHEN event_id % 7 = 0 THEN 'ignore' WHEN 1 + event_id % 5 < 5 THEN 'pending' ELSE 'dead_letter' END AS route FROM events""")
def delivery_route(spark, folder):
    delivery = F.when(F.pmod("event_id", F.lit(7)) != 0, F.pmod("event_id", F.lit(5)) + 1)
    return read(spark, folder, "events").select("event_id", M.delivery_route(F.col("event_type") != "error", delivery).alias("route"))


@query("""WITH r AS (SELECT (user_id % 8)::INTEGER AS partition, event_id AS o, event_id % 97 = 96 AS bad FROM events), f AS (SELECT partition, min(o) FILTER (WHERE bad) AS b FROM r GROUP BY 1)
SELECT 'events' AS topic, r.partition, max(o) AS committed FROM r JOIN f USING (partition) WHERE b IS NULL OR o < b GROUP BY r.partition""")
def commit_prefix(spark, folder):
    return M.commit_prefix(records(spark, folder), F.pmod("offset", F.lit(97)) == 96)


@query("SELECT event_id, CAST(least(10000.0, 100.0 * pow(2, least(event_id % 70, 62))) AS BIGINT) AS delay FROM events")
def backoff_delay(spark, folder):
    return read(spark, folder, "events").select("event_id", S.backoff_ms(F.pmod("event_id", F.lit(70)), 100, 10_000).alias("delay"))


@query("SELECT event_id, least(event_id % 6, 3) + 1 AS calls FROM events")
def retry_calls(spark, folder):
    return read(spark, folder, "events").select("event_id", M.attempts_used(F.pmod("event_id", F.lit(6)), 3).alias("calls"))


@query("SELECT event_id, 'app:stream:' || replace(replace(rtrim(to_base64(encode(props || event_type)), '='), '+', '-'), '/', '_') AS key FROM events")
def stream_key(spark, folder):
    return read(spark, folder, "events").select("event_id", S.stream_key("app", F.concat("props", "event_type")).alias("key"))


@query("SELECT event_id AS id, (epoch_ns(ts) // 1000000) AS last_ms FROM events WHERE 1893456000000 - (epoch_ns(ts) // 1000000) >= 60000 ORDER BY event_id::VARCHAR LIMIT 256")
def reclaim_pending(spark, folder):
    pending = read(spark, folder, "events").select(F.col("event_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("last_ms"))
    return M.reclaimable(pending, F.lit(1893456000000)).select(F.col("id").cast("long").alias("id"), "last_ms")


@query("SELECT user_id AS id, min(event_id) AS delivery FROM events GROUP BY user_id")
def inflight_dedup(spark, folder):
    return M.once_in_flight(read(spark, folder, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("delivery")))


@query("SELECT c_name AS name, 0 AS pending, c_custkey * 3600000 AS idle_ms FROM customer WHERE c_custkey % 3 = 0 AND c_custkey * 3600000 >= 86400000 ORDER BY c_name LIMIT 128")
def stale_consumers(spark, folder):
    consumers = read(spark, folder, "customer").select(F.col("c_name").alias("name"), F.pmod("c_custkey", F.lit(3)).cast("int").alias("pending"), (F.col("c_custkey") * 3600000).alias("idle_ms"))
    return M.stale_consumers(consumers)


# Ids
@query("SELECT event_id, (((epoch_ns(ts) // 1000000) - 1577836800000) << 22) | ((user_id % 1024) << 12) | (event_id % 4096) AS id FROM events WHERE (epoch_ns(ts) // 1000000) >= 1577836800000")
def snowflake_pack(spark, folder):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ev = read(spark, folder, "events").where(ms >= ids.EPOCH)
    return ev.select("event_id", ids.pack(ms, F.pmod("user_id", F.lit(1024)), F.pmod("event_id", F.lit(4096))).alias("id"))


@query("SELECT event_id, (v >> 22) + 1577836800000 AS ms, (v >> 12) & 1023 AS worker, v & 4095 AS sequence FROM (SELECT event_id, event_id * 987654321 + 12345 AS v FROM events)")
def snowflake_unpack(spark, folder):
    v = F.col("event_id") * 987654321 + 12345
    return read(spark, folder, "events").select("event_id", ids.time_of(v).alias("ms"), ids.worker_of(v).alias("worker"), ids.sequence_of(v).alias("sequence"))


@query("""WITH r AS (SELECT event_id, user_id % 4 AS w, 1600000000000 + event_id // 9000 AS ms FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY ms, event_id) - 1 AS k FROM r),
t AS (SELECT *, max((ms - 1577836800000) * 4096 - k) OVER (PARTITION BY w ORDER BY k ROWS UNBOUNDED PRECEDING) + k AS slot FROM n)
SELECT event_id, ((slot // 4096) << 22) | (w << 12) | (slot % 4096) AS id FROM t""")
def snowflake_assign(spark, folder):
    ev = read(spark, folder, "events").select("event_id", F.pmod("user_id", F.lit(4)).alias("w"), (F.lit(1600000000000) + F.floor(F.col("event_id") / 9000)).alias("ms"))
    return ids.assign(ev, "ms", "w", ["event_id"]).select("event_id", "id")


def _workers(spark: SparkSession, folder: str) -> DataFrame:
    """The 1,024 workers of the id layout: a worker's customers are those whose key leaves its number, and its times are their latest."""
    rows = read(spark, folder, "customer").select(F.pmod("c_custkey", F.lit(ids.MOST_WORKERS)).cast("int").alias("worker_id"), (F.col("c_custkey") * 7919 % 100003).alias("updated_at"), (F.col("c_custkey") * 31).alias("last_timestamp"))
    return rows.groupBy("worker_id").agg(F.max("updated_at").alias("updated_at"), F.max("last_timestamp").alias("last_timestamp"))


@query("SELECT worker_id, true AS reclaimed FROM (SELECT (c_custkey % 1024)::INTEGER AS worker_id, max(c_custkey * 7919 % 100003) AS heard FROM customer GROUP BY 1) WHERE heard < 200000 - 15000 ORDER BY heard, worker_id LIMIT 1")
def worker_lease(spark, folder):
    return ids.lease_candidate(_workers(spark, folder), 200_000)


@query("SELECT coalesce(max(c_custkey * 31), 0)::BIGINT AS last_timestamp FROM customer")
def coalesce_max(spark, folder):
    return ids.last_timestamp(_workers(spark, folder))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(F.col("event_type").alias("biz_tag")).distinct().select("biz_tag", F.length("biz_tag").cast("long").alias("max_id"), F.lit(100).alias("step"))


@query("SELECT event_id, length(event_type) + row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS id FROM events")
def segment_alloc(spark, folder):
    rows, _ = ids.allocate(read(spark, folder, "events").select("event_id", "event_type"), _segments(spark, folder), "event_type", ["event_id"])
    return rows.select("event_id", "id")


@query("SELECT event_type AS biz_tag, (length(event_type) + 100 * ceil(count(*) / 100.0))::BIGINT AS max_id, 100 AS step FROM events GROUP BY event_type")
def segment_fetch(spark, folder):
    return ids.allocate(read(spark, folder, "events").select("event_id", "event_type"), _segments(spark, folder), "event_type", ["event_id"])[1]


@query("SELECT DISTINCT event_type AS biz_tag, length(event_type) AS max_id, CASE WHEN event_type = 'error' THEN 1000 ELSE 100 END AS step FROM events UNION ALL SELECT 'fresh', 50, 5")
def segment_reinit(spark, folder):
    return ids.init_segment(ids.init_segment(_segments(spark, folder), "error", 0, 0), "fresh", 50, 5)


# Changelog and health
def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select("user_id", F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), "value", F.col("event_id").alias("revision"))


_CH = "SELECT user_id, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, value, event_id AS revision FROM events"


@query(f"SELECT user_id, op, value, revision FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY revision DESC) AS n FROM ({_CH})) WHERE n = 1 AND op <> 'DELETE'")
def cdc_latest(spark, folder):
    return changelog.latest(_changes(spark, folder), ["user_id"], "revision", "op")


@query(f"""SELECT user_id, op, value, revision FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY revision DESC) AS n FROM (SELECT * FROM ({_CH}) WHERE revision > 500 UNION ALL SELECT DISTINCT user_id, 'PUT', -1.0::DOUBLE, 500 FROM events)) WHERE n = 1 AND op <> 'DELETE'""")
def cdc_stale_guard(spark, folder):
    changes = _changes(spark, folder)
    snapshot = changes.select("user_id").distinct().select("user_id", F.lit(-1.0).alias("value"))
    return changelog.apply_changes(snapshot.withColumn("revision", F.lit(0).cast("long")), 500, changes, ["user_id"], "revision", "op")


@query("SELECT user_id, event_type, value FROM events WHERE event_type = (SELECT max(event_type) FROM events)")
def cdc_newest_snapshot(spark, folder):
    return changelog.newest_snapshot(read(spark, folder, "events").select("user_id", "event_type", "value"), "event_type")


@query("""SELECT event_id, NOT (event_id % 5 IN (1, 2, 3, 4)) AS ok FROM events""")
def instance_valid(spark, folder):
    k = F.pmod("event_id", F.lit(5))
    service = F.when(k == 1, "..").otherwise("pay")
    endpoint = F.when(k == 2, "http://h:80/x").when(k == 3, "https://h:80").otherwise("http://10.0.0.1:8080")
    meta = F.create_map(F.when(k == 4, " ").otherwise("zone"), F.lit("a"))
    stored = changelog.encode(service, F.col("event_id").cast("string"), endpoint, meta)
    return read(spark, folder, "events").select("event_id", changelog.decode(stored).isNotNull().alias("ok"))


@query("SELECT user_id, min(event_id) AS revision FROM events WHERE value > 0 GROUP BY user_id")
def first_report(spark, folder):
    reports = read(spark, folder, "events").select("user_id", F.col("value").alias("latency"), F.col("event_id").alias("revision"))
    return changelog.first_reports(reports, "user_id", "revision").select("user_id", "revision")


@query("""SELECT user_id, list_reduce(list_prepend(10000000::BIGINT, list(trunc(value * 1e6)::BIGINT ORDER BY event_id)), lambda a, v: trunc(0.8::DOUBLE * a + 0.2::DOUBLE * v)::BIGINT) AS ewma FROM events GROUP BY user_id""")
def ewma(spark, folder):
    return health.ewma(read(spark, folder, "events").select("user_id", "event_id", (F.col("value") * 1e6).cast("long").alias("ns")), ["user_id"], "event_id", "ns")


def _breaker_sql() -> str:
    step = "CASE WHEN x.ok THEN {'f': 0::BIGINT, 'u': 0::BIGINT, 't': 0::BIGINT, 'ok': true} WHEN (s.u > 0 AND x.t >= s.u) OR s.f + 1 >= 3 THEN {'f': 0::BIGINT, 'u': x.t + 30000000000, 't': 0::BIGINT, 'ok': true} ELSE {'f': s.f + 1, 'u': s.u, 't': 0::BIGINT, 'ok': true} END"
    return f"""SELECT user_id, r.f AS failures, r.u AS ejected_until FROM (SELECT user_id, list_reduce(list_prepend({{'f': 0::BIGINT, 'u': 0::BIGINT, 't': 0::BIGINT, 'ok': true}},
    list({{'f': 0::BIGINT, 'u': 0::BIGINT, 't': event_id * 1000000000, 'ok': event_id % 3 = 0}} ORDER BY event_id)), lambda s, x: {step}) AS r FROM events GROUP BY user_id)"""


@query(_breaker_sql())
def breaker(spark, folder):
    ev = read(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") * 1_000_000_000).alias("t"))
    return health.breaker(ev, ["user_id"], "event_id", "t", F.pmod("event_id", F.lit(3)) == 0)


@query("SELECT event_id, ((value * 1000)::DOUBLE) * (event_id % 4 + 1) AS score FROM events")
def load_score(spark, folder):
    return read(spark, folder, "events").select("event_id", health.score(F.col("value") * 1000, F.pmod("event_id", F.lit(4))).alias("score"))


_P2C = """WITH i AS (SELECT s_suppkey % 5 AS service, s_suppkey AS id, (s_suppkey * 1000)::DOUBLE * (s_suppkey % 3 + 1) AS score, s_suppkey % 4 <> 0 AS ok, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS number FROM supplier),
n AS (SELECT service, count(*) AS n FROM i GROUP BY 1), r AS (SELECT event_id, user_id % 5 AS service, n FROM events JOIN n ON n.service = user_id % 5),
d AS (SELECT event_id, service, k, ('0x' || substr(md5(event_id || ':' || k), 1, 8))::BIGINT % n + 1 AS number FROM r, range(1, 9) AS t(k)),
c AS (SELECT event_id, d.service, k, id, score FROM d JOIN i ON i.service = d.service AND i.number = d.number WHERE ok UNION ALL
      SELECT event_id, r.service, 8 + f.nth, f.id, f.score FROM r JOIN (SELECT service, id, score, row_number() OVER (PARTITION BY service ORDER BY id) AS nth FROM i WHERE ok) f ON f.service = r.service AND f.nth <= 3),
u AS (SELECT event_id, service, id, any_value(score) AS score, min(k) AS k FROM c GROUP BY event_id, service, id),
p AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k) AS nth FROM u)
SELECT a.event_id, a.service, CASE WHEN b.score < a.score THEN b.id ELSE a.id END AS id, false AS all_ejected FROM p a LEFT JOIN p b ON b.event_id = a.event_id AND b.nth = 2 WHERE a.nth = 1"""


@query(_P2C)
def p2c_pick(spark, folder):
    k = F.col("s_suppkey")
    inst = read(spark, folder, "supplier").select(F.pmod(k, F.lit(5)).alias("service"), k.alias("id"), (k * 1000).alias("ewma"), F.pmod(k, F.lit(3)).alias("inflight"), F.when(F.pmod(k, F.lit(4)) == 0, 10**12).otherwise(0).alias("ejected_until"), F.lit(False).alias("half_open"))
    requests = read(spark, folder, "events").select("event_id", F.pmod("user_id", F.lit(5)).alias("service"))
    return health.pick_of_two(requests, inst, "event_id", "service", F.lit(0))


@query("""SELECT user_id, r.al AS allowed, r.rj AS rejected FROM (SELECT user_id, list_reduce(list_prepend({'k': 5.0::DOUBLE, 't': NULL::DOUBLE, 'al': 0::BIGINT, 'rj': 0::BIGINT},
    list({'k': 0.0::DOUBLE, 't': (event_id * 0.25)::DOUBLE, 'al': 0::BIGINT, 'rj': 0::BIGINT} ORDER BY event_id)),
    lambda s, x: CASE WHEN least(5.0, s.k + (x.t - coalesce(s.t, x.t)) * 0.015625) >= 1 THEN {'k': least(5.0, s.k + (x.t - coalesce(s.t, x.t)) * 0.015625) - 1, 't': x.t, 'al': s.al + 1, 'rj': s.rj}
    ELSE {'k': least(5.0, s.k + (x.t - coalesce(s.t, x.t)) * 0.015625), 't': x.t, 'al': s.al, 'rj': s.rj + 1} END) AS r FROM events GROUP BY user_id)""")
def token_bucket(spark, folder):
    ev = read(spark, folder, "events").select("user_id", "event_id", (F.col("event_id") * 0.25).alias("at"))
    return health.token_bucket(ev, ["user_id"], "event_id", "at", 0.015625, 5).drop("tokens")


# Idempotency
_OUT = """SELECT event_id, CASE WHEN f IS NOT NULL AND event_id > f THEN 'conflict' WHEN event_id = f THEN 'committed' ELSE 'rolled_back' END AS outcome
FROM (SELECT event_id, min(event_id) FILTER (WHERE event_id % 3 <> 0) OVER (PARTITION BY event_type, user_id) AS f FROM events)"""


@query(_OUT)
def idem_outcomes(spark, folder):
    return idempotency.outcomes(read(spark, folder, "events").select("event_type", "user_id", "event_id"), "event_type", "user_id", "event_id", F.pmod("event_id", F.lit(3)) != 0).select("event_id", "outcome")


@query(f"SELECT outcome, count(*) AS n FROM ({_OUT}) GROUP BY outcome")
def idem_conflicts(spark, folder):
    return idem_outcomes(spark, folder).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT event_id, length(trim(event_type)) > 0 AND length(event_type) <= 128 AND length(props) <= 256 AND length(trim(props)) > 0 AS ok FROM events")
def idem_valid_key(spark, folder):
    return read(spark, folder, "events").select("event_id", idempotency.valid_key(F.col("event_type"), F.col("props")).alias("ok"))


@query("SELECT ('0x' || substr(md5(event_type || chr(31) || user_id), 1, 8))::BIGINT % 64 AS partition, count(*) AS n FROM events GROUP BY 1")
def idem_partition_count(spark, folder):
    return read(spark, folder, "events").select(idempotency.record_partition(F.col("event_type"), F.col("user_id").cast("string")).alias("partition")).groupBy("partition").agg(F.count("*").alias("n"))


# Constraints and catalog-like joins
@query("SELECT o_custkey, count(*) AS count FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) GROUP BY 1")
def fk_violations(spark, folder):
    return checks.missing_references(read(spark, folder, "orders"), "o_custkey", read(spark, folder, "customer").where("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, folder):
    return checks.duplicates(read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")
def catalog_join_chain(spark, folder):
    n, r = read(spark, folder, "nation"), read(spark, folder, "region")
    return read(spark, folder, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_name", "n_name", "r_name")


@query("SELECT a.n_name AS a, b.n_name AS b, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey")
def catalog_self_join(spark, folder):
    n, r = read(spark, folder, "nation"), read(spark, folder, "region")
    a, b = n.alias("a"), n.alias("b")
    j = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return j.join(r, F.col("r_regionkey") == F.col("a.n_regionkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), "r_name")


@query("SELECT count(*) AS count FROM events WHERE event_type LIKE '%r%' AND event_type <> 'error'")
def count_like(spark, folder):
    return catalog(spark, folder).query("events").where(e.event_type.like("%r%"), Not(e.event_type.eq("error"))).count()


@query("SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 1")
def top1_desc(spark, folder):
    return catalog(spark, folder).query("customer").order(c.c_custkey.desc()).first().select("c_custkey")


@query("SELECT p_partkey, coalesce(p_retailprice, 0.0) AS price FROM (" + _NULLED + ")")
def coalesce_literal(spark, folder):
    return _with_null_price(spark, folder).select("p_partkey", F.coalesce("p_retailprice", F.lit(0.0)).alias("price"))


@query("SELECT count(*) FILTER (WHERE n_name = 'x') > 0 AS exists FROM nation")
def table_exists(spark, folder):
    return checks.table_exists(read(spark, folder, "nation").select(F.col("n_name").alias("table_name")), "x")


# Scalars
@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN NULL WHEN 3 THEN 'other' ELSE 'female' END AS gender FROM events")
def gender(spark, folder):
    raw = F.element_at(F.array(F.lit(" Male "), F.lit("FEMALE"), F.lit("  "), F.lit("x"), F.lit("female ")), F.pmod("event_id", F.lit(5)).cast("int") + 1)
    return read(spark, folder, "events").select("event_id", S.gender(raw).alias("gender"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 3600 WHEN 1 THEN 600 WHEN 2 THEN 86400 ELSE 3600 END::BIGINT AS seconds FROM events")
def cache_seconds(spark, folder):
    raw = F.element_at(F.array(F.lit("no-store"), F.lit('public, Max-Age="600"'), F.lit("max-age=999999"), F.lit("max-age=-4")), F.pmod("event_id", F.lit(4)).cast("int") + 1)
    return read(spark, folder, "events").select("event_id", S.cache_seconds(raw).alias("seconds"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verified FROM events")
def verified(spark, folder):
    raw = F.element_at(F.array(F.lit("T"), F.lit("false"), F.lit("yes")), F.pmod("event_id", F.lit(3)).cast("int") + 1)
    return read(spark, folder, "events").select("event_id", S.boolean(raw).alias("verified"))
