"""Messages as rows: decoding, routing, acknowledgement and dead letters, in batch and in streams alike.

A message is id STRING, key BINARY, body BINARY, headers MAP<STRING,BINARY>, timestamp TIMESTAMP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.scalars import base64_url

MESSAGE = "id STRING, key BINARY, body BINARY, headers MAP<STRING,BINARY>, timestamp TIMESTAMP"
#: Fixed values of the wire format: suffix of a dead-letter topic, its six headers (under a prefix of the user's), and the codec's version.
DEAD_LETTER_SUFFIX, DEAD_LETTER_PREFIX = ".dlq", "dlq."
DEAD_LETTER_HEADERS = ("source_topic", "source_group", "source_message_id", "delivery_count", "error", "failed_at")
CODEC_VERSION = "1"


def message_id(partition: Column, offset: Column) -> Column:
    return F.concat_ws(":", partition.cast("string"), offset.cast("string"))


def last_wins(headers: Column) -> Column:
    """An array of (key, value) as a map; of equal keys the last counts, whatever the session's policy."""
    keys = F.array_distinct(F.transform(headers, lambda h: h["key"]))
    last = lambda k: F.element_at(F.filter(headers, lambda h: h["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def from_log_records(records: DataFrame) -> DataFrame:
    """Records of a partitioned log (partition, offset, key, value, headers as array of key and value, timestamp) as messages."""
    headers = F.coalesce(last_wins(F.col("headers")), F.create_map().cast("map<string,binary>"))
    return records.select("partition", "offset", message_id(F.col("partition"), F.col("offset")).alias("id"), "key", F.col("value").alias("body"), headers.alias("headers"), "timestamp")


def stream_id_ms(stream_id: Column) -> Column:
    """Milliseconds of ``<ms>-<seq>``; NULL for another form."""
    return F.regexp_extract(stream_id, r"^([0-9]{1,18})-", 1).try_cast("long")


def decode_stream(records: DataFrame) -> DataFrame:
    """Records of a field stream (id, fields MAP<STRING,BINARY>) with ``message`` (NULL if unreadable) and ``error``.

    Fields are v, key, body, headers (JSON, values in base64) and timestamp (nanoseconds; 0 falls back to the id's
    milliseconds; Spark keeps microseconds)."""
    field = lambda n: F.element_at("fields", n)
    text = lambda n: field(n).cast("string")
    raw = F.from_json(text("headers"), "map<string,string>")
    nanos = text("timestamp").try_cast("long")
    time = F.when(nanos != 0, F.timestamp_micros(F.call_function("div", nanos, F.lit(1000)))).otherwise(F.timestamp_millis(stream_id_ms(F.col("id"))))
    missing = [F.when(field(n).isNull(), F.lit(f"field {n} is missing")) for n in ("v", "key", "body", "headers", "timestamp")]
    bad_headers = (~text("headers").isin("", "null")) & raw.isNull()
    error = F.coalesce(missing[0], F.when(text("v") != CODEC_VERSION, F.concat(F.lit("unsupported version "), text("v"))), *missing[1:], F.when(bad_headers, "headers cannot be read"), F.when(nanos.isNull(), "timestamp cannot be read"))
    headers = F.coalesce(F.transform_values(raw, lambda _, v: F.unbase64(v)), F.create_map().cast("map<string,binary>"))
    message = F.struct(F.col("id"), field("key").alias("key"), field("body").alias("body"), headers.alias("headers"), time.alias("timestamp"))
    return records.withColumn("error", error).withColumn("message", F.when(F.col("error").isNull(), message))


def encode_stream(messages: DataFrame) -> DataFrame:
    """(id, fields): the reverse of ``decode_stream``."""
    b = lambda c: c.cast("binary")
    plain = F.transform_values("headers", lambda _, v: F.regexp_replace(F.base64(v), "[\r\n]", ""))
    nanos = F.coalesce(F.unix_micros("timestamp") * 1000, F.lit(0)).cast("string")
    fields = F.create_map(F.lit("v"), b(F.lit(CODEC_VERSION)), F.lit("key"), F.coalesce("key", b(F.lit(""))), F.lit("body"), F.coalesce("body", b(F.lit(""))), F.lit("headers"), b(F.coalesce(F.to_json(plain), F.lit("null"))), F.lit("timestamp"), b(nanos))
    return messages.select("id", fields.alias("fields"))


def commit_prefix(records: DataFrame, failed: Column) -> DataFrame:
    """(topic, partition, committed): the last record before a partition's first failure; no row where the first one failed. Records of a batch follow each other without gaps they could leave."""
    first = records.groupBy("topic", "partition").agg(F.min(F.when(failed, F.col("offset"))).alias("__bad"))
    done = records.join(first, ["topic", "partition"]).where(F.col("__bad").isNull() | (F.col("offset") < F.col("__bad")))
    return done.groupBy("topic", "partition").agg(F.max("offset").alias("committed"))


def ack_decision(ok: Column, delivery: Column, dead_letter_ok: Column, most: int, cancelled: Column | None = None) -> Column:
    """accept, release (comes again) or reject (went to the dead letters)."""
    out = F.when(F.lit(False) if cancelled is None else cancelled, "release")
    return out.when(ok, "accept").when(delivery < most, "release").when(dead_letter_ok, "reject").otherwise("release")


def delivery_route(ok: Column, delivery: Column, most: int = 5) -> Column:
    """ack, pending, dead_letter, or ignore for a record whose delivery count is unknown."""
    return F.when(ok, "ack").when(delivery.isNull(), "ignore").when(delivery < most, "pending").otherwise("dead_letter")


def attempts_used(fails: Column, most_retries: int) -> Column:
    """Handler calls of in-place retrying: one more than the failures before success, at most one more than the retries."""
    return F.least(fails, F.lit(most_retries)) + 1


def dead_letters(messages: DataFrame, topic: str, group: str, delivery: Column, error: Column, failed_at: Column, prefix: str = DEAD_LETTER_PREFIX) -> DataFrame:
    """The messages for ``topic``'s dead letters: all as it was, six headers more (an old header of that name gives way)."""
    values = (F.lit(topic), F.lit(group), F.col("id"), delivery.cast("string"), error, F.date_format(failed_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    names = [prefix + n for n in DEAD_LETTER_HEADERS]
    own = F.create_map(*(x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v.cast("binary"))))
    old = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,binary>")), lambda k, _: ~k.isin(*names))
    return messages.withColumn("headers", F.map_concat(old, own)).withColumn("topic", F.lit(topic + DEAD_LETTER_SUFFIX))


def unreadable(records: DataFrame, topic: str, group: str, failed_at: Column) -> DataFrame:
    """Dead letters for records that ``decode_stream`` could not read: the body is their fields as JSON (null without fields)."""
    bad = records.where(F.col("message").isNull())
    body = F.when(F.size("fields") > 0, F.to_json(F.transform_values("fields", lambda _, v: v.cast("string")))).otherwise("null").cast("binary")
    rows = bad.select("id", F.lit(None).cast("binary").alias("key"), body.alias("body"), F.create_map().cast("map<string,binary>").alias("headers"), F.timestamp_millis(stream_id_ms(F.col("id"))).alias("timestamp"), "error")
    return dead_letters(rows, topic, group, F.lit(1), F.col("error"), failed_at).drop("error")


def reclaimable(pending: DataFrame, now_ms: Column, idle_ms: int = 60_000, batch: int = 64, batches: int = 4, after: str = "") -> DataFrame:
    """Pending entries (id, last_ms) that were idle long enough, from a cursor on, as many as one round takes."""
    return pending.where((now_ms - F.col("last_ms") >= idle_ms) & (F.col("id") > after)).orderBy("id").limit(batch * batches)


def once_in_flight(records: DataFrame) -> DataFrame:
    """Of records with one id, the first delivery."""
    w = Window.partitionBy("id").orderBy("delivery")
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def stale_consumers(consumers: DataFrame, idle_ms: int = 86_400_000, most: int = 128) -> DataFrame:
    """Consumers without pending entries that were idle for a day, at most ``most`` a run."""
    return consumers.where((F.col("pending") == 0) & (F.col("idle_ms") >= idle_ms)).orderBy("name").limit(most)

