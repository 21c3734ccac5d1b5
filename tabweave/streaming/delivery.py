"""Publish, subscribe, retry and dead letters on Structured Streaming.

A topic is a folder of message files (or any streaming DataFrame of messages). A subscription is one streaming query
with a checkpoint per (topic, group); each micro-batch runs the handler on executors, writes dead letters and results,
and is then committed. Delivery is at least once: a batch that fails is given again, so outputs are written under the
batch's number and replace what a failed try left. Three kinds of subscription share this:

* ``subscribe``: an ordered group of a log; retries in place, partition by partition in order of id;
* ``subscribe_shared``: a share group; no order, a failed message is released and delivered again, then rejected;
* ``subscribe_fields``: records of a field stream; unreadable ones go to the dead letters, and a record is acknowledged
  only after what became of it is written."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabweave.cluster import ship
from tabweave.functions import messages as M
from tabweave.plans.errors import InvalidArgument
from tabweave.streaming.options import SubscribeOptions

#: What a handler gets: id, key, body, headers, timestamp. It returns nothing; an exception is a failure.
Handler = Callable[[dict], None]
_HANDLED = M.MESSAGE + ", ok BOOLEAN, calls INT, error STRING"
_COLUMNS = ("id", "key", "body", "headers", "timestamp")


def publish(messages: DataFrame, folder: str, batch_size: int = 100) -> None:
    """Append messages to a topic's folder, in files of at most ``batch_size``; a message needs a body."""
    if missing := [c for c in _COLUMNS if c not in messages.columns]:
        raise InvalidArgument(f"messages lack {missing}")
    messages.select(*_COLUMNS).write.mode("append").option("maxRecordsPerFile", batch_size).parquet(folder)


def topic(spark: SparkSession, folder: str, options: SubscribeOptions | None = None) -> DataFrame:
    """The topic as a stream. A micro-batch has as many files as handlers run at once, so with files of ``batch_size`` messages that many for each."""
    options = options or SubscribeOptions()
    return spark.readStream.schema(M.MESSAGE).option("maxFilesPerTrigger", options.concurrency).parquet(folder)


def id_order(id_: Column) -> Column:
    """Numbers of ``<partition>:<offset>`` or ``<ms>-<sequence>``, by which ids compare; other ids compare as text after these."""
    return F.struct(F.transform(F.split(id_, "[:-]"), lambda x: x.try_cast("long")), id_)


def _handle(row: dict, handler: Handler, options: SubscribeOptions) -> tuple[bool, int, str | None]:
    calls, error = 0, None
    while calls <= (options.max_retries or 0):
        calls, began = calls + 1, time.monotonic()
        try:
            handler(row)
            if time.monotonic() - began <= options.handler_timeout_s:
                return True, calls, None
            error = "handler timeout"
        except Exception as e:
            error = str(e) or type(e).__name__
        if calls <= (options.max_retries or 0):
            time.sleep(min(options.backoff_max_ms, options.backoff_min_ms * 2 ** min(calls - 1, 30)) / 1000)
    return False, calls, error


def handle(messages: DataFrame, handler: Handler, options: SubscribeOptions, ordered_by: str | None = None) -> DataFrame:
    """``messages`` with ok, calls and error: the handler's result, after its retries, by ``concurrency`` handlers at once.

    With ``ordered_by``, messages of one value of that column are handled one after another in order of id."""
    ship(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            results = [_handle(r | {"headers": dict(r["headers"] or [])}, handler, options) for r in rows]
            columns = [pa.array([r[k] for r in results], t) for k, t in enumerate((pa.bool_(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "ok", "calls", "error"])

    if ordered_by:
        messages = messages.repartition(options.concurrency, F.col(ordered_by)).sortWithinPartitions(ordered_by, id_order(F.col("id")))
    else:
        messages = messages.repartition(options.concurrency)
    return messages.select(*_COLUMNS).mapInArrow(run, _HANDLED)


def _written(df: DataFrame, path: str, schema: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _to_dead_letters(failed: DataFrame, topic_name: str, group: str, delivery: Column, path: str) -> None:
    dead = M.dead_letters(failed, topic_name, group, delivery, F.col("error"), F.lit(datetime.now(timezone.utc)))
    dead.select(*_COLUMNS, "topic").write.mode("overwrite").parquet(path)


def _start(stream: DataFrame, batch, topic_name: str, group: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/{topic_name}/{group}").queryName(f"{topic_name}-{group}")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _from_latest(stream: DataFrame, checkpoint: str, topic_name: str, group: str) -> DataFrame:
    """Only files written after the group was first seen; that time is kept beside its checkpoint."""
    spark = stream.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/{topic_name}/{group}-since")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        spark.range(1).select(F.lit(time.time()).alias("since")).coalesce(1).write.parquet(path.toString())
    since = spark.read.schema("since double").parquet(path.toString()).first()["since"]
    return stream.where(F.col("_metadata.file_modification_time").cast("double") > since)


def subscribe(stream: DataFrame, topic_name: str, group: str, handler: Handler, checkpoint: str, results: str, dead_letters: str, options: SubscribeOptions | None = None, ordered_by: str | None = "key", available_now: bool = False) -> StreamingQuery:
    """Start an ordered group. Handled messages go to ``results``, failed ones to ``dead_letters``, both by batch.

    A new group starts at the topic's beginning, or with ``start_offset="latest"`` at what is published from now on; later it goes on from its checkpoint."""
    options = (options or SubscribeOptions()).for_log()
    if options.start_offset == "latest":
        stream = _from_latest(stream, checkpoint, topic_name, group)

    def batch(df: DataFrame, number: int) -> None:
        handled = _written(handle(df.dropDuplicates(["id"]), handler, options, ordered_by), f"{results}/batch={number}", _HANDLED)
        _to_dead_letters(handled.where(~F.col("ok")), topic_name, group, F.col("calls"), f"{dead_letters}/batch={number}")

    return _start(stream, batch, topic_name, group, checkpoint, available_now)


def subscribe_shared(stream: DataFrame, topic_name: str, group: str, handler: Handler, checkpoint: str, results: str, dead_letters: str, options: SubscribeOptions | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a share group: messages in no order, one call per delivery. A failed message is released and delivered again in
    the batch's next round; after ``share_attempts`` deliveries it is rejected to the dead letters. If these cannot be
    written the batch fails as a whole and comes again, as a release does. ``results`` has each message once, with its deliveries as calls."""
    options = (options or SubscribeOptions()).for_log(share=True)
    once = options.with_(max_retries=0)

    def batch(df: DataFrame, number: int) -> None:
        open_, done = df.dropDuplicates(["id"]), None
        for delivery in range(1, options.share_attempts + 1):
            handled = _written(handle(open_, handler, once), f"{results}-rounds/{group}/batch={number}/delivery={delivery}", _HANDLED).withColumn("calls", F.lit(delivery))
            accepted = handled.where("ok")
            done = accepted if done is None else done.unionByName(accepted)
            open_ = handled.where("NOT ok")
            if open_.isEmpty():
                break
        _to_dead_letters(open_, topic_name, group, F.col("calls"), f"{dead_letters}/batch={number}")
        done.unionByName(open_).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return _start(stream, batch, topic_name, group, checkpoint, available_now)


def subscribe_fields(stream: DataFrame, topic_name: str, group: str, handler: Handler, checkpoint: str, acks: str, dead_letters: str, options: SubscribeOptions | None = None, available_now: bool = False) -> StreamingQuery:
    """Start a group on a field stream (id, fields). A record that cannot be decoded, or that fails ``delivery_attempts`` deliveries, goes to the dead letters.

    ``acks`` gets (id, route) of every record, in files of ``ack_batch``, and is written last: if the dead letters cannot be written,
    nothing of the batch is acknowledged and all of it comes again."""
    options = (options or SubscribeOptions()).for_stream()
    tries = options.with_(max_retries=options.delivery_attempts - 1)
    work = f"{acks}-rounds/{group}"

    def batch(df: DataFrame, number: int) -> None:
        decoded = M.decode_stream(df.dropDuplicates(["id"]))
        readable = decoded.where(F.col("message").isNotNull()).select("message.*")
        handled = _written(handle(readable, handler, tries), f"{work}/batch={number}", _HANDLED)
        _to_dead_letters(handled.where("NOT ok"), topic_name, group, F.col("calls"), f"{dead_letters}/batch={number}/failed=1")
        bad = M.unreadable(decoded, topic_name, group, F.lit(datetime.now(timezone.utc)))
        bad.select(*_COLUMNS, "topic").write.mode("overwrite").parquet(f"{dead_letters}/batch={number}/failed=0")
        route = handled.select("id", M.delivery_route(F.col("ok"), F.col("calls"), options.delivery_attempts).alias("route"))
        every = route.unionByName(decoded.where(F.col("message").isNull()).select("id", F.lit("dead_letter").alias("route")))
        every.coalesce(1).write.mode("overwrite").option("maxRecordsPerFile", options.ack_batch).parquet(f"{acks}/batch={number}")

    return _start(stream, batch, topic_name, group, checkpoint, available_now)


def keep_running(start: Callable[[], StreamingQuery], options: SubscribeOptions, most_restarts: int | None = None) -> int:
    """Wait for a subscription and start it again when it fails, with growing pauses; the number of restarts once it ends well. After ``most_restarts`` its error is raised."""
    restarts = 0
    while True:
        try:
            start().awaitTermination()
            return restarts
        except Exception:
            if most_restarts is not None and restarts >= most_restarts:
                raise
            time.sleep(min(options.backoff_max_ms, options.backoff_min_ms * 2 ** min(restarts, 30)) / 1000)
            restarts += 1


def close(query: StreamingQuery) -> None:
    """Finish what has arrived, then stop."""
    if query.isActive:
        query.processAllAvailable()
        query.stop()
