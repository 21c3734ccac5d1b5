"""Token-id files: one wavelet matrix per shard, written in ascending doc_id order and read back.

A shard holds the ids of neighbouring documents, each with its end id. Its payload is a header (magic, version, bits
per id, number of ids), a directory, and one bit-plane per bit of an id from the highest down (at each level ids are
stably parted by that bit), in chunks of ``CHUNK`` bits that zstandard compresses one by one. The directory has, for
each chunk, the number of ones before it in its plane and where it lies. ``WaveletMatrix`` answers access, rank, count and
select (occurrence lookup) from one payload and unpacks for it only the chunks it passes through, one or two a plane;
``count_ids`` and ``places_of`` ask all shards. Shards are rows of Parquet files in the shared folder, so Spark's writer
commits them: a lost executor leaves no half-written file, and any store that Spark writes will do.

Documents are range-partitioned by doc_id and sorted inside partitions; a task cuts shards between documents after
about ``shard_tokens`` ids. Only one number per partition (its ids) passes the driver, to turn places in a partition
into places in the whole.

Cases: a null or empty text is its end id; rows that repeat a doc_id follow each other in order of their
texts' MD5; a null
doc_id comes first; an empty table gives no shards and no rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import small_batches, store
from tabweave.llm.tokens import default_tokenizer, encoder, text_parts

MAGIC, VERSION, CHUNK = b"TWWM", 2, 1 << 17
SHARDS = "part long, shard long, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"


class WaveletMatrix:
    """An opened payload. Unpacked chunks are kept while the object lives."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC or payload[4] != VERSION:
            raise ValueError("not a wavelet shard of this version")
        _, self.bits, self.n = struct.unpack_from("<BBQ", payload, 4)
        self.chunks = -(-self.n // CHUNK)
        shape, count = (self.bits, self.chunks), self.bits * self.chunks
        self.before = np.frombuffer(payload, "<u4", count, 14).reshape(shape).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(np.frombuffer(payload, "<u4", count, 14 + 4 * count).astype(np.int64)))) + 14 + 8 * count + 4 * self.bits
        ones = np.frombuffer(payload, "<u4", self.bits, 14 + 8 * count)
        self.zeros = [self.n - int(x) for x in ones]
        self.payload, self.open = memoryview(payload), {}

    @staticmethod
    def build(ids: np.ndarray, bits: int) -> bytes:
        """The payload of ``ids``, all under 2 to the power of ``bits``."""
        x, chunks, before, packed, ones = ids, -(-len(ids) // CHUNK), [], [], []
        for level in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << level)) != 0
            plane = np.packbits(one, bitorder="little").tobytes()
            starts = np.arange(chunks) * CHUNK
            per = np.add.reduceat(one, starts, dtype=np.int64) if chunks else np.zeros(0, np.int64)
            before.append(np.cumsum(per) - per)
            ones.append(int(per.sum()))
            packed += [pa.compress(plane[k : k + CHUNK // 8], codec="zstd", asbytes=True) for k in range(0, len(plane), CHUNK // 8)]
            x = np.concatenate((x.take(np.flatnonzero(~one)), x.take(np.flatnonzero(one))))
        directory = [*before, np.array([len(p) for p in packed]), np.array(ones)]
        return b"".join((MAGIC, struct.pack("<BBQ", VERSION, bits, len(ids)), *(np.asarray(d).astype("<u4").tobytes() for d in directory), *packed))

    def _chunk(self, level: int, k: int) -> np.ndarray:
        """Bytes of one chunk of a plane."""
        at = level * self.chunks + k
        if at not in self.open:
            size = -(-min(CHUNK, self.n - k * CHUNK) // 8)
            self.open[at] = np.frombuffer(pa.decompress(self.payload[self.at[at] : self.at[at + 1]], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
        return self.open[at]

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before place ``at``."""
        if at >= self.n:
            return self.n - self.zeros[level]
        k, rest = divmod(at, CHUNK)
        chunk = self._chunk(level, k)
        count = int(self.before[level][k]) + int(np.bitwise_count(chunk[: rest // 8]).sum(dtype=np.int64))
        return count + (int(chunk[rest // 8] & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0)

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            k, rest = divmod(at, CHUNK)
            bit, ones = int(self._chunk(level, k)[rest // 8]) >> rest % 8 & 1, self._ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> self.bits - 1 - level & 1 else (start - a, end - b)
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in ids[start:end]."""
        if value < 0 or value >> self.bits:
            return 0
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of an id; raises IndexError beyond the last."""
        if nth < 0 or nth >= self.count(value):
            raise IndexError(nth)
        at = self._range(value, 0, self.n)[0] + nth
        for level in range(self.bits - 1, -1, -1):
            at = self._find(level, at - self.zeros[level], True) if value >> self.bits - 1 - level & 1 else self._find(level, at, False)
        return at

    def _find(self, level: int, nth: int, one: bool) -> int:
        before = self.before[level] if one else np.arange(self.chunks) * CHUNK - self.before[level]
        k = int(np.searchsorted(before, nth, "right")) - 1
        bits = np.unpackbits(self._chunk(level, k), bitorder="little")[: self.n - k * CHUNK]
        return k * CHUNK + int(np.flatnonzero(bits == one)[nth - before[k]])

    def decode(self) -> np.ndarray:
        """All ids in order."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self._chunk(level, k) for k in range(self.chunks)] or [np.zeros(0, np.uint8)])
            self.open.clear()
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(np.bool_)
            up = np.empty_like(x)
            up[np.flatnonzero(~one)] = x[: self.zeros[level]]
            up[np.flatnonzero(one)] = x[self.zeros[level] :] | x.dtype.type(1 << self.bits - 1 - level)
            x = up
        return x


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shard_tokens: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """Write the wavelet shards of ``docs`` to the shared folder; the stored table of SHARDS."""
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard, total = encoder(path), TaskContext.get().partitionId(), 0, 0
        bits = max(1, max(enc.whole.get_vocab_size() - 1, end_id).bit_length())
        end = np.array([end_id], enc.dtype).tobytes()
        ids, names, size = [], [], 0

        def flush():
            nonlocal shard, total, size
            counts = [len(b) // enc.dtype.itemsize for b in ids]
            payload = WaveletMatrix.build(np.frombuffer(b"".join(ids), enc.dtype), bits)
            row = {"part": part, "shard": shard, "first_token": total, "n_tokens": sum(counts), "doc_ids": list(names), "doc_tokens": counts, "payload": payload}
            shard, total, size = shard + 1, total + sum(counts), 0
            ids.clear(), names.clear()
            return pa.RecordBatch.from_pylist([row], _arrow_schema())

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in text_parts(texts):
                for doc, b in zip(doc_ids[i:j], enc.encode_batch(texts[i:j]), strict=True):
                    if size and size + len(b) > shard_tokens * enc.dtype.itemsize:
                        yield flush()
                    ids.append(b + end), names.append(doc)
                    size += len(b) + len(end)
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))  # parts rows of one doc_id, or without one, among tasks
    ordered = rows.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    return store(ordered.mapInArrow(run, SHARDS), "shards")


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SHARDS.split(", "))])


def _with_bases(shards: DataFrame) -> DataFrame:
    """``shards`` with ``before``, the ids of all parts before theirs; one number per part passes the driver."""
    totals, before, base = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}, 0, []
    for part in sorted(totals):
        base.append({"part": part, "before": before})
        before += totals[part]
    return shards.join(shards.sparkSession.createDataFrame(pa.Table.from_pylist(base, pa.schema([("part", pa.int64()), ("before", pa.int64())]))), "part")


def count_ids(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n): how often each of ``ids`` occurs, by counting in every shard's planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                w = WaveletMatrix(payload)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([w.count(i) for i in ids], pa.int64())], ["id", "n"])

    return shards.select("payload").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def places_of(shards: DataFrame, id_: int) -> DataFrame:
    """(place): the places of an id among all ids of all documents, by occurrence lookup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = WaveletMatrix(payload)
                yield pa.RecordBatch.from_arrays([pa.array([before + first + w.select(id_, k) for k in range(w.count(id_))], pa.int64())], ["place"])

    return _with_bases(shards).select("before", "first_token", "payload").mapInArrow(run, "place long")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards alone: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wide = memoryview(WaveletMatrix(row["payload"]).decode().astype("<u4")).cast("B")
                ends = np.cumsum(np.array(row["doc_tokens"], np.int64))
                starts = ends - row["doc_tokens"]
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first_token"] + row["before"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_bases(shards).select("first_token", "before", "doc_ids", "doc_tokens", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
