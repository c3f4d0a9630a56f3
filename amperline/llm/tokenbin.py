"""Token ids in Arrow files of equal-length sequences, and the reader of these files.

Documents in ascending doc_id order form one stream of ids (each document followed by the end
id). The stream is range-partitioned by doc_id; each partition is one shard of two Arrow IPC
files in a shared folder:

* `ids-<shard>-<attempt>.arrow`: record batches of at most BATCH rows; a row is `ids`, a fixed-size list of
  `seq_len` unsigned integers, and `mask`, a fixed-size list of booleans that is false on the
  padding of a shard's last row. Sequence i is row i % BATCH of batch i // BATCH; a memory map
  of the file gives it without a copy.
* `docs-<shard>-<attempt>.arrow`: doc_id, start in the shard, n_tokens.

A task writes under names of its own attempt and tells them in the manifest, of which Spark keeps
one row per shard. So a task that runs again after a lost executor, or twice at a time, spoils
nothing and nothing is renamed; files that the manifest lacks are removed at the end.

Defined cases: null text is empty and gives the end id only; rows with the same doc_id follow
each other by the hash of their text; an empty table gives no files; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amperline.llm.store import fresh_path, save

BATCH = 256
SHARD_TEXT_BYTES, GROUP = 16 << 20, 4096
_MANIFEST = "shard int, attempt long, n_docs long, n_ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _ShardWriter:
    """Cuts a stream of ids into rows of `seq_len` and writes whole batches as they fill."""

    def __init__(self, out, seq_len: int, kind: pa.DataType):
        self.seq_len, self.kind = seq_len, kind
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.file = pa.ipc.new_file(out, self.schema)
        self.rest, self.waiting, self.n = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.n += len(ids)
        if self.waiting >= self.seq_len * BATCH:
            flat = np.concatenate(self.rest)
            whole = len(flat) // (self.seq_len * BATCH) * self.seq_len * BATCH
            for at in range(0, whole, self.seq_len * BATCH):
                self._write(flat[at : at + self.seq_len * BATCH], None)
            self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.zeros(0)
        if len(flat):
            pad = -len(flat) % self.seq_len
            self._write(np.concatenate([flat, np.zeros(pad, flat.dtype)]), len(flat))
        self.file.close()

    def _write(self, flat: np.ndarray, valid: int | None) -> None:
        mask = np.arange(len(flat)) < (len(flat) if valid is None else valid)
        self.file.write_batch(
            pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.seq_len), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len)],
                schema=self.schema,
            )
        )


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, out: str, seq_len: int = 2048) -> DataFrame:
    """Write the files into the folder `out`; returns (shard, attempt, n_docs, n_ids), one row per shard."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0] or 0
    ordered = docs.repartitionByRange(max(1, -(-size // SHARD_TEXT_BYTES)), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from amperline.llm.encoder import encoder

        enc, task = encoder(tokenizer), TaskContext.get()
        end = np.array([end_id], enc.dtype)
        store, root = _open(out)
        store.create_dir(root, recursive=True)
        shard, attempt = task.partitionId(), task.taskAttemptId()
        ids_file, n_docs, index = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids_file is None:
                ids_file = store.open_output_stream(f"{root}/{_file("ids", shard, attempt)}")
                writer = _ShardWriter(ids_file, seq_len, pa.from_numpy_dtype(enc.dtype))
            sizes = np.zeros(batch.num_rows, np.int64)
            first = writer.n
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                ids = np.frombuffer(enc.blob(text.as_py() or b""), enc.dtype)
                writer.add(np.concatenate([ids, end]))
                sizes[i] = len(ids) + 1
            index.append(pa.record_batch([batch.column(0), pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes)], names=["doc_id", "start", "n_tokens"]))
            n_docs += batch.num_rows
        if ids_file is None:
            return
        writer.close()
        ids_file.close()
        with store.open_output_stream(f"{root}/{_file("docs", shard, attempt)}") as f, pa.ipc.new_file(f, index[0].schema) as docs_file:
            for x in index:
                docs_file.write_batch(x)
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([attempt]), pa.array([n_docs]), pa.array([writer.n])], names=["shard", "attempt", "n_docs", "n_ids"])

    manifest = save(ordered.mapInArrow(write, _MANIFEST), "token-shards")
    _remove_others(manifest, out)
    return manifest


def _file(kind: str, shard: int, attempt: int) -> str:
    return f"{kind}-{shard:06d}-{attempt}.arrow"


def _remove_others(manifest: DataFrame, out: str) -> None:
    """Delete files of attempts that the manifest doesn't name."""
    spark = manifest.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return
    names = {_file(kind, r.shard, r.attempt) for r in manifest.select("shard", "attempt").toLocalIterator() for kind in ("ids", "docs")}
    for x in store.listStatus(folder):
        if x.getPath().getName() not in names:
            store.delete(x.getPath(), False)


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    # the first id's place in the whole stream: sums of groups of shards, then within each group
    keyed = manifest.withColumn("group", F.floor(F.col("shard") / GROUP))
    order = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    groups = keyed.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    base = F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    shards = keyed.join(groups, "group").select("shard", "attempt", base.alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(out)
        for batch in batches:
            for shard, attempt, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{_file("ids", shard, attempt)}") as f:
                    t = pa.ipc.open_file(f).read_all()
                ids = np.concatenate([c.flatten().to_numpy() for c in t["ids"].chunks])
                mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["mask"].chunks])
                ids = np.ascontiguousarray(ids[mask], "<u4")
                with store.open_input_file(f"{root}/{_file("docs", shard, attempt)}") as f:
                    index = pa.ipc.open_file(f).read_all().combine_chunks()
                start, n = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                crc = np.array([zlib.crc32(ids[a : a + k]) for a, k in zip(start, n, strict=True)], np.int64)
                yield pa.record_batch([index["doc_id"].chunk(0), pa.array(start + base), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return shards.repartition(n, "shard").mapInArrow(read, _DOCS)


def sequence(path: str, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i of a local shard file; the ids are a view of the file's pages."""
    with pa.memory_map(path) as f:
        batch = pa.ipc.open_file(f).get_batch(i // BATCH)
    k = i % BATCH
    return batch["ids"][k].values.to_numpy(), batch["mask"][k].values.to_numpy(zero_copy_only=False)


def token_stream(docs: DataFrame, tokenizer: str, end_id: int = 2, seq_len: int = 2048, out: str | None = None) -> DataFrame:
    """Write the files and read each document back from them."""
    spark: SparkSession = docs.sparkSession
    out = out or fresh_path(spark, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, end_id, out, seq_len), out)
