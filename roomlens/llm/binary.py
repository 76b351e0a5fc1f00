"""Token-ID output: Arrow files whose batches hold fixed-size lists, for random access without copies.

Documents are put in ascending id order (ties by text), encoded, and each is followed by the end id. A partition of that
order is one shard of two Arrow IPC files in the shared folder: ``sequences`` with columns ids (fixed-size list of
``LENGTH`` uint16) and mask (fixed-size list of ``LENGTH`` / 8 bytes, a bit for each id from the lowest on, 0 behind the shard's last token;
both are read without a copy), and ``index`` with the
documents' ids, starts in the shard and lengths. Files are written under a name of the task's attempt and then renamed, so
a lost executor's task can run again. All batches of a shard have ``BATCH`` sequences but the last.

Cases: null is the empty text, which is only the end id; null ids come first; repeated rows are each written; an empty table
gives no files and no rows; extra columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, shared_dir
from .tokens import tokenizer, with_end

LENGTH, BATCH, END_ID = 2048, 256, 0


def _fs(folder: str):
    """(file system, path) of a folder given as a URI or a plain path."""
    return pafs.FileSystem.from_uri(folder if ":" in folder else "file://" + folder)


class ShardWriter:
    """Writes one shard: tokens in, fixed-size batches out; holds at most one batch. ``length``: a multiple of 8."""

    def __init__(self, sink, length: int = LENGTH, batch: int = BATCH):
        if length % 8:
            raise ValueError(f"length {length} is no multiple of 8")
        self.length, self.room = length, length * batch
        self.schema = pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.out, self.parts, self.held = ipc.new_file(sink, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        while self.held >= self.room:
            flat = np.concatenate(self.parts)
            self._write(flat[: self.room], self.room)
            self.parts, self.held = [flat[self.room :]], self.held - self.room

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = np.packbits(np.arange(len(ids)) < valid, bitorder="little")
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((ids, self.length), (mask, self.length // 8))]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.parts)
            full = np.zeros(-(-len(flat) // self.length) * self.length, np.uint16)
            full[: len(flat)] = flat
            self._write(full, len(flat))
        self.out.close()


class ShardReader:
    """Random access to one shard's sequences and tokens; local files are mapped, not copied."""

    def __init__(self, fs, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.file = ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        first = self.file.get_batch(0) if self.file.num_record_batches else None
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = len(first) if first is not None else 0
        self.last: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != k:
            self.last = (k, self.file.get_batch(k))
        return self.last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask bits of sequence ``k``, as views of the file's bytes."""
        b, row = self._batch(k // self.rows), k % self.rows
        ids, mask = (b.column(j).slice(row, 1).flatten() for j in (0, 1))
        return ids.to_numpy(), mask.to_numpy()

    def tokens(self, start: int, size: int) -> np.ndarray:
        """Tokens from ``start`` on, over batch ends."""
        parts, room = [], self.rows * self.length
        while size:
            b = self._batch(start // room)
            flat = b.column(0).flatten().to_numpy()[start % room : start % room + size]
            parts.append(flat)
            start += len(flat)
            size -= len(flat)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write(docs: DataFrame, path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write the shards to ``folder``; returns the manifest (shard, name, n_docs, n_tokens, start), one row for each shard."""
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = base.repartitionByRange(parts, "i", F.xxhash64("t")).sortWithinPartitions("i", F.xxhash64("t"), "t")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        tok, k = tokenizer(path), ctx.partitionId()
        fs, root = _fs(folder)
        name, mine = f"{k:06d}", f"{k:06d}-{ctx.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        writer, sink = None, None
        n_docs = n_tokens = 0
        ids_out = None
        for b in batches:
            if len(b) == 0:
                continue
            if writer is None:
                sink = fs.open_output_stream(f"{root}/.{mine}.sequences")
                writer = ShardWriter(sink, length)
                index_sink = fs.open_output_stream(f"{root}/.{mine}.index")
                schema = pa.schema([("doc", b.schema.field(0).type), ("start", pa.int64()), ("size", pa.int64())])
                ids_out = ipc.new_file(index_sink, schema)
            ids, ends = with_end(*tok.encode(b.column(1)), end_id)
            writer.add(ids)
            sizes = np.diff(ends, prepend=0)
            starts = n_tokens + ends - sizes
            n_tokens += len(ids)
            ids_out.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            n_docs += len(b)
        if writer is not None:
            writer.close()
            ids_out.close()
            sink.close()
            index_sink.close()
            for what in ("sequences", "index"):
                fs.move(f"{root}/.{mine}.{what}", f"{root}/{name}.{what}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["shard", "name", "n_docs", "n_tokens"])

    made = cut(ranged.mapInArrow(shard, "shard long, name string, n_docs long, n_tokens long"))
    return made.withColumn("start", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens"))


def read(manifest: DataFrame, folder: str, *, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """One row for each document of the files: id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.select("shard", "name", "start").repartition(parts, "shard")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for b in batches:
            for name, offset in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                seqs = ShardReader(fs, f"{root}/{name}.sequences.arrow")
                with fs.open_input_file(f"{root}/{name}.index.arrow") as f:
                    index = ipc.open_file(f)
                    for j in range(index.num_record_batches):
                        x = index.get_batch(j)
                        start, size = x.column(1).to_numpy(), x.column(2).to_numpy()
                        crc = [zlib.crc32(seqs.tokens(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(start, size, strict=True)]
                        yield pa.RecordBatch.from_arrays([x.column(0), pa.array(start + offset), x.column(2), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(load, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files, then read every document back from them."""
    folder = new_folder(docs.sparkSession, "token-ids")
    made = write(docs, path, folder, id_col=id_col, text_col=text_col)
    return read(made, folder, id_col=id_col, id_type=dict(docs.dtypes)[id_col])
