"""Token ids in the Arrow stream format.

Documents are dealt by ranges of doc_id; each task writes one shard: a stream file whose batches hold
fixed-size lists of ids and of mask bits, a second one that says where each document lies, and a third with the
place of each batch in the first, as the stream format has no footer: sequence k of a shard is a slice of
a memory map. Ids of one document run on over sequences, and only a shard's last sequence is padded. A shard
counts once its task's row has reached the manifest; files of lost attempts bear other names and are removed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import partitions, shared_dir, small_batches, table, text_or_empty
from .word_ids import word_encoder

MANIFEST = "shard int, ids_path string, index_path string, places_path string, n_ids long, n_docs long"
#: Sequences in a record batch; bytes of text in a shard at most, on average.
BATCH_SEQUENCES, SHARD_BYTES = 256, 256_000_000


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, length: int = 2048, shards: int | None = None) -> list[tuple]:
    """Writes docs (doc_id, text) in ascending doc_id order and returns the manifest: a row for each shard, in order.

    Null text counts as empty: its document is the end id alone. Null doc_id comes first; rows that share a
    doc_id stand next to each other in the order of their texts' lengths and digests. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("_n", F.length("text")).withColumn("_h", F.xxhash64("text"))
    order = ["doc_id", "_n", "_h"]
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(partitions(spark), -(-size // SHARD_BYTES))
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_encoder(vocabulary)
        writer = None
        for batch in batches:
            if writer is None:
                shard = TaskContext.get().partitionId()
                writer = ShardWriter(f"{folder}/{shard:06d}-{uuid.uuid4().hex}", encode.dtype, length, batch.schema.field(0).type)
            writer.add(batch.column(0).to_pylist(), [x.tobytes() for x in encode(batch.column(1), end_id)])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([x]) for x in (*writer.paths, writer.n_ids, writer.n_docs)]], ["shard", "ids_path", "index_path", "places_path", "n_ids", "n_docs"])

    manifest = sorted(map(tuple, dealt.mapInArrow(run, MANIFEST).collect()))
    _sweep(spark, folder, {x for row in manifest for x in row[1:4]})
    return manifest


def _sweep(spark: SparkSession, folder: str, kept: set[str]) -> None:
    """Removes the files of attempts that did not reach the manifest."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = {x.rsplit("/", 1)[1] for x in kept}
    for found in files.listStatus(path) if files.exists(path) else ():
        if found.getPath().getName() not in names:
            files.delete(found.getPath(), False)


def opened(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


class ShardWriter:
    def __init__(self, stem: str, dtype: np.dtype, length: int, id_type: pa.DataType):
        self.length, self.dtype = length, dtype
        self.paths = tuple(f"{stem}{x}.arrows" for x in ("", ".index", ".places"))
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_ids", pa.int64())])
        self.streams, self.writers = [], []
        self.places_schema = pa.schema([("offset", pa.int64())])
        self.places: list[int] = []
        for path, schema in zip(self.paths, (self.schema, self.index_schema, self.places_schema)):
            files, local = opened(path)
            files.create_dir(local.rsplit("/", 1)[0], recursive=True)
            stream = files.open_output_stream(local)
            self.streams.append(stream)
            self.writers.append(pa.ipc.new_stream(stream, schema))
        self.open_ids = b""
        self.n_ids = self.n_docs = 0

    def add(self, doc_ids: list, docs: list[bytes]) -> None:
        width = self.dtype.itemsize
        sizes = np.array([len(x) for x in docs], np.int64) // width
        starts = self.n_ids + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, self.index_schema.field(0).type), pa.array(starts), pa.array(sizes)], schema=self.index_schema))
        self.n_ids += int(sizes.sum())
        self.n_docs += len(docs)
        data = self.open_ids + b"".join(docs)
        step = self.length * width * BATCH_SEQUENCES
        whole = len(data) // step * step
        for i in range(0, whole, step):
            self._write(data[i : i + step])
        self.open_ids = data[whole:]

    def _write(self, data: bytes) -> None:
        ids = np.frombuffer(data, self.dtype)
        n = -(-len(ids) // self.length)
        padded = np.zeros(n * self.length, self.dtype)
        padded[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(n * self.length) < len(ids))]
        self.places.append(self.streams[0].tell())
        self.writers[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.open_ids:
            self._write(self.open_ids)
        self.writers[2].write_batch(pa.RecordBatch.from_arrays([pa.array(self.places, pa.int64())], schema=self.places_schema))
        for x in (*self.writers, *self.streams):
            x.close()


class Sequences:
    """Random access to a shard's sequences: len(), and (ids, mask) of any number as Arrow arrays, slices of the memory map where the file is local. Mask
    bits stay packed: a byte each would make the files half as large again."""

    def __init__(self, ids_path: str, places_path: str):
        from pyarrow import fs

        files, local = opened(ids_path)
        self.source = pa.memory_map(local) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(local)
        self.schema = pa.ipc.open_stream(self.source).schema
        self.places = np.concatenate([b.column(0).to_numpy() for b in batches_of(places_path)] or [np.zeros(0, np.int64)])
        self.length = self.schema.field("ids").type.list_size

    def batch(self, number: int) -> pa.RecordBatch:
        self.source.seek(int(self.places[number]))
        message = pa.ipc.read_message(self.source)
        if message.type == "schema":  # it goes out with the first batch
            message = pa.ipc.read_message(self.source)
        return pa.ipc.read_record_batch(message, self.schema)

    def __len__(self) -> int:
        return (len(self.places) - 1) * BATCH_SEQUENCES + self.batch(-1).num_rows if len(self.places) else 0

    def __getitem__(self, k: int) -> tuple[pa.Array, pa.Array]:
        number, row = divmod(k, BATCH_SEQUENCES)
        if k < 0 or number >= len(self.places):
            raise IndexError(k)
        batch = self.batch(number)
        if row >= batch.num_rows:
            raise IndexError(k)
        return tuple(c.slice(row, 1).flatten() for c in batch.columns)


def batches_of(path: str) -> Iterator[pa.RecordBatch]:
    """Batches of a stream file: from a memory map where the file is local, so nothing is copied."""
    from pyarrow import fs

    files, local = opened(path)
    with pa.memory_map(local) if isinstance(files, fs.LocalFileSystem) else files.open_input_stream(local) as source:
        yield from pa.ipc.open_stream(source)


def read_sequences(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of each batch, both sequences x length."""
    for b in batches_of(path):
        n = b.schema.field("ids").type.list_size
        yield b.column(0).flatten().to_numpy().reshape(-1, n), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def read_documents(ids_path: str, index_path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the shard, ids) of each document, from the stream of sequences; memory holds a batch and an open document."""
    held, at = np.zeros(0, np.uint32), 0
    batches = batches_of(ids_path)
    for index in batches_of(index_path):
        for doc_id, start, n in zip(*(c.to_pylist() for c in index.columns)):
            parts = []
            while start + n > at + len(held):
                parts.append(held)
                at += len(held)
                held = next(batches).column(0).flatten().to_numpy()
                if parts and len(parts[0]) == 0:
                    parts.pop()
            if parts:
                first = start - (at - sum(map(len, parts)))
                joined = np.concatenate([*parts, held])[first : first + n]
            else:
                joined = held[start - at : start - at + n]
            yield doc_id, start, joined


def read_back(spark: SparkSession, manifest: list[tuple], id_type: T.DataType = T.LongType()) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a manifest; tasks read a shard each."""
    base, rows = 0, []
    for _, ids, index, _, n_ids, _ in manifest:
        rows.append((ids, index, base))
        base += n_ids
    files = spark.createDataFrame(rows, "ids_path string, index_path string, base long")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    kinds = [to_arrow_type(id_type), *[pa.int64()] * 3]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids_path, index_path, base in zip(*(c.to_pylist() for c in batch.columns)):
                found = ((d, base + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in read_documents(ids_path, index_path))
                while part := list(islice(found, 8192)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)

    n = max(1, len(rows))
    return files.repartition(n).mapInArrow(run, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as an Arrow stream in ascending doc_id and read back; null texts are one end id, null ids come first, an empty table gives no rows."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/arrow-stream-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    manifest = write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_back(spark, manifest, docs.schema["doc_id"].dataType)
