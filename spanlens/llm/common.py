"""Reading tables, shared scratch tables and the piece caches of the text operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset
    and Spark is local (tests) a fresh temporary one, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_made: contextvars.ContextVar[list["Scratch"] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Clears, at its end, the scratch tables of everything that was called inside, in this thread: what is to be read later must be written elsewhere by then."""
    made: list[Scratch] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for scratch in made:
            scratch.clear()


class Scratch:
    """Tables of one run under the shared folder. A written table cuts lineage and outlives executors; drop() removes those
    that a later round has replaced, clear() all of them. A result may read them: it must be written before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        if (made := _made.get()) is not None:
            made.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, df: DataFrame) -> None:
        self._delete(df.scratch_path)

    def clear(self) -> None:
        self._delete(self.root)

    def numbered(self, docs: DataFrame, *columns, name: str = "uid") -> DataFrame:
        """The columns of docs with a number for each row, written: a number given anew at each read follows the file
        splits, which follow the executors alive at planning, so it must be given once where several jobs rely on it."""
        return self.write(docs.select(*columns, F.monotonically_increasing_id().alias(name)))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it (case aside, as Spark takes names)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bounds what a Python worker holds at once: texts go over in Arrow batches of so many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def chunked(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct blank-separated chunks of a batch's texts, the number of each chunk among them, and the edges of each
    text's chunks. An empty text is one empty chunk; null counts as empty."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(), lists.offsets.to_numpy()


def strings(values: pa.Array) -> list[str]:
    """A string array as a list, by way of numpy, which is faster than to_pylist."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Pieces(dict):
    """Memo of a function of short strings. It is emptied at `limit` entries, so its memory is bounded
    whatever the corpus holds; worker processes keep it between tasks."""

    def __init__(self, of: Callable, limit: int = 600_000):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, key):
        value = self.of(key)
        if len(self) >= self.limit:
            self.clear()
        if len(key) <= 256:
            self[key] = value
        return value


def give_back() -> None:
    """Hands a worker's free memory back to the system, as an idle worker keeps it beside those of the stages to come."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory else
        trim(0)


_owner: list = [None, None]


def own_memory(operator: str, forget: Callable[[], None]) -> None:
    """Called as a task starts: a worker keeps the memos of one operator at a time, so those of a pipeline's stages don't add up."""
    if _owner[0] != operator:
        if _owner[1] is not None:
            _owner[1]()
            give_back()
        _owner[:] = [operator, forget]


def quiet_tokenizers() -> None:
    """One thread for each task: Spark's own tasks fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
