"""The vocabulary of a model file in GGUF: a Python data source that reads the header alone, where the file lies.

spark.dataSource.register(GgufTokens); spark.read.format("gguf_tokens").load("hdfs://.../*.gguf") or a path of one file. Files may be many
gigabytes; only the metadata up to the tokens is read, a file in a task, in batches of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The format's mark, its value types of a fixed size, and the key of the tokens.
MAGIC = b"GGUF"
SIZES = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
STRING, ARRAY = 8, 9
TOKENS = "tokenizer.ggml.tokens"

BATCH = 8192
LONGEST = 1 << 20


class Header:
    """A cursor over a file's metadata."""

    def __init__(self, file: BinaryIO, name: str):
        self.file, self.name = file, name

    def take(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"{self.name}: the header ends early")
        return data

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "little")

    def string(self) -> str:
        n = self.number(8)
        if n > LONGEST:
            raise ValueError(f"{self.name}: a string of {n} bytes in the header")
        return self.take(n).decode("utf-8", "replace")

    def ahead(self, n: int) -> None:
        self.file.seek(n, 1)

    def skip(self, kind: int) -> None:
        if kind in SIZES:
            self.ahead(SIZES[kind])
        elif kind == STRING:
            self.ahead(self.number(8))
        elif kind == ARRAY:
            kind, n = self.number(4), self.number(8)
            if kind in SIZES:
                self.ahead(n * SIZES[kind])
            else:
                for _ in range(n):
                    self.skip(kind)
        else:
            raise ValueError(f"{self.name}: unknown kind of value {kind}")

    def tokens(self) -> Iterator[str]:
        if self.take(4) != MAGIC:
            raise ValueError(f"{self.name} is no GGUF file")
        if (version := self.number(4)) < 2:
            raise ValueError(f"{self.name}: version {version} is not supported")
        self.number(8)  # tensors
        for _ in range(self.number(8)):
            key, kind = self.string(), self.number(4)
            if key != TOKENS:
                self.skip(kind)
            elif kind != ARRAY or self.number(4) != STRING:
                raise ValueError(f"{self.name}: the tokens are no array of strings")
            else:
                for _ in range(self.number(8)):
                    yield self.string()
                return
        raise ValueError(f"{self.name} has no tokens")


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GgufReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if "*" not in self.path:
            return [File(self.path)]
        folder, _, pattern = self.path.rpartition("/")
        system, root = fs.FileSystem.from_uri(folder)
        before, _, after = pattern.partition("*")
        head = folder[: len(folder) - len(root)]
        names = (i.path for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.base_name.startswith(before) and i.base_name.endswith(after))
        return [File(head + n) for n in sorted(names)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as file:
            tokens, first = [], 0
            for token in Header(file, partition.path).tokens():
                tokens.append(token)
                if len(tokens) == BATCH:
                    yield self.batch(partition.path, first, tokens)
                    first, tokens = first + BATCH, []
            yield self.batch(partition.path, first, tokens)

    @staticmethod
    def batch(path: str, first: int, tokens: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(tokens), pa.string()), pa.array(range(first, first + len(tokens)), pa.int64()), pa.array(tokens, pa.string())], ["path", "id", "token"])


class GgufTokens(DataSource):
    """path, id, token of every token of GGUF files. A file that is no GGUF file, or has no tokens, is the job's failure."""

    @classmethod
    def name(cls) -> str:
        return "gguf_tokens"

    def schema(self) -> str:
        return "path string, id long, token string"

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("path"):
            raise ValueError("gguf_tokens wants a path")
        return GgufReader(self.options["path"])
