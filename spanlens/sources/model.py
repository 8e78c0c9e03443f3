"""Answers of a model server to the engine's questions: a client in each task, on the executor's own loopback address.

A question's key is a digest of its prompt and of the model's name. Answers are appended to a store, a Parquet table in a shared folder, in waves
of questions: what a lost job has answered is not asked again, and a lost executor's task asks its own share of one wave.

A server that fails `failures` calls in a row, by transport or by status, is down: the task fails, and with it the job, once Spark has tried
the task elsewhere. An answer that can't be read is no transport failure: it stays empty, and the engine sends its span to review. No question is skipped.
"""

from __future__ import annotations

import http.client
import ipaddress
import json
import math
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.judge import prompt_prefix
from ..operators.questions import question_text

# What the model is told first, and the template of servers that take a finished prompt.
SYSTEM = "You classify one marked span in clinical or administrative text from Singapore. Reply with exactly one option letter and nothing else."
TEMPLATE = "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{user}<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"

STORED = "key string, tokens array<struct<token:string,prob:double>>, seconds double"


class Down(RuntimeError):
    """The server failed several calls in a row."""


def loopback(url: str) -> tuple[str, int, str]:
    """Host, port and path of a plain HTTP address on this machine; an error for any other: texts don't leave it."""
    parts = urlsplit(url)
    host = parts.hostname or ""
    try:
        near = host == "localhost" or ipaddress.ip_address(host).is_loopback
    except ValueError:
        near = False
    if parts.scheme != "http" or not near:
        raise ValueError(f"{url!r} is no HTTP address on the loopback interface")
    return host, parts.port or 80, parts.path.rstrip("/")


@dataclass(frozen=True)
class Server:
    """A model server. chat: it takes messages and returns log probabilities of its first token; else it takes a finished prompt."""

    url: str
    model: str | None = None
    key: str | None = None
    chat: bool = True
    timeout: float = 120.0
    top: int = 20
    failures: int = 3
    wait: float = 0.5

    def body(self, prompt: str) -> tuple[str, dict]:
        if self.chat:
            asked = {
                "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}], "max_tokens": 1, "temperature": 0, "logprobs": True, "top_logprobs": self.top,
                "stream": False, "cache_prompt": True, "chat_template_kwargs": {"enable_thinking": False},
            }
            return "/v1/chat/completions", asked | ({"model": self.model} if self.model else {})
        asked = {
            "model": self.model, "raw": True, "stream": False, "prompt": TEMPLATE.format(system=SYSTEM, user=prompt), "logprobs": True, "top_logprobs": self.top,
            "keep_alive": "30m", "options": {"num_predict": 1, "temperature": 0, "num_ctx": 4096, "num_gpu": 0},
        }
        return "/api/generate", asked

    def read(self, answer: bytes) -> list[dict] | None:
        """The first token's alternatives with their probabilities; null if the answer doesn't hold them."""
        try:
            found = json.loads(answer.decode("utf-8"))
            top = found["choices"][0]["logprobs"]["content"][0]["top_logprobs"] if self.chat else found["logprobs"][0]["top_logprobs"]
            return [{"token": str(t["token"]), "prob": math.exp(float(t["logprob"]))} for t in top]
        except (ValueError, KeyError, IndexError, TypeError, OverflowError):
            return None


class Client:
    """One connection, kept open; counts failures in a row."""

    def __init__(self, server: Server):
        self.server, self.failed, self.connection = server, 0, None
        self.host, self.port, self.path = loopback(server.url)

    def close(self) -> None:
        if self.connection is not None:
            self.connection.close()
        self.connection = None

    def ask(self, prompt: str) -> list[dict] | None:
        path, body = self.server.body(prompt)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.server.key}"} if self.server.key else {})
        while True:
            try:
                if self.connection is None:
                    self.connection = http.client.HTTPConnection(self.host, self.port, timeout=self.server.timeout)
                self.connection.request("POST", self.path + path, json.dumps(body).encode(), headers)
                response = self.connection.getresponse()
                data = response.read()
                why = None if response.status == 200 else f"status {response.status}"
            except (http.client.HTTPException, OSError) as e:
                why = f"{type(e).__name__}: {e}"
            if why is None:
                self.failed = 0
                return self.server.read(data)
            self.close()
            self.failed += 1
            if self.failed >= self.server.failures:
                raise Down(f"{self.server.url}: {self.failed} calls in a row failed, the last by {why}")
            time.sleep(self.server.wait)


def _answers(server: Server) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("token", pa.string()), ("prob", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(server)
        try:
            for batch in batches:
                found, took = [], []
                for prompt in batch.column("prompt").to_pylist():
                    began = time.perf_counter()
                    found.append(client.ask(prompt) or [])
                    took.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, kind), pa.array(took, pa.float64())], ["key", "tokens", "seconds"])
        finally:
            client.close()

    return run


def prompts(shown: DataFrame, server: Server) -> DataFrame:
    """candidate, order_idx, prompt, key of the engine's questions (candidate, order_idx, position, option, family, kind, match, text, span_start, span_end, column)."""
    where = [F.col(c) for c in ("text", "span_start", "span_end")]
    column = F.col("column") if "column" in shown.columns else F.lit(None).cast("string")
    before = shown.groupBy("candidate", "order_idx").agg(F.first(prompt_prefix(*where, column)).alias("before"))
    whole = question_text(shown).join(before, ["candidate", "order_idx"]).withColumn("prompt", F.concat("before", "question"))
    return whole.select("candidate", "order_idx", "prompt", F.sha2(F.concat_ws("\n", F.lit(f"{server.model or ''} {int(server.chat)} {server.top}"), "prompt"), 256).alias("key"))


def model_backend(server: Server, store: str | None = None, waves: int = 1, clients: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A backend for engine.scan. store: a folder of answers kept between runs; without one a run has a folder of its own under spark.checkpoint.dir.
    waves: how many parts the questions are asked and stored in. clients: tasks that ask at once, Spark's shuffle partitions if not given."""
    loopback(server.url)

    def backend(shown: DataFrame) -> DataFrame:
        from .staging import Staging

        spark = shown.sparkSession
        stage = Staging(spark, "questions")
        path = store or f"{stage.root}/answers-{uuid.uuid4().hex}"
        asked = stage.write(prompts(shown, server))
        spark.createDataFrame([], STORED).write.mode("append").parquet(path)
        unique = asked.select("key", "prompt").distinct()
        for wave in range(waves):
            known = spark.read.schema(STORED).parquet(path).select("key")
            due = unique.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).join(known, "key", "left_anti")
            n = clients or int(spark.conf.get("spark.sql.shuffle.partitions"))
            due.repartition(n, "key").mapInArrow(_answers(server), STORED).write.mode("append").parquet(path)
        stored = spark.read.schema(STORED).parquet(path).groupBy("key").agg(F.first("tokens").alias("tokens"))
        told = asked.select("candidate", "order_idx", "key").join(stored, "key")
        return told.select("candidate", "order_idx", F.explode("tokens").alias("t")).select("candidate", "order_idx", "t.token", "t.prob")

    return backend


def latency(store: DataFrame) -> DataFrame:
    """One row from stored answers: calls, and nearest-rank percentiles of their seconds, p50 and p95."""
    return store.agg(F.count("*").alias("calls"), F.percentile_approx("seconds", 0.5, 10_000).alias("p50"), F.percentile_approx("seconds", 0.95, 10_000).alias("p95"))
