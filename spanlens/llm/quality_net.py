"""Quality of texts by a convolutional network over their bytes, in numpy.

A text is cut into chunks of CHUNK bytes that reach WIDTH - 1 bytes into the next one, so that every window of WIDTH bytes
lies in a chunk and none in two. A filter is a table of weights by place and byte; its answer at a window is their sum, above 0,
and a chunk keeps each filter's greatest answer. The text's log odds are the mean over its chunks, weighted by their bytes,
of a linear form of these maxima. So all of a text counts, in memory that doesn't grow with it.

The network is fitted by gradient descent in one task, on a sample bounded in rows and bytes; only its weights go to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, small_batches, table

CHUNK, WIDTH, FILTERS = 256, 7, 24
#: Bounds of the sample: documents of each label, and chunks of a document, spread evenly over the whole of it.
SAMPLE_DOCS, SAMPLE_CHUNKS = 1000, 16
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 32, 0.01, 1e-4, 7


class Network:
    """filters[place, byte, filter], weights[filter], bias. Byte 0 weighs nothing: it pads."""

    def __init__(self, filters: np.ndarray, weights: np.ndarray, bias: float):
        self.filters, self.weights, self.bias = filters.astype(np.float32), weights.astype(np.float32), float(bias)

    def answers(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Every filter's answer at the windows that begin at these places."""
        z = self.filters[0].take(padded[at], axis=0)
        for k in range(1, WIDTH):
            z += self.filters[k].take(padded[at + k], axis=0)
        return z

    def log_odds(self, texts: pa.Array, chunks: int = 64) -> np.ndarray:
        """One number for each text (null: empty); `chunks` bounds what is convolved at once."""
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out = np.empty(len(texts))
        for i, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
            out[i] = self._text(data[lo:hi], chunks)
        return out

    def _text(self, data: np.ndarray, chunks: int) -> float:
        total, step = 0.0, chunks * CHUNK
        for lo in range(0, len(data), step):
            padded = np.zeros(min(step, len(data) - lo) + WIDTH - 1, np.uint8)
            part = data[lo : lo + len(padded)]
            padded[: len(part)] = part
            n = len(padded) - WIDTH + 1
            starts = np.arange(0, n, CHUNK)
            greatest = np.maximum(np.maximum.reduceat(self.answers(padded, np.arange(n)), starts, axis=0), 0)
            total += float((greatest @ self.weights).astype(np.float64) @ np.diff(starts, append=n))
        return self.bias + (total / len(data) if len(data) else 0.0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(texts), -700, 700)))


def chunks_of(text: bytes, most: int = SAMPLE_CHUNKS) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` padded chunks of a text, spread evenly, and the bytes that each begins."""
    n = max(1, -(-len(text) // CHUNK))
    chosen = np.unique(np.linspace(0, n - 1, min(n, most)).astype(np.int64))
    padded = np.zeros((len(chosen), CHUNK + WIDTH - 1), np.uint8)
    for row, c in zip(padded, chosen):
        part = np.frombuffer(text[c * CHUNK : (c + 1) * CHUNK + WIDTH - 1], np.uint8)
        row[: len(part)] = part
    return padded, np.minimum(CHUNK, len(text) - chosen * CHUNK)


def train(docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, prior: float) -> Network:
    """Adam on the logistic loss with both labels of equal weight; the bias then moves by the log odds of the labels (prior).
    A filter's gradient goes to the one window of a chunk where it is greatest."""
    rng = np.random.default_rng(SEED)
    state = {"filters": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), "weights": rng.normal(0, 0.5, FILTERS), "bias": np.zeros(1)}
    state["filters"][:, 0] = 0
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in state.items()}
    balance = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    windows = np.arange(CHUNK)
    steps = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            chunks = np.concatenate([docs[i] for i in batch])
            size = np.concatenate([sizes[i] for i in batch]).astype(np.float64)
            of = np.repeat(np.arange(len(batch)), [len(docs[i]) for i in batch])
            share = size / np.maximum(np.bincount(of, size)[of], 1)
            net = Network(state["filters"], state["weights"], state["bias"][0])
            z = net.answers(chunks.reshape(-1), (np.arange(len(chunks))[:, None] * chunks.shape[1] + windows).reshape(-1)).reshape(len(chunks), CHUNK, FILTERS)
            top = z.argmax(axis=1)
            greatest = np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0).astype(np.float64)
            odds = np.bincount(of, share * (greatest @ state["weights"])) + state["bias"][0]
            off = (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - labels[batch]) * balance[batch] / len(batch)
            by_chunk = off[of] * share
            down = (by_chunk[:, None] * state["weights"]) * (greatest > 0)
            bytes_at = chunks[np.arange(len(chunks))[:, None, None], top[:, None] + np.arange(WIDTH)[None, :, None]]
            cell = (np.arange(WIDTH)[None, :, None] * 256 + bytes_at) * FILTERS + np.arange(FILTERS)
            filters = np.bincount(cell.reshape(-1), np.broadcast_to(down[:, None], cell.shape).reshape(-1), WIDTH * 256 * FILTERS).reshape(WIDTH, 256, FILTERS)
            filters[:, 0] = 0
            slopes = {"filters": filters + DECAY * state["filters"], "weights": greatest.T @ by_chunk + DECAY * state["weights"], "bias": np.array([off.sum()])}
            steps += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in slopes.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                state[k] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return Network(state["filters"], state["weights"], state["bias"][0] + prior)


def _cut() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = [chunks_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
        columns = [batch.column("quality"), batch.column("h"), pa.array([c.tobytes() for c, _ in cut], pa.binary()), pa.array([s.astype("<i8").tobytes() for _, s in cut], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["quality", "h", "chunks", "sizes"])

    return each


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """A network from docs (doc_id, text) and labels (doc_id, quality 0 or 1; other values are left out).

    Of each quality, the labelled documents whose ids have the least hashes are looked up, twice sample_docs of them, and their first
    sample_docs distinct texts are learned. Where a quality has no text, scores are the smoothed share of quality 1 for every text."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    n = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))
    least = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.withColumn("k", F.row_number().over(least)).where(F.col("k") <= 2 * sample_docs).drop("k")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("quality", F.xxhash64("text").alias("h"), "text")
    sample = arrow_map(found, _cut, "quality int, h long, chunks binary, sizes binary").groupBy("quality", "h").agg(F.first("chunks").alias("chunks"), F.first("sizes").alias("sizes"))

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["quality"], r["h"], r["chunks"], r["sizes"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        kept = [r for q in (0, 1) for r in [x for x in rows if x[0] == q][:sample_docs]]
        if {r[0] for r in kept} == {0, 1}:
            net = train([np.frombuffer(r[2], np.uint8).reshape(-1, CHUNK + WIDTH - 1) for r in kept], [np.frombuffer(r[3], "<i8") for r in kept], np.array([r[0] for r in kept]), prior)
        else:
            net = Network(np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.filters, net.weights, net.bias))], pa.binary())], ["network"])

    made = sample.repartition(1).mapInArrow(learn, "network binary").collect()
    return Network(*pickle.loads(made[0]["network"])) if made else Network(np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS), prior)


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score of every row of docs."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        return lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.scores(batch.column("text")))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double")


def held_out():
    """Rows kept out of the fit: the unsigned CRC-32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text and any other columns). A null text is an empty one,
    a row without a doc_id is scored and never learned from; without labels of both kinds the score is the share of quality 1."""
    small_batches(docs.sparkSession)
    net = fit(docs, labels.where(~held_out()))
    return predict(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents, learned from labels outside the held-out third."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
