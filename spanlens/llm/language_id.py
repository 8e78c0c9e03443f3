"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the
sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words,
which are runs of letters: the first one between two blanks bears the vocabulary's mark of a start, others don't.
No piece reaches over a blank. Probabilities are fitted by expectation maximisation on a bounded sample of
labelled documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, chunked, own_memory, small_batches, strings, table

START = "▁"
WORD = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")

#: Labelled texts of each language that the fit reads whole: its bound.
SAMPLE_DOCS = 400
ROUNDS = 2
#: Probability of a character that the vocabulary lacks, and the count given to every piece beforehand.
UNKNOWN, PRIOR = 1e-8, 0.05
#: Longer words go through the forward algorithm one by one, rescaled at each character.
BATCHED = 24


def words_of(text: str) -> list[str]:
    if text.isalpha():
        return [START + text.lower()]
    out = []
    for chunk in text.lower().split(" "):
        runs = [w for w in WORD.findall(chunk) if LETTER.search(w)]
        out += [START + w for w in runs[:1]] + runs[1:]
    return out


def vocabulary(path: str) -> list[str]:
    """The file's pieces without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Lattice:
    """Piece numbers of all substrings of words. Number n is an unknown character, n + 1 no piece."""

    BASE, SLOTS = np.uint64(0x9E3779B97F4A7C15), 18

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.n = len(pieces)
        self.widest = max(map(len, pieces))
        self.tables = []  # pieces by 64-bit hash; those whose slot is taken go to the next table
        hashes = np.zeros(self.n, np.uint64)
        for n, ks in _by_length(pieces).items():
            c = _characters([pieces[k] for k in ks], n)
            for w in range(n):
                hashes[ks] = hashes[ks] * self.BASE + c[:, w]
        left, factor = np.arange(self.n), self.BASE
        while len(left):
            factor = np.uint64(int(factor) * int(self.BASE) % (1 << 64))
            slots, first = np.unique(self._slots(hashes[left], factor), return_index=True)
            keys, numbers = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, self.n + 1, np.int32)
            keys[slots], numbers[slots] = hashes[left[first]], left[first]
            self.tables.append((factor, keys, numbers))
            left = np.delete(left, first)

    def _slots(self, hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((hashes * factor) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, self.n + 1, np.int32)
        for factor, keys, numbers in self.tables:
            at = self._slots(hashes, factor)
            out = np.where(keys[at] == hashes, numbers[at], out)
        return out

    def of(self, word: str) -> list[list[int]]:
        get, none, n = self.number.get, self.n + 1, len(word)
        rows = []
        for i in range(n):
            row = [get(word[i:j], none) for j in range(i + 1, min(n, i + self.widest) + 1)]
            if row[0] == none:
                row[0] = self.n
            rows.append(row)
        return rows

    def blocks(self, words: list[str], rows: int = 4096):
        """(numbers of the words, index array words x start x width) for words of one length at a time, `rows` at most."""
        for n, ks in _by_length(words).items():
            for lo in range(0, len(ks), rows):
                part = ks[lo : lo + rows]
                c, width = _characters([words[k] for k in part], n), min(n, self.widest)
                at = np.full((len(part), n, width), self.n + 1, np.int32)
                h = np.zeros_like(c)
                for w in range(width):
                    h = h[:, : n - w] * self.BASE + c[:, w:]
                    at[:, : n - w, w] = self.find(h)
                at[:, :, 0][at[:, :, 0] == self.n + 1] = self.n
                yield part, at


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _characters(words: list[str], n: int) -> np.ndarray:
    """Code points, plus one, of words of n characters, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)


def forward(at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Prefix probabilities, words x (length + 1) x languages, from piece probabilities p (pieces x languages)."""
    count, n, width = at.shape
    a = np.zeros((count, n + 1, p.shape[1]))
    a[:, 0] = 1
    for j in range(1, n + 1):
        for w in range(1, min(j, width) + 1):
            a[:, j] += a[:, j - w] * p[at[:, j - w, w - 1]]
    return a


def log_word(rows: list[list[int]], p: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length: the forward algorithm with the prefix sums rescaled."""
    n, languages = len(rows), p.shape[1]
    a, scale = {0: np.ones(languages)}, np.zeros(languages)
    widest = max(map(len, rows))
    for j in range(1, n + 1):
        now = np.zeros(languages)
        for i in range(max(0, j - widest), j):
            if j - i <= len(rows[i]):
                now += a[i] * p[rows[i][j - i - 1]]
        a[j] = now
        a.pop(j - widest, None)
        if j % 16 == 0:
            top = a[j].copy()
            scale += np.log(top)
            a = {k: v / top for k, v in a.items()}
    return scale + np.log(a[n])


class Model:
    """languages, their log priors and the piece probabilities, with a zero row for no piece."""

    def __init__(self, pieces: list[str], languages: list[str], prior: np.ndarray, p: np.ndarray):
        self.pieces, self.languages, self.prior, self.p = pieces, languages, prior, p


def expected(rows: list[list[int]], q: list[float]) -> list[tuple[int, float]]:
    """(piece, its expected count) at each place of one word of any length. Ratios of neighbouring prefix sums stand in for
    the sums, which would underflow."""
    n, widest = len(rows), max(map(len, rows))
    grown = [1.0] * (n + 1)  # prefix sum j over prefix sum j - 1
    for j in range(1, n + 1):
        total, ratio = 0.0, 1.0
        for w in range(1, min(j, widest) + 1):
            total += ratio * q[rows[j - w][w - 1]]
            ratio /= grown[j - w]
        grown[j] = total
    met = [0.0] * n + [1.0]  # the chance that a cut lies at j
    out = []
    for j in range(n, 0, -1):
        ratio = met[j]
        for w in range(1, min(j, widest) + 1):
            ratio /= grown[j - w + 1]
            x = rows[j - w][w - 1]
            if q[x]:
                met[j - w] += ratio * q[x]
                out.append((x, ratio * q[x]))
    return out


def fit_counts(pieces: list[str], counts: dict[str, dict[str, float]], docs: dict[str, int], rounds: int = ROUNDS) -> Model:
    """The model for {language: {word: count}}, by expectation maximisation from the counts of all substrings that are pieces."""
    lattice = Lattice(pieces)
    languages = sorted(counts)
    p = np.zeros((lattice.n + 2, len(languages)))
    for l, language in enumerate(languages):
        words = [w for w in counts[language] if len(w) <= BATCHED]
        long = [(lattice.of(w), n) for w, n in counts[language].items() if len(w) > BATCHED]
        weight = np.array([counts[language][w] for w in words], float)
        blocks = list(lattice.blocks(words))
        seen = np.zeros(lattice.n + 2)
        for ks, at in blocks:
            np.add.at(seen, at, np.broadcast_to(weight[ks][:, None, None], at.shape))
        for rows, n in long:
            np.add.at(seen, [x for row in rows for x in row], n)
        for step in range(rounds + 1):
            own = seen[: lattice.n] + PRIOR
            q = np.concatenate((own / own.sum(), [UNKNOWN, 0.0]))[:, None]
            if step == rounds:
                break
            seen = np.zeros(lattice.n + 2)
            for ks, at in blocks:
                count, n, width = at.shape
                a = forward(at, q)[:, :, 0]
                b = np.zeros((count, n + 1))
                b[:, n] = 1
                for i in range(n - 1, -1, -1):
                    for w in range(1, min(n - i, width) + 1):
                        b[:, i] += b[:, i + w] * q[at[:, i, w - 1], 0]
                for i in range(n):
                    for w in range(1, min(n - i, width) + 1):
                        np.add.at(seen, at[:, i, w - 1], weight[ks] * a[:, i] * q[at[:, i, w - 1], 0] * b[:, i + w] / a[:, n])
            flat = q[:, 0].tolist()
            for rows, times in long:
                for x, share in expected(rows, flat):
                    seen[x] += times * share
        p[:, l] = q[:, 0]
    total = sum(docs.values())
    return Model(pieces, languages, np.log(np.array([docs[x] / total for x in languages])), p)


def fit(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from docs (text, lang): the sample_docs distinct texts of each non-null language whose hashes are the smallest,
    of those with a letter, read whole. None where no labelled document has a word. Each value of lang is a class of the
    model, which the driver and every worker hold: clean a column of many thousand values first."""
    # Most texts have a letter at their start; the rest of those is not decoded.
    letter = F.substring("text", 1, 100).rlike(r"\p{L}") | F.col("text").rlike(r"\p{L}")
    rows = docs.where(F.col("lang").isNotNull() & letter).select("lang", "text", F.xxhash64("text", F.lit(17)).alias("h"))
    sizes = {r["lang"]: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).collect()}
    if not sizes:
        return None
    # Four times as many hashes are looked at as are wanted, as the counts are estimates; a language of few texts is looked at whole.
    share = F.create_map(*[F.lit(x) for k, r in sizes.items() for x in (k, min(1.0, 4 * sample_docs / max(1, r["texts"])))])
    least = rows.where(F.col("h") / float(1 << 64) + 0.5 <= F.element_at(share, F.col("lang"))).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h")
    taken = least.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs)
    last = F.create_map(*[F.lit(x) for r in taken.groupBy("lang").agg(F.max("h").alias("h")).collect() for x in (r["lang"], r["h"])])
    # Of a text's copies one is read.
    sample = rows.where(F.col("h") <= F.element_at(last, F.col("lang"))).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in words_of(text):
                    counts[lang, w] += 1
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

        return each

    words = arrow_map(sample, make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, float]] = defaultdict(dict)
    for r in words.orderBy("lang", "word").collect():
        counts[r["lang"]][r["word"]] = r["n"]
    return fit_counts(vocabulary(path), counts, {k: sizes[k]["n"] for k in counts}) if counts else None


_scorers: dict[str, "Scorer"] = {}


class Scorer:
    """Language log probabilities of texts. Columns of `values` are sums over a chunk's words; column 0 is a chunk without a letter."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.lattice, self.limit = model, Lattice(model.pieces), limit
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, int] = {}
        self.chunks: dict[str, int] = {"": 0}
        self.filled = 1
        self.values, self.own = (np.zeros((len(self.model.languages), 1 << 14)) for _ in range(2))

    @staticmethod
    def _room(values: np.ndarray, n: int) -> np.ndarray:
        while n > values.shape[1]:
            values = np.concatenate((values, np.zeros_like(values)), axis=1)
        return values

    def learn(self, chunks: list[str]) -> None:
        split = [words_of(c) for c in chunks]
        new = list({w for ws in split for w in ws} - self.words.keys())
        n = len(self.words)
        self.own = self._room(self.own, n + len(new))
        short = [w for w in new if len(w) <= BATCHED]
        for ks, at in self.lattice.blocks(short):
            self.own[:, n + ks] = np.log(forward(at, self.model.p)[:, -1]).T
        long = [w for w in new if len(w) > BATCHED]
        for k, w in enumerate(long, n + len(short)):
            self.own[:, k] = log_word(self.lattice.of(w), self.model.p)
        self.words.update(zip(short + long, range(n, n + len(new))))
        with_words = [(c, ws) for c, ws in zip(chunks, split) if ws]
        self.chunks.update((c, 0) for c, ws in zip(chunks, split) if not ws)
        if with_words:
            first = self.filled
            self.filled += len(with_words)
            self.values = self._room(self.values, first + len(with_words))
            flat = [self.words[w] for _, ws in with_words for w in ws]
            sizes = np.fromiter((len(ws) for _, ws in with_words), np.int64, len(with_words))
            self.values[:, first : first + len(with_words)] = np.add.reduceat(self.own[:, flat], np.cumsum(sizes) - sizes, axis=1)
            self.chunks.update(zip((c for c, _ in with_words), range(first, first + len(with_words))))

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if len(self.chunks) > self.limit:
            self.reset()
        chunks, at, edges = chunked(texts)
        chunks = strings(chunks)
        if unseen := [c for c in chunks if c not in self.chunks]:
            self.learn(unseen)
        at = np.array([self.chunks[c] for c in chunks], np.int64)[at]
        logs = np.stack([np.add.reduceat(v[at], edges[:-1]) for v in self.values], 1) + self.model.prior
        none = np.maximum.reduceat(at, edges[:-1]) == 0
        best = logs.argmax(1)
        score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        names = self.model.languages
        return ["und" if x else names[k] for x, k in zip(none, best)], np.where(none, 0.0, score)


def unlearned(texts: pa.Array) -> tuple[list[str], list[float | None]]:
    found = [None if LETTER.search(t or "") else 0.0 for t in texts.to_pylist()]
    return ["und"] * len(found), found


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with lang_pred and score, from the whole text.

    lang_pred is a learned language; und with score 0 where the text is null or has no letter; und with a null
    score where it has one, but nothing was learned. score is the language's posterior probability. Rows pass through one by one.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*kept)
    at = kept.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own_memory("language_id", _scorers.clear)
        if shared.value is not None and (key := str(id(shared.value))) not in _scorers:
            _scorers.clear()  # one model at a time, so a worker's memory stays bounded
            _scorers[key] = Scorer(shared.value)
        score = _scorers[str(id(shared.value))] if shared.value is not None else unlearned

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = score(batch.column(at))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

        return each

    schema = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(None).cast("double")}).schema
    return arrow_map(rows, make, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, path: str) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the rows that are not held out and have a doc_id."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()), path)
    return predict(docs.withColumn("held_out", held_out()), model)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents: see language_id. Null and letterless texts are und; rows without doc_id are predicted, never learned from."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = language_id(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", "held_out", "lang_pred", "score")
