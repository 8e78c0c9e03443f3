"""Ids of the word vocabulary (lower case, white space dropped, word ends), as the tokenizers library gives them.

White space separates pre-tokens in this vocabulary, so a text's ids are the concatenation of the ids of
its chunks between blanks and line feeds. Each distinct word goes through the library once in a worker; the rest is lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Pieces, chunked, own_memory, quiet_tokenizers, strings

_encoders: dict[str, "WordIds"] = {}


def word_encoder(path: str) -> "WordIds":
    """The worker's encoder for a vocabulary file; it and its memo last as long as the worker."""
    own_memory("word_ids", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class WordIds:
    """Callable: texts to their ids (little endian, `dtype`), each with the given end id after them."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = Pieces(self._word, 800_000)
        self.chunks = Pieces(self._chunk, 200_000)

    def _word(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk[-1] in ".," and chunk[:-1].isalnum():  # a run of letters or digits ends where punctuation begins
            return self._folded(chunk[:-1]) + self.words[chunk[-1]]
        return self._folded(chunk)

    def _folded(self, chunk: str) -> bytes:
        """Latin-1 has only composed characters and one-to-one lower case, so folding first changes no id."""
        try:
            chunk.encode("latin-1")
        except UnicodeEncodeError:
            return self.words[chunk]
        return self.words[chunk if chunk.isascii() and "<|" in chunk else chunk.lower()]

    def _parts(self, chunks: pa.Array) -> list[bytes]:
        """The ids of each chunk. ASCII letters and digits, with a full stop or comma after them or without, are folded all at once."""
        end = pc.utf8_slice_codeunits(chunks, -1)
        stem = pc.if_else(pc.is_in(end, pa.array([".", ","])), pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        plain = pc.and_(pc.string_is_ascii(stem), pc.ascii_is_alnum(stem)).to_numpy(zero_copy_only=False)
        words, mark = self.words, (self.words["."], self.words[","])
        out = [b""] * len(chunks)
        at = np.flatnonzero(plain)
        taken = strings(pc.ascii_lower(stem).take(at))
        ends = strings(end.take(at))
        for k, w, e in zip(at.tolist(), taken, ends):
            out[k] = words[w] + mark[0] if e == "." else words[w] + mark[1] if e == "," else words[w]
        rest = np.flatnonzero(~plain)
        for k, c in zip(rest.tolist(), strings(chunks.take(rest))):
            out[k] = self.chunks[c]
        return out

    def __call__(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        chunks, at, edges = chunked(pc.replace_substring(texts, "\n", " "))
        parts = self._parts(chunks)
        flat = np.frombuffer(b"".join(parts), self.dtype)
        sizes = np.array([len(x) for x in parts], np.int64) // self.dtype.itemsize
        own = sizes[at]
        ends = np.cumsum(own)
        first = (np.cumsum(sizes) - sizes)[at] - (ends - own)
        ids = flat[np.repeat(first, own) + np.arange(len(first) and ends[-1])]
        ends = np.concatenate(([0], ends))[edges]
        for i, j in zip(ends, ends[1:]):
            yield np.append(ids[i:j], self.dtype.type(end_id))
