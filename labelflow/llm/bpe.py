"""Byte-level BPE encoding and decoding by a monoid tree reduction over the halves of each text.

A node of the tree holds the tokens of a stretch of the text. Two neighbours are joined by encoding anew
only a window around the cut. The window grows to the nearest *certain* match boundary on either side: a
space after a character that is not white space. No alternative of the split pattern can match across such
a place, and matching has no memory of what came before a boundary, so the tokens outside the window are
those of the whole text. Decoding concatenates bytes up the same kind of tree.

Null texts count as empty, an empty text has no tokens, repeated rows are encoded each, columns other than
those named are not read. A text without any boundary is encoded as one window, still exactly.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 8192
LEAF_TOKENS = 4096


class Codec:
    """Encoder and decoder for one ranks file; ``leaf`` is the stretch encoded without splitting."""

    def __init__(self, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS):
        import public_tokenizers
        import tiktoken

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.base = tiktoken.Encoding(
            os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.leaf = max(2, leaf)
        self.widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for word, rank in ranks.items():
            self.widths[rank] = len(word)

    def _leaf(self, text: str) -> np.ndarray:
        return np.array(self.base.encode_ordinary(text), dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        begin, end = _boundary_before(text, lo, mid), _boundary_after(text, mid, hi)
        kept = self._tokens_within(left[::-1], len(text[begin:mid].encode()))
        gone = self._tokens_within(right, len(text[mid:end].encode()))
        return np.concatenate([left[: len(left) - kept], self._leaf(text[begin:end]), right[gone:]])

    def _tokens_within(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading tokens make up exactly ``n_bytes``."""
        done, n = 0, 0
        while done < n_bytes:
            ends = done + np.cumsum(self.widths[ids[n : n + LEAF_TOKENS]])
            step = int(np.searchsorted(ends, n_bytes, side="left")) + 1
            if step <= len(ends):
                if ends[step - 1] != n_bytes:
                    raise ValueError("a certain boundary falls inside a token")
                return n + step
            done, n = int(ends[-1]), n + len(ends)
        return n

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_TOKENS:
            return self.base.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _boundary_before(text: str, lo: int, mid: int) -> int:
    at = text.rfind(" ", lo + 1, mid)
    while at > lo and text[at - 1].isspace():
        at = text.rfind(" ", lo + 1, at)
    return max(at, lo)


def _boundary_after(text: str, mid: int, hi: int) -> int:
    at = text.find(" ", mid + 1, hi)
    while at > 0 and text[at - 1].isspace():
        at = text.find(" ", at + 1, hi)
    return hi if at < 0 else at


@lru_cache(maxsize=4)
def codec(vocabulary: str, leaf: int = LEAF_CHARS) -> Codec:
    return Codec(vocabulary, leaf)


def encode_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF_CHARS, tokens: bool = True
) -> DataFrame:
    """Tokens of every whole text, with digests of the ids and of the bytes they decode to.

    Columns: doc_id, tokens (only if asked for), n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256.
    """
    doc_type = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {doc_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", tokens array<int>" if tokens else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, leaf)
        for batch in batches:
            lengths, digests, decoded, lists = [], [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                lengths.append(len(ids))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if tokens:
                    lists.append(ids.astype(np.int32))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(lengths, pa.int64()),
                "ids_sha256": pa.array(digests, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            if tokens:
                columns["tokens"] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of (doc_id, tokens); null tokens give an empty text, broken UTF-8 is replaced."""
    doc_type = dict(encoded.select("doc_id").dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            texts = [
                bpe.decode(np.array(ids.as_py() or [], dtype="<u4")).decode("utf-8", "replace")
                for ids in batch.column("tokens")
            ]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "tokens").mapInArrow(work, f"doc_id {doc_type}, text string")
