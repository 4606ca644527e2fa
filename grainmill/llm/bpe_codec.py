"""Byte-level BPE encoding and decoding of whole texts, by the batched matrix merging of ``bpe``.

Null text counts as empty. Rows are handled one by one: null ids, ties and repeated rows pass through,
an empty table gives an empty result, and other columns are not read. Pieces of any length are encoded
(those over the widest bucket by a heap).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm import bpe


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, table: bpe.MergeTable, pattern: str):
        self.table = table
        self.encoder = bpe.TextEncoder(pattern, table.merge_pieces, b"".join)
        self.digests = bpe.TextEncoder(pattern, self._spelled, self._joined)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(v), dtype="<u4") for v in self.encoder.encode_all(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.token_bytes.__getitem__, ids))

    def _spelled(self, pieces: list[bytes]) -> list[tuple[int, str, bytes]]:
        """Count, decimal ids and decoded bytes of pieces."""
        out = []
        for data in self.table.merge_pieces(pieces):
            ids = np.frombuffer(data, dtype="<u4").tolist()
            out.append((len(ids), " ".join(map(str, ids)), self.decode(ids)))
        return out

    @staticmethod
    def _joined(values: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes]:
        if len(values) == 1:
            return values[0]
        return sum(v[0] for v in values), " ".join(v[1] for v in values), b"".join(v[2] for v in values)

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Count, SHA-256 of the decimal ids and SHA-256 of the decoded bytes."""
        for own in self.digests.encode_all(texts):
            own = [v for v in own if v[0]]
            n, ids, data = zip(*own) if own else ((), (), ())
            yield sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


def _worker(path: str, pattern: str, _made: dict = {}) -> Codec:  # noqa: B006  one for each Python worker
    if (path, pattern) not in _made:
        _made[path, pattern] = Codec(bpe.from_ranks(path), pattern)
    return _made[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                own = batch.slice(start, 1000)
                ids = [x.astype(np.int32) for x in codec.encode([x or "" for x in own.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, data binary): the bytes of each row's ids; null or no ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=[id_col, "data"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes its ids; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _worker(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                own = batch.slice(start, 1000)
                n, ids, data = zip(*codec.digest([x or "" for x in own.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(data)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
