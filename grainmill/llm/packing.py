"""Best-fit packing of token sequences with a bounded number of open bins.

Documents longer than a sequence are cut so that the first piece takes the remainder and all others fill
a sequence. Pieces then go, in id order, to the open sequence with the least free space that holds them.
Open sequences stand in lists by free space, with a bitset of the spaces that have any; when there would
be more than ``open_bins``, the fullest closes.

Null text counts as empty and is one piece with only the end id. Texts of any length are packed whole. Rows with a null id
come first; pieces of equal id and place, as of repeated rows, are packed each for itself, in the order of their checksums.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm import bpe
from grainmill.llm.common import lean


class BestFit:
    """Online best fit; ``place`` gives (bin, offset)."""

    def __init__(self, size: int, open_bins: int, first_bin: int = 0, step: int = 1):
        self.size, self.open_bins, self.next_bin, self.step = size, open_bins, first_bin, step
        self.by_space: list[list[int]] = [[] for _ in range(size + 1)]
        self.spaces = 0  # bit s: some open bin has s free
        self.n_open = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            own = self.by_space[space]
            number = own.pop()
            if not own:
                self.spaces &= ~(1 << space)
            self.n_open -= 1
        else:
            space, number = self.size, self.next_bin
            self.next_bin += self.step
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.spaces |= 1 << left
            self.n_open += 1
            if self.n_open > self.open_bins:  # the fullest closes
                fullest = (self.spaces & -self.spaces).bit_length() - 1
                own = self.by_space[fullest]
                own.pop(0)
                self.n_open -= 1
                if not own:
                    self.spaces &= ~(1 << fullest)
        return number, self.size - space


class Cutter:
    """Encodes texts and cuts their ids into pieces."""

    def __init__(self, table: bpe.MergeTable, pattern: str, end_id: int, size: int):
        self.encoder = bpe.TextEncoder(pattern, table.merge_pieces, b"".join, table.special)
        self.special = {k: np.array(v, dtype="<u4").tobytes() for k, v in table.special.items()}
        self.end, self.size = np.array(end_id, dtype="<u4").tobytes(), size

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each text (piece, start, length, crc32)."""
        for values in self.encoder.encode_all(texts, self.special.__getitem__):
            data = memoryview(b"".join(values) + self.end)
            n, out, start = len(data) // 4, [], 0
            stop = n % self.size or self.size
            while start < n:
                out.append((len(out), start, stop - start, zlib.crc32(data[4 * start : 4 * stop])))
                start, stop = stop, stop + self.size
            yield out


def _worker(path: str, pattern: str, end_id: int, size: int, _made: dict = {}) -> Cutter:  # noqa: B006  one for each Python worker
    key = (path, pattern, end_id, size)
    if key not in _made:
        _made[key] = Cutter(bpe.from_json(path), pattern, end_id, size)
    return _made[key]


def cut_documents(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _worker(tokenizer, pattern, end_id, size)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                own = batch.slice(begin, 1000)
                found = list(cutter.pieces([x or "" for x in own.column(1).to_pylist()]))
                piece, start, length, crc = (np.array(x) for x in zip(*(p for ps in found for p in ps)))
                row = np.repeat(np.arange(len(found)), [len(ps) for ps in found])
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 1024, open_bins: int = 512, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset. Only the narrow rows of ``pieces`` are dealt out, by id; AQE sizes the
    partitions by bytes, so the number of packers grows with the input and each packs many documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if fit is None:
                fit = BestFit(size, open_bins, batch.column(5)[0].as_py() << 40)
            placed = [fit.place(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([x[0] for x in placed], pa.int64()), pa.array([x[1] for x in placed], pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = pieces.schema[id_col].dataType.simpleString()
    dealt = pieces.select(id_col, "piece", "start", "length", "ids_crc32").repartition(id_col).sortWithinPartitions(id_col, "piece", "ids_crc32")
    return dealt.withColumn("_packer", F.spark_partition_id().cast("long")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
