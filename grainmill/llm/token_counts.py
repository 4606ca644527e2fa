"""Exact token counts at every prefix of a text, by dynamic programming over token ends.

The last token of the encoding of a prefix is the one token t that ends there and that goes together
with the last token of the prefix before t; two tokens go together if byte-pair merging their joined
bytes gives back just the two. So one pass over a piece's bytes gives the token count of all its
prefixes, and counts of longer texts add up over pieces.

Counts of whole texts of any length take one pass. Null text counts as empty: 0 bytes, 0 tokens. Null ids, ties and repeated rows pass through row by row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from grainmill.llm import bpe
from grainmill.llm.bpe import MergeTable, TextEncoder


class PrefixCounter:
    """Counts tokens at prefixes of pieces and of whole texts."""

    def __init__(self, table: MergeTable, pattern: str, remember: int = 300_000):
        self.table, self.remember = table, remember
        self.longest = max(map(len, table.id_of), default=1)
        self.together: dict[int, bool] = {}
        self.encoder = TextEncoder(pattern, self.totals, sum, table.special)

    def goes_together(self, left: int, right: int) -> bool:
        key = left * (self.table.pad + 1) + right
        found = self.together.get(key)
        if found is None:
            t = self.table
            found = self._merged_small(t.token_bytes[left] + t.token_bytes[right]) == [left, right]
            if len(self.together) < self.remember:
                self.together[key] = found
        return found

    def _merged_small(self, piece: bytes) -> list[int]:
        if len(piece) > 24:
            return self.table.merge_one(piece)
        pairs, ids = self.table.pair_rank, self.table.byte_ids[list(piece)].tolist()
        while True:
            best, at = None, -1
            for i, pair in enumerate(zip(ids, ids[1:])):
                found = pairs.get(pair)
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]

    def ends(self, piece: bytes) -> list[int]:
        """Token counts of piece[:1], piece[:2], ..., piece."""
        id_of, longest = self.table.id_of.get, self.longest
        last, count = [-1], [0]
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - longest), end):  # the longest first; mostly it holds
                token = id_of(piece[start:end])
                if token is not None and (start == 0 or self.goes_together(last[start], token)) and (start or self._whole(piece, end, token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return count[1:]

    def _whole(self, piece: bytes, end: int, token: int) -> bool:
        """A token's own bytes are one token unless no merge leads to it."""
        key = -1 - token
        found = self.together.get(key)
        if found is None:
            found = self.together[key] = self._merged_small(piece[:end]) == [token]
        return found

    def totals(self, pieces: list[bytes]) -> list[int]:
        return [1 if len(p) == 1 else self.ends(p)[-1] for p in pieces]

    def count(self, texts: list[str]) -> Iterator[int]:
        return map(sum, self.encoder.encode_all(texts, lambda _: 1))

    def at_prefixes(self, text: str) -> list[int]:
        """Token counts of text[:1], text[:2], ..., text, each as if that prefix was encoded by itself.

        A special string counts as one token where it is whole, and as ordinary text where it is cut.
        """
        out: list[int] = []
        base = 0
        parts = self.encoder.segments(text)
        for k, part in enumerate(parts):
            if k % 2:
                before = parts[k - 1]
                cut = [self.at_prefixes_plain(before + part[:j])[-1] - self.at_prefixes_plain(before)[-1] if before else self.at_prefixes_plain(part[:j])[-1] for j in range(1, len(part))]
                out += [base + c for c in cut] + [base + 1]
                base += 1
            elif part:
                own = self.at_prefixes_plain(part)
                out += [base + c for c in own]
                base += own[-1]
        return out

    def at_prefixes_plain(self, text: str) -> list[int]:
        out: list[int] = []
        base = 0
        pieces = self.encoder.find(text)
        blank = self.encoder.blank
        run, run_base = "", 0  # the white space that a prefix may end in: one piece as long as nothing follows
        for piece in pieces:
            data = piece.encode("utf-8")
            counts = self.ends(data)
            body = 0
            if all(map(blank, piece)) or (run and blank(piece[0])):
                if not run:
                    run_base = base
                while body < len(piece) and blank(piece[body]):
                    run += piece[body]
                    body += 1
                at = self.ends(run.encode("utf-8"))
                for j in range(len(run) - body + 1, len(run) + 1):
                    out.append(run_base + at[len(run[:j].encode("utf-8")) - 1])
            if body < len(piece):
                run = ""
                for j in range(body + 1, len(piece) + 1):
                    own = self.encoder.find(piece[:j])
                    # a contraction that is cut splits otherwise
                    out.append(base + (counts[len(piece[:j].encode("utf-8")) - 1] if len(own) == 1 else sum(self.totals([p.encode("utf-8") for p in own]))))
            base += counts[-1]
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has ``budget`` tokens at most."""
        counts = self.at_prefixes(text)
        return next((i for i in range(len(counts), 0, -1) if counts[i - 1] <= budget), 0)


def _worker(path: str, pattern: str, _made: dict = {}) -> PrefixCounter:  # noqa: B006  one for each Python worker
    if (path, pattern) not in _made:
        _made[path, pattern] = PrefixCounter(bpe.from_json(path), pattern)
    return _made[path, pattern]


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) for each row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(tokenizer, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                own = batch.slice(start, 1000)
                texts = [x or "" for x in own.column(1).to_pylist()]
                n = list(counter.count(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def within_budget(docs: DataFrame, tokenizer: str, pattern: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, text): the longest prefix of each text that has ``budget`` tokens at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker(tokenizer, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [counter.longest_within(x, budget) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([x[:k] for x, k in zip(texts, n)], pa.string())], names=[id_col, "n_chars", text_col])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, `{text_col}` string")
