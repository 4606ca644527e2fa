"""Byte-level BPE on numpy matrices: merge tables, batched merging and a text encoder with bounded caches.

``MergeTable`` holds the pair ranks in an open-addressing hash table of numpy arrays. ``merge_pieces``
groups byte pieces by padded length, and in each round merges every row's leftmost pair of the least
rank, then compacts the matrix by the column that each row lost. ``TextEncoder`` cuts texts at single
blanks before a non-blank, where the split pattern always starts a new match, so that a word with its
punctuation is worked out once and found in a dictionary afterwards.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

NONE = np.int32(2**30)
#: Marks a chunk that starts a text; chunks that are looked up hold no blank.
HEAD = " "
WIDTHS = (*range(2, 17), 20, 24, 32, 48, 64, 96, 128, 192, 256)


class MergeTable:
    """Ranks of mergeable pairs of ids, and the bytes of each id.

    ``pairs`` maps (left, right) to (rank, merged id); lower ranks merge first.
    """

    def __init__(self, token_bytes: list[bytes], pairs: np.ndarray, special: dict[str, int] | None = None):
        self.token_bytes = token_bytes
        self.special = special or {}
        self.id_of = {b: i for i, b in enumerate(token_bytes) if b}
        self.pad = len(token_bytes)  # no token's id
        self.byte_ids = np.array([self.id_of.get(bytes([b]), self.pad) for b in range(256)], dtype=np.int32)
        left, right, rank, merged = pairs.T
        self.pair_rank = dict(zip(zip(left.tolist(), right.tolist()), zip(rank.tolist(), merged.tolist())))
        self.merged_of_rank = np.zeros(int(rank.max()) + 1 if len(rank) else 1, dtype=np.int32)
        self.merged_of_rank[rank] = merged
        self._build(self._keys(left, right), rank.astype(np.int32))

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) * np.uint64(self.pad + 1) + right.astype(np.uint64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.slot_key = np.full(size, np.uint64(2**64 - 1), dtype=np.uint64)
        self.slot_rank = np.full(size, NONE, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(keys), dtype=bool)
            put[first] = True
            put &= free
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], ranks[put]
            keys, ranks, at = keys[~put], ranks[~put], (at[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where the pair does not merge."""
        shape = left.shape
        keys = self._keys(left, right).ravel()
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], NONE)
        left_over = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        size = (1 << self.bits) - 1
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & size
            found = self.slot_key[at[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.slot_rank[at[left_over[hit]]]
            left_over = left_over[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(shape)

    def merge_one(self, piece: bytes) -> list[int]:
        """One piece by a heap, for pieces too long for a matrix: n log n."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pairs = self.pair_rank
        heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = pairs[pair][1]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in pairs:
                heapq.heappush(heap, (pairs[p][0], h, p))
        return [x for x, keep in zip(ids, alive) if keep]

    def merge_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        for i in np.flatnonzero(lengths > WIDTHS[-1]).tolist():
            out[i] = np.array(self.merge_one(pieces[i]), dtype="<u4").tobytes()
        for i in np.flatnonzero(lengths == 1).tolist():
            out[i] = np.array(self.byte_ids[pieces[i][0]], dtype="<u4").tobytes()
        low = 1
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for start in range(0, len(rows), 40_000 // width * 8 + 1):
                self._merge_rows(pieces, rows[start : start + 40_000 // width * 8 + 1], lengths, width, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, width: int, out: list[bytes]) -> None:
        own = [pieces[i] for i in rows.tolist()]
        n = lengths[rows]
        if (n != width).any():
            own = [p.ljust(width, b"\0") for p in own]
        ids = self.byte_ids[np.frombuffer(b"".join(own), dtype=np.uint8).reshape(len(rows), width)]
        ids[np.arange(width) >= n[:, None]] = self.pad
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), dtype=np.int64)
            every = np.arange(len(rows))
            best = rank[every, at] if rank.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                size = ids.shape[1] * 4
                flat = ids[done].astype("<u4").tobytes()
                for k, (i, m) in enumerate(zip(rows[done].tolist(), n[done].tolist())):
                    out[i] = flat[k * size : k * size + 4 * m]
                going = ~done
                if not going.any():
                    return
                ids, rank, rows, n, at, best = ids[going], rank[going], rows[going], n[going], at[going], best[going]
                every = np.arange(len(rows))
            ids[every, at] = self.merged_of_rank[best]
            gone = np.arange(rank.shape[1]) > at[:, None]
            ids = np.where(gone, ids[:, 1:], ids[:, :-1])
            rank = np.where(gone[:, 1:] | (at[:, None] == np.arange(rank.shape[1] - 1)), rank[:, 1:], rank[:, :-1])
            n = n - 1
            for shift in (-1, 0):
                here = np.flatnonzero((at + shift >= 0) & (at + shift < rank.shape[1]))
                col = at[here] + shift
                rank[here, col] = self.ranks(ids[here, col], ids[here, col + 1])


def _printable_bytes() -> dict[str, int]:
    """The printable stand-ins that vocabulary files of byte-level BPE use for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def from_json(path: str) -> MergeTable:
    """The merge list of a ``tokenizers`` file: a pair merges only if it is listed."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, stand_in = whole["model"], _printable_bytes()
    special = {x["content"]: x["id"] for x in whole["added_tokens"]}
    token_bytes = [b""] * (1 + max(model["vocab"].values()))
    for token, i in model["vocab"].items():
        if token not in special:
            token_bytes[i] = bytes(stand_in[c] for c in token)
    rows = []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        rows.append((model["vocab"][left], model["vocab"][right], rank, model["vocab"][left + right]))
    return MergeTable(token_bytes, np.array(rows, dtype=np.int64).reshape(-1, 4), special)


@lru_cache(maxsize=4)
def from_ranks(path: str) -> MergeTable:
    """A rank file: two neighbours merge if their bytes together have a rank."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    token_bytes = [b""] * (1 + max(ranks.values()))
    rows = []
    for token, rank in ranks.items():
        token_bytes[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.append((left, right, rank, rank))
    return MergeTable(token_bytes, np.array(rows, dtype=np.int64).reshape(-1, 4))


class TextEncoder:
    """Maps each text to the values of its chunks, with bounded dictionaries.

    A chunk is what stands between two cuts; a cut is a blank before a non-blank, where the split pattern
    always starts a new match. ``solve`` gives the values of byte pieces and ``value`` makes a chunk's value
    of its pieces' values. A full dictionary takes nothing more; what it lacks is worked out for each batch.
    """

    def __init__(self, pattern: str, solve: Callable[[list[bytes]], list], value: Callable[[list], object], special: Iterable[str] = (), cache: int = 120_000):
        self.find = regex.compile(pattern).findall
        self.blank = regex.compile(r"\s").match
        self.cut = regex.compile(r" (?=\S)").split
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.solve, self.value, self.limit = solve, value, cache
        self.chunks: dict[str, object] = {}  # of chunks after a blank, and under HEAD + chunk of those that start a text
        self.pieces: dict[str, object] = {}

    def _work_out(self, chunks: list[str]) -> list:
        """Values of strings that each start where a match starts."""
        flat: list[str] = []
        ends: list[int] = []
        if all(c[:1] == " " and c.rfind(" ") == 0 for c in chunks):
            flat = self.find("".join(chunks))
            ends = [i for i, p in enumerate(flat) if p[0] == " "][1:] + [len(flat)]
        else:
            for c in chunks:
                flat += self.find(c)
                ends.append(len(flat))
        known = self.pieces
        values = list(map(known.get, flat))
        missing = list({p for p, v in zip(flat, values) if v is None})
        if missing:
            fresh = dict(zip(missing, self.solve([p.encode("utf-8") for p in missing])))
            values = [fresh[p] if v is None else v for p, v in zip(flat, values)]
            if len(known) < self.limit // 2:
                known.update(fresh)
        out, start, value = [], 0, self.value
        for end in ends:
            out.append(value(values[start:end]))
            start = end
        return out

    def _encode_apart(self, text: str) -> list:
        """One text in which blanks stand side by side."""
        first, *rest = self.cut(text)
        return self._work_out([first] * bool(first) + [" " + c for c in rest])

    def encode(self, texts: list[str]) -> list[list]:
        """The values of each text's chunks, in order. Special strings must have been cut out before."""
        parts: list[str] = []
        ends = []
        for text in texts:
            own = text.split(" ")
            own[0] = HEAD + own[0]
            parts += own
            ends.append(len(parts))
        codes, unique = pd.factorize(np.array(parts, dtype=object))
        del parts
        values = list(map(self.chunks.get, unique))
        apart: set[int] = set()
        if None in values:
            gaps = [i for i, v in enumerate(values) if v is None]
            inner, heads = [], []
            for i in gaps:
                c = unique[i]
                if not c:
                    apart.add(i)
                elif c[0] == HEAD:
                    heads.append(i)
                elif c[0] <= " " and self.blank(c) or c[0] > "~" and self.blank(c):
                    apart.add(i)
                else:
                    inner.append(i)
            for own, strings in ((inner, [" " + unique[i] for i in inner]), (heads, [unique[i][1:] for i in heads])):
                if own:
                    fresh = self._work_out(strings)
                    for i, v in zip(own, fresh):
                        values[i] = v
                    if len(self.chunks) < self.limit:
                        self.chunks.update((c, v) for c, v in zip(unique[own], fresh) if len(c) < 64)
        table = np.empty(len(values), dtype=object)
        table[:] = values
        flat = table[codes].tolist()
        odd = np.isin(codes, list(apart)) if apart else None
        out, start = [], 0
        for text, end in zip(texts, ends):
            out.append(self._encode_apart(text) if odd is not None and odd[start:end].any() else flat[start:end])
            start = end
        return out

    def encode_all(self, texts: list[str], special_value: Callable[[str], object] | None = None, chars: int = 6_000_000) -> Iterable[list]:
        """As ``encode``, in portions of bounded size, special strings in texts included."""
        start, n = 0, 0
        for i, text in enumerate(texts):
            n += len(text)
            if n >= chars or i + 1 == len(texts):
                own = texts[start : i + 1]
                if self.special is not None and any(map(self.special.search, own)):
                    for text in own:
                        yield [v for k, part in enumerate(self.segments(text)) for v in ([special_value(part)] if k % 2 else self.encode([part])[0])]
                else:
                    yield from self.encode(own)
                start, n = i + 1, 0

    def segments(self, text: str) -> list[str]:
        """Text and special strings in turn: text, special, text, ..."""
        out, last = [], 0
        for m in self.special.finditer(text):
            out += [text[last : m.start()], m.group()]
            last = m.end()
        return [*out, text[last:]]
