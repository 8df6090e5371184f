"""Byte-level BPE encoding and decoding with a segment tree.

A text is cut by the tokenizer's pattern; every piece is encoded on its own. Over the byte
positions of a piece lies a segment tree whose leaves hold the rank of the pair that begins there
and whose root tells the leftmost pair of least rank. A merge takes the pair's right half out and
updates the leaves of the live neighbours: a few paths of logarithmic length. Short pieces are
encoded many at a time, one tree per row of an array; long ones one by one.

Defined results: a null or empty text has no ids; null ids decode to no bytes; whole texts are
encoded whatever their length; control strings in a text are ordinary text; other columns are
carried along, those named like an added one are replaced; an empty table gives an empty result.
The rank file is read by the driver and sent to the executors; its size is fixed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NONE = np.int64(1 << 62)
#: Longer pieces get a tree of their own; a memo of pieces is emptied beyond so many.
LONG, MEMO = 64, 200_000
#: Bytes of text encoded at a time.
CHUNK = 2 << 20


def tokens(lines: bytes) -> dict[int, bytes]:
    """The bytes of every id of a rank file."""
    rows = (line.split() for line in lines.splitlines() if line)
    return {int(rank): base64.b64decode(token) for token, rank in rows}


class Ranks:
    """A rank file: the bytes of every token, and the rank of every pair that makes up a token."""

    def __init__(self, lines: bytes):
        self.token = tokens(lines)
        self.rank = {token: rank for rank, token in self.token.items()}
        self.pair: dict[tuple[int, int], int] = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left, right] = rank
        keys = np.array([a << 32 | b for a, b in self.pair], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.pair.values()), dtype=np.int64)[order]
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no such token."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (whole := self.rank.get(piece)) is not None:
                out[k] = np.array([whole], dtype=np.int32)
            elif len(piece) > LONG:
                out[k] = np.array(self._encode_long(piece), dtype=np.int32)
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            step = max(1, (1 << 19) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self._encode_rows([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def _encode_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
        ids = self.byte[raw].reshape(n, width)
        place = np.arange(width)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), _NONE)
        pairs = self.look_up(ids[:, :-1], ids[:, 1:])
        pairs[place[None, 1:] >= length[:, None]] = _NONE
        tree[:, width : 2 * width - 1] = np.where(pairs < _NONE, pairs * width + place[:-1], _NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        flat, id_at, next_at, prev_at = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            base = row * width
            least = flat[2 * base + 1]
            at = least % width
            gone = next_at[base + at]
            right = next_at[base + gone]
            left = prev_at[base + at]
            merged = least // width
            id_at[base + at] = merged
            id_at[base + gone] = -1
            next_at[base + at] = right
            r = np.flatnonzero(right < length[row])
            prev_at[base[r] + right[r]] = at[r]
            own = np.full(len(row), _NONE)
            found = self.look_up(merged[r], id_at[base[r] + right[r]])
            own[r] = np.where(found < _NONE, found * width + at[r], _NONE)
            self._set(flat, 2 * base, width + gone, _NONE)
            self._set(flat, 2 * base, width + at, own)
            r = np.flatnonzero(left >= 0)
            found = self.look_up(id_at[base[r] + left[r]], merged[r])
            self._set(flat, 2 * base[r], width + left[r], np.where(found < _NONE, found * width + left[r], _NONE))
            row = row[flat[2 * base + 1] < _NONE]
        live = (ids >= 0) & (place[None, :] < length[:, None])
        return np.split(ids[live].astype(np.int32), np.cumsum(live.sum(axis=1))[:-1])

    @staticmethod
    def _set(tree: np.ndarray, base: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Puts a value into one leaf of each row's tree and mends the path to the root."""
        tree[base + leaf] = value
        node = leaf >> 1
        while len(node) and node[0]:
            child = base + 2 * node
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
            node = node >> 1

    def _encode_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = (1 << 62, 0)
        ids = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def pair(at: int) -> tuple[int, int]:
            rank = self.pair.get((ids[at], ids[after[at]])) if after[at] < n else None
            return none if rank is None else (rank, at)

        def put(at: int, value: tuple[int, int]) -> None:
            node = width + at
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for at in range(n):
            tree[width + at] = pair(at)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            rank, at = tree[1]
            gone = after[at]
            ids[at], ids[gone] = rank, -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
        return [x for x in ids if x >= 0]


class Encoder:
    """Encodes texts; remembers pieces, up to a bound."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        cut = [self.find(t) for t in texts]
        flat = [p for c in cut for p in c]
        new = [p for p in dict.fromkeys(flat) if p not in self.known]
        if len(new) + len(self.known) > MEMO:
            self.forget()
            new = list(dict.fromkeys(flat))
        for piece, ids in zip(new, self.ranks.encode([p.encode() for p in new])):
            self.known[piece] = len(self.ids)
            self.ids.append(ids)
        sizes = np.fromiter(map(len, self.ids), dtype=np.int64, count=len(self.ids))
        starts = np.cumsum(sizes) - sizes
        all_ids = np.concatenate(self.ids) if self.ids else np.zeros(0, dtype=np.int32)
        which = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        size = sizes[which]
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - (ends - size), size)
        of_text = np.cumsum([0, *map(len, cut)])
        total = np.concatenate([[0], ends])[of_text]
        return all_ids[places], np.diff(total)


def read_ranks(spark: SparkSession, path: str):
    """The rank file, sent to the executors once."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


_LOADED: dict[int, Ranks] = {}


def _ranks(sent) -> Ranks:
    lines = sent.value
    key = hash(lines)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Ranks(lines)
    return _LOADED[key]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", drop_text: bool = False, round_trip: bool = False) -> DataFrame:
    """df with `ids` (array of int) and `n_tokens`; without the text, if asked. With round_trip the
    ids are decoded again on the spot, into `decoded`: one pass, and half as many workers."""
    df = df.drop("ids", "n_tokens", *["decoded"] * round_trip)
    sent = read_ranks(df.sparkSession, path)
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text_col)]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])
    if round_trip:
        schema = schema.add("decoded", T.BinaryType())
    names = [f.name for f in kept]
    text_at, kept_at = df.columns.index(text_col), [df.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_ranks(sent), pattern)
        for batch in batches:
            texts = batch.column(text_at)
            weight = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            part = np.concatenate([[0], np.cumsum(weight) // CHUNK])
            cuts = [0, *(np.flatnonzero(np.diff(part[1:])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                ids, sizes = encoder.encode([t or "" for t in texts[a:b].to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns = [batch.column(k)[a:b] for k in kept_at]
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes)]
                if round_trip:
                    token = encoder.ranks.token.__getitem__
                    columns.append(pa.array([b"".join(map(token, x.tolist())) for x in np.split(ids, offsets[1:-1])[: b - a]], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", drop_ids: bool = False) -> DataFrame:
    """df with `decoded`, the bytes that the ids stand for; without the ids, if asked."""
    df = df.drop("decoded")
    sent = read_ranks(df.sparkSession, path)
    kept = [f for f in df.schema.fields if not (drop_ids and f.name == ids_col)]
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in kept]
    ids_at, kept_at = df.columns.index(ids_col), [df.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens(sent.value).__getitem__
        for batch in batches:
            lists = batch.column(ids_at)
            out = [b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in lists]
            columns = [batch.column(k) for k in kept_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    return df.mapInArrow(run, schema)
