"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of either side cover the same bytes, so they overlap where their byte ranges do. Every token
points to the token of the other side that overlaps it farthest to the right, if that ends beyond
it; two that end at one place point to the first side's. Doubling the successors of all tokens of
many documents at once, until nothing changes, takes every token to the last one of its component:
documents are cut into groups where tokens of both sides end. A pair of ids that overlap is a link.

How many documents hold a pair is counted over the corpus: documents lie in blocks, a block sends
each of its pairs once with its number of documents, and gets the counts of its pairs back. The best
count of a first-side id is one row per entry of the vocabulary, which bounds its broadcast.

Defined results: a text that is null, empty or not kept whole by one of the tokenizers (its joined
bytes differ) has no tokens, and zeros; control strings in a text are ordinary text; repeated rows
count as documents of their own; whole texts are taken whatever their length; the columns asked for
are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import _packed, squeezed, unpacked, widened
from .common import saved
from .units import ByteLevel, Memo, Pieces, by_place, chunks, per_text, units

#: Bytes of text whose documents share a block.
BLOCK = 8 << 20


class Vocabularies:
    """Both tokenizers: ids of units, whole texts, and the bytes of every id."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        library = Tokenizer.from_buffer(first)
        library.encode_special_tokens = True
        self.a, self.b = ByteLevel(library), Pieces(SentencePieceProcessor(model_proto=second))
        self.lengths = [self.a.lengths, self.b.lengths]
        self.memo = Memo(lambda new: [self.a(new), self.b(new)], 2)
        #: where a pair of ids is one number: the second id's bits
        self.bits = len(self.lengths[1]).bit_length()
        self.digits = _digits(max(map(len, self.lengths)))
        #: the library may join pieces over a cut if a piece has a space behind something else
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.b.token.values())


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids as rows of bytes, and their number."""
    text = [str(i).encode() for i in range(n)]
    width = max(map(len, text)) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(n, width), np.array([len(t) for t in text])


def groups(ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each token's component, by pointer jumping; tokens of the first side are
    numbered from 0, those of the second side follow. ends are the ends of each side's tokens."""
    a, b = ends
    n = len(a)
    # the token of the other side that holds a token's last byte overlaps it farthest to the right
    reach_b = np.searchsorted(b, a)
    reach_a = np.searchsorted(a, b)
    to = np.concatenate([np.where(b[reach_b] > a, n + reach_b, np.arange(n)), reach_a])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:n], to[n:]
        to = further


def links(ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping tokens: an overlap ends where one of both does, and no overlap ends twice."""
    cuts = np.sort(np.concatenate(ends), kind="stable")
    cuts = cuts[np.flatnonzero(np.diff(cuts, append=-1))]
    return np.searchsorted(ends[0], cuts), np.searchsorted(ends[1], cuts)


def _written(ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], digits) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` for all groups one after another, as bytes, and how many bytes each group has."""
    counts = [np.bincount(g, minlength=int(group[0][-1]) + 1) for g in group]
    last = [np.cumsum(c) - 1 for c in counts]
    places = (np.arange(len(ids[0])) + (np.cumsum(counts[1]) - counts[1])[group[0]], np.arange(len(ids[1])) + np.cumsum(counts[0])[group[1]])
    marks, tokens = np.full(len(ids[0]) + len(ids[1]), ord(","), np.uint8), np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    for side, mark in ((0, "|"), (1, ";")):
        tokens[places[side]] = ids[side]
        marks[places[side][last[side]]] = ord(mark)
    rows, size = digits[0][tokens], digits[1][tokens]
    rows[np.arange(len(rows)), size] = marks
    flat = rows[np.arange(rows.shape[1]) <= size[:, None]]
    of_group = np.cumsum(size + 1)[places[1][last[1]]]
    return flat, np.diff(of_group, prepend=0)


def align(texts: list[str | None], vocabularies: Vocabularies) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Figures of texts, and the links of all: the text's number, and both ids as one number."""
    v = vocabularies
    cut = [(units(t) if v.cuts else [t]) if t else [] for t in texts]
    flat = [u for own in cut for u in own]
    which = v.memo.look_up(flat)
    counts = [len(own) for own in cut]
    sides = [v.memo.gather(f, which) for f in (0, 1)]
    bad = ~v.memo.good[which]
    of_unit = np.repeat(np.arange(len(texts)), counts)
    ids = [np.split(i, np.cumsum(per_text(n, counts))[:-1]) for i, n in sides] if texts else [[], []]
    for k in np.unique(of_unit[bad]):  # a whole text decides, not its units
        text = f" {texts[k]}"
        first, second = v.a.encode(text), v.b.encode(text)
        good = v.a.keeps(text, first) and v.b.keeps(text, second)
        ids[0][k], ids[1][k] = (np.array(x if good else [], np.int64) for x in (first, second))
    sizes = [np.array([len(x) for x in side], np.int64) for side in ids]
    figures = pd.DataFrame({"n_a": sizes[0], "n_b": sizes[1], "n_groups": 0, "n_links": 0, "groups_sha256": ""})
    if not sum(map(len, ids[0])):
        return figures, np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = tuple(np.concatenate(side) for side in ids)
    ends = tuple(np.cumsum(v.lengths[f][joined[f]]) for f in (0, 1))
    of_token = np.repeat(np.arange(len(texts)), sizes[0])
    final = groups(ends)
    heads = np.flatnonzero(final[0] == np.arange(len(final[0])))
    numbers = np.searchsorted(heads, final[0]), np.searchsorted(heads, final[1])
    figures["n_groups"] = np.bincount(of_token[heads], minlength=len(texts))
    a, b = links(ends)
    of_link = of_token[a]
    figures["n_links"] = np.bincount(of_link, minlength=len(texts))
    written, size = _written(joined, numbers, v.digits)
    data = written.tobytes()
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of_token[heads], weights=size, minlength=len(texts)).astype(np.int64))])
    figures["groups_sha256"] = [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])]
    return figures, of_link, joined[0][a] << v.bits | joined[1][b]


_SENT: dict[tuple[int, int], Vocabularies] = {}


def _vocabularies(first: bytes, second: bytes) -> Vocabularies:
    key = hash(first), hash(second)
    if key not in _SENT:
        _SENT.clear()
        _SENT[key] = Vocabularies(first, second)
    return _SENT[key]


_FIGURES = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}


def _distinct(keys: np.ndarray, shift: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of each of n texts, how often each occurs there, and how many each text has."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[new] & ((1 << shift) - 1), np.diff(new, append=len(keys)), np.bincount(keys[new] >> shift, minlength=n)


def aligned_blocks(df: DataFrame, first: str, second: str, text_col: str) -> DataFrame:
    """(block, a, b, docs, payload, pairs, times, sizes): the distinct pairs of a block with their
    documents, the figures of its documents, and each document's pairs by their place among the keys."""
    with open(first, "rb") as a, open(second, "rb") as b:
        sent = df.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # files of fixed size
    text_at = df.columns.index(text_col)
    rest = [k for k, c in enumerate(df.columns) if k != text_at]

    def block(number: int, bits: int, rows: list[pa.RecordBatch], found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        keys, place = np.unique(np.concatenate([k for k, _, _ in found]), return_inverse=True)
        docs = np.bincount(place, minlength=len(keys)).astype(np.int64)
        times, sizes = (np.concatenate([f[k] for f in found]).astype(np.int32) for k in (1, 2))
        values = [number, squeezed(keys >> bits), squeezed(keys & (1 << bits) - 1), squeezed(docs), _packed(pa.Table.from_batches(rows)), squeezed(place.astype(np.int32)), squeezed(times), squeezed(sizes)]
        return pd.DataFrame([values], columns=_BLOCK_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, number, rows, found, size = _vocabularies(*sent.value), TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, j in chunks(batch.column(text_at)):
                texts = batch.column(text_at)[i:j]
                figures, of_link, pair = align(texts.to_pylist(), v)
                shift = v.bits + len(v.lengths[0]).bit_length()
                found.append(_distinct(of_link << shift | pair, shift, j - i))
                columns = [batch.column(k)[i:j] for k in rest]
                names = [f"c{k}" for k in range(len(rest))] + list(_FIGURES)
                rows.append(pa.RecordBatch.from_arrays([*columns, *(pa.array(figures[c]) for c in _FIGURES)], names=names))
                size += texts.nbytes
                if size >= BLOCK:
                    yield pa.RecordBatch.from_pandas(block(number, v.bits, rows, found), preserve_index=False)
                    number, rows, found, size = number + 1, [], [], 0
        if rows:
            yield pa.RecordBatch.from_pandas(block(number, v.bits, rows, found), preserve_index=False)

    return by_place(df).mapInArrow(run, "block long, " + ", ".join(f"{c} binary" for c in _BLOCK_COLUMNS[1:]))


_BLOCK_COLUMNS = ["block", "a", "b", "docs", "payload", "pairs", "times", "sizes"]


def _pairs(blocks: DataFrame) -> DataFrame:
    """(block, place, a, b, docs) of the distinct pairs of every block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, *columns in zip(frame["block"], frame["a"], frame["b"], frame["docs"]):
                a, b, docs = (widened(c, np.int64) for c in columns)
                yield pd.DataFrame({"block": number, "place": np.arange(len(a)), "a": a, "b": b, "docs": docs})

    return blocks.select("block", "a", "b", "docs").mapInPandas(run, "block long, place int, a int, b int, docs long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents a pair is linked, and whether that is the most
    that any pair of its first-side id has."""
    counts = saved(_pairs(blocks).groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair_counts")
    most = counts.groupBy("a").agg(F.max("count").alias("_most"))  # a row per id of the vocabulary
    return counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))


def align_documents(df: DataFrame, first: str, second: str, text_col: str = "text") -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, n_links, n_best (links of a pair whose count is
    its first id's highest), count_sum (counts over links) and groups_sha256. Columns of df named
    like one of these are replaced."""
    added = [*_FIGURES, "n_best", "count_sum"]
    df = df.drop(*added)
    fields = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*fields, *[T.StructField(c, t) for c, t in _FIGURES.items()], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    blocks = saved(aligned_blocks(df, first, second, text_col), "aligned")
    told = _pairs(blocks).drop("docs").join(pair_counts(blocks), ["a", "b"]).select("block", "place", "count", "best")

    def finish(_, own: pa.Table, got: pa.Table) -> pa.Table:
        out = []
        count, best = np.zeros(got.num_rows, np.int64), np.zeros(got.num_rows, bool)
        place = got.column("place").to_numpy()
        count[place], best[place] = got.column("count").to_numpy(), got.column("best").to_numpy()
        for row in own.to_pylist():
            pairs, times, sizes = (widened(row[c], np.int32) for c in ("pairs", "times", "sizes"))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            figures = (np.concatenate([[0], np.cumsum(f[pairs] * times.astype(np.int64))]) for f in (best, count))
            sums = [pa.array(np.diff(f[bounds])) for f in figures]
            rows = unpacked(row["payload"]).combine_chunks()
            out.append(pa.Table.from_arrays([*rows.columns, *sums], names=schema.names))
        return pa.concat_tables(out)

    left = blocks.select("block", "payload", "pairs", "times", "sizes").groupBy("block")
    return left.cogroup(told.groupBy("block")).applyInArrow(finish, schema)
