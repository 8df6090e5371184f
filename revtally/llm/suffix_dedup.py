"""Removal of repeated passages by merging shard Burrows-Wheeler transforms.

A passage is `length` bytes; it is removed wherever it stands if it starts anywhere else too.

Where passages meet. Equal passages hold the same anchor: the leftmost k-gram of least hash among
those of the passage. Successive passages with one anchor form a stretch. Blocks tell (see blocks)
the anchors and stretches they hold; only anchors that occur twice or more stay, and equal
stretches are sent once, with a weight.

Shards. The stretches that a block sends to a range of anchors are a shard. Its suffixes are sorted
on their own, and its transform is, for every suffix in that order, the symbol before it. Symbols
are runs of `STRIDE` bytes; a string has one phase per offset, so one step of the transform is one
symbol.

Merge. The interleave of a range says from which shard each place of the merged order comes. It
begins with the shards one after another and is refined: reading the shards' transforms in the
order of the interleave and dealing their entries out by symbol, stably, gives the interleave by
one symbol more. Bounds between places with different symbols, or whose successors were told
apart before, are kept, so that after length / STRIDE rounds the places between two bounds have a
common prefix of `length` bytes. Suffixes aren't sorted again. An interval of a total weight over
one is a repeat.

An anchor with very many different stretches is not gathered: its passages are anchors of their
own (as long as the passage), which are counted like others; this is exact too.

Defined results: a null text is empty; matches never cross documents; a repeated row is a second
document with the same text; whole texts are taken whatever their length; an empty table gives an
empty result; other columns are carried along, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import hashing as H
from .common import saved, set_aside

LENGTH, STRIDE = 200, 25
#: Different stretches of an anchor beyond which its passages are counted one by one.
GATHERED = 4096
#: How many times finer than usual the ranges of anchors are cut; a merge takes some hundred bytes
#: of memory for each byte it gets.
FINER = 4
_PLACE = np.uint64((1 << 28) - 1)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What a block is told of a stretch: alone; its anchor has too many; sent by another; to be
#: sent; to be sent, and the stretch itself occurs more than once.
ALONE, CROWDED, KNOWN, SEND, SEND_REPEATED = range(5)


class Stretches:
    """The stretches of some documents: document, start, number of passages, anchor, content."""

    def __init__(self, texts: list[bytes], length: int):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.begins = np.cumsum([0, *map(len, texts)])
        sizes = np.diff(self.begins)
        k = length // 2
        w = length - k + 1
        passages = np.maximum(sizes - length + 1, 0)
        total = int(passages.sum())
        if not total:
            self.doc = self.start = self.count = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        sums = H.prefix_sums(self.data)
        n = len(self.data)
        starts = np.arange(n - k + 1)
        grams = H.spans(sums, starts, starts + k)
        keyed = (grams & ~_PLACE) | starts.astype(np.uint64)
        padded = np.full(-(-(len(keyed) + w) // w) * w, _NEVER)
        padded[: len(keyed)] = keyed
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        # documents' passages one after another
        doc = np.repeat(np.arange(len(texts)), passages)
        at = np.arange(total) - np.repeat(np.cumsum(passages) - passages, passages) + self.begins[doc]
        place = (np.minimum(behind[at], ahead[at + w - 1]) & _PLACE).astype(np.int64)
        new = np.ones(total, dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.doc, self.count = doc[first], np.diff(np.append(first, total))
        self.start = at[first]
        # the least hashes are small numbers: hash again, to spread them over all ranges
        self.anchor = H.mixed(grams[place[first]] ^ np.uint64(0x5851F42D4C957F2D))
        self.content = H.spans(sums, self.start, self.start + self.count + length - 1)


def _rows(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches to tell of, in order: one of every kind, and a second one if there are more;
    for every stretch, the place of the first of its kind among them."""
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    kind = np.cumsum(new) - 1
    kept = np.arange(len(a)) - np.flatnonzero(new)[kind] < 2
    place = np.empty(len(a), dtype=np.int64)
    place[order] = (np.cumsum(kept) - 1)[new][kind]
    return order[kept], place


class Told:
    """All stretches of a block, and what the block was told of each."""

    def __init__(self, rows: pa.Table, length: int):
        self.pieces: list[Stretches] = []
        docs, of_piece, offset = [], [], 0
        for part in B.parts_of(rows):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            piece = Stretches(texts, length)
            docs.append(piece.doc + offset)
            of_piece.append(np.full(len(piece.doc), len(self.pieces)))
            self.pieces.append(piece)
            offset += len(texts)

        def whole(arrays: list[np.ndarray], dtype) -> np.ndarray:
            return np.concatenate(arrays) if arrays else np.zeros(0, dtype)

        self.doc, self.piece = whole(docs, np.int64), whole(of_piece, np.int64)
        self.anchor = whole([s.anchor for s in self.pieces], np.uint64)
        self.content = whole([s.content for s in self.pieces], np.uint64)
        self.count = whole([s.count for s in self.pieces], np.int64)
        self.at = whole([s.start for s in self.pieces], np.int64)
        self.start = whole([s.start - s.begins[s.doc] for s in self.pieces], np.int64)
        self.kept, self.place = _rows(self.anchor, self.content)

    def string(self, i: int, length: int) -> np.ndarray:
        """The bytes of a stretch."""
        return self.pieces[self.piece[i]].data[self.at[i] : self.at[i] + self.count[i] + length - 1]

    def hear(self, verdict: np.ndarray) -> None:
        self.verdict = verdict[self.place]
        self.sends = self.kept[verdict >= SEND]
        self.repeated = verdict[verdict >= SEND] == SEND_REPEATED


def _asked(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    own = Told(rows, length)
    return own.anchor[own.kept], own.content[own.kept]


def _verdicts(distinct: np.ndarray, place: np.ndarray, content: np.ndarray, gathered: int) -> np.ndarray:
    order = np.lexsort((content, place))
    p, c = place[order], content[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    rows = np.bincount(p, minlength=len(distinct))
    different = np.bincount(p[new], minlength=len(distinct))
    verdict = np.where(new, np.where(np.append(~new[1:], False), SEND_REPEATED, SEND), KNOWN)
    verdict = np.where(different[p] > gathered, CROWDED, verdict)
    verdict = np.where(rows[p] < 2, ALONE, verdict)
    out = np.empty(len(p), dtype=np.uint8)
    out[order] = verdict
    return out


def _sent(rows: pa.Table, got: pd.DataFrame, length: int, parts: int) -> Iterable[pd.DataFrame]:
    """For each range of anchors: the stretches to send, the kinds of stretches to be told of, and
    (for the block itself) where these stand."""
    if not len(got):
        return
    own = Told(rows, length)
    own.hear(B.told(got, np.uint8))
    part = (own.anchor >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64)
    asks = np.flatnonzero(own.verdict >= KNOWN)
    asks = asks[np.argsort(part[asks], kind="stable")]
    cuts = np.searchsorted(part[asks], np.arange(parts + 1))
    sends = own.sends[np.argsort(part[own.sends], kind="stable")]
    repeated = own.repeated[np.argsort(part[own.sends], kind="stable")]
    send_cuts = np.searchsorted(part[sends], np.arange(parts + 1))
    out = []
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        mine = asks[cuts[r] : cuts[r + 1]]
        mail = sends[send_cuts[r] : send_cuts[r + 1]]
        wanted, which = np.unique(own.content[mine], return_inverse=True)
        strings = [own.string(i, length) for i in mail.tolist()]
        row = {
            "sent": own.content[mail],
            "sizes": (own.count[mail] + length - 1).astype(np.uint32),
            "weights": repeated[send_cuts[r] : send_cuts[r + 1]].astype(np.uint8) + np.uint8(1),
            "strings": np.concatenate(strings) if strings else np.zeros(0, np.uint8),
            "wanted": wanted,
            "which": which.astype(np.uint32),
            "docs": own.doc[mine].astype(np.uint32),
            "starts": own.start[mine].astype(np.uint32),
        }
        out.append((got["block"].iloc[0], r, *map(B.squeezed, row.values())))
    yield pd.DataFrame(out, columns=["block", "part", *(c.split()[0] for c in _STRINGS.split(", "))])


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """Places in the order of their symbols (below 2 to the 32), equal ones as they stand."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and int(symbols.max()) > 0xFFFF:
        order = order[np.argsort((symbols[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def sorted_suffixes(symbols: np.ndarray, after: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of one shard in the order of their first `depth` symbols, by doubling; after:
    the suffix one symbol on, or -1."""
    rank, step, known = symbols.astype(np.int64), after, 1
    while known < depth:
        behind = np.where(step >= 0, rank[np.maximum(step, 0)] + 1, 0)
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + behind, return_inverse=True)
        step = np.where(step >= 0, step[np.maximum(step, 0)], -1)
        known *= 2
    return np.argsort(rank, kind="stable")


def repeated_passages(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int, stride: int) -> np.ndarray:
    """For every byte of the shards (data, sizes of the strings, their weights), one shard after
    another: whether the passage that starts there stands elsewhere too, in any shard, or in a
    string of a weight over one."""
    data = np.concatenate([d for d, _, _ in shards])
    sizes = np.concatenate([s for _, s, _ in shards]).astype(np.int64)
    weight = np.repeat(np.concatenate([w for _, _, w in shards]), sizes)
    n, depth = len(data), length // stride
    at = np.arange(n, dtype=np.int32)
    last = np.cumsum(sizes)
    ends = np.repeat(last.astype(np.int32), sizes)
    whole = at + stride <= ends
    places = np.flatnonzero(whole)
    runs = H.spans(H.prefix_sums(data), places, places + stride)
    # symbols: 0 is none; what is left at the end of a string is like nothing else; then runs
    tails = n - len(runs)
    symbol = np.empty(n, dtype=np.int32)
    symbol[~whole] = 1 + np.arange(tails)
    symbol[places] = 1 + tails + np.unique(runs, return_inverse=True)[1]
    del runs, places, whole
    after = np.where(at + stride < ends, at + stride, -1)
    back = at - stride
    before = np.where(back >= np.repeat((last - sizes).astype(np.int32), sizes), symbol[np.maximum(back, 0)], 0)
    del back
    # each shard's suffixes in order, and its transform
    bounds = np.cumsum([0, *(len(d) for d, _, _ in shards)])
    order = np.empty(n, dtype=np.int32)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        local = np.where(after[a:b] >= 0, after[a:b] - a, -1)
        order[a:b] = a + sorted_suffixes(np.unique(symbol[a:b], return_inverse=True)[1], local, depth)
    transform = before[order]
    leads = transform > 0
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), np.diff(bounds))
    # suffixes with nothing behind their symbol; the transform leads to all others
    ending = np.flatnonzero(after[order] < 0).astype(np.int32)
    end_symbol = symbol[order[ending]]
    del symbol, before, after
    place = np.arange(n, dtype=np.int32)  # which suffix of which shard stands at each place of the interleave
    interval = np.zeros(n, dtype=np.int32)
    for turn in range(depth):
        read = leads[place]
        entries = np.concatenate([ending, place[read]])
        symbols = np.concatenate([end_symbol, transform[place[read]]])
        known = np.concatenate([np.full(len(ending), -1 if turn else 0, dtype=np.int32), interval[read]])
        dealt = stable_order(symbols)
        symbols, known = symbols[dealt], known[dealt]
        new = np.ones(n, dtype=bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (known[1:] != known[:-1])
        interval = np.cumsum(new, dtype=np.int32) - np.int32(1)
        # the n-th place of a shard in the interleave holds the n-th suffix of the shard
        interleave = shard[entries][dealt]
        place[np.argsort(interleave, kind="stable")] = np.arange(n, dtype=np.int32)
    suffix = order[place]
    total = np.bincount(interval, weights=weight[suffix])
    repeated = np.zeros(n, dtype=bool)
    repeated[suffix] = total[interval] > 1
    return repeated & (at + length <= ends)


#: Bytes of a shard, at least, unless there are no more; blocks that send little share one.
SHARD = 1 << 18


def _merge(group: pd.DataFrame, length: int, stride: int) -> pd.DataFrame:
    """Merges the transforms of a range of anchors and tells every block of its stretches: for
    each, the number of runs of repeated bytes, and where these begin and end."""
    shards, waiting = [], []
    contents = []
    for sent, sizes, weights, strings in zip(group["sent"], group["sizes"], group["weights"], group["strings"]):
        own = B.widened(sent, np.uint64)
        if len(own):
            contents.append(own)
            waiting.append((B.widened(strings, np.uint8), B.widened(sizes, np.uint32), B.widened(weights, np.uint8)))
        if sum(len(w[0]) for w in waiting) >= SHARD:
            shards.append(tuple(np.concatenate(x) for x in zip(*waiting)))
            waiting = []
    if waiting:
        shards.append(tuple(np.concatenate(x) for x in zip(*waiting)))
    repeated = repeated_passages(shards, length, stride)
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    run_from, run_to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + length - 1
    sizes = np.concatenate([s for _, s, _ in shards]).astype(np.int64)
    string_end = np.cumsum(sizes)
    content = np.concatenate(contents)
    by_content = np.argsort(content)
    lo, hi = np.searchsorted(run_from, string_end - sizes), np.searchsorted(run_from, string_end)
    rows = []
    for wanted in group["wanted"]:
        string = by_content[np.searchsorted(content[by_content], B.widened(wanted, np.uint64))]
        count = hi[string] - lo[string]
        run = np.repeat(lo[string] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        origin = np.repeat((string_end - sizes)[string], count)
        rows.append([B.squeezed(x.astype(np.uint32)) for x in (count, run_from[run] - origin, run_to[run] - origin)])
    told = pd.DataFrame(rows, columns=["a", "b", "c"])
    return told.assign(block=group["block"].to_numpy(), part=group["part"].to_numpy(), kind=2)[["block", "part", "kind", "a", "b", "c"]]


def _crowded(own: Told, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and hash of every passage whose anchor has too many stretches."""
    docs, starts, keys = [], [], []
    for i in np.flatnonzero(own.verdict == CROWDED).tolist():
        at = np.arange(own.count[i])
        keys.append(H.spans(H.prefix_sums(own.string(i, length)), at, at + length))
        docs.append(np.full(len(at), own.doc[i]))
        starts.append(own.start[i] + at)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(keys)


def _crowd_asked(rows: pa.Table, got: pd.DataFrame, length: int, parts: int) -> Iterable[pd.DataFrame]:
    verdict = B.told(got, np.uint8)
    if not (verdict == CROWDED).any():
        return
    own = Told(rows, length)
    own.hear(verdict)
    keys, n = np.unique(_crowded(own, length)[2], return_counts=True)
    n = np.minimum(n, 2).astype(np.uint8)
    block = got["block"].iloc[0]
    out = [(r, block, B.squeezed_keys(keys[s]), B.squeezed(n[s])) for r, s in B.sliced(keys, parts)]
    yield pd.DataFrame(out, columns=["part", "block", "keys", "weights"])


def _crowd_verdicts(distinct: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (np.bincount(place, weights=n, minlength=len(distinct)) > 1).astype(np.uint8)[place]


def _cleaned(rows: pa.Table, got: pd.DataFrame, length: int, carried: list[str], as_text: bool) -> Iterable[pd.DataFrame]:
    docs, begins, ends = [], [], []
    runs = {r["part"]: r for r in got[got["kind"] == 2].to_dict("records")}
    for r in got[got["kind"] == 1].to_dict("records"):
        which, doc, start = (B.widened(r[c], np.uint32).astype(np.int64) for c in "abc")
        count, begin, end = (B.widened(runs[r["part"]][c], np.uint32).astype(np.int64) for c in "abc")
        first = np.cumsum(count) - count
        n = count[which]
        run = np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        docs.append(np.repeat(doc, n))
        begins.append(np.repeat(start, n) + begin[run])
        ends.append(np.repeat(start, n) + end[run])
    crowd = got[got["kind"] == 3]
    if len(crowd):
        own = Told(rows, length)
        own.hear(B.told(got[got["kind"] == 0].rename(columns={"a": "values"}), np.uint8))
        doc, start, keys = _crowded(own, length)
        again = B.told(crowd.rename(columns={"a": "values"}), np.uint8)[np.searchsorted(np.unique(keys), keys)] > 0
        docs.append(doc[again])
        begins.append(start[again])
        ends.append(start[again] + length)
    doc, begin, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, begins, ends))
    order = np.argsort(doc, kind="stable")
    doc, begin, end = doc[order], begin[order], end[order]
    offset = 0
    for part in B.parts_of(rows):
        frame = part.select(carried).to_pandas(integer_object_nulls=True)
        cuts = np.searchsorted(doc, offset + np.arange(part.num_rows + 1))
        kept, size, removed, spans = [], [], [], []
        for k, text in enumerate(part.column("text").to_pylist()):
            raw = (text or "").encode()
            a, b = cuts[k], cuts[k + 1]
            left, n = raw, 0
            if b > a:
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, begin[a:b], 1)
                np.add.at(edge, end[a:b], -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept.append(left.decode(errors="ignore") if as_text else left)
            size.append(len(raw))
            removed.append(len(raw) - len(left))
            spans.append(n)
        offset += part.num_rows
        yield frame.assign(n_bytes=size, n_removed=removed, n_spans=spans, kept=kept)


_STRINGS = "sent binary, sizes binary, weights binary, strings binary, wanted binary, which binary, docs binary, starts binary"


def deduplicate(documents: DataFrame, length: int = LENGTH, stride: int = STRIDE, gathered: int = GATHERED, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """The carried columns of documents (all, if not said) with n_bytes, n_removed, n_spans and
    kept, the bytes that remain; as text, if asked, without the halves of characters at a cut.
    length is a multiple of stride."""
    documents = documents.drop("n_bytes", "n_removed", "n_spans", "kept")
    carry = documents.columns if carry is None else carry
    blocks = B.pack(documents)
    parts = FINER * B.ranges(blocks)
    asked = B.questions(blocks, lambda rows: _asked(rows, length), parts, "uint64")
    verdicts = saved(B.answers(asked, lambda d, p, w: _verdicts(d, p, w, gathered), "uint64"), "verdicts")
    sent = saved(B.meet(blocks, verdicts, lambda rows, got: _sent(rows, got, length, parts), f"block long, part int, {_STRINGS}"), "stretches")
    runs = sent.select("block", "part", "sent", "sizes", "weights", "strings", "wanted").groupBy("part")
    told = runs.applyInPandas(lambda group: _merge(group, length, stride), "block long, part int, kind int, a binary, b binary, c binary")
    none = F.lit(None).cast("binary")
    told = told.union(sent.select("block", "part", F.lit(1).alias("kind"), "which", "docs", "starts"))
    crowd = B.meet(blocks, verdicts, lambda rows, got: _crowd_asked(rows, got, length, parts), "part int, block long, keys binary, weights binary")
    crowd = saved(B.answers(crowd, _crowd_verdicts, "uint8"), "crowd")
    told = told.union(crowd.select("block", "part", F.lit(3), "values", none, none))
    told = told.union(verdicts.join(crowd.select("block").distinct(), "block", "left_semi").select("block", "part", F.lit(0), "values", none, none))
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in carry), "n_bytes long, n_removed long, n_spans long", f"kept {'string' if as_text else 'binary'}"])
    return B.meet(blocks, told, lambda rows, got: _cleaned(rows, got, length, carry, as_text), schema)


def cleaned_documents(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents with what is left of their texts, and its length where there is n_chars."""
    rows, restored = set_aside(documents, ("doc_id", "text", "n_chars"))
    out = deduplicate(rows, length, as_text=True).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return restored(out)
