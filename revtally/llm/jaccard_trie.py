"""Similarity join of word n-gram sets with a prefix tree.

Shingles have one order for all documents: by the number of documents that hold them, then by
hash. A pair over the threshold shares one of the rarest shingles of either side (the prefix), so
sets that share a prefix shingle form families, and links lie within families. A family's sets
are stored in a tree, most frequent shingle first, so that copies share long paths. Each set is
matched against the tree from the root down, one level at a time: overlaps of a path are counted
once for all sets below it, and a subtree is left when the overlap so far and what can remain, on
either side, is too little for its smallest set, or when its sizes don't fit. What is left at the
end of a path is compared exactly.

Large families are cut by size, where only neighbouring sizes can link, and by hash, and each
pair of pieces is worked on by itself: exact at any size and in bounded memory. Equal sets are one
set with a number of copies. Frequencies come from all documents (see blocks).

Defined results: a null or blank text has no shingles and no links; fewer words than a shingle
make up one shingle; repeated rows are copies of each other; copies count as links; an empty
table gives an empty result; other columns are carried along, those named like an added one are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import hashing as H
from .common import saved, set_aside
from .components import components

WORDS, PERCENT = 5, 80
#: Shingles of a piece of a family, and of a bundle of pieces, about.
PIECE, BUNDLE = 1 << 20, 1 << 20
#: Frequencies are counted by the first 48 bits of a hash; they only order shingles.
_COARSE = np.uint64(0xFFFFFFFFFFFF0000)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw), dtype=np.uint8)]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, ends = H.words(data)
    hashes = H.spans(H.prefix_sums(data), starts, ends)
    cuts = np.searchsorted(starts, begins)
    grams = H.windows(hashes, words)
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(H.windows(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def _asked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for part in B.parts_of(rows):
        sets = shingle_sets(part.column("text").to_pylist())
        found.append(np.concatenate(sets) & _COARSE if sets else np.zeros(0, np.uint64))
    keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64),) * 2
    return keys, np.minimum(n, 65535)


def _frequencies(distinct: np.ndarray, place: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.bincount(place, weights=weights, minlength=len(distinct))
    return np.minimum(total, 65535).astype(np.uint16)[place]


def _prefixed(rows: pa.Table, got: pd.DataFrame, percent: int, carried: list[str]) -> Iterable[pd.DataFrame]:
    """Sets in their order: the prefix shingles that other documents may hold, and all such."""
    frequency = B.told(got, np.uint16)
    keys, _ = _asked(rows)
    for part in B.parts_of(rows):
        sets = shingle_sets(part.column("text").to_pylist())
        frame = part.select(carried).to_pandas(integer_object_nulls=True)
        size, node, check, tokens, members = [], [], [], [], []
        for own in sets:
            n = len(own)
            often = frequency[np.searchsorted(keys, own & _COARSE)]
            order = np.lexsort((own, often))
            prefix = order[: n - (percent * n + 99) // 100 + 1] if n else order
            probe = own[prefix[often[prefix] > 1]]
            size.append(n)
            node.append(int(H.mixed(own).sum(dtype=np.uint64).astype(np.int64)) if n else 0)
            check.append(int(np.bitwise_xor.reduce(H.mixed(own ^ np.uint64(n))).astype(np.int64)) if n else 0)
            tokens.append(probe.view(np.int64).tolist() if len(probe) else None)
            live = order[often[order] > 1][::-1]
            members.append(own[live].tobytes() + often[live].tobytes() if len(probe) else None)
        yield frame.assign(n_shingles=size, node=node, check=check, tokens=tokens, members=members)


class Tree:
    """Sets in a path-compressed prefix tree, as arrays of nodes level by level."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, universe: int):
        self.sizes, self.universe = sizes, universe
        order = sorted(range(len(sets)), key=[s.astype(">u4").tobytes() for s in sets].__getitem__)
        # a path holds nodes [set, begin, end, parent]; a set that leaves it splits a node
        nodes: list[list[int]] = []
        self.end_of = np.zeros(len(sets), dtype=np.int64)
        path: list[int] = []
        last = None
        for k in order:
            own = sets[k]
            shared = 0
            if last is not None:
                m = min(len(own), len(last))
                differ = np.flatnonzero(own[:m] != last[:m])
                shared = int(differ[0]) if len(differ) else m
            while path and nodes[path[-1]][1] >= shared and not nodes[path[-1]][2] == shared:
                path.pop()
            if path and nodes[path[-1]][2] > shared:
                top = nodes[path[-1]]
                nodes.append([top[0], top[1], shared, top[3]])
                top[1], top[3] = shared, len(nodes) - 1
                path[-1] = len(nodes) - 1
            if shared < len(own) or not path:
                nodes.append([k, shared, len(own), path[-1] if path else -1])
                path.append(len(nodes) - 1)
            self.end_of[k] = path[-1]
            last = own
        raw = np.array(nodes, dtype=np.int64).reshape(-1, 4)
        count = len(raw)
        depth = np.zeros(count, dtype=np.int64)
        chain = raw[:, 3].copy()
        while (chain >= 0).any():
            depth += chain >= 0
            chain = np.where(chain >= 0, raw[np.maximum(chain, 0), 3], -1)
        ranked = np.lexsort((raw[:, 3], depth))
        place = np.empty(count, dtype=np.int64)
        place[ranked] = np.arange(count)
        raw = raw[ranked]
        self.parent = np.where(raw[:, 3] >= 0, place[np.maximum(raw[:, 3], 0)], -1)
        self.end_of = place[self.end_of]
        self.level = np.searchsorted(depth[ranked], np.arange(depth.max(initial=0) + 2))
        segments = [sets[k][a:b] for k, a, b in raw[:, :3].tolist()]
        self.lengths = np.array([len(s) for s in segments], dtype=np.int64)
        self.flat = np.concatenate(segments) if segments else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.last = np.array([s[-1] if len(s) else -1 for s in segments], dtype=np.int64)
        # of the sets below a node: sizes, and how many shingles can follow
        self.least = np.full(count, 1 << 60)
        self.most, self.follow = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
        np.minimum.at(self.least, self.end_of, sizes)
        np.maximum.at(self.most, self.end_of, sizes)
        for lo, hi in zip(self.level[-2:0:-1], self.level[:0:-1]):
            up = self.parent[lo:hi]
            np.minimum.at(self.least, up, self.least[lo:hi])
            np.maximum.at(self.most, up, self.most[lo:hi])
            np.maximum.at(self.follow, up, self.follow[lo:hi] + self.lengths[lo:hi])
        # children of a node are neighbours, as a level is sorted by parent
        self.child_from = np.searchsorted(self.parent, np.arange(count))
        self.child_to = np.searchsorted(self.parent, np.arange(count), side="right")
        by_end = np.argsort(self.end_of, kind="stable")
        self.sets_at, self.sets_from = by_end, np.searchsorted(self.end_of[by_end], np.arange(count + 1))

    def matches(self, own: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The stored sets whose Jaccard similarity with this one reaches the threshold."""
        mask = np.zeros(self.universe + 1, dtype=np.int64)
        mask[own] = 1
        remaining = len(own) - np.cumsum(mask)
        mask_sums = np.concatenate([[0], np.cumsum(mask[self.flat])])
        found = []
        nodes = np.arange(self.level[0], self.level[1])
        overlap = np.zeros(len(nodes), dtype=np.int64)
        while len(nodes):
            overlap = overlap + mask_sums[self.starts[nodes] + self.lengths[nodes]] - mask_sums[self.starts[nodes]]
            rest = np.minimum(np.where(self.last[nodes] >= 0, remaining[self.last[nodes]], len(own)), self.follow[nodes])
            fits = (overlap + rest) * (100 + percent) >= percent * (size + self.least[nodes])
            fits &= (100 * self.most[nodes] >= percent * size) & (percent * self.least[nodes] <= 100 * size)
            nodes, overlap = nodes[fits], overlap[fits]
            a, b = self.sets_from[nodes], self.sets_from[nodes + 1]
            for at in np.flatnonzero(b > a):
                ended = self.sets_at[a[at] : b[at]]
                union = size + self.sizes[ended] - overlap[at]
                found.append(ended[100 * overlap[at] >= percent * union])
            a, n = self.child_from[nodes], self.child_to[nodes] - self.child_from[nodes]
            overlap = np.repeat(overlap, n)
            nodes = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def links_between(left: pd.DataFrame, right: pd.DataFrame | None, percent: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links of the rows (node, n_shingles, copies, members) of one piece with each other, or
    with those of another: a spanning set of them, and how many documents each node is linked with."""
    rows = left if right is None else pd.concat([left, right])
    raw = rows["members"].tolist()
    count = [len(m) // 10 for m in raw]
    flat = np.concatenate([np.frombuffer(m, np.uint64, n) for m, n in zip(raw, count)])
    often = np.concatenate([np.frombuffer(m, np.uint16, n, 8 * n) for m, n in zip(raw, count)])
    distinct, first, place = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(distinct), dtype=np.int64)
    rank[np.lexsort((distinct, -often[first].astype(np.int64)))] = np.arange(len(distinct))
    sets = [np.sort(s) for s in np.split(rank[place], np.cumsum(count)[:-1])]
    node, copies = rows["node"].tolist(), rows["copies"].to_numpy()
    sizes = rows["n_shingles"].to_numpy().astype(np.int64)
    begin = 0 if right is None else len(left)
    tree = Tree(sets[begin:], sizes[begin:], len(distinct))
    probes = range(len(sets)) if right is None else range(len(left))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    spanning, linked = [], dict.fromkeys(node, 0)
    for x in probes:
        for y in (tree.matches(sets[x], int(sizes[x]), percent) + begin).tolist():
            if y == x:
                continue
            linked[node[x]] += int(copies[y])
            if right is not None:
                linked[node[y]] += int(copies[x])
            a, b = find(x), find(y)
            if a != b:
                root[a] = b
                spanning.append((node[x], node[y]))
    return spanning, linked


def _pieces(sets: DataFrame, family: DataFrame) -> DataFrame:
    """(task, side, node, n_shingles, copies, members): the pairs of pieces to be compared; side
    is 0 and 1 for two different pieces, 2 for one piece with itself."""
    rows = sets.join(family.select("node", F.col("root").alias("family")), "node")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(1.25))).cast("int")
    weight = rows.groupBy("family").agg(F.sum("n_shingles").alias("_all"))
    one_piece = weight.filter(F.col("_all") <= PIECE).select("family", F.lit(0).alias("band"), F.lit(1).alias("parts"))
    cut = rows.withColumn("band", band).groupBy("family", "band").agg(F.ceil(F.sum("n_shingles") / PIECE).cast("int").alias("parts"))
    cut = cut.join(weight.filter(F.col("_all") > PIECE).select("family"), "family")
    pieces = saved(one_piece.union(cut.select("family", "band", "parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "pieces")
    a, b = pieces.alias("a"), pieces.alias("b")
    near = (F.col("b.band") == F.col("a.band")) & (F.col("b.part") >= F.col("a.part")) | (F.col("b.band") == F.col("a.band") + 1)
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & near).select("a.family", F.struct("a.band", "a.part").alias("x"), F.struct("b.band", "b.part").alias("y"))
    pairs = pairs.withColumn("task", F.xxhash64("family", "x", "y"))
    alone = F.col("x") == F.col("y")
    sides = pairs.select("family", "task", F.col("x").alias("piece"), F.when(alone, 2).otherwise(0).alias("side"))
    sides = saved(sides.union(pairs.filter(~alone).select("family", "task", "y", F.lit(1))), "sides")
    whole = rows.join(weight, "family")
    parts = pieces.select("family", "band", "parts").distinct()
    placed = whole.withColumn("band", F.when(F.col("_all") <= PIECE, 0).otherwise(band)).join(parts, ["family", "band"])
    placed = placed.withColumn("piece", F.struct("band", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part")))
    return placed.join(sides, ["family", "piece"]).select("task", "side", "node", "n_shingles", "copies", "members")


_ADDED = ("n_shingles", "node", "check", "tokens", "members", "n_links", "component_id", "class")


def join(documents: DataFrame, percent: int = PERCENT, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of documents (doc_id, if not said) with n_shingles, n_links (other
    documents linked directly), component_id (the least doc_id reachable over links) and class
    (a number for the component, null for documents without any link), one row per row."""
    carry = ["doc_id"] if carry is None else [c for c in carry if c not in _ADDED]
    blocks = B.pack(documents.select(*dict.fromkeys([*carry, "doc_id", "text"])))
    asked = B.questions(blocks, _asked, B.ranges(blocks), "uint16")
    answered = B.answers(asked, _frequencies, "uint16")
    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in carry), "n_shingles long, node long, check long, tokens array<long>, members binary"])
    ordered = saved(B.meet(blocks, answered, lambda rows, got: _prefixed(rows, got, percent, carry), schema), "sets")
    shared = ordered.filter(F.col("tokens").isNotNull())
    sets = shared.groupBy("node", "check").agg(
        F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("members").alias("members")
    )
    sets = saved(sets, "distinct")
    tokens = sets.select(F.explode("tokens").alias("token"), "node")
    hubs = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    family = saved(components(tokens.join(hubs, "token").select(F.col("node").alias("u"), F.col("hub").alias("v"))), "families")
    work = _pieces(sets.drop("tokens", "check"), family)
    bundles = max(12, int((sets.agg(F.sum("n_shingles")).first()[0] or 0) // BUNDLE) * 2)

    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, task in bundle.groupby("task"):
            if len(task) < 2:
                continue
            left, right = task[task["side"] != 1], task[task["side"] == 1]
            if not len(right) and not (left["side"] == 2).any():
                continue  # nothing falls into the other piece
            spanning, linked = links_between(left, right if len(right) else None, percent)
            # a row with two different nodes is a link, one with the same node twice its number of links
            out += [(u, v, 0) for u, v in spanning] + [(u, u, n) for u, n in linked.items() if n]
        return pd.DataFrame(out, columns=["u", "v", "n"], dtype="int64")

    work = work.withColumn("bundle", F.pmod("task", F.lit(bundles)))
    found = saved(work.groupBy("bundle").applyInPandas(run, "u long, v long, n long"), "links")
    linked = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("_links"))
    roots = components(found.filter("u != v"))
    labels = sets.select("node", "copies").join(linked, "node", "left").join(roots, "node", "left")
    labels = saved(labels.select("node", F.coalesce("root", "node").alias("root"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_links")), "labels")
    own = shared.drop("check", "tokens", "members").join(labels, "node")
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classed = own.join(least, "root").select(*carry, "n_shingles", F.col("_links").alias("n_links"), "component_id", F.when(F.col("_links") > 0, F.col("root")).alias("class"))
    lone = ordered.filter(F.col("tokens").isNull()).select(*carry, "n_shingles", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class"))
    return classed.union(lone)


def one_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents with one row of each component: one of those with its least id."""
    rows, restored = set_aside(documents, ("doc_id", "text"))
    joined = join(rows, percent, rows.columns)
    alone = joined.filter(F.col("class").isNull())
    first = joined.filter(F.col("class").isNotNull() & (F.col("doc_id").eqNullSafe(F.col("component_id"))))
    return restored(alone.unionByName(first.dropDuplicates(["class"])))
