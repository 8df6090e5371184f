"""Embedding near-duplicates by search in a robust-pruned flat graph.

Vectors of one label and dimension are clustered by centres fitted on a bounded sample; every vector goes to its
`OVERLAP` nearest clusters. Clusters over `SHARD` vectors are dealt out into shards. In each shard
a flat graph is built: a vector's nearest candidates, thinned out by robust pruning, with links in
both directions. The adjacency lists that a vector has in several shards are united. Then every
vector is searched in all shards of its nearest cluster: a greedy search goes from the shard's
medoid to its neighbourhood, and from there the search expands as long as it finds vectors within
range. Every pair is verified by its cosine in double precision.

Recall is audited: a bounded number of queries is compared with all vectors by brute force. While
it is under `RECALL`, overlap, degree and beam are doubled and the index is built anew.

Equal vectors are one with a number of copies; copies are linked with each other. Defined results:
rows with a null label, and vectors that are null, empty, zero, or hold null or non-finite
components, have no links; repeated ids are rows of their own; an empty table gives an empty
result; other columns are ignored. Fit: at most about `FIT` vectors of a label, and `CENTRES`
centres.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, unit_hash
from .components import components

THRESHOLD = 0.93
SHARD, FIT, CENTRES = 1000, 4096, 256
#: Vectors compared with the centres in one task.
SLICE = 20_000
RECALL, AUDITED, ATTEMPTS = 0.9, 256, 3


@dataclass(frozen=True)
class Shape:
    """Clusters per vector, links per vector, breadth of the greedy search, slack of pruning."""

    overlap: int = 3
    degree: int = 24
    beam: int = 32
    slack: float = 1.2

    def doubled(self) -> Shape:
        return replace(self, overlap=2 * self.overlap, degree=2 * self.degree, beam=2 * self.beam)


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of one dimension as unit rows."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node, which is null for a vector without links); distinct vectors (node, group, copies, vector)."""
    real = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x != 0)"
    valid = F.coalesce(F.expr(f"label is not null and {real}"), F.lit(False))
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"), valid.alias("_valid"))
    node = F.when(F.col("_valid"), F.xxhash64("label", "vector"))
    keyed = rows.withColumn("node", node).withColumn("group", F.xxhash64("label", F.size("vector")))
    distinct = keyed.filter("_valid").groupBy("node").agg(F.first("group").alias("group"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    return saved(keyed.select("vec_id", "node"), "rows"), saved(distinct, "vectors")


def fitted(distinct: DataFrame, sizes: DataFrame) -> DataFrame:
    """(group, centre, vector): spherical k-means on a sample of each group."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = matrix(group.sort_values("node")["vector"])
        k = min(len(x), CENTRES, int(-(-group["n"].iloc[0] // SHARD)) * 2)
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(10):
            of = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, x)
            length = np.linalg.norm(sums, axis=1)[:, None]
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
        return pd.DataFrame({"group": group["group"].iloc[0], "centre": np.arange(k), "vector": list(centres)})

    sample = distinct.join(sizes, "group").filter(unit_hash(F.lit("fit"), F.col("node")) * F.col("n") < FIT)
    return saved(sample.select("group", "node", "n", "vector").groupBy("group").applyInPandas(fit, "group long, centre int, vector array<double>"), "centres")


def clustered(distinct: DataFrame, sizes: DataFrame, centres: DataFrame, overlap: int) -> DataFrame:
    """(group, centre, near, node, copies, vector): the nearest centres of each vector; near is
    0 for the nearest."""
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    left = distinct.join(sizes, "group").withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int"))
    counts = sizes.toDF("group", "m")  # new columns, as both sides come from sizes
    right = centres.join(counts, "group").withColumn("slice", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / SLICE).cast("int") - 1))).drop("m")

    def assign(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(near):
            c = np.stack(near["vector"].to_numpy())
            names = near["centre"].to_numpy()
            m = min(overlap, len(c))
            order = np.argsort(-(matrix(own["vector"]) @ c.T), axis=1, kind="stable")[:, :m]
            for k in range(m):
                out.append(own[["group", "node", "copies", "vector"]].assign(centre=names[order[:, k]], near=k))
        frame = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("group", "centre", "near", "node", "copies", "vector")})
        return frame[["group", "centre", "near", "node", "copies", "vector"]]

    keys = ["group", "slice"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(assign, "group long, centre int, near int, node long, copies long, vector array<double>")


def robust_pruned(similar: np.ndarray, candidates: np.ndarray, own: int, degree: int, slack: float) -> list[int]:
    """Of candidates (nearest first) those that no chosen one is much nearer to than `own` is."""
    chosen: list[int] = []
    open_ = np.ones(len(candidates), dtype=bool)
    apart = 1 - similar[own, candidates]
    for k, c in enumerate(candidates.tolist()):
        if open_[k]:
            chosen.append(c)
            if len(chosen) == degree:
                break
            open_ &= slack * (1 - similar[c, candidates]) > apart
    return chosen


def flat_graph(x: np.ndarray, shape: Shape) -> list[list[int]]:
    """Adjacency lists of the rows of x."""
    n = len(x)
    similar = x @ x.T
    np.fill_diagonal(similar, -2.0)
    width = min(n - 1, 3 * shape.degree)
    lists: list[list[int]] = [[] for _ in range(n)]
    if width < 1:
        return lists
    near = np.argpartition(-similar, width - 1, axis=1)[:, :width]
    # a few rows far off keep the parts of the graph together
    far = np.random.default_rng(n).integers(0, n, (n, 4))
    for i in range(n):
        c = np.unique(np.concatenate([near[i], far[i][far[i] != i]]))
        c = c[np.argsort(-similar[i, c], kind="stable")]
        lists[i] = robust_pruned(similar, c, i, shape.degree, shape.slack)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(lists):
        for j in own:
            back[j].append(i)
    for i in range(n):
        both = np.array(sorted({*lists[i], *back[i]}), dtype=np.int64)
        if len(both) > 2 * shape.degree:
            both = both[np.argsort(-similar[i, both], kind="stable")]
            both = np.array(robust_pruned(similar, both, i, 2 * shape.degree, shape.slack))
        lists[i] = both.tolist()
    return lists


class Searcher:
    """Range search in the graph of one shard."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray], shape: Shape):
        self.x, self.shape = x, shape
        self.size = np.array([len(a) for a in lists], dtype=np.int64)
        self.flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.medoid = int(np.argmax(x @ x.mean(axis=0)))

    def _next_to(self, nodes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        n = self.size[nodes]
        places = np.repeat(self.at[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.unique(self.flat[places])
        found = found[~seen[found]]
        seen[found] = True
        return found

    def within(self, query: np.ndarray, threshold: float) -> np.ndarray:
        seen = np.zeros(len(self.x), dtype=bool)
        nodes = np.array([self.medoid])
        seen[nodes] = True
        score = self.x[nodes] @ query
        opened = np.zeros(1, dtype=bool)
        # greedy: open the best of the beam until all of it is open
        while not opened.all():
            k = np.flatnonzero(~opened)[:4]
            opened[k] = True
            new = self._next_to(nodes[k], seen)
            nodes = np.concatenate([nodes, new])
            score = np.concatenate([score, self.x[new] @ query])
            opened = np.concatenate([opened, np.zeros(len(new), dtype=bool)])
            best = np.argsort(-score, kind="stable")[: self.shape.beam]
            nodes, score, opened = nodes[best], score[best], opened[best]
        # expansion: on from all that is within range
        frontier = nodes[score >= threshold]
        found = [frontier]
        seen[:] = False
        seen[nodes] = True
        while len(frontier):
            new = self._next_to(frontier, seen)
            frontier = new[self.x[new] @ query >= threshold]
            found.append(frontier)
        return np.concatenate(found)


def indexed(distinct: DataFrame, sizes: DataFrame, shape: Shape) -> tuple[DataFrame, DataFrame]:
    """Members (group, shard, near, node, copies, vector) and their united adjacency lists (node, next)."""
    placed = saved(clustered(distinct, sizes, fitted(distinct, sizes), shape.overlap), "clusters")
    parts = placed.groupBy("group", "centre").agg(F.ceil(F.count(F.lit(1)) / (SHARD * shape.overlap)).cast("int").alias("parts"))
    members = placed.join(saved(parts, "parts"), ["group", "centre"])
    own = members.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("node")), "parts").cast("int"))
    # a query goes to all shards of its nearest cluster, a member to one shard
    member = own.select("group", "centre", "part", F.lit(True).alias("member"), ((F.col("near") == 0) & (F.col("parts") == 1)).alias("query"), "node", "copies", "vector")
    guest = members.filter("near = 0 and parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    guest = guest.select("group", "centre", "part", F.lit(False), F.lit(True), "node", "copies", "vector")
    members = saved(member.union(guest), "members")

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("node")
        nodes = shard["node"].to_numpy()
        lists = flat_graph(matrix(shard["vector"]), shape)
        return pd.DataFrame({"node": nodes, "next": [nodes[a] for a in lists]})

    built = members.filter("member").groupBy("group", "centre", "part").applyInPandas(build, "node long, next array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    return members, saved(united, "graph")


def found_links(members: DataFrame, graph: DataFrame, threshold: float, shape: Shape) -> DataFrame:
    """(u, v, n): u and v are linked (n is 0), or, where u is v, u is linked with n rows."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["member", "node"], ascending=[False, True])
        own = shard[shard["member"]]
        if not len(own) or not shard["query"].any():
            return pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")
        nodes, copies = own["node"].to_numpy(), own["copies"].to_numpy()
        lists = []
        for following in own["next"]:
            wanted = np.asarray(following if following is not None else [], dtype=np.int64)
            at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
            lists.append(at[nodes[at] == wanted])
        searcher = Searcher(matrix(own["vector"]), lists, shape)
        queries = shard[shard["query"]]
        root = {n: n for n in shard["node"].tolist()}

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        out = []
        for node, vector in zip(queries["node"].tolist(), matrix(queries["vector"])):
            hits = searcher.within(vector, threshold)
            hits = hits[nodes[hits] != node]
            if len(hits):
                out.append((node, node, int(copies[hits].sum())))
            for other in nodes[hits].tolist():
                a, b = find(node), find(other)
                if a != b:
                    root[a] = b
                    out.append((node, other, 0))
        return pd.DataFrame(out, columns=["u", "v", "n"], dtype="int64")

    joined = members.join(graph, "node", "left")
    return joined.groupBy("group", "centre", "part").applyInPandas(search, "u long, v long, n long")


def audited_recall(distinct: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Share of the true links of a bounded number of queries that were found."""
    total = distinct.count()
    chosen = distinct.filter(unit_hash(F.lit("audit"), F.col("node")) * total < AUDITED).limit(2 * AUDITED)
    queries = chosen.select("node", "group", "vector").toPandas()  # bounded by AUDITED
    if not len(queries):
        return 1.0
    unit = {g: (q["node"].to_numpy(), matrix(q["vector"])) for g, q in queries.groupby("group")}
    schema = "node long, n long"

    def compare(frames):
        for frame in frames:
            for group, rows in frame.groupby("group"):
                if group in unit:
                    nodes, x = unit[group]
                    for at in range(0, len(rows), 2000):
                        part = rows.iloc[at : at + 2000]
                        hit = (x @ matrix(part["vector"]).T >= threshold) & (nodes[:, None] != part["node"].to_numpy()[None, :])
                        yield pd.DataFrame({"node": nodes, "n": hit @ part["copies"].to_numpy()})

    actual = distinct.select("node", "group", "copies", "vector").mapInPandas(compare, schema).groupBy("node").agg(F.sum("n").alias("actual")).filter("actual > 0")
    both = actual.join(counted, "node", "left").agg(F.sum("actual").alias("t"), F.sum(F.least("actual", F.coalesce("links", F.lit(0)))).alias("f")).first()
    return both["f"] / both["t"] if both["t"] else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shape: Shape = Shape()) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (least id reachable), kept (the
    row is its component's first) and recall, as audited, one row per row of vectors."""
    rows, distinct = classes(vectors)
    sizes = saved(distinct.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "sizes")
    for attempt in range(ATTEMPTS):
        members, graph = indexed(distinct, sizes, shape)
        found = saved(found_links(members, graph, threshold, shape), "links")
        counted = found.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
        recall = audited_recall(distinct, counted, threshold)
        if recall >= RECALL:
            break
        shape = shape.doubled()
    roots = components(found.filter("u != v"))
    labels = distinct.select("node", "copies").join(counted, "node", "left").join(roots, "node", "left")
    labels = saved(labels.select("node", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels")
    own = rows.join(labels, "node")
    least = own.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = own.join(least, "root").select("vec_id", "n_links", "component_id")
    lone = rows.filter("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lone).select("*", (F.col("vec_id") == F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("recall"))
