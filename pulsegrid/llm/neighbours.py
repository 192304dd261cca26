"""The k nearest vectors of every vector, by a forest of random-projection trees.

A bounded sample (SAMPLE vectors) fits the splits of a few trees; every vector is then put into one leaf of each
tree. A query descends all trees through one shared priority queue: the branch with the smallest margin, of
whichever tree, is followed next, until enough leaves are found. How many that are is an argument, or told by the
sample: the fewest with which the given share of its own nearest vectors is met. Queries meet the members of their
leaves in a shuffle by leaf, and exact distances rank all of them. The sample is bounded, the data are not: a leaf with
more than CROWDED members is split once more by a tree of its own, fitted to a bounded sample of its members, along
which its rows are streamed, and so on until no leaf is crowded, so no task holds more than a leaf.

exact=True compares queries with all vectors, in blocks of queries; recall() measures the share of true neighbours.

Exact copies are one vector to the search, so no leaf fills with them: a vector keeps the k + 1 smallest ids, which
are all that other vectors can need; further copies have the k smallest of them as their neighbours.

Of equal distances the smaller id is nearer. Vectors that are null or hold a null, NaN or infinity are left out,
as are rows without id; repeated rows of one id count once. Fewer than k others give fewer neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, fitting

TREES = 4
#: Leaves that a query visits at least.
VISITS = 8
LEAF = 512
#: Members of a leaf over which it is split once more.
CROWDED = 4096
SAMPLE = 65_536
#: Members of a crowded leaf that its own tree is fitted to, at most.
LEAF_SAMPLE = 16_384
#: Share of a query's nearest vectors in the sample that the leaves visited must hold, and the queries it is told by.
TARGET, PROBES = 0.97, 256
#: Leaves that a query visits at least in each crowded leaf it comes to, and how often leaves are split at most.
SPLIT_VISITS, LEVELS = 4, 6
#: Queries that are compared with all vectors at once.
BLOCK = 8192
#: A leaf of the fitted forest holds at least so many vectors of the sample.
LEAST_SAMPLE = 48


class Tree:
    """Splits by unit normals: node i goes to left[i] where normal @ v < cut, else to right[i]; leaves are ~number."""

    def __init__(self, normals: np.ndarray, cuts: np.ndarray, left: np.ndarray, right: np.ndarray, leaves: int):
        self.normals, self.cuts, self.left, self.right, self.leaves = normals, cuts, left, right, leaves


def fit_tree(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals, cuts, left, right, leaves = [], [], [], [], 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, slot = todo.pop()
        node, split = None, None
        if len(rows) > leaf:
            for _ in range(8):
                normal = rng.normal(size=sample.shape[1])
                normal /= max(np.linalg.norm(normal), 1e-300)
                p = sample[rows] @ normal
                cut = np.median(p)
                side = p >= cut
                if 0 < side.sum() < len(rows):
                    split = (normal, cut, side)
                    break
        if split is None:
            node, leaves = ~leaves, leaves + 1
        else:
            node = len(cuts)
            normals.append(split[0])
            cuts.append(split[1])
            left.append(0)
            right.append(0)
            todo += [(rows[~split[2]], (left, node)), (rows[split[2]], (right, node))]
        if slot is not None:
            slot[0][slot[1]] = node
    return Tree(np.array(normals).reshape(len(cuts), sample.shape[1]), np.array(cuts), np.array(left, np.int64), np.array(right, np.int64), leaves)


def fit_forest(sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = 7) -> list[Tree]:
    rng = np.random.default_rng(seed)
    return [fit_tree(sample, leaf, rng) for _ in range(trees)]


def home_leaves(forest: list[Tree], v: np.ndarray) -> np.ndarray:
    """The leaf of each vector in each tree."""
    out = np.empty((len(v), len(forest)), np.int64)
    for t, tree in enumerate(forest):
        at = np.zeros(len(v), np.int64) if len(tree.cuts) else np.full(len(v), -1)
        live = np.flatnonzero(at >= 0)
        while len(live):
            node = at[live]
            right = np.einsum("ij,ij->i", v[live], tree.normals[node]) >= tree.cuts[node]
            at[live] = np.where(right, tree.right[node], tree.left[node])
            live = live[at[live] >= 0]
        out[:, t] = ~at
    return out


def search_leaves(forest: list[Tree], v: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """The trees and leaves that each vector visits, in order; -1 where there are no more.

    One queue for all trees and, side by side, for all vectors: it holds branches with the largest margin on the
    way to them; the branch with the smallest is taken and descended, its siblings are queued.
    """
    n, trees = len(v), len(forest)
    depth = 4 + max(int(np.ceil(np.log2(max(2, t.leaves)))) for t in forest) * 2
    room = trees + visits * depth
    margin = np.full((n, room), np.inf)
    branch = np.zeros((n, room), np.int64)
    owner = np.zeros((n, room), np.int64)
    margin[:, :trees] = 0.0
    owner[:, :trees] = np.arange(trees)
    branch[:, :trees] = [0 if len(t.cuts) else -1 for t in forest]
    used = np.full(n, trees)
    got_tree, got_leaf = np.full((n, visits), -1), np.full((n, visits), -1)
    # All trees' nodes in one array, so that vectors in different trees step together.
    base = np.r_[0, np.cumsum([len(t.cuts) for t in forest])]
    normals = np.concatenate([t.normals for t in forest])
    cuts = np.concatenate([t.cuts for t in forest])
    left = np.concatenate([t.left for t in forest])
    right = np.concatenate([t.right for t in forest])
    every = np.arange(n)
    for k in range(visits):
        best = margin.argmin(axis=1)
        low = margin[every, best]
        margin[every, best] = np.inf
        node, tree = branch[every, best], owner[every, best]
        valid = np.isfinite(low)
        live = every[valid & (node >= 0)]
        while len(live):
            i = base[tree[live]] + node[live]
            d = np.einsum("ij,ij->i", v[live], normals[i]) - cuts[i]
            goes = d >= 0
            other = np.where(goes, left[i], right[i])
            slot = np.minimum(used[live], room - 1)
            margin[live, slot] = np.maximum(low[live], np.abs(d))
            branch[live, slot] = other
            owner[live, slot] = tree[live]
            used[live] = slot + 1
            node[live] = np.where(goes, right[i], left[i])
            live = live[node[live] >= 0]
        got_tree[valid, k] = tree[valid]
        got_leaf[valid, k] = ~node[valid]
    return got_tree, got_leaf


def rank(q: np.ndarray, q_ids: np.ndarray, m: np.ndarray, m_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact squared distances and ids of the k nearest members of each query; inf and -1 where there are fewer."""
    order = np.argsort(m_ids, kind="stable")
    m, m_ids = m[order], m_ids[order]
    n, size = len(q), len(m)
    dist, near = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    if not size:
        return dist, near
    step = max(1, 400_000 // size)
    take = min(k, size)
    for a in range(0, n, step):
        part = q[a : a + step]
        d = np.zeros((len(part), size))
        for c in range(m.shape[1]):
            x = part[:, c, None] - m[None, :, c]
            d += x * x
        d[q_ids[a : a + step, None] == m_ids[None, :]] = np.inf
        top = np.argpartition(d, take - 1, axis=1)[:, :take]
        worst = np.take_along_axis(d, top, 1).max(axis=1)
        tied = np.flatnonzero((d <= worst[:, None]).sum(axis=1) > take)
        for i in tied:  # members are in order of id, so a stable order decides ties
            top[i] = np.argsort(d[i], kind="stable")[:take]
        dd = np.take_along_axis(d, top, 1)
        ids = m_ids[top]
        o = np.lexsort((ids, dd), axis=1)
        dist[a : a + step, :take] = np.take_along_axis(dd, o, 1)
        near[a : a + step, :take] = np.take_along_axis(ids, o, 1)
    near[~np.isfinite(dist)] = -1
    return dist, near


def combine(dist: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's candidates, each id once."""
    o = np.lexsort((near, dist), axis=1)
    dist, near = np.take_along_axis(dist, o, 1), np.take_along_axis(near, o, 1)
    again = np.zeros(dist.shape, bool)
    again[:, 1:] = (near[:, 1:] == near[:, :-1]) & (near[:, 1:] >= 0)
    dist = np.where(again, np.inf, dist)
    o = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(dist, o, 1), np.take_along_axis(near, o, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _router(forest: list[Tree], visits: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            step = max(64, 32_768 // visits)
            for at in range(0, big.num_rows, step):
                batch = big.slice(at, step)
                v = _matrix(batch.column(1))
                homes = home_leaves(forest, v)
                trees, leaves = search_leaves(forest, v, visits)
                n = len(v)
                row = np.r_[np.repeat(np.arange(n), len(forest)), np.repeat(np.arange(n), visits)]
                tree = np.r_[np.tile(np.arange(len(forest)), n), trees.ravel()]
                leaf = np.r_[homes.ravel(), leaves.ravel()]
                asks = np.r_[np.zeros(n * len(forest), bool), np.ones(n * visits, bool)]
                ok = leaf >= 0
                if len(batch.schema.names) > 2:
                    wanted = batch.column(2).to_numpy(zero_copy_only=False)
                    ok &= ~asks | wanted[row]
                row, tree, leaf, asks = row[ok], tree[ok], leaf[ok], asks[ok]
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(tree * 2**40 + leaf), pa.array(asks), batch.column(0).take(pick), batch.column(1).take(pick)], ["leaf", "asks", "id", "vec"])

    return route


def visits_for(sample: np.ndarray, forest: list[Tree], k: int, target: float = TARGET) -> int:
    """The fewest leaves (doubling) that hold the target share of the k nearest vectors of some of the sample."""
    n = len(sample)
    every = sum(t.leaves for t in forest)
    if n <= k or every <= VISITS:
        return VISITS
    probes = sample[:: max(1, n // PROBES)][:PROBES]
    ids = np.arange(n)
    _, true = rank(probes, ids[:: max(1, n // PROBES)][:PROBES], sample, ids, k)
    homes = home_leaves(forest, sample)
    visits = VISITS
    while visits < every:
        trees, leaves = search_leaves(forest, probes, visits)
        # A true neighbour is met where a visited leaf is its home in that tree.
        met = np.zeros(true.shape, bool)
        for v in range(visits):
            ok = trees[:, v] >= 0
            met[ok] |= homes[true[ok], trees[ok, v][:, None]] == leaves[ok, v][:, None]
        if met[true >= 0].mean() >= target:
            break
        visits *= 2
    return min(visits, every)


def _runs(leaf: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, len(leaf)]


def _searcher(k: int):
    """Ranks the members of a leaf for its queries; rows come sorted by leaf, one leaf is held at a time."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            v, ids, asks = _matrix(t.column("vec")), t.column("id").to_numpy(), t.column("asks").to_numpy()
            d, i = rank(v[asks], ids[asks], v[~asks], ids[~asks], k)
            n = len(d)
            row, col = np.nonzero(i >= 0)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))].astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(d[row, col]), pa.array(i[row, col])], ["d", "id"])
            return pa.RecordBatch.from_arrays([pa.array(ids[asks]), pa.ListArray.from_arrays(offsets, pairs)], ["id", "near"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column(0).to_numpy()
            cuts = _runs(leaf)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and leaf[a] != last:
                    yield answer(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = leaf[a]
        if held:
            yield answer(held)

    return search


def _members(forest: list[Tree]):
    """leaf and n: how many vectors of a batch have their home there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                homes = home_leaves(forest, _matrix(batch.column(0))) + np.arange(len(forest)) * 2**40
                leaf, n = np.unique(homes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], ["leaf", "n"])

    return count


def _fit_leaf(rows):
    """The tree of one crowded leaf, from the sample of its members."""
    import pandas as pd

    v = np.stack(rows["vec"].to_numpy())[: 2 * LEAF_SAMPLE]
    size = max(LEAST_SAMPLE, int(LEAF * len(v) / max(1, rows["n"].iloc[0])))
    t = fit_tree(v, size, np.random.default_rng(int(rows["leaf"].iloc[0]) % 2**32))
    return pd.DataFrame({"leaf": rows["leaf"].iloc[:1].to_numpy(), "tree": [pickle.dumps(t)]})


def _split_leaves(share: float):
    """Streams the rows of crowded leaves along their trees; a leaf's tree comes before its rows. Queries visit a share
    of its leaves, SPLIT_VISITS at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for big in batches:
            cuts = _runs(big.column(0).to_numpy())
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = big.slice(a, b - a)
                packed = part.column(4)
                if packed[0].is_valid:
                    tree = pickle.loads(packed[0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                v, asks = _matrix(part.column(3)), part.column(1).to_numpy(zero_copy_only=False)
                rows, leaves = [np.flatnonzero(~asks)], [home_leaves([tree], v[~asks])[:, 0]]
                if asks.any():
                    _, found = search_leaves([tree], v[asks], min(max(SPLIT_VISITS, int(share * tree.leaves) + 1), tree.leaves))
                    at, col = np.nonzero(found >= 0)
                    rows.append(np.flatnonzero(asks)[at])
                    leaves.append(found[at, col])
                row, leaf = np.concatenate(rows), np.concatenate(leaves).astype(np.uint64)
                key = part.column(0).to_numpy()[row].view(np.uint64)
                key = (key ^ (leaf + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(31)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[part.column(c).take(pick) for c in (1, 2, 3)]], ["leaf", "asks", "id", "vec"])

    return work


ROUTED = "leaf long, asks boolean, id long, vec array<double>"


def _uncrowded(routed: DataFrame, crowded: DataFrame, share: float) -> DataFrame:
    """routed with the rows of crowded leaves (leaf, n) put into leaves of their own trees."""
    crowded = F.broadcast(crowded)  # leaves of trees of bounded samples, counted to be few
    taken = F.least(F.lit(1.0), LEAF_SAMPLE / F.col("n"))
    sample = routed.where("not asks").join(crowded, "leaf").where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < taken * 1_000_000)
    trees = sample.select("leaf", "n", "vec").groupBy("leaf").applyInPandas(_fit_leaf, "leaf long, tree binary")
    rows = routed.join(crowded.select("leaf"), "leaf", "left_semi").select("leaf", "asks", "id", "vec", F.lit(None).cast("binary").alias("tree"))
    heads = trees.select("leaf", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("vec"), "tree")
    both = rows.unionByName(heads).repartition("leaf").sortWithinPartitions("leaf", F.col("tree").isNull())
    return routed.join(crowded.select("leaf"), "leaf", "left_anti").select("leaf", "asks", "id", "vec").unionByName(both.mapInArrow(_split_leaves(share), ROUTED))


def vectors_of(points: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, vec) with whole finite vectors; repeated rows of one id count once."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return points.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0").where(~bad).dropDuplicates(["id"])


def _all_pairs(queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """id and near: the k nearest members of every query, by comparing blocks of queries with all of them."""
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = checkpoint(queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    out = None
    for i in range(blocks):
        block = queries.where(F.col("block") == i).select("id", "vec").toArrow()  # about BLOCK vectors
        if not block.num_rows:
            continue
        sent = queries.sparkSession.sparkContext.broadcast((block.column("id").to_numpy(), _matrix(block.column("vec"))))

        def compare(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                d, i = rank(q, ids, _matrix(batch.column(1)), batch.column(0).to_numpy(), k)
                row, col = np.nonzero(i >= 0)
                offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(q)))].astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array(d[row, col]), pa.array(i[row, col])], ["d", "id"])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pairs)], ["id", "near"])

        part = members.select("id", "vec").mapInArrow(compare, "id long, near array<struct<d:double,id:long>>")
        out = part if out is None else out.unionByName(part)
    return members.where("false").select("id", F.lit(None).cast("array<struct<d:double,id:long>>").alias("near")) if out is None else out


def nearest(
    points: DataFrame, k: int = 4, ident: str = "id", vector: str = "vec", every: int | None = None, trees: int = TREES, visits: int | None = None, target: float = TARGET, exact: bool = False
) -> DataFrame:
    """(id, neighbour, distance) of the k nearest others of every vector, or of the queries id % every = 0.

    trees, visits: of the forest and of each query in it; without visits as many leaves as meet the share target of the
    nearest vectors within the sample, which differs by dimension. exact: all vectors are compared.
    """
    p = checkpoint(vectors_of(points, ident, vector))
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1)
    reps = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    reps = checkpoint(reps.select(F.col("ids")[0].alias("id"), "vec", "ids"))
    if exact:
        wanted = reps.where(F.exists("ids", lambda i: i % every == 0)) if every else reps
        return _by_id(p, reps, _all_pairs(wanted.select("id", "vec"), reps, k), k, every)
    n = reps.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = reps.where(F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(1_000_000)) < share * 1_000_000).select("vec").limit(SAMPLE * 2).toArrow()
    v = _matrix(sample.column("vec"))
    if not len(v):
        v = np.zeros((1, 1))
    leaf = max(LEAST_SAMPLE, int(LEAF * len(v) / max(1, n)))
    forest = fit_forest(v, leaf, trees)
    visits = visits or visits_for(v, forest, k, target)
    asking = [F.exists("ids", lambda i: i % every == 0).alias("wanted")] if every else []
    routed = reps.select("id", "vec", *asking).mapInArrow(_router(forest, visits), ROUTED)
    members = reps.select("vec").mapInArrow(_members(forest), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    crowded = checkpoint(members.where(F.col("n") > CROWDED))
    for _ in range(LEVELS):
        if crowded.isEmpty():
            break
        # One tree takes twice the share of leaves that a forest does.
        routed = checkpoint(_uncrowded(routed, crowded, 2 * visits / sum(t.leaves for t in forest)))
        crowded = checkpoint(routed.where("not asks").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED))
    routed = routed.repartition("leaf").sortWithinPartitions("leaf")
    found = routed.mapInArrow(_searcher(k), "id long, near array<struct<d:double,id:long>>")
    return _by_id(p, reps, found, k, every)


def _by_id(p: DataFrame, reps: DataFrame, found: DataFrame, k: int, every: int | None) -> DataFrame:
    """From what was found for distinct vectors to the neighbours of every id."""
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    # From vectors back to ids: the copies of a vector itself come first.
    own = reps.select("id", "ids")
    others = best.select("id", F.explode("near").alias("c")).select("id", F.col("c.d").alias("d"), F.col("c.id").alias("other"))
    others = others.join(own.select(F.col("id").alias("other"), F.col("ids").alias("other_ids")), "other")
    others = others.groupBy("id").agg(F.flatten(F.collect_list(F.transform("other_ids", lambda i: F.struct("d", i.alias("id"))))).alias("near"))
    each = own.join(others, "id", "left").select(F.explode("ids").alias("me"), "ids", "near")
    copies = F.transform(F.filter("ids", lambda i: i != F.col("me")), lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id")))
    ranked = F.slice(F.array_sort(F.concat(copies, F.coalesce("near", F.array().cast("array<struct<d:double,id:long>>")))), 1, k)
    out = each.select(F.col("me").alias("id"), F.explode(ranked).alias("c")).select("id", F.col("c.id").alias("neighbour"), F.sqrt("c.d").alias("distance"))
    crowded = reps.where(F.size("ids") > k).select("vec", F.slice("ids", 1, k).alias("firsts"), F.col("ids")[k].alias("last"))
    rest = p.join(fitting(crowded, 100_000), "vec").where(F.col("id") > F.col("last")).select("id", F.explode("firsts").alias("neighbour"), F.lit(0.0).alias("distance"))
    out = out.unionByName(rest)
    return out.where(F.col("id") % every == 0) if every else out


def pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first, of which one is a neighbour of the other."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def recall(found: DataFrame, points: DataFrame, k: int = 4, ident: str = "id", vector: str = "vec", every: int = 50) -> float:
    """The share of the true neighbours of the queries id % every = 0 that found (from nearest) holds."""
    true = nearest(points, k, ident, vector, every, exact=True).select("id", "neighbour")
    total = true.count()
    return true.join(found.select("id", "neighbour"), ["id", "neighbour"], "left_semi").count() / total if total else 1.0
