"""Approximate nearest neighbours by learned partitions.

A sample of at most ``sample`` vectors (smallest by hash; the bound of the fit) gets its exact neighbour graph, which is
cut into balanced parts: recursive halving along principal directions, then moves that gain edges while every part
stays within 10 % of its share. A small classifier (one hidden layer) learns, for each vector, the distribution of its
neighbours' parts. Every row is indexed under its most probable part; a query goes to the most probable parts and is
reranked there by exact distance. How many parts it takes is measured on held-out sample vectors: the least number
that reaches ``aim`` recall on the sample.

The number of parts follows the number of rows (about ``rows_a_part``): up to ``fan`` parts of the sample, and where
those would be larger, as many smaller ones in each, learned by a task of its own from at most ``sample`` vectors of
that part. A leaf's probability is the product of both classifiers; the leaves to probe are measured like the parts.
Beyond ``fan * fan * rows_a_part`` rows (8.4 million) leaves grow with the table. Vectors of a part are dealt into pieces of at most ``piece`` rows, queries of a part into groups of at most ``group``; each pair of them is a
bounded block of work that returns ten rows a query, so a part or a vector that holds a third of all rows is many
blocks. The models are broadcast; their size depends on dimensions and ``fan`` alone (6 MB at 64 dimensions).

Distance is Euclidean in double precision on the original vectors; ties go to the smaller id. Cases: vectors that
are null, empty, zero, of another length than most, or hold null or non-finite components take no part; null ids
neither. Fewer than ten candidates give fewer rows; a query whose parts hold too few is asked again in all parts.
Every row is a query or a candidate of its own, those of a repeated id or vector too: only a query's own row is none
of its candidates. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat

SAMPLE = 8192
ROWS_A_PART = 512
FAN = 128
PIECE, GROUP = 4096, 256
K = 10
AIM = 0.97


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact Euclidean distances, by differences, a few queries at a time."""
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        d = x - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k nearest others of every vector."""
    out, norm = np.empty((len(x), min(k, len(x) - 1)), np.int64), (x * x).sum(1)
    for lo in range(0, len(x), 512):
        d = norm - 2 * (x[lo : lo + 512] @ x.T)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 8) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them."""
    label = np.zeros(len(x), np.int64)

    def halve(at, first, n):
        label[at] = first
        if n == 1 or len(at) < 2:
            return
        c = x[at] - x[at].mean(0)
        v = np.linspace(1, 2, c.shape[1])
        for _ in range(12):
            v = c.T @ (c @ v)
            v /= max(np.linalg.norm(v), 1e-30)
        order = at[np.argsort(c @ v, kind="stable")]
        cut = len(at) * (n // 2) // n
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    share = len(x) / parts
    most, least = int(np.ceil(1.1 * share)), int(np.floor(0.9 * share))
    size = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts), np.int16)
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(len(x)), label[graph[:, j]]), 1)
            np.add.at(votes, (graph[:, j], label), 1)
        to = votes.argmax(1)
        gain = votes[np.arange(len(x)), to] - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[to[i]] < most and size[label[i]] > least:
                size[label[i]] -= 1
                size[to[i]] += 1
                label[i] = to[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer on standardised vectors; trained with Adam on soft labels."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 30, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-12
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
        self.p = [rng.normal(0, (2 / s[0]) ** 0.5, s) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v, step = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        z = (x - self.mean) / self.scale
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                at = order[lo : lo + 256]
                h = np.maximum(z[at] @ self.p[0] + self.p[1], 0)
                d = (self._soft(h @ self.p[2] + self.p[3]) - target[at]) / len(at)
                dh = (d @ self.p[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((z[at].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    rate = 3e-3 * (1 - epoch / epochs) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                    self.p[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)

    @staticmethod
    def _soft(a):
        a = np.exp(a - a.max(1, keepdims=True))
        return a / a.sum(1, keepdims=True)

    def narrowed(self) -> Router:
        """The same in single precision, to be sent around."""
        self.mean, self.scale = self.mean.astype(np.float32), self.scale.astype(np.float32)
        self.p = [a.astype(np.float32) for a in self.p]
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return self._soft(np.maximum(z @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3])


def held_out(x: np.ndarray):
    """The sample without its last eighth, and of that eighth at most 512 vectors to measure recall with."""
    test = max(1, len(x) // 8)
    return x[:-test], x[-test:][:512]


def fit(x: np.ndarray, parts: int, aim: float = AIM, k: int = K, hidden: int = 128):
    """(router, number of parts to probe)."""
    if parts <= 1 or len(x) < 4 * parts:
        return None, 1
    learn, held = held_out(x)
    graph = neighbour_graph(learn, 16)
    label = balanced_parts(learn, graph, parts)
    target = np.zeros((len(learn), parts))
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(learn)), label[graph[:, j]]), 1.0)
    np.add.at(target, (np.arange(len(learn)), label), 2.0)
    router = Router(learn, target / target.sum(1, keepdims=True), hidden)
    place = router.probabilities(learn).argmax(1)
    nearest = np.argsort(distances(held, learn), axis=1, kind="stable")[:, :k]
    rank = np.argsort(np.argsort(-router.probabilities(held), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(rank, place[nearest], 1)
    recall = [(needed < n).mean() for n in range(1, parts + 1)]
    return router, next(n for n, r in enumerate(recall, 1) if r >= aim or n == parts)


class Tree:
    """Parts and, in each, ``subs`` leaves; leaf ``a * subs + b`` is leaf b of part a."""

    def __init__(self, router: Router | None, parts: int, probes: int):
        self.router, self.parts, self.probes, self.subs, self.below = router, parts, probes, 1, {}
        self.leaf_probes = probes

    def leaves(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` best leaves of every vector, best first; -1 where fewer are open. The first is the leaf that
        it is indexed under: the best of its best part."""
        if self.router is None:
            top, p = np.zeros((len(x), 1), np.int64), np.ones((len(x), 1))
        else:
            p = self.router.probabilities(x)
            top = np.argsort(-p, axis=1, kind="stable")[:, : self.probes]
            p = np.take_along_axis(p, top, 1)
        if self.subs == 1:
            return top[:, :most]
        joint = np.full((*top.shape, self.subs), -1.0)
        joint[:, :, 0] = p  # a part whose sample could not be parted is one leaf
        for part in np.unique(top):
            router = self.below.get(int(part))
            if router is not None:
                at, col = np.nonzero(top == part)
                joint[at, col] = p[at, col, None] * router.probabilities(x[at])
        home = joint[:, 0].argmax(1)
        joint[np.arange(len(x)), 0, home] = 2.0
        flat_p = joint.reshape(len(x), -1)
        order = np.argsort(-flat_p, axis=1, kind="stable")[:, :most]
        ids = (top[:, :, None] * self.subs + np.arange(self.subs)).reshape(len(x), -1)
        return np.where(np.take_along_axis(flat_p, order, 1) >= 0, np.take_along_axis(ids, order, 1), -1)

    def measure(self, x: np.ndarray, aim: float, k: int) -> None:
        """Sets the least number of leaves that reaches ``aim`` recall on the held-out part of the sample."""
        learn, held = held_out(x)
        if not len(learn):
            return
        nearest = np.argsort(distances(held, learn), axis=1, kind="stable")[:, :k]
        place, open_ = self.leaves(learn, 1)[:, 0], self.leaves(held, self.probes * self.subs)
        rank = np.full((len(held), self.parts * self.subs + 1), open_.shape[1])
        np.put_along_axis(rank, open_, np.broadcast_to(np.arange(open_.shape[1]), open_.shape), 1)
        needed = np.sort(np.take_along_axis(rank, place[nearest], 1), axis=None)
        needed = needed[needed < open_.shape[1]]  # what the parts themselves miss, more leaves cannot bring
        self.leaf_probes = int(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))]) + 1 if len(needed) else open_.shape[1]


def plant(base: DataFrame, n: int, dims: int, sample: int, aim: float, k: int, rows_a_part: int, fan: int) -> Tree:
    """The tree over rows (id, v, q): its first level from one sample, its second, where the rows need one, from a
    sample of each part, each fitted by a task of its own."""
    spark = base.sparkSession
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit(31)), 1) / F.lit(float(1 << 63))
    picked = base.filter(chance < min(1.0, 1.3 * sample / n + 0.01)).select("v", F.xxhash64("id", "v", F.lit(31)).alias("h")).orderBy("h").limit(sample).select("v").toArrow()
    x = picked["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
    parts = int(min(fan, max(1, n // rows_a_part), max(1, len(x) // 32)))
    router, probes = fit(x, parts, aim, k)
    tree = Tree(router, parts, probes)
    subs = int(min(fan, n // (parts * rows_a_part), sample // 32))
    if tree.router is None or subs < 2:
        return tree
    first = spark.sparkContext.broadcast(tree)

    def parted(batches):
        for batch in batches:
            if len(batch):
                v = batch.column(0).flatten().to_numpy().reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first.value.leaves(v, 1)[:, 0], pa.int64())], names=["v", "h", "part"])

    def below(table: pa.Table) -> pa.Table:
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        router, _ = fit(v, subs, aim, k, 64)
        return pa.table({"part": table["part"][:1].combine_chunks(), "model": pa.array([pickle.dumps(router and router.narrowed())], pa.binary())})

    # A part that holds many rows has many sampled; the limit by hash within the part is applied before the shuffle.
    some = base.filter(chance < min(1.0, 1.3 * sample * parts / n + 0.01)).select("v", F.xxhash64("id", "v", F.lit(37)).alias("h"))
    some = some.mapInArrow(parted, "v array<double>, h long, part long")
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("h"))).filter(F.col("nth") <= sample).select("part", "h", "v")
    models = some.groupBy("part").applyInArrow(below, "part long, model binary").collect()  # at most ``fan`` rows
    tree.subs, tree.below = subs, {r.part: pickle.loads(r.model) for r in models}
    tree.measure(x, aim, k)
    return tree


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, sample: int = SAMPLE, aim: float = AIM, rows_a_part: int = ROWS_A_PART, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` admits."""
    spark = rows.sparkSession
    rows = flat.unclash(rows, ())
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes[0].d, sizes[0]["count"]
    base = base.filter(F.size("v") == dims)
    tree = plant(base, n, dims, sample, aim, k, rows_a_part, fan)
    leaves = tree.parts * tree.subs
    held = spark.sparkContext.broadcast(tree)

    def route(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column(1).flatten().to_numpy().reshape(-1, dims)
            best = [[leaf for leaf in row if leaf >= 0] for row in held.value.leaves(v, held.value.leaf_probes).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.list_(pa.int32()))], names=["id", "v", "q", "row", "parts"])

    # A number for every row, fixed by being written: ids and vectors may repeat.
    routed = base.withColumn("row", F.monotonically_increasing_id()).mapInArrow(route, "id long, v array<double>, q boolean, row long, parts array<int>")
    routed = flat.saved(routed)
    own = routed.select("id", "row", "v", F.col("parts")[0].alias("part"))
    queries = routed.filter("q")
    found = flat.saved(_ranked(own, queries.select("id", "row", "v", F.explode("parts").alias("part")), dims, k))
    if tree.leaf_probes < leaves:
        enough = found.filter(F.col("rank") == min(k, n - 1)).select("row")
        short = flat.saved(queries.join(enough, "row", "left_anti"))
        if not short.isEmpty():
            wide = short.select("id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("part"))
            found = found.join(short.select("row"), "row", "left_anti").unionByName(_ranked(own, wide, dims, k))
    return found.select("query_id", "rank", "vec_id", "score")


def _ranked(own: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, row, rank, vec_id, score): the k nearest of each asked row (id, row, v, part) among the rows of its
    parts, in blocks of at most ``PIECE`` candidates and ``GROUP`` queries."""
    counts = own.groupBy("part").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    groups = asked.groupBy("part").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    sizes = F.broadcast(counts.join(groups, "part"))  # one row a leaf: at most fan * fan
    # Within a part rows are dealt by their numbers, so equal ids or vectors never gather.
    one = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")
    mine = own.join(sizes, "part").select("id", "row", "v", "part", one.alias("piece"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).toDF("xid", "xrow", "xv", "xpart", "xpiece", "xgroup")
    grp = F.pmod(F.xxhash64("row", F.lit(1)), F.col("groups")).cast("int")
    theirs = asked.join(sizes, "part").select("id", "row", "v", "part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), grp.alias("group"))

    def nearest(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not len(queries) or not len(found):
            return pa.table({"query_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = (t.combine_chunks().flatten().to_numpy().reshape(-1, dims) for t in (queries["v"], found["xv"]))
        qid, qrow, xid, xrow = (t.to_numpy() for t in (queries["id"], queries["row"], found["xid"], found["xrow"]))
        ids, far = [], []
        for lo in range(0, len(q), 64):
            d = distances(q[lo : lo + 64], x)
            d[qrow[lo : lo + 64, None] == xrow] = np.inf
            order = np.lexsort((np.broadcast_to(xid, d.shape), d), axis=1)[:, :k]
            far.append(np.take_along_axis(d, order, 1))
            ids.append(xid[order])
        far, ids = np.vstack(far), np.vstack(ids)
        some = np.isfinite(far)
        many = some.sum(1)
        return pa.table({"query_id": pa.array(np.repeat(qid, many)), "row": pa.array(np.repeat(qrow, many)), "vec_id": pa.array(ids[some]), "score": pa.array(far[some])})

    keys = ["part", "piece", "group"]
    pairs = theirs.groupBy(*keys).cogroup(mine.groupBy(*[f"x{c}" for c in keys])).applyInArrow(nearest, "query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "row", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 100 == 0)
