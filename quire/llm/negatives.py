"""Hard negatives: product quantisation with stored residual norms, rigorous bounds, exact integer rerank.

Components are whole numbers floor(scale * x), so scores (inner products) are exact. A row is coded by its nearest
centroid in each subspace and keeps the norm of what is left there. A table of an anchor's products with all centroids
gives each row's approximate score; by Cauchy-Schwarz the exact one differs from it by no more than the sum over
subspaces of the anchor's norm times the residual's. Rows that these bounds cannot rule out are scored exactly, and only
exact scores are compared, so results are those of a full scan whatever the codes are. An anchor's positives are its best
other rows of its label; for each of them the window of low to high percent of the positive's score is completed with the
best rows of other labels.

Rows lie in coarse cells, a cell in blocks of about ``BLOCK`` rows dealt by row number, so equal vectors or keys never
gather. An anchor visits a cell only if the cell's ball can hold a score that it needs: the least it needs is known from
the fitted sample (the k-th best of a subset is a bound for the whole) and, for negatives, from the positive's score. At
worst each anchor visits every cell: the query set against all rows, in blocks of rows and groups of anchors, two
passes. What is fitted on a bounded sample (cells, centroids) changes cost alone.

Cases: rows without key, label or vector, with a null or non-finite component, with another number of components than
most rows, or with components so large that a product could pass 64 bits take no part. Repeated rows are rows (and anchors) of their own;
ties go to the smaller key. Scores may be negative: a window below zero is empty. Empty tables, tables without an anchor,
anchors without positives give no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import flat

#: Rows in the fitted sample, and numbers in it.
SAMPLE, SAMPLE_NUMBERS = 8192, 1 << 22
#: Dimensions of a subspace and centroids in each.
WIDTH, CENTROIDS = 8, 256
#: Rows of a block, anchors of a group, coarse cells.
BLOCK, GROUP, CELLS = 8192, 4096, 1024
#: Anchors whose bounds are held at once.
CHUNK = 32
#: Numbers of exactly scored vectors held at once.
PAIR_NUMBERS = 1 << 21
_FOUND = "arow long, nth int, score long, id long, row long"
_NONE = {"arow": pa.int64(), "nth": pa.int32(), "score": pa.int64(), "id": pa.int64(), "row": pa.int64()}


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of every row."""
    out, norm = np.empty(len(x), np.int64), (centers * centers).sum(1)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (norm - 2 * (x[lo : lo + 4096] @ centers.T)).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of at most k clusters of the rows; one at 0 if there are no rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centers = x[np.random.default_rng(5).choice(len(x), min(k, len(x)), replace=False)].astype(float)
    for _ in range(rounds):
        at = nearest(x, centers)
        many = np.bincount(at, minlength=len(centers))
        order = np.argsort(at, kind="stable")
        held = np.flatnonzero(many)
        centers[held] = np.add.reduceat(x[order], (np.cumsum(many) - many)[held], 0) / many[held, None]
    return centers


class Codes:
    """The coarse cells and each subspace's centroids."""

    def __init__(self, x: np.ndarray, cells: int):
        x = x.astype(float)
        self.cells = k_means(x, cells)
        self.spans = [slice(lo, min(lo + WIDTH, x.shape[1])) for lo in range(0, x.shape[1], WIDTH)]
        self.centroids = [k_means(x[:, s], CENTROIDS) for s in self.spans]

    def code(self, x: np.ndarray):
        """(cells, distances to their centres, codes, residual norms), the distances and norms rounded up."""
        x = x.astype(float)
        cell = nearest(x, self.cells)
        codes = np.stack([nearest(x[:, s], c) for s, c in zip(self.spans, self.centroids)], 1).astype(np.uint8)
        left = np.stack([np.linalg.norm(x[:, s] - c[codes[:, k]], axis=1) for k, (s, c) in enumerate(zip(self.spans, self.centroids))], 1)
        return cell, np.linalg.norm(x - self.cells[cell], axis=1) * (1 + 1e-9), codes, np.nextafter((left * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))

    def bounds(self, q: np.ndarray, codes: np.ndarray, left: np.ndarray, longest: float):
        """(least, greatest) possible score of every anchor and row."""
        q = q.astype(float)
        score, slack = np.zeros((len(q), len(codes))), np.zeros((len(q), len(codes)))
        for k, (s, c) in enumerate(zip(self.spans, self.centroids)):
            score += (q[:, s] @ c.T)[:, codes[:, k]]
            slack += np.linalg.norm(q[:, s], axis=1)[:, None] * left[:, k]
        slack += 1e-9 * (1 + np.linalg.norm(q, axis=1)[:, None] * longest)  # of the sums in double precision
        return score - slack, score + slack

    def reach(self, q: np.ndarray, radius: np.ndarray):
        """(least, greatest) possible score of every anchor in every cell; a cell without rows has radius -1."""
        q = q.astype(float)
        middle, size = q @ self.cells.T, np.linalg.norm(q, axis=1)[:, None]
        slack = size * radius + 1e-9 * (1 + size * (np.linalg.norm(self.cells, axis=1) + radius))
        return np.where(radius < 0, np.inf, middle - slack), np.where(radius < 0, -np.inf, middle + slack)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in pairs, in whole numbers."""
    return np.einsum("ij,ij->i", q, x)


def kth(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest masked value of each row; -inf where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return -np.partition(np.where(mask, -values, np.inf), k - 1, axis=1)[:, k - 1]


def first(score: np.ndarray, ident: np.ndarray, row: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each group ``of``: greatest score, then smallest key."""
    order = np.lexsort((row, ident, -score, of))
    ranked = of[order]
    start = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[nth < k]


def _numbers(column) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def _vectors(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def whole_vectors(rows: DataFrame, key: str, vector: str, label: Column, is_anchor: Column, scale: int) -> tuple[DataFrame, int, int]:
    """(rows that take part as (id, label, v, anchor, row), their number, their dimensions)."""
    v = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    fine = F.forall(F.col(f"`{vector}`").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = rows.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), F.when(fine, v).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    base = base.filter("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0")
    most = F.floor(F.sqrt(F.lit(2.0**63) / F.size("v"))) - 1
    base = base.filter(F.forall("v", lambda x: F.abs(x.cast("double")) <= most))
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return base, 0, 0
    # A number for every row, fixed by being written: keys and vectors may repeat.
    return flat.saved(base.filter(F.size("v") == sizes[0].d).withColumn("row", F.monotonically_increasing_id())), sizes[0]["count"], sizes[0].d


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK, group: int = GROUP, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first ``negatives`` rows of other
    labels for each of the first ``positives`` rows of an anchor's label, that lie in the positive's window."""
    spark = rows.sparkSession
    label = F.col("label") if label is None else label
    base, n, dims = whole_vectors(rows, key, vector, label, is_anchor, scale)
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = max(1, min(sample, SAMPLE_NUMBERS // dims))
    few = base.select("label", "v", "row", F.xxhash64("row", F.lit(3)).alias("h")).orderBy("h", "row").limit(sample).select("label", "v", "row").toArrow()
    seen, seen_label, seen_row = _vectors(few["v"], dims), _numbers(few["label"]), _numbers(few["row"])
    codes = Codes(seen, min(CELLS, max(1, n // block), max(1, len(seen) // 8)))
    sent = spark.sparkContext.broadcast((codes, seen, seen_label, seen_row))  # the sample and its centres, both bounded

    def coded(batches):
        held = sent.value[0]
        for batch in batches:
            if len(batch):
                cell, far, code, left = held.code(_vectors(batch.column(2), dims))
                new = [pa.array(cell.astype(np.int32)), pa.array(far), flat.binary_array(code.ravel(), np.arange(len(code) + 1) * code.shape[1])]
                new.append(flat.lists(pa.array(left.ravel()), np.full(len(left), left.shape[1])))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "cell", "far", "code", "rest"])

    indexed = base.mapInArrow(flat.tidy(coded), "id long, label long, v array<long>, anchor boolean, row long, cell int, far double, code binary, rest array<float>")
    indexed = flat.saved(indexed)
    sizes = indexed.groupBy("cell").agg(F.max("far").alias("far"), F.ceil(F.count("*") / block).cast("int").alias("pieces"))  # at most CELLS rows
    radius = np.full(len(codes.cells), -1.0)
    for r in sizes.select("cell", "far").collect():
        radius[r.cell] = r.far
    index = indexed.join(F.broadcast(sizes.select("cell", "pieces")), "cell")
    index = index.select("cell", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece"), "id", "label", "v", "row", "code", "rest")

    def ask_positives(batches):
        held, some, some_label, some_row = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                q, own, row = _vectors(part.column(2), dims), _numbers(part.column(1)), _numbers(part.column(3))
                known = q @ some.T
                least = kth(known.astype(float), (own[:, None] == some_label) & (row[:, None] != some_row), positives)
                least -= np.abs(least) * 1e-12  # whole numbers beyond 2^53 are rounded here
                _, most = held.reach(q, radius)
                yield _requests(part, most >= least[:, None], [[x] for x in least.tolist()], [[]] * len(part), [[]] * len(part))

    def ask_negatives(batches):
        held, some, some_label, some_row = sent.value
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                q, own = _vectors(part.column(2), dims), _numbers(part.column(1))
                windows = [[(-(-low * p // 100), high * p // 100) for p in scores] for scores in part.column(4).to_pylist()]
                known = (q @ some.T).astype(float)
                other = own[:, None] != some_label
                least, most = held.reach(q, radius)
                visit, needs = np.zeros(most.shape, bool), [[] for _ in windows]
                for j in range(positives):
                    bottom, top = (np.array([w[j][k] if j < len(w) else fill for w in windows], float) for k, fill in ((0, np.inf), (1, -np.inf)))
                    need = np.maximum(bottom, kth(known, other & (known >= bottom[:, None] * (1 + 1e-12)) & (known <= top[:, None] * (1 - 1e-12)), negatives))
                    need -= np.abs(np.where(np.isfinite(need), need, 0)) * 1e-12
                    visit |= (most >= need[:, None]) & (least <= top[:, None] * (1 + 1e-12)) & (bottom <= top)[:, None]
                    for at, w in enumerate(windows):
                        if j < len(w):
                            needs[at].append(float(need[at]))
                yield _requests(part, visit, needs, [[w[0] for w in ws] for ws in windows], [[w[1] for w in ws] for ws in windows])

    def _requests(part, visit, needs, bottoms, tops):
        kinds = [pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        values = [needs, bottoms, tops, [np.flatnonzero(v).tolist() for v in visit]]
        return pa.RecordBatch.from_arrays([*part.columns[:4], *[pa.array(v, k) for v, k in zip(values, kinds)]], names=["id", "label", "v", "row", "needs", "bottoms", "tops", "cells"])

    def best_of_label(asked: pa.Table, found: pa.Table) -> pa.Table:
        return _scan(asked, found, True)

    def best_in_window(asked: pa.Table, found: pa.Table) -> pa.Table:
        return _scan(asked, found, False)

    def _positive_candidates(rows, lower, upper, needs, own):
        fits = (own[0][:, None] == rows["label"]) & (own[1][:, None] != rows["row"])
        need = np.maximum(kth(lower, fits, positives), np.array([x[0] for x in needs]))
        return [(0, *np.nonzero(fits & (upper >= need[:, None])))]

    def _window_candidates(rows, lower, upper, needs, own, bottoms, tops):
        other = own[0][:, None] != rows["label"]
        for j in range(max(map(len, needs))):
            some = np.array([i for i, x in enumerate(needs) if j < len(x)], np.int64)
            bottom, top, need = (np.array([x[i][j] for i in some], float) for x in (bottoms, tops, needs))
            lo, hi, fits = lower[some], upper[some], other[some]
            inside = fits & (lo >= bottom[:, None] * (1 + 1e-12)) & (hi <= top[:, None] * (1 - 1e-12))
            need = np.maximum(need, kth(lo, inside, negatives))
            at, col = np.nonzero(fits & (hi >= need[:, None]) & (lo <= top[:, None] * (1 + 1e-12)))
            yield j, some[at], col

    def _scan(asked: pa.Table, found: pa.Table, positive: bool) -> pa.Table:
        if not len(asked) or not len(found):
            return pa.table({c: pa.array([], t) for c, t in _NONE.items()})
        held = sent.value[0]
        x, rows = _vectors(found["xv"], dims), {c: _numbers(found[f"x{c}"]) for c in ("id", "label", "row")}
        code = np.frombuffer(b"".join(found["xcode"].to_pylist()), np.uint8).reshape(len(x), -1)
        left = _vectors(found["xrest"], code.shape[1]).astype(float)
        longest = float(np.sqrt((x.astype(float) ** 2).sum(1).max()))
        out, most = [], max(1, PAIR_NUMBERS // dims)
        for lo in range(0, len(asked), CHUNK):
            part = asked.slice(lo, CHUNK)
            q, own = _vectors(part["v"], dims), (_numbers(part["label"]), _numbers(part["row"]))
            lower, upper = held.bounds(q, code, left, longest)
            needs, bottoms, tops = (part[c].to_pylist() for c in ("needs", "bottoms", "tops"))
            sets = _positive_candidates(rows, lower, upper, needs, own) if positive else _window_candidates(rows, lower, upper, needs, own, bottoms, tops)
            for j, at, col in sets:
                for a in range(0, len(at), most):
                    i, c = at[a : a + most], col[a : a + most]
                    score = exact(q[i], x[c])
                    if not positive:
                        inside = (score >= np.array([bottoms[k][j] for k in i.tolist()], np.int64)) & (score <= np.array([tops[k][j] for k in i.tolist()], np.int64))
                        i, c, score = i[inside], c[inside], score[inside]
                    best = first(score, rows["id"][c], rows["row"][c], i, positives if positive else negatives)
                    if len(best):
                        out.append((own[1][i[best]], np.full(len(best), j, np.int32), score[best], rows["id"][c[best]], rows["row"][c[best]]))
        if not out:
            return pa.table({c: pa.array([], t) for c, t in _NONE.items()})
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]), t) for k, (c, t) in enumerate(_NONE.items())})

    asked_schema = "id long, label long, v array<long>, row long, needs array<double>, bottoms array<long>, tops array<long>, cells array<int>"

    def visited(requests: DataFrame, scan) -> DataFrame:
        """What ``scan`` finds for every anchor in the blocks of the cells it visits."""
        asked = flat.saved(requests).withColumn("cell", F.explode("cells")).drop("cells")
        groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
        both = F.broadcast(sizes.select("cell", "pieces").join(groups, "cell"))  # at most CELLS rows
        theirs = asked.join(both, "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.col("groups")).cast("int"))
        ours = index.join(F.broadcast(groups), "cell").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        ours = ours.toDF(*[f"x{c}" for c in ours.columns])
        keys = ["cell", "piece", "group"]
        return theirs.drop("groups", "pieces").groupBy(*keys).cogroup(ours.groupBy(*[f"x{c}" for c in keys])).applyInArrow(flat.trimmed(scan), _FOUND)

    anchors = indexed.filter("anchor").select("id", "label", "v", "row")
    by = Window.partitionBy("arow").orderBy(F.desc("score"), "id", "row")
    found = visited(anchors.mapInArrow(ask_positives, asked_schema), best_of_label)
    found = found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= positives)
    held = found.groupBy("arow").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("held"))  # at most ``positives``
    chosen = flat.saved(anchors.join(held, F.col("row") == F.col("arow")).drop("arow"))
    asked = chosen.select("id", "label", "v", "row", F.transform("held", lambda h: h["score"]).alias("scores"))
    windows = Window.partitionBy("arow", "nth").orderBy(F.desc("score"), "id", "row")
    best = visited(asked.mapInArrow(ask_negatives, asked_schema), best_in_window)
    best = best.withColumn("rank", F.row_number().over(windows)).filter(F.col("rank") <= negatives).select("arow", "nth", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = best.join(chosen.select(F.col("row").alias("arow"), F.col("id").alias("anchor_id"), "held"), "arow")
    positive = F.col("held")[F.col("nth")]
    return out.select("anchor_id", positive["id"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), "negative_score")


def relabelled() -> Column:
    """The label; of rows whose vec_id is divisible by 7, the next one of ten."""
    return F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return mine(rows, F.col("vec_id") % 100 == 0, label=relabelled())


ORACLE = """
WITH r AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, a.label AS anchor_label, r.n AS n, r.vec_id, r.label, list_dot_product(a.q, r.q)::BIGINT AS score
  FROM r a JOIN r ON a.n <> r.n WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, anchor_id, anchor_label, n, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN scores s ON s.a = p.a AND s.label <> p.anchor_label AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY rank <= 5
"""
