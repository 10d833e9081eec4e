"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; a shingle is ``n`` consecutive
words (a text of fewer words is one shingle of all). Its weight is tf * (1 + gain * idf). idf is 0 for a shingle in
every document and 1 for one in at most ``RARE`` of them, by the logarithm of its share of documents in between. Only
shares above ``RARE`` matter, and at most (shingles a document) / ``RARE`` shingles have one at any size of the corpus,
so shares are counted over all documents in a fixed number of cells (the mean of the cells, which is what rare
shingles add to each, is taken off): weights do not change as the same corpus grows. Exact copies collapse first.

1. Each text draws ``bands * rows`` samples (shingle, level) by improved consistent weighted sampling; two texts
   agree on a sample with the probability of their weighted Jaccard similarity. The method's gamma and uniform
   variables come from seeded tables of 65,536 entries, looked up by shingle hash.
2. Texts that agree on all rows of a band share a bucket. Buckets of up to ``SMALL`` texts give all their pairs, a
   larger one each member's pairs with ``LEADERS`` members: these only make classes early (see 4).
3. Pairs whose samples agree too rarely for the threshold are dropped (at 4 standard deviations). The others are
   verified by exact weighted Jaccard on whole texts: each text's best pair first, then all pairs that still join
   different classes, then in each large bucket every member with the member that agrees most with the others (the
   original of many edited copies is like each of them, where two copies may not be like each other).
4. Then every pair of a large bucket that is still in different classes is compared: the bucket is cut into blocks
   of about ``BLOCK_ROWS`` texts, and each pair of blocks drops pairs by the rule of 3 and verifies the rest at once,
   without a row for a pair. Two blocks of one class are not compared, so a group of copies costs what its
   outsiders cost.
5. Classes are the connected components of verified links, by label propagation on DataFrames.

Classes are written as one row a document, never as pairs. Cases: null texts and texts without a word are classes of
their own; equal texts are one class; the class id is the least doc_id in it (null only if all are). Empty tables
give no rows. Extra columns pass through ``keep_one``; clashing names are renamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

N = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
CELLS = 1 << 18
CHUNK = 1 << 12
SLOTS = 1 << 16
GAIN = 0.25
RARE = 1 / 1024
SMALL, LEADERS = 16, 2
#: Blocks of large buckets: texts and bytes; texts and shingles of a piece that is compared at once.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 22
PIECE, UNITS = 128, 1 << 13
#: Bits of the broadcast bitmap of nodes (8 MB), and of one of its rows (what Spark's bitmap functions fix).
BITS, BITS_ROW = 1 << 26, 1 << 15


def shingles(data: np.ndarray, offs: np.ndarray, n: int = N):
    """(document, shingle hash, count), sorted by document and hash."""
    data = flat.LOWER[data]
    starts, ends, doc = flat.words(data, offs, flat.ALNUM)
    code = flat.span_hash(flat.prefix(data), starts, ends)
    many = flat.per_doc(doc, len(offs) - 1).astype(np.int64)
    h = flat.gram_hash(code, n)
    at = np.flatnonzero(doc[: len(h)] == doc[n - 1 : n - 1 + len(h)])
    docs, codes = [doc[at]], [h[at]]
    first = np.searchsorted(doc, np.arange(len(many)))
    for size in range(1, n):
        short = np.flatnonzero(many == size)
        if len(short):
            docs.append(short)
            codes.append(flat.gram_hash(code, size)[first[short]])
    doc, h = np.concatenate(docs), np.concatenate(codes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def document_frequencies(docs: DataFrame, text: str, n: int = N):
    """(number of documents, cells of document frequencies): counts of all documents, one array a task, summed in
    two steps by cell range."""

    def count(batches):
        cells, rows = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for _, data, offs in flat.text_blocks(batch.column(0)):
                _, h, _ = shingles(data, offs, n)
                cells += np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=CELLS)
                rows += len(offs) - 1
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() % 64
        parts = [cells[lo : lo + CHUNK].tobytes() for lo in range(0, CELLS, CHUNK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int64()), pa.array([task] * len(parts), pa.int64()), pa.array([rows] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
            names=["chunk", "task", "n", "cells"],
        )

    def total(table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(c.as_py(), np.int64) for c in table["cells"])
        row = [table["chunk"][0].as_py(), 0, sum(table["n"].to_pylist()), cells.tobytes()]
        return pa.table([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "task", "n", "cells"])

    schema = "chunk long, task long, n long, cells binary"
    parts = docs.select(text).mapInArrow(count, schema)
    parts = parts.groupBy("chunk", "task").applyInArrow(total, schema).groupBy("chunk").applyInArrow(total, schema)
    rows = parts.orderBy("chunk").collect()
    if not rows:
        return 0, np.zeros(CELLS, np.int64)
    return rows[0].n, np.concatenate([np.frombuffer(r.cells, np.int64) for r in rows])


def weight_table(n: int, cells: np.ndarray, gain: float = GAIN) -> np.ndarray:
    """Weight of a shingle by cell: 1 (in every document) to 1 + gain (in at most RARE of them, or in one)."""
    rare = min(max(RARE, 1.0 / max(1, n)), 0.5)
    share = np.clip((cells - cells.sum() / len(cells)) / max(1, n), rare, 1.0)
    return 1.0 + gain * np.log(share) / np.log(rare)


class Sampler:
    """The method's random tables follow from the seed, so only the weights travel to the executors."""

    def __init__(self, table: np.ndarray, samples: int = BANDS * ROWS, seed: int = 5):
        self.table, self.samples, self.seed, self.odd = table.astype(np.float32), samples, seed, None

    def prepare(self) -> None:
        if self.odd is None:
            rng = np.random.default_rng(self.seed)
            self.odd = rng.integers(0, 1 << 63, self.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            self.r = rng.gamma(2, 1, (self.samples, SLOTS))
            self.log_c = np.log(rng.gamma(2, 1, (self.samples, SLOTS)))
            self.beta = rng.random((self.samples, SLOTS))

    def weights(self, h, count):
        return self.table[(h >> np.uint64(46)).astype(np.int64)].astype(float) * count

    def draw(self, data, offs, n: int = N):
        """Samples (documents x samples) and whether a document has any shingle."""
        self.prepare()
        doc, h, count = shingles(data, offs, n)
        docs = len(offs) - 1
        out = np.zeros((docs, len(self.odd)), np.int64)
        if not len(h):
            return out, np.zeros(docs, bool)
        own, first, many = np.unique(doc, return_index=True, return_counts=True)
        log_w = np.log(self.weights(h, count))
        for k, odd in enumerate(self.odd):
            slot = ((h * odd) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[k][slot], self.beta[k][slot]
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[k][slot] - r * (t - beta + 1)
            least = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, first), many))
            least = least[np.searchsorted(least, first)]  # ties: the least hash
            out[own, k] = flat.mix(h[least] ^ (t[least].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
        some = np.zeros(docs, bool)
        some[own] = True
        return out, some


def similarities(sampler: Sampler, a, b, n: int = N) -> np.ndarray:
    """Weighted Jaccard of rows of two blocks (bytes, offsets) of equal length."""
    rows = len(a[1]) - 1
    parts = [shingles(*x, n) for x in (a, b)]
    weights = [sampler.weights(h, c) for _, h, c in parts]
    total = sum(np.bincount(d, w, rows) for (d, _, _), w in zip(parts, weights))
    doc, h, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(weights)
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    both = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), rows)
    return np.divide(both, total - both, out=np.zeros(rows), where=total > both)


def _candidates(texts: DataFrame, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, agree) with a < b: pairs of texts in small buckets and of members of large ones with their leaders, and
    the number of samples they agree on; and the members (key, band, node) of large buckets."""
    band = lambda k: F.xxhash64(F.lit(k), *[F.get("sig", F.lit(k * rows + i)) for i in range(rows)])
    member = texts.select("node", F.posexplode(F.array(*[band(k) for k in range(bands)])).alias("band", "key"))
    # A text that leads in one band leads in most, so that few different pairs arise.
    sizes = member.groupBy("key").agg(
        F.count("*").alias("n"),
        F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "node"))["node"] for j in range(LEADERS)])).alias("leaders"),
    ).filter("n > 1")
    held = flat.saved(member.join(sizes, "key").select("key", "band", "node", "n", "leaders"))
    small = held.filter(F.col("n") <= SMALL).select("key", "node")
    large = held.filter(F.col("n") > SMALL)
    star = large.select("node", F.explode("leaders").alias("other")).filter("node != other")
    pairs = small.join(small.withColumnRenamed("node", "other"), "key").filter("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    pairs = pairs.unionByName(star.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
    left = texts.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    right = texts.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.distinct().join(left, "a").join(right, "b").select("a", "b", agree.alias("agree")), large.select("key", "band", "node")


def _likely(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose node is in ``nodes``, and a few others: nodes are marked in a bitmap of ``BITS`` bits, which is
    broadcast and never grows; the more nodes, the more other rows pass (an exact join must follow)."""
    place = F.pmod(F.col("node.k1"), F.lit(BITS))
    row, bit = (place / BITS_ROW).cast("int"), place % BITS_ROW
    bits = nodes.select(row.alias("row"), bit.alias("bit")).repartition("row").groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substr(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
    placed = keyed.withColumn("row", row).withColumn("bit", bit).join(F.broadcast(bits), "row")
    return placed.filter(marked).select(*keyed.columns)


def _verified(pairs: DataFrame, keyed: DataFrame, sampler, similarity: float, n: int) -> DataFrame:
    """Of (a, b) those whose texts reach the similarity. Only texts in some pair move."""
    nodes = flat.saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    texts = flat.saved(_likely(keyed, nodes).join(nodes, "node").groupBy("node").agg(F.first("t").alias("t")))
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches):
        s = sampler.value
        for batch in batches:
            at = 0
            while at < len(batch):  # few pairs at a time: both sides must fit a block
                left = next(flat.text_blocks(batch.column(2).slice(at)))
                rows = len(left[2]) - 1
                right = next(flat.text_blocks(batch.column(3).slice(at, rows)))
                rows = min(rows, len(right[2]) - 1)
                cut = [(x[1][: x[2][rows]], x[2][: rows + 1]) for x in (left, right)]
                keep = pa.array(similarities(s, *cut, n) >= similarity - 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, rows).filter(keep) for k in (0, 1)], names=["a", "b"])
                at += rows

    return both.select("a", "b", "ta", "tb").mapInArrow(run, T.StructType([both.schema["a"], both.schema["b"]]))


def _outsiders(crowded: DataFrame, texts: DataFrame, keyed: DataFrame, roots: DataFrame, sampler, similarity: float, n: int, least: float, rows: int) -> DataFrame:
    """Verified links (a, b) between different classes of ``roots`` in the large buckets, from all their pairs; of the
    links of two blocks only those that join classes anew."""
    held = crowded.join(texts.select("node", "bytes"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = flat.saved(held)
    parts = F.ceil(F.greatest(F.sum("n") / BLOCK_ROWS, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    # A class beyond a block has blocks of its own; the other classes of a bucket share lot 0.
    sizes = held.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    own = (F.col("n") > BLOCK_ROWS) | (F.col("bytes") > BLOCK_BYTES)
    sizes = flat.saved(sizes.withColumn("lot", F.when(own, F.xxhash64("root")).otherwise(F.lit(0))))
    lots = sizes.groupBy("key", "lot").agg(parts.alias("parts"), F.count("*").alias("classes"))
    mixed = lots.groupBy("key").agg(F.sum("classes").alias("all")).filter(F.col("all") > 1).select("key")
    lots = flat.saved(lots.join(mixed, "key"))
    blocks = lots.select("key", "lot", F.explode(F.sequence(F.lit(0), F.greatest("parts", F.lit(1)) - 1)).alias("i"))
    blocks = blocks.select("key", "lot", F.xxhash64("lot", "i").alias("block"))
    others = blocks.select("key", F.col("lot").alias("lot2"), F.col("block").alias("block2"))
    faced = blocks.join(others, "key").filter((F.col("block") <= F.col("block2")) & ((F.col("lot") != F.col("lot2")) | (F.col("lot") == 0)))
    faced = faced.select("key", F.col("block").alias("p"), F.col("block2").alias("q"))
    faced = faced.withColumn("block", F.explode(F.array_distinct(F.array("p", "q"))))
    placed = held.join(sizes.select("key", "root", "lot"), ["key", "root"]).join(lots.select("key", "lot", "parts"), ["key", "lot"])
    place = F.pmod(F.xxhash64("node", F.lit(11)), F.greatest("parts", F.lit(1))).cast("int")
    dealt = flat.saved(placed.withColumn("block", F.xxhash64("lot", place)).join(faced, ["key", "block"]).select("key", "band", "p", "q", "block", "node", "root"))
    nodes = flat.saved(dealt.select("node").distinct())
    bodies = _likely(keyed, nodes).join(nodes, "node").groupBy("node").agg(F.first("t").alias("t"))
    bodies = flat.saved(bodies.join(texts.select("node", "sig"), "node"))

    def run(table: pa.Table) -> pa.Table:
        found = _across_blocks(sampler.value, table, similarity, n, least, rows)
        own = table["node"].combine_chunks()
        return pa.table([own.take(pa.array(x, pa.int64())) for x in found], names=["a", "b"])

    kind = dealt.schema["node"].dataType
    return dealt.join(bodies, "node").groupBy("key", "p", "q").applyInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _across_blocks(sampler, table: pa.Table, similarity: float, n: int, least: float, rows: int):
    """Row numbers (left, right) of links that join different classes of two blocks (or of one with itself)."""
    many, band = len(table), table["band"][0].as_py()
    sig = np.array(table["sig"].combine_chunks().flatten()).reshape(many, -1)
    root = table["root"].combine_chunks()
    label = np.unique(np.column_stack([np.array(root.field(k)) for k in range(2)]), axis=0, return_inverse=True)[1].ravel()
    block, p, q = np.array(table["block"]), table["p"][0].as_py(), table["q"][0].as_py()
    parts = []
    for lo, data, offs in flat.text_blocks(table["t"].combine_chunks()):
        doc, h, count = shingles(data, offs, n)
        parts.append((doc + lo, h, count))
    doc, h, count = (np.concatenate(x) for x in zip(*parts))
    total = np.bincount(doc, sampler.weights(h, count), many)
    # A shingle that a text holds c times is c units, so that common units add up to the lesser weight.
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, weight = np.repeat(doc, count), np.repeat(sampler.weights(h, np.ones(len(h))), count)
    unit = np.unique(flat.mix(np.repeat(h, count) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)[1]
    shared = np.bincount(unit)[unit] > 1
    doc, unit, weight = doc[shared], unit[shared], weight[shared]
    first = np.searchsorted(doc, np.arange(many + 1))

    def entries(own):
        """(place in own, unit, weight) of the rows ``own``."""
        size = first[own + 1] - first[own]
        at = np.arange(size.sum()) + np.repeat(first[own] - np.cumsum(size) + size, size)
        return np.repeat(np.arange(len(own)), size), unit[at], weight[at]

    def common(left, right):
        """Common weight of each left row with each right row."""
        (d, u, w), (e, v, _) = entries(left), entries(right)
        both = np.intersect1d(u, v)
        out = np.zeros((len(left), len(right)))
        keep, kept = np.isin(u, both), np.isin(v, both)
        d, w, u, e, v = d[keep], w[keep], np.searchsorted(both, u[keep]), e[kept], np.searchsorted(both, v[kept])
        for lo in range(0, len(both), UNITS):
            x, y = np.zeros((len(left), UNITS)), np.zeros((len(right), UNITS))
            here, there = (u >= lo) & (u < lo + UNITS), (v >= lo) & (v < lo + UNITS)
            x[d[here], u[here] - lo] = w[here]
            y[e[there], v[there] - lo] = 1
            out += x @ y.T
        return out

    cut = lambda own: [own[lo : lo + PIECE] for lo in range(0, len(own), PIECE)]
    left, right = cut(np.flatnonzero(block == p)), cut(np.flatnonzero(block == q))
    ends = [], []
    for i, a in enumerate(left):
        for b in right[i if p == q else 0 :]:
            open_ = label[a][:, None] != label[b]
            if not open_.any():
                continue
            agree, earlier = np.zeros(open_.shape, np.int16), np.zeros(open_.shape, bool)
            for k in range(sig.shape[1] // rows):
                same = [sig[a, k * rows + r][:, None] == sig[b, k * rows + r] for r in range(rows)]
                agree += sum(x.astype(np.int16) for x in same)
                if k < band:  # such pairs meet in that band's bucket
                    earlier |= np.logical_and.reduce(same)
            open_ &= (agree >= least) & ~earlier
            x, y = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            if not len(x):
                continue
            a_, b_ = a[x], b[y]
            both = common(a_, b_)
            hit = open_[np.ix_(x, y)] & (both >= (similarity - 1e-12) * (total[a_][:, None] + total[b_] - both))
            while (live := np.argwhere(hit & (label[a_][:, None] != label[b_]))).size:
                u, v = a_[live[0][0]], b_[live[0][1]]
                ends[0].append(u)
                ends[1].append(v)
                label[label == label[v]] = label[u]
    return ends


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the least node of its component.

    Each round takes the least label among a node and its neighbours and then the label of that label; the edges
    stay, labels are checkpointed, and only a count of changes reaches the driver."""
    edges = flat.saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = flat.saved(edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(label, edges["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        label = flat.saved(step.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")))
        if label.filter("root != old").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")


def node_of(text: Column) -> Column:
    return F.struct(*flat.text_key(text))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS):
    """(texts, roots): one row of each text (node, keeper, copies: least id and number of its documents), and the
    component of every text with a link."""
    spark = docs.sparkSession
    keyed = docs.select(node_of(F.col(text)).alias("node"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sampler = spark.sparkContext.broadcast(Sampler(weight_table(*document_frequencies(keyed, "t", n)), bands * rows))

    def kernel():
        s = sampler.value

        def work(data, offs):
            drawn, some = s.draw(data, offs, n)
            return [flat.lists(pa.array(drawn.ravel()), np.full(len(drawn), drawn.shape[1])), pa.array(some), pa.array(np.diff(offs), pa.int64())]

        return work

    fields = [T.StructField("sig", T.ArrayType(T.LongType())), T.StructField("some", T.BooleanType()), T.StructField("bytes", T.LongType())]
    signed = flat.map_texts(keyed, "t", fields, kernel, ["node", "key"]).filter("some")
    texts = flat.saved(
        signed.groupBy("node").agg(F.min(F.struct(F.col("key").isNull(), F.col("key").alias("key")))["key"].alias("keeper"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    )
    least = max(0.0, bands * rows * similarity - 4 * (bands * rows * similarity * (1 - similarity)) ** 0.5)
    pairs, crowded = _candidates(texts.select("node", "sig"), bands, rows)
    pairs = flat.saved(pairs.filter(F.col("agree") >= F.lit(least)))

    def across(found: DataFrame, tried: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs not tried yet that join different classes."""
        of = lambda side: F.coalesce(F.col(f"r{side}.root"), F.col(side))
        ends = [roots.select(F.col("node").alias(x), F.struct("root").alias(f"r{x}")) for x in "ab"]
        found = found.select("a", "b").join(tried, ["a", "b"], "left_anti")
        return found.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(of("a") != of("b")).select("a", "b")

    both = [pairs.select(F.col(x).alias("node"), "a", "b", "agree") for x in "ab"]
    best = both[0].unionByName(both[1]).groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = flat.saved(_verified(best, keyed, sampler, similarity, n))
    roots, tried = components(links), best
    open_ = flat.saved(across(pairs, best, roots))
    if not open_.isEmpty():
        links = flat.saved(links.unionByName(_verified(open_, keyed, sampler, similarity, n)))
        roots, tried = components(links), best.unionByName(open_)
    # Mean agreement over a text's pairs, shrunk towards the least that counts.
    central = both[0].unionByName(both[1]).groupBy("node").agg(((F.sum("agree") + 2 * least) / (F.count("*") + 2)).alias("mean"), F.sum("agree").alias("sum"), F.count("*").alias("n"))
    central = central.withColumn("plain", F.when(F.col("n") >= 4, F.col("sum") / F.col("n")))
    top = [F.max(F.struct(c, "node"))["node"] for c in ("mean", "plain")]
    hubs = crowded.join(central, "node").groupBy("key").agg(F.array_distinct(F.array(*top)).alias("hubs")).select("key", F.explode("hubs").alias("hub"))
    star = crowded.join(hubs, "key").filter("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    open_ = flat.saved(across(star, tried, roots))
    if not open_.isEmpty():
        links = flat.saved(links.unionByName(_verified(open_, keyed, sampler, similarity, n)))
        roots = components(links)
    more = flat.saved(_outsiders(crowded, texts, keyed, roots, sampler, similarity, n, least, rows))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return texts.select("node", "keeper", "copies"), roots


def class_of(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(node, class_id, class_node, class_size) of every text with words."""
    texts, roots = classes(docs, text, key, **options)
    placed = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("keeper").isNull(), F.col("keeper").alias("keeper"), F.col("node").alias("node")))
    per = placed.groupBy("root").agg(least.alias("k"), F.sum("copies").alias("class_size"))
    return placed.join(per, "root").select("node", F.col("k.keeper").alias("class_id"), F.col("k.node").alias("class_node"), "class_size")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents' own columns, one document of each class (that of the least id); wordless texts all stay."""
    columns = docs.columns
    docs = flat.unclash(docs, ("__node", "__twin", "__row"))
    inner = docs.columns
    found = flat.saved(class_of(docs, text, key, **options))
    keyed = docs.withColumn("__node", node_of(F.col(text)))
    kept = found.filter(F.col("node") == F.col("class_node")).select(F.col("node").alias("__node"), "class_id")
    # Rows that equal the kept one in id and text: counted on narrow rows, dropped only where there are any.
    twins = keyed.groupBy("__node", F.col(key).alias("class_id")).agg(F.count("*").alias("__twin"))
    kept = kept.join(twins.withColumnRenamed("__node", "n2").withColumnRenamed("class_id", "c2"), (F.col("__node") == F.col("n2")) & F.col("class_id").eqNullSafe(F.col("c2"))).drop("n2", "c2")
    mine = keyed.join(found.select(F.col("node").alias("__node")), "__node", "left_anti").select(*[f"`{c}`" for c in inner])
    kept = kept.withColumnRenamed("class_id", "__class")
    chosen = keyed.join(kept, "__node").filter(F.col(key).eqNullSafe(F.col("__class")))
    single = chosen.filter("__twin = 1").select(*[f"`{c}`" for c in inner])
    others = [c for c in inner if c not in (key, text)]
    plain = [f"`{c}`" for c in others if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    mark = F.xxhash64(*plain, F.lit(1))  # of rows equal in id and text the one of the least hash stays whole
    double = chosen.filter("__twin > 1").groupBy("__node", key).agg(F.min(text).alias(text), F.min_by(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0)]), mark).alias("__row")).select(*[F.col("__row")[c].alias(c) if c in others else F.col(f"`{c}`") for c in inner]).select(*[f"`{c}`" for c in inner])
    return single.unionByName(double).unionByName(mine).toDF(*columns)


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = class_of(docs)
    keyed = docs.select("doc_id", node_of(F.col("text")).alias("node"))
    return keyed.join(found, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )
