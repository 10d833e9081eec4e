"""Mixing sources to target weights by the cube method of balanced sampling.

Sources in code-point order (null last) get the weights of ``weights``, repeated, and share 100 % of all words.
A target stops at ``cap`` times its source's size; the excess is shared again by weight until none is above
(in closed form: ``min(cap * size, level * weight)``). A document is taken ``target / size`` times: the whole
part is certain, the fraction is its inclusion probability. The flight phase moves the probabilities of a
block of documents through the null space of two constraints, the word total and the document total, until at
most two of them are fractions; those meet the other blocks' in the next round, and what the last block of a
source leaves is the landing problem. Every move keeps each probability's expectation.

Equal rows (of one hash over all columns) are one unit first: c of them with probability p give floor(c * p) certain
ones and one fraction, a move that keeps both totals exactly, so a row that a third of a table repeats is one number.
Blocks are dealt by hash within a source, so a source that holds a third of all rows is many blocks of about
``block`` documents; rounds shrink the rest by ``block / 2`` each. Within a block large documents land first
(each against all smaller ones at once), so only the smallest are left; the last block of a
source is drawn ``LANDINGS`` times and the draw nearest to its expected words stays (rejective sampling).

Sources are few against documents: their table (one row each) is sorted in one task, millions of them fit.
Cases: a null text has size 0 and takes nothing; a null source is a source of its own, the last; sources
without any word have target 0; an empty table gives no rows. Equal rows share what their unit takes as evenly as may be. Draws depend
on content and ``seed`` alone, so reruns agree. Extra columns pass through ``mix``; clashing names are renamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources their table is broadcast (about 40 bytes each); beyond, the join shuffles.
BROADCAST_SOURCES = 100_000
#: A source's last block is drawn so often, and the draw whose words come nearest to their expectation stays.
LANDINGS = 16
#: Copies of one row beyond so many are written by several tasks.
SPREAD = 4096
OUTPUTS = ("size", "source_size", "target", "copies", "taken")
_INNER = ("sid", "n_units", "h", "h2", "p", "block", "blocks", "row", "rows", "left", "__own", "__source", "__i", "__lo")
_EPS = 1e-9


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = 3) -> DataFrame:
    """One row per source: sid (its rank), n_units, source_size, target. Input: source, size, rows (units of equal rows).

    The windows run over this table of one row per source, not over documents."""
    s = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n_units"))
    everything = Window.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("sid", F.row_number().over(everything) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1)
    s = s.withColumn("w", w).withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "sid")
    whole = Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("k", F.row_number().over(by_ratio))
        .withColumn("before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("before")) / F.col("rest"))
        .withColumn("first", F.min(F.when(F.col("ratio") >= F.col("level"), F.col("k"))).over(whole))
        .withColumn("level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(whole))
    )
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("w"))
    return s.select("source", "sid", "n_units", "source_size", target.alias("target"))


def flight(z: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """Move p (fractions in 0..1) with sum(p) and sum(z * p) kept until at most two fractions are left (one
    more where sizes are equal but one). ``z`` must be in descending order: the largest unit moves against all
    smaller ones at once, so it lands while the others shift little."""
    p = p.copy()
    act = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    while len(act) >= 3:
        i, rest = act[0], act[1:]
        zr = z[rest]
        centred = zr - zr.mean()
        spread = float(centred @ centred)
        if spread <= 0 and z[i] != zr[0]:
            i, rest, centred = rest[0], rest[1:], centred[1:]
        u = np.full(len(rest), -1.0 / len(rest))
        if spread > 0:
            u += (zr.mean() - z[i]) / spread * centred
        idx, u = np.concatenate([[i], rest]), np.concatenate([[1.0], u])
        q = p[idx]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min()
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        q[q < _EPS], q[q > 1 - _EPS] = 0.0, 1.0
        p[idx] = q
        act = act[(p[act] > 0) & (p[act] < 1)]
    return p


def landing(p: np.ndarray, rng) -> np.ndarray:
    """Decide the last fractions: the word total is given up, the document total is kept while two are left."""
    p = p.copy()
    act = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    while len(act):
        if len(act) == 1:
            p[act[0]] = float(rng.random() < p[act[0]])
        else:
            i, j = act[:2]
            up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
            step = up if rng.random() * (up + down) < down else -down
            p[i] += step
            p[j] -= step
        p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
        act = np.flatnonzero((p > 0) & (p < 1))
    return p


def _fly(seed: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        z, p, h = (table[c].to_numpy() for c in ("size", "p", "h"))
        order = np.lexsort((h, -z))
        first = table.slice(0, 1).to_pylist()[0]
        zs, ps, last = z[order].astype(float), p[order], first["blocks"] == 1
        best = None
        for attempt in range(LANDINGS if last else 1):
            rng = np.random.default_rng([seed, turn, first["sid"], first["block"], attempt])
            q = flight(zs, ps, rng)
            q = landing(q, rng) if last else q
            off = abs(float(zs @ (q - ps)))
            if best is None or off < best[0]:
                best = off, q
        q = best[1]
        out = np.empty(len(z))
        out[order] = q
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out, pa.float64()))

    return run


def _hash(docs: DataFrame, seed: int):
    """h, h2: two hashes of a whole row, which together tell different rows apart. What xxhash64 does not take (maps,
    variants, what holds them) counts by its JSON text; equal maps in another order of entries are different rows then."""
    hard = (T.MapType, T.VariantType)
    holds = lambda kind: isinstance(kind, hard) or isinstance(kind, T.ArrayType) and holds(kind.elementType) or isinstance(kind, T.StructType) and any(holds(f.dataType) for f in kind)
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if holds(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*columns, F.lit(seed)).alias("h"), F.xxhash64(F.lit(seed), *columns, F.lit(~seed)).alias("h2")


def _spread(df: DataFrame, many: str, name: str) -> DataFrame:
    """Each row ``many`` times, numbered from 0 in ``name``; beyond ``SPREAD`` times by several tasks."""
    few = df.filter(F.col(many).between(1, SPREAD)).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1)))
    lots = df.filter(F.col(many) > SPREAD).withColumn("__lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1, F.lit(SPREAD))))
    lots = lots.repartition("h", "__lo").withColumn(name, F.explode(F.sequence("__lo", F.least(F.col("__lo") + SPREAD, F.col(many)) - 1)))
    return few.unionByName(lots.drop("__lo"))


def _units(docs: DataFrame, text: str, source: str, weights, cap: int, block: int, seed: int) -> DataFrame:
    """One row for equal rows: h, row (their columns but the text), rows (how many), size, source_size, target and
    taken, how often the mix takes all of them together."""
    rest = [c for c in docs.columns if c != text]
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(source).alias("__own"), size.alias("size"), *_hash(docs, seed))
    units = flat.saved(units.groupBy("h", "h2").agg(F.first("row").alias("row"), F.first("__own").alias("__own"), F.first("size").alias("size"), F.count("*").alias("rows")))
    targets = flat.saved(source_targets(units.select(F.col("__own").alias("source"), "size", "rows"), weights, cap).withColumnRenamed("source", "__source"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    every = F.floor(share + _EPS).cast("long")  # copies of each row that are certain
    left = F.greatest(share - every, F.lit(0.0)) * F.col("rows")
    work = units.join(targets, F.col("__own").eqNullSafe(F.col("__source"))).drop("__source", "__own")
    work = work.withColumn("taken", every * F.col("rows") + F.floor(left + _EPS).cast("long")).withColumn("p", F.greatest(left - F.floor(left + _EPS), F.lit(0.0))).withColumn("left", F.col("n_units"))
    done, turn = [], 0
    while True:
        blocks = F.ceil(F.col("left") / block).cast("long")
        work = work.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("h", F.lit(turn)), F.col("blocks")))
        work = flat.saved(work.groupBy("sid", "block").applyInArrow(_fly(seed, turn), work.schema))
        turn += 1
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(work.filter(~open_))
        work = work.filter(open_).withColumn("left", 2 * F.col("blocks"))
        if work.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("h", "h2", "row", "rows", "size", "source_size", "target", (F.col("taken") + F.col("p").cast("long")).alias("taken"))


def copies(docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = 3, block: int = 1024, seed: int = 1) -> DataFrame:
    """The documents' columns but the text, with size, source_size, target, copies (how often the mix takes the
    document) and taken (copies * size), all long but target."""
    docs = flat.unclash(docs, (*OUTPUTS, *_INNER))
    rest = [c for c in docs.columns if c != text]
    units = _spread(_units(docs, text, source, weights, cap, block, seed), "rows", "__i")
    upto = lambda i: F.expr(f"({i} * taken) div rows")
    units = units.withColumn("copies", upto("(__i + 1)") - upto("__i"))
    out = units.select(*[F.col("row")[c].alias(c) for c in rest], "h", "size", "source_size", "target", "copies")
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = 3, block: int = 1024, seed: int = 1) -> DataFrame:
    """The mix itself: the documents' own columns, every document as often as it is taken, with ``copy`` from 1.

    Equal rows become one before their text moves, and it meets its decision by the hash of the whole row."""
    docs = flat.unclash(docs, ("copy", *_INNER))
    taken = _units(docs, text, source, weights, cap, block, seed).select("h", "h2", "rows", "taken").filter("taken > 0")
    whole = docs.select(*_hash(docs, seed), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.groupBy("h", "h2").agg(F.first("row").alias("row"))
    out = _spread(whole.join(taken, ["h", "h2"]), "taken", "__i")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.expr("__i div rows + 1").alias("copy"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return copies(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
