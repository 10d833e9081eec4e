"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over an inverted index, weighted votes.

Examples: at most ``sample`` labelled texts a class (smallest by hash, over all labels that ``training`` admits,
whole texts). Terms: words (A-Z lower-cased) and the first 4 and 5 bytes of longer words; every term of an example
counts, with its document frequency over all documents. A document's vector is (1 + ln tf) * ln((N + 1) / (df + 1)),
times how much the term tells about the label (``evidence_of``, never 0), of unit length over the examples' terms.

The index is block-max: examples stand in blocks of ``BLOCK``; a term's postings of a block carry their greatest
weight. A query's common terms (dense rows) are summed for all examples; with the greatest weights of its other terms
they bound its cosine in every block. Two blocks of greatest bounds are summed first; then only blocks whose bound
reaches the k-th cosine found are, so the neighbours are exact. The vote is the neighbours' similarity-weighted share of toxic labels,
each class weighted back to its share of all training labels; a logistic curve fitted on leave-one-out votes of
the examples makes it a probability. Neighbours and their cosines are the evidence.

Index and vocabulary hold the terms of at most 2 * ``sample`` texts, and so does their broadcast. Scoring is one narrow stage.

Cases: a text without a term of any example (null and empty too) gets the smoothed share of such examples that are toxic;
without labels of both classes every score is the smoothed prior. Null labels and ids teach nothing; ties go to the
smaller example. Empty tables and repeated rows work; extra columns pass through, clashing names are renamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .language import held_out

SAMPLE = 1500
NEIGHBOURS = 15
#: Weight of a term without evidence, and the chi-square up to which there is none.
FLOOR, EVEN = 0.05, 10.83
BLOCK = 64
OUTPUTS = ("score", "predicted", "evidence")


def terms_of(data: np.ndarray, offs: np.ndarray):
    """(document of every word, number of its distinct word, and for each of those the hashes of the word and of its
    leading parts, 0 where the word has none)."""
    data = flat.LOWER[data]
    starts, ends, doc = flat.words(data, offs, flat.ALNUM)
    sums = flat.prefix(data)
    code, first, number, _ = flat.distinct(flat.span_hash(sums, starts, ends))
    starts, ends = starts[first], ends[first]
    terms = np.zeros((len(code), 3), np.uint64)
    terms[:, 0] = code
    for k, part in enumerate((4, 5), 1):
        longer = np.flatnonzero(ends - starts > part)
        terms[longer, k] = flat.span_hash(sums, starts[longer], starts[longer] + part) ^ np.uint64(part)
    return doc, number, terms


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes[hashes > 0])
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, code: np.ndarray) -> np.ndarray:
        out = np.full(len(code), -1)
        some = np.flatnonzero(self.bits[(code >> np.uint64(44)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, code[some]), len(self.hashes) - 1)
            same = self.hashes[at] == code[some]
            out[some[same]] = at[same]
        return out

    def counts(self, data, offs):
        """(document, term, count), sorted."""
        doc, number, terms = terms_of(data, offs)
        found = self.find(terms.ravel()).reshape(terms.shape)[number]
        pair = np.sort(((doc * len(self.hashes))[:, None] + found)[found >= 0])
        if not len(pair):
            return [np.zeros(0, np.int64)] * 3
        at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        return pair[at] // len(self.hashes), pair[at] % len(self.hashes), np.diff(np.append(at, len(pair)))


class Rows:
    """Sparse rows: the entries of row i are term[start[i]:start[i + 1]] and value[...]."""

    def __init__(self, start, term, value, width: int):
        self.start, self.term, self.value, self.width = start, term, value, width

    def __len__(self):
        return len(self.start) - 1

    def cut(self, lo: int, hi: int) -> Rows:
        a, b = self.start[lo], self.start[min(hi, len(self))]
        return Rows(self.start[lo : hi + 1] - a, self.term[a:b], self.value[a:b], self.width)

    def row_of(self):
        return np.repeat(np.arange(len(self)), np.diff(self.start))


def sparse(dense: np.ndarray) -> Rows:
    row, term = np.nonzero(dense)
    return Rows(np.searchsorted(row, np.arange(len(dense) + 1)), term, dense[row, term], dense.shape[1])


def vectors(found, n: int, idf: np.ndarray) -> Rows:
    """Unit vectors of n documents (rows without a term are empty)."""
    doc, term, count = found
    value = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(doc, value * value, n)) if len(doc) else np.ones(n)
    return Rows(np.searchsorted(doc, np.arange(n + 1)), term, value / norm[doc], len(idf))


def _expand(first: np.ndarray, keys: np.ndarray):
    """Places first[key]..first[key + 1] of all keys, and how many each key has."""
    size = first[keys + 1] - first[keys]
    return np.arange(size.sum()) + np.repeat(first[keys] - np.cumsum(size) + size, size), size


class Index:
    """Postings of the examples by term and block; terms in many examples have a dense row instead."""

    def __init__(self, weights):
        w = weights if isinstance(weights, Rows) else sparse(weights)
        self.n, self.blocks = len(w), max(1, -(-len(w) // BLOCK))
        row, df = w.row_of(), np.bincount(w.term, minlength=w.width)
        common = np.flatnonzero(df >= max(32, self.n // 32))
        self.place = np.full(w.width, -1)
        self.place[common] = np.arange(len(common))
        at = self.place[w.term]
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        self.dense[at[at >= 0], row[at >= 0]] = w.value[at >= 0]
        term, row, value = w.term[at < 0], row[at < 0], w.value[at < 0]
        order = np.lexsort((row, term))
        term, self.example, self.value = term[order], row[order], value[order]
        group = term * self.blocks + self.example // BLOCK
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        self.start = np.append(start, len(group))
        self.block = self.example[start] // BLOCK
        self.most = np.maximum.reduceat(self.value, start) if len(start) else np.zeros(0)
        self.first = np.searchsorted(term[start], np.arange(w.width + 1))

    def search(self, q, k: int, skip: np.ndarray | None = None):
        """Ids and cosines of the k nearest examples of each row (-1 and 0 where there are fewer); ``skip`` holds
        an example that a row must not meet."""
        q = q if isinstance(q, Rows) else sparse(q)
        top, ids = np.zeros((len(q), k)), np.full((len(q), k), -1)
        for lo in range(0, len(q), 256):
            score, least = self._scores(q.cut(lo, lo + 256), k, None if skip is None else skip[lo : lo + 256])
            row, name = np.nonzero(score >= np.maximum(least - 1e-9, 1e-12))
            order = np.lexsort((name, -np.round(score[row, name], 12), row))
            row, name = row[order], name[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, name, nth = row[nth < k], name[nth < k], nth[nth < k]
            top[lo + row, nth], ids[lo + row, nth] = score[row, name], name
        return ids, top

    def _scores(self, q: Rows, k: int, skip):
        """Cosines (rows x examples) in all blocks that can hold one of the k nearest, parts of them in others; and
        a cosine that k examples of the row reach (0: there may be fewer), which those parts do not."""
        row, at = q.row_of(), self.place[q.term]
        x = np.zeros((len(q), len(self.dense)))
        x[row[at >= 0], at[at >= 0]] = q.value[at >= 0]
        out = x @ self.dense
        group, size = _expand(self.first, q.term[at < 0])
        row, value = np.repeat(row[at < 0], size), np.repeat(q.value[at < 0], size)
        bound = out.reshape(len(q), self.blocks, BLOCK).max(2)
        bound += np.bincount(row * self.blocks + self.block[group], value * self.most[group], bound.size).reshape(bound.shape)

        def add(blocks):
            """The other terms' parts in the chosen blocks of each row."""
            use = np.flatnonzero(blocks[row, self.block[group]])
            post, many = _expand(self.start, group[use])
            cell = np.repeat(row[use] * out.shape[1], many) + self.example[post]
            part = np.bincount(cell, np.repeat(value[use], many) * self.value[post], out.size).reshape(out.shape)
            if skip is not None:
                out[np.arange(len(out)), skip] = part[np.arange(len(out)), skip] = 0.0
            return part

        best = np.argsort(-bound, axis=1)[:, : 2 + k // BLOCK]
        done = np.zeros(bound.shape, bool)
        np.put_along_axis(done, best, True, axis=1)
        out += add(done)
        near = np.take_along_axis(out.reshape(len(q), self.blocks, BLOCK), best[:, :, None], axis=1).reshape(len(q), -1)
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None] if near.shape[1] >= k else np.zeros((len(q), 1))
        out += add(~done & (bound > 0) & (bound >= least - 1e-9))
        return out, least


def votes(ids, top, toxic, weight, prior):
    """Similarity-weighted share of toxic neighbours, shrunk towards the prior."""
    near = np.where(ids >= 0, top, 0.0) ** 2
    w = near * weight[ids]
    return ((w * toxic[ids]).sum(1) + 0.02 * prior) / (w.sum(1) + 0.02)


def calibrate(vote: np.ndarray, toxic: np.ndarray, weight: np.ndarray):
    """Slope and intercept of a weighted logistic curve over the vote's log odds (Newton steps, ridge)."""
    x = np.log(vote / (1 - vote))
    design, beta = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (toxic - p)) - 1e-2 * (beta - [1.0, 0.0])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return beta


class Model:
    def __init__(self, vocabulary, idf, weights, toxic, weight, names, prior):
        self.vocabulary, self.idf, self.weights, self.toxic, self.weight, self.names, self.prior = vocabulary, idf, weights, toxic, weight, names, prior
        self.curve, self.blank = np.array([1.0, 0.0]), prior
        if len(toxic) and 0 < toxic.mean() < 1:
            some = np.diff(weights.start) > 0
            ids, top = Index(weights).search(weights, NEIGHBOURS, np.arange(len(toxic)))
            vote = votes(ids, top, toxic, weight, prior)
            if some.any():
                self.curve = calibrate(vote[some], toxic[some], weight[some])
            w = weight[~some]
            self.blank = float(((w * toxic[~some]).sum() + 0.5 * prior) / (w.sum() + 0.5))


def fit(docs: DataFrame, labels: DataFrame, training, text="text", key="doc_id", label="toxic", sample=SAMPLE) -> Model:
    """Collects at most ``sample`` texts a class, and one count of each of their terms."""
    marks = labels.filter(training & F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("y"))
    marks = marks.distinct()
    sizes = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}
    total = sum(sizes.values())
    prior = (sizes.get(1, 0) + 1) / (total + 10)
    h = F.xxhash64("key", F.lit(23))
    share = (F.shiftrightunsigned(h, 1) / F.lit(float(1 << 63))) < F.when(F.col("y") == 1, F.lit((2.0 * sample + 50) / max(1, sizes.get(1, 0)))).otherwise(F.lit((2.0 * sample + 50) / max(1, sizes.get(0, 0))))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(h, "key"))
    picked = marks.filter(share).withColumn("n", nth).filter(F.col("n") <= sample).drop("n")
    # Ids may repeat in documents; one text of each id is an example.
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    rows = rows.groupBy("key", "y").agg(F.min("text").alias("text")).orderBy("key", "y").collect()
    if not rows:
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), sparse(np.zeros((0, 0))), np.zeros(0), np.zeros(0), [], prior)
    toxic = np.array([float(r.y) for r in rows])
    weight = np.where(toxic == 1, sizes.get(1, 0) / max(1, toxic.sum()), sizes.get(0, 0) / max(1, (1 - toxic).sum()))
    raw = [(r.text or "").encode() for r in rows]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    vocabulary = Vocabulary(np.unique(terms_of(data, offs)[2]))
    found = vocabulary.counts(data, offs)
    idf = document_frequencies(docs, vocabulary, text) * evidence_of(found, toxic, len(vocabulary.hashes))
    weights = vectors(found, len(rows), idf)
    del data, raw, found
    flat.release(docs.sparkSession)
    return Model(vocabulary, idf, weights, toxic, weight / weight.mean(), [r.key for r in rows], prior)


def evidence_of(found, toxic, terms: int) -> np.ndarray:
    """Weight of each term by its chi-square against the label in the examples: nearly 1 for a telling term, and
    ``FLOOR`` for one that says nothing or is too rare to say."""
    doc, term, _ = found
    n, ones = len(toxic), toxic.sum()
    df = np.bincount(term, minlength=terms)
    expected = df * ones / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (np.bincount(term, toxic[doc], terms) - expected) ** 2 / (expected * (1 - ones / n) * (n - df))
    chi = np.where(np.isfinite(chi), chi, 0)
    return FLOOR + (1 - FLOOR) * np.maximum(0, 1 - EVEN / np.maximum(chi, EVEN))


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str) -> np.ndarray:
    """idf of the vocabulary over all documents: one row a task and term, then one a term."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocab = held.value
        seen, n = np.zeros(len(vocab.hashes), np.int64), 0
        for batch in batches:
            for _, data, offs in flat.text_blocks(batch.column(0)):
                n += len(offs) - 1
                _, term, _ = vocab.counts(data, offs)
                seen += np.bincount(term, minlength=len(seen))
        terms = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(np.append(seen[seen > 0], n), pa.int64())], names=["term", "n"])

    rows = docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # no objects: there is a row for each term
    term, count = (rows[c].to_numpy() for c in ("term", "n"))
    n = count[term < 0].sum()
    df = np.zeros(len(vocabulary.hashes))
    df[term[term >= 0]] = count[term >= 0]
    return np.log((n + 1) / (df + 1)) + 1e-3


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, evidence: int = 3) -> DataFrame:
    """Documents with score, predicted and evidence: the ``evidence`` nearest examples (key, similarity, toxic)."""
    docs = flat.unclash(docs, OUTPUTS)
    held = docs.sparkSession.sparkContext.broadcast(model)
    item = T.StructType([T.StructField("key", T.StringType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())])
    fields = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False), T.StructField("evidence", T.ArrayType(item))]

    def kernel():
        m = held.value
        index = Index(m.weights) if len(m.toxic) else None
        names = np.array([str(x) for x in m.names], object)

        def work(data, offs):
            n = len(offs) - 1
            out, near, sims = np.full(n, m.blank), np.full((n, NEIGHBOURS), -1), np.zeros((n, NEIGHBOURS))
            if index is not None and len(m.idf):
                doc, term, count = m.vocabulary.counts(data, offs)
                used, place = np.unique(doc, return_inverse=True)
                for lo in range(0, len(used), 256):
                    own = (place >= lo) & (place < lo + 256)
                    rows = used[lo : lo + 256]
                    q = vectors((place[own] - lo, term[own], count[own]), len(rows), m.idf)
                    near[rows], sims[rows] = index.search(q, NEIGHBOURS)
                    v = votes(near[rows], sims[rows], m.toxic, m.weight, m.prior)
                    x = np.log(v / (1 - v)) * m.curve[0] + m.curve[1]
                    out[rows] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            show = near[:, :evidence]
            kept = show >= 0
            items = pa.StructArray.from_arrays(
                [pa.array(names[show[kept]] if kept.any() else [], pa.string()), pa.array(sims[:, :evidence][kept], pa.float64()), pa.array(m.toxic[show[kept]].astype(np.int32) if kept.any() else [], pa.int32())],
                names=["key", "similarity", "toxic"],
            )
            return [pa.array(out, pa.float64()), pa.array((out >= 0.5).astype(np.int32), pa.int32()), flat.lists(items, kept.sum(1))]

        return work

    return flat.map_texts(docs, text, fields, kernel, keep)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, ~held_out("doc_id", 5, 0))
    found = score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted", "evidence")
