"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public byte-level vocabulary (a rank file whose path is a
parameter; every single byte is a piece, so every text has a segmentation). The probability of a word, with the
space before it, is the sum over all its segmentations into pieces, computed by a forward algorithm; a text's is
the product over its words. Piece probabilities come from expectation-maximisation (forward and backward) on a
bounded sample of labelled texts: ``sample`` different texts a language, the smallest by a hash, whole texts, of the
``MAX_LANGUAGES`` labels with most texts (of equals the smaller labels).

The forward pass runs over the distinct words of a block, all languages at once, so its cost follows distinct
words. Prediction is one narrow stage; the model (pieces x languages) is a broadcast whose size is fixed by the
vocabulary and ``MAX_LANGUAGES``.

Cases: a null text, or one without a letter, is ``und`` with score 0. Without labelled texts all others are
``und`` too. A null label teaches nothing. Ties go to the smaller label. Long words are scored in runs of
``LONGEST`` bytes; all pieces of the vocabulary that such a run can hold are used. Empty tables and repeated rows work; extra columns pass through, clashing names are renamed.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SAMPLE = 300
#: Scores of so many words that a task has met are kept for its next blocks.
CACHE = 300_000
ROUNDS = 3
TRAIN_WORDS = 16_384
MAX_LANGUAGES = 256
LONGEST = 48
#: Longer pieces fit no run of a word and the space before it.
PIECE = LONGEST + 1
OUTPUTS = ("lang_pred", "score")


class Pieces:
    """Pieces of at most PIECE bytes, lower-cased, looked up by span hash: ids[...] or -1."""

    def __init__(self, pieces: list[bytes]):
        pieces = sorted({p.lower() for p in pieces if 0 < len(p) <= PIECE} | {bytes([b]) for b in range(256)})
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = flat.span_hash(flat.prefix(data), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.n = hashes[order], order.astype(np.int32), len(pieces)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(hashes >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Pieces:
        try:
            f = open(path, "rb")
        except FileNotFoundError:
            raise FileNotFoundError(f"the vocabulary {path} is missing on the driver; pass the path of a rank file as 'vocabulary'") from None
        with f:
            return cls([base64.b64decode(line.split()[0]) for line in f if line.strip()])

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), self.n - 1)
        same = self.hashes[at] == h[maybe]
        out[maybe[same]] = self.ids[at[same]]
        return out


def spaced_words(data: np.ndarray, offs: np.ndarray):
    """Every word in runs of at most LONGEST bytes: hash, start, end, document, over lower-cased bytes."""
    data = flat.LOWER[data]
    starts, ends, doc = flat.words(data, offs, flat.NONSPACE)
    long_ = ends - starts > LONGEST
    if long_.any():
        parts = -(-(ends - starts) // LONGEST)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends, doc = np.repeat(starts, parts) + k * LONGEST, np.repeat(ends, parts), np.repeat(doc, parts)
        ends = np.minimum(ends, starts + LONGEST)
    return data, starts, ends, doc, flat.span_hash(flat.prefix(data), starts, ends)


def lattice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces):
    """Per word, sorted by length: its bytes after one space, and ids[j][l]: the piece of length l + 1 that ends
    before position j + 1, for the words that are that long."""
    size = ends - starts + 1
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], np.concatenate([[0], np.cumsum(size[order])])
    flat_ = np.full(begin[-1], 32, np.uint8)
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
    body = at > 0
    flat_[body] = data[(np.repeat(starts[order], size) + at - 1)[body]]
    sums = flat.prefix(flat_)
    # alive[j]: words (a leading run of the order) that have a byte at position j.
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    ids = []
    for j, n in enumerate(alive):
        row, stop = [], begin[:n] + j + 1
        for length in range(1, min(j + 1, PIECE) + 1):
            row.append(pieces.find(flat.span_hash(sums, stop - length, stop)))
        ids.append(row)
    return order, size, alive, ids


def forward(lat, probs: np.ndarray):
    """log P(word) for every word and language, and the scaled forward values. probs: pieces x languages,
    with a last row of zeros for 'no piece'."""
    order, size, alive, ids = lat
    n, k = len(order), probs.shape[1]
    alpha = [np.ones((n, k))]
    scale, out = np.zeros((n, k)), np.zeros((n, k))
    for j, m in enumerate(alive):
        total = np.zeros((m, k))
        for length, piece in enumerate(ids[j], 1):
            has = np.flatnonzero(piece >= 0)
            total[has] += alpha[j + 1 - length][has] * probs[piece[has]]
        alpha.append(total)
        if j % 8 == 7:  # rescale the window that later positions read
            top = np.maximum(total.max(1, keepdims=True), 1e-290)
            for i in range(max(0, j + 2 - PIECE), j + 2):
                alpha[i] = alpha[i].copy()
                alpha[i][:m] /= top
            scale[:m] += np.log(top)
    with np.errstate(divide="ignore"):
        for j, m in enumerate(alive):
            done = np.flatnonzero(size[:m] == j + 1)
            if len(done):
                # later rescaling touched only the words that go on
                out[order[done]] = np.log(np.maximum(alpha[j + 1][done], 1e-300)) + scale[done]
    return out


def expected_counts(lat, probs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, weighted (words x languages)."""
    order, size, alive, ids = lat
    n, k = len(order), probs.shape[1]
    alpha = [np.ones((n, k))]
    for j, m in enumerate(alive):
        total = np.zeros((m, k))
        for length, piece in enumerate(ids[j], 1):
            has = np.flatnonzero(piece >= 0)
            total[has] += alpha[j + 1 - length][has] * probs[piece[has]]
        alpha.append(total)
    whole = np.empty((n, k))
    beta = [np.zeros((len(a), k)) for a in alpha]
    for j, m in enumerate(alive):
        done = np.flatnonzero(size[:m] == j + 1)
        whole[done] = np.maximum(alpha[j + 1][done], 1e-300)
        beta[j + 1][done] = 1.0
    counts, w = np.zeros_like(probs), weight[order] / whole
    for j in range(len(alive) - 1, -1, -1):
        for length, piece in enumerate(ids[j], 1):
            has = np.flatnonzero(piece >= 0)
            use = beta[j + 1][has] * probs[piece[has]]
            beta[j + 1 - length][has] += use
            use *= alpha[j + 1 - length][has] * w[has]
            for c in range(k):
                counts[:, c] += np.bincount(piece[has], use[:, c], len(counts))
    return counts


def train(texts: list[str], langs: list[str], pieces: Pieces, rounds: int = ROUNDS):
    """(labels, piece probabilities with a last row of zeros, log priors) from labelled texts."""
    labels = sorted(set(langs))
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data, starts, ends, doc, h = spaced_words(data, offs)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    lang = np.array([labels.index(x) for x in langs])[doc]
    weight = np.zeros((len(first), len(labels)))
    np.add.at(weight, (inverse, lang), 1.0)
    probs = np.full((pieces.n, len(labels)), 1.0 / pieces.n)
    for _ in range(rounds):
        counts = np.full(probs.shape, 0.05)
        for lo in range(0, len(first), TRAIN_WORDS):  # the lattice of a few words at a time
            part = first[lo : lo + TRAIN_WORDS]
            counts += expected_counts(lattice(data, starts[part], ends[part], pieces), probs, weight[lo : lo + TRAIN_WORDS])
        probs = counts / counts.sum(0)
    share = np.bincount([labels.index(x) for x in langs], minlength=len(labels))
    return labels, np.vstack([probs, np.zeros(len(labels))]), np.log(share / share.sum())


def labelled_sample(docs: DataFrame, training, text: str, lang: str, sample: int) -> DataFrame:
    """At most ``sample`` texts for each label: those of smallest hash, over all rows that ``training`` admits."""
    rows = docs.filter(training & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(11)))
    # A cut by hash first: its bound is found from counts of different texts, so the window sorts about 4 * sample rows a label.
    seen = rows.select("lang", "h").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    rows = rows.join(F.broadcast(seen), "lang")
    rows = rows.filter((F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))) < F.lit(2.0 * sample + 50) / F.col("count"))
    rows = rows.groupBy("lang", "h").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return rows.withColumn("n", nth).filter(F.col("n") <= sample).select("lang", "text")


def identify(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with lang_pred and score, the posterior probability of the predicted label."""
    docs = flat.unclash(docs, OUTPUTS)
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]

    def kernel():
        pieces, labels, probs, prior = held.value
        named = np.array([*labels, "und"], object)
        letters = np.zeros(256, bool)
        letters[97:123] = True

        known = [np.zeros(0, np.uint64), np.zeros((0, len(labels)))]

        def scores(low, starts, ends, h):
            """Log probabilities of words with distinct, ascending hashes h; only new ones are computed."""
            at = np.minimum(np.searchsorted(known[0], h), max(len(known[0]) - 1, 0))
            old = known[0][at] == h if len(known[0]) else np.zeros(len(h), bool)
            out = np.empty((len(h), len(labels)))
            out[old] = known[1][at[old]]
            out[~old] = forward(lattice(low, starts[~old], ends[~old], pieces), probs)
            if len(known[0]) + (~old).sum() > CACHE:
                known[:] = h, out
            else:
                both = np.concatenate([known[0], h[~old]])
                order = np.argsort(both)
                known[:] = both[order], np.concatenate([known[1], out[~old]])[order]
            return out

        def work(data, offs):
            n = len(offs) - 1
            low, starts, ends, doc, h = spaced_words(data, offs)
            some = flat.per_doc(np.searchsorted(offs, np.flatnonzero(letters[low]), "right") - 1, n) > 0
            for i in np.flatnonzero(~some):  # no a-z: is any other character a letter?
                raw = data[offs[i] : offs[i + 1]].tobytes()
                some[i] = not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace"))
            if not labels or not len(h):
                best, score = np.full(n, len(labels)), np.zeros(n)
            else:
                distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                each = scores(low, starts[first], ends[first], distinct)
                total = np.column_stack([np.bincount(doc, each[inverse, c], n) for c in range(len(labels))]) + prior
                best = total.argmax(1)
                score = 1.0 / np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0)).sum(1)
                best[~some], score[~some] = len(labels), 0.0
            return [pa.array(named[best], pa.string()), pa.array(score, pa.float64())]

        return work

    return flat.map_texts(docs, text, fields, kernel, keep)


def fit(docs: DataFrame, training, text: str = "text", lang: str = "lang", sample: int = SAMPLE, vocabulary: str = VOCABULARY):
    """The model: pieces, labels, probabilities, priors. Reads at most ``sample`` texts a label to the driver."""
    rows = labelled_sample(docs, training, text, lang, sample).orderBy("lang", "text").collect()
    pieces = Pieces.read(vocabulary)
    if not rows:
        return pieces, [], np.zeros((pieces.n + 1, 0)), np.zeros(0)
    model = train([r.text for r in rows], [r.lang for r in rows], pieces)
    del rows
    flat.release(docs.sparkSession)
    return pieces, *model


def held_out(id_column: str, by: int, rest: int):
    """Whether crc32 of the id's text has that remainder; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(by)) == rest


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out("doc_id", 4, 2))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
