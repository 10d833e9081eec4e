"""Language-model scores by a hierarchical Pitman-Yor model.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end token. Restaurants: the context of
a token is the whole word before it (or the start of the text); all contexts share one parent, the empty context, and
its base is a spelling model, itself hierarchical: a byte after two bytes, after one, after none, then uniform. So
there are as many context restaurants as training words, and both grow with the corpus.

Seating is sampled by Gibbs sweeps: given all other dishes and restaurants as of the last sweep, the customers of a
(context, word) leave and sit down anew. Up to ``EXACT`` customers the number of their tables is drawn from its exact
conditional distribution (generalised Stirling numbers); more are seated one after the other by the restaurant's own
odds (from ``ONE_BY_ONE`` customers on in runs of 1/32 of those seated, by binomial draws). Tables of a context are
customers of the parent. Predictive probabilities are averaged over the sweeps after ``BURN_IN``. Discounts come from
the counts of ones and twos; strengths are 1. A pair seen once always sits at a table of its own, so no sweep moves it: it
counts in both restaurants like any other, and its own part of the prediction is the same for all pairs seen once of a
context, (1 - discount) / (strength + customers). So the sweeps carry none of these pairs; with ``once`` (as in the query) the
model keeps ``PAIR_BYTES`` bytes of the hash of each and predicts with all pairs. Without it their own part is the
parent's mass. Every context sums to one either way.

``score`` is over the base's events, the known words and one event for every unknown word (the mass that the parent
gives to new words, less what spells a known one). ``spelled_score`` also pays for the spelling of unknown words.

All counts cover all training texts. Words and pairs are dealt by hash into buckets of about ``BUCKET_BYTES`` of text,
each packed into one row; pairs are counted within a task first, and one pass finds the words with more than
1 / ``SPLIT`` of all tokens, whose pairs are dealt by the whole pair. A sweep is two exchanges: buckets send the tables
of their contexts, and of split words, to the buckets at home in them, which answer with totals. Only sums, the at
most ``2 * SPLIT`` split words and the spelling model (at most 2**24 byte triples, as arrays) reach the driver. To score,
texts are dealt into blocks of about ``BLOCK_BYTES`` by hash; a block asks each bucket for its distinct words and pairs
and gets numbers back, in ``PASSES`` passes over the blocks, whose requests are not all on disk at once. A text with more than 1 / ``SPLIT`` of all rows is scored once and its rows join the result.

Cases: null and empty texts are one end token. Without training texts base and score are those of an empty corpus.
Repeated rows count again. Empty tables give no rows. Extra columns pass through; clashing names are renamed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .language import held_out

SWEEPS = 4
BURN_IN = 1
STRENGTH = 1.0
EXACT, ONE_BY_ONE = 64, 256
BUCKET_BYTES = 6 << 20
BLOCK_BYTES = 8 << 20
COUNT_BYTES = 8 << 20
PASSES = 3
SPLIT = 16_384
OUTPUTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score")
_STEP = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0x5354415254)  # the context of a text's first token
END = flat.span_hash(np.zeros(2, np.uint64), [0], [0])[0]


def tokens(data: np.ndarray, offs: np.ndarray):
    """The lower-cased bytes, and for every token in order: word hash, hash of the word before, document, start and
    end (equal for an end token)."""
    data = flat.LOWER[data]
    starts, ends, doc = flat.words(data, offs, flat.NONSPACE)
    docs = len(offs) - 1
    place = np.arange(len(starts)) + doc
    many = flat.per_doc(doc, docs).astype(np.int64)
    last = np.cumsum(many) + np.arange(docs)
    n = len(starts) + docs
    s, e, d = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    s[place], e[place], d[place], d[last] = starts, ends, doc, np.arange(docs)
    word = flat.span_hash(flat.prefix(data), s, e)
    before = np.roll(word, 1)
    before[np.append(0, last[:-1] + 1)[:docs]] = START
    return data, word, before, d, s, e


def pair_hash(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return flat.mix(word ^ flat.mix(before + _STEP))


def take(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Bytes and offsets of the spans, one after the other."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(starts, size)
    return data[at], offs


# --- seating ----------------------------------------------------------------------------------------------------


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    return (flat.mix(seed + np.uint64((step + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) * 2.0**-53


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), -inf where there are none."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, most):
            t = np.arange(1, c + 2)
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, :c + 1], np.log(np.maximum(c - t * discount, 0)) + out[c, 1 : c + 2])
    return out


def seat(customers: np.ndarray, discount: float, others: np.ndarray, base: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Tables that each dish's customers occupy, given the tables of the restaurant's other dishes (``others``) and
    the parent's probability of the dish (``base``)."""
    t = np.ones(len(customers))
    stirling, log_base = log_stirling(discount), np.log(np.maximum(base, 1e-300))
    small = np.flatnonzero((customers > 1) & (customers <= EXACT))
    small = small[np.argsort(customers[small], kind="stable")]
    for rows in np.split(small, np.flatnonzero(np.diff(customers[small])) + 1) if len(small) else []:
        c = int(customers[rows[0]])
        for at in np.array_split(rows, -(-len(rows) * c // (1 << 20))):
            w = np.log(STRENGTH + discount * (others[at, None] + np.arange(c))) + log_base[at, None]
            w = np.cumsum(w, 1) + stirling[c, 1 : c + 1]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
            t[at] += (w < (uniform(seed[at], 0) * w[:, -1])[:, None]).sum(1)
    live, i = np.flatnonzero(customers > EXACT), 1
    rng = np.random.default_rng(int(seed[live].sum()) & 0xFFFFFFFF) if len(live) else None
    while len(live):
        new = (STRENGTH + discount * (others[live] + t[live])) * base[live]
        p = new / (new + i - discount * t[live])
        if i < ONE_BY_ONE:
            m = 1
            t[live] += uniform(seed[live], i) < p
        else:
            m = i // 32
            t[live] += rng.binomial(np.minimum(customers[live] - i, m), p)
        i += m
        live = live[customers[live] > i]
    return t


class Spelling:
    """P(bytes of a word, then its end); byte 32, which no word holds, ends and starts words."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, sweeps: int = SWEEPS):
        order = np.argsort(codes)
        self.codes = [codes[order].astype(np.int64)]
        for _ in range(2):
            self.codes.append(np.unique(self.codes[-1] & 0xFFFF if len(self.codes) == 1 else self.codes[-1] & 0xFF))
        self.contexts = [np.unique(c >> 8) for c in self.codes[:2]]
        c3 = counts[order].astype(np.int64)
        self.samples = []
        prob = [np.full(len(c), 1 / 256) for c in self.codes]
        tables = [np.ones(len(c)) for c in self.codes]
        up = [np.searchsorted(self.codes[1], self.codes[0] & 0xFFFF), np.searchsorted(self.codes[2], self.codes[1] & 0xFF)]
        for sweep in range(sweeps if len(codes) else 0):
            c = c3
            customers = []
            for level in range(3):
                customers.append(c)
                group = np.searchsorted(self.contexts[level], self.codes[level] >> 8) if level < 2 else np.zeros(len(c), int)
                n_groups = len(self.contexts[level]) if level < 2 else 1
                d = discount((c == 1).sum(), (c == 2).sum())
                base = prob[level + 1][up[level]] if level < 2 else np.full(len(c), 1 / 256)
                total = np.bincount(group, tables[level], n_groups)
                seed = flat.mix(self.codes[level].astype(np.uint64) + np.uint64(1000 * level + 7 * sweep + 1))
                tables[level] = seat(c, d, total[group] - tables[level], base, seed)
                if level < 2:
                    c = np.bincount(up[level], tables[level], len(self.codes[level + 1])).astype(np.int64)
            kept = []
            for level in (2, 1, 0):
                c, t = customers[level], tables[level]
                group = np.searchsorted(self.contexts[level], self.codes[level] >> 8) if level < 2 else np.zeros(len(c), int)
                n_groups = len(self.contexts[level]) if level < 2 else 1
                d = discount((c == 1).sum(), (c == 2).sum())
                whole, total = np.bincount(group, c, n_groups), np.bincount(group, t, n_groups)
                own, back = (c - d * t) / (STRENGTH + whole[group]), (STRENGTH + d * total) / (STRENGTH + whole)
                base = prob[level + 1][up[level]] if level < 2 else 1 / 256
                prob[level] = own + back[group] * base
                kept.insert(0, (own, back))
            if sweep >= BURN_IN:
                self.samples.append(kept)

    def _level(self, sample, level, code):
        """(own probability, back-off weight) of codes at a level; unseen contexts back off entirely."""
        own, back = sample[level]
        at = np.minimum(np.searchsorted(self.codes[level], code), len(self.codes[level]) - 1)
        p = np.where(self.codes[level][at] == code, own[at], 0.0)
        if level == 2:
            return p, back[0]
        context = self.contexts[level]
        at = np.minimum(np.searchsorted(context, code >> 8), len(context) - 1)
        return p, np.where(context[at] == code >> 8, back[at], 1.0)

    def log_prob(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Natural logarithm for each word (bytes and offsets)."""
        code, word = triples(data, offs)
        if not self.samples:
            return np.bincount(word, minlength=len(offs) - 1) * np.log(1 / 256)
        codes, inverse = np.unique(code, return_inverse=True)
        p = np.zeros(len(codes))
        for sample in self.samples:
            p3, b3 = self._level(sample, 0, codes)
            p2, b2 = self._level(sample, 1, codes & 0xFFFF)
            p1, b1 = self._level(sample, 2, codes & 0xFF)
            p += (p3 + b3 * (p2 + b2 * (p1 + b1 / 256))) / len(self.samples)
        return np.bincount(word, np.log(p)[inverse], len(offs) - 1)


def triples(data: np.ndarray, offs: np.ndarray):
    """Code of every byte of a word, and of its end, after the two bytes before it; and the word's number."""
    n = len(offs) - 1
    size = np.diff(offs) + 1
    begin = np.cumsum(size) - size
    full = np.full(size.sum(), 32, np.int64)
    word = np.repeat(np.arange(n), size)
    full[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offs))] = data
    at = np.arange(len(full)) - begin[word]
    one = np.where(at >= 1, np.roll(full, 1), 32)
    two = np.where(at >= 2, np.roll(full, 2), 32)
    return (two << 16) | (one << 8) | full, word


def discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(1.0, ones + 2.0 * twos), 0.05, 0.95))


# --- buckets ----------------------------------------------------------------------------------------------------


def dump(*arrays) -> bytes:
    """Arrays in one binary, each padded to eight bytes; ``load`` reads them by their kinds."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    parts = [np.array([a.nbytes for a in arrays], np.int64).tobytes()]
    for a in arrays:
        parts += [a.tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(parts)


def load(blob, kinds: str) -> list[np.ndarray]:
    kinds = kinds.split()
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)).tolist(), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at) if size else np.zeros(0, kind))
        at += size + -size % 8
    return out


class Deal:
    """Where words and pairs live: a word at home in one bucket, its pairs there too unless the word is split."""

    def __init__(self, buckets: int, split: np.ndarray):
        self.buckets, self.split = buckets, np.sort(split)

    def home(self, word):
        return (flat.mix(word ^ _STEP) % np.uint64(self.buckets)).astype(np.int64)

    def is_split(self, word):
        if not len(self.split):
            return np.zeros(len(word), bool)
        return self.split[np.minimum(np.searchsorted(self.split, word), len(self.split) - 1)] == word

    def bucket(self, word, code):
        out, wide = self.home(word), self.is_split(word)
        out[wide] = (flat.mix(code[wide] + _STEP) % np.uint64(self.buckets)).astype(np.int64)
        return out


def _short(h: np.ndarray, size: int) -> np.ndarray:
    """The high bytes of hashes: what is sorted stays sorted."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].ravel()


def _long(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view("<u8").ravel()


def pieces(bucket: np.ndarray):
    """(bucket, from, to) of the runs of a sorted array."""
    found, first = np.unique(bucket, return_index=True)
    return zip(found.tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist())


_ROW = "dest long, source long, kind int, blob binary, sums array<double>"
_NAMES = ["dest", "source", "kind", "blob", "sums"]
STATE, TABLES, WORDS, TOTALS, DISHES, ONCE = range(6)
_WORD_BYTES, PAIR_BYTES = 6, 5  # of a hash travel; the bucket says some more


def _table(rows) -> pa.Table:
    """Rows (dest, source, kind, blob, sums) in the form of ``_ROW``."""
    cols = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64())]
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=_NAMES)


def _batches(rows, bytes_: int = 4 << 20):
    """Arrow batches of about so many bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= bytes_:
            yield from _table(held).to_batches()
            held, size = [], 0
    if held:
        yield from _table(held).to_batches()


def _frequent(batches):
    """(word, n): the words of more than half of 1 / SPLIT of this task's tokens; word null: all its tokens, and its
    texts and bytes."""
    parts, n, docs, size = [], 0, 0, 0

    def merged():
        code, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        code, _, place, _ = flat.distinct(code)
        return code, np.bincount(place, count, len(code)).astype(np.int64)

    for batch in batches:
        for _, data, offs in flat.text_blocks(batch.column(0)):
            low = flat.LOWER[data]
            starts, ends, _ = flat.words(low, offs, flat.NONSPACE)
            word = np.append(flat.span_hash(flat.prefix(low), starts, ends), np.full(len(offs) - 1, END))
            code, _, _, count = flat.distinct(word)
            parts.append((code, count))
            n, docs, size = n + len(word), docs + len(offs) - 1, size + len(data)
            if len(parts) >= 16:
                parts = [merged()]
    if parts:
        code, count = merged()
        often = count * 2 * SPLIT > n
        yield pa.RecordBatch.from_arrays(
            [pa.array([None] * 3 + code[often].view(np.int64).tolist(), pa.int64()), pa.array([0, 1, 2] + [3] * int(often.sum()), pa.int32()), pa.array([n, docs, size, *count[often].tolist()], pa.int64())],
            names=["word", "what", "n"],
        )


def _count(deal: Deal, group_bytes: int):
    """Packed distinct words and pairs of about ``group_bytes`` of text at a time, one row a bucket."""

    def packed(parts):
        word, before = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        code, first, _, count = flat.distinct(pair_hash(word, before))
        word, before = word[first], before[first]
        names, at, rank, _ = flat.distinct(word)
        at = first[at]
        bucket = deal.bucket(word, code)
        order = np.argsort((bucket << 40) | rank)
        bucket, rank, before, count = bucket[order], rank[order], before[order], count[order]
        # The bytes of each name, from the chunk where it stands.
        lows, starts, ends, base = [], [], [], 0
        for low, _, _, s, e in parts:
            lows.append(low)
            starts.append(s + base)
            ends.append(e + base)
            base += len(low)
        data, offs = take(np.concatenate(lows), np.concatenate(starts)[at], np.concatenate(ends)[at])
        for b, lo, hi in pieces(bucket):
            new = np.flatnonzero(np.append(True, rank[lo + 1 : hi] != rank[lo : hi - 1]))
            own = rank[lo:hi][new]
            raw, ends = take(data, offs[own], offs[own + 1])
            yield b, -1, WORDS, dump(names[own], np.diff(ends).astype(np.uint32), raw, np.diff(np.append(new, hi - lo)).astype(np.uint32), before[lo:hi], count[lo:hi].astype(np.uint32)), None

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for _, data, offs in flat.text_blocks(batch.column(0)):
                low, word, before, _, s, e = tokens(data, offs)
                parts.append((low, word, before, s, e))
                size += len(data) + 64 * len(offs)
                if size >= group_bytes:
                    yield from _batches(packed(parts))
                    parts, size = [], 0
        if parts:
            yield from _batches(packed(parts))

    return run


class State:
    """A bucket. Home words: hash, count, pairs seen once, kinds of pairs, and as contexts the kept customers and
    tables; customers and tables in the parent; log spelling. Kept pairs by dish: word before, count, tables."""

    KINDS = "u8 i8 i8 i8 i8 f8 f8 f8 f4 f4 f4 u4 u1 u8 u4 u8 u4 u4 f4"
    FIELDS = "word n once kinds kept tables c0 t0 spelt p0 back size letters dish run before count t own".split()

    def __init__(self, blob=None, **fields):
        for name, value in zip(self.FIELDS, load(blob, self.KINDS)) if blob is not None else fields.items():
            setattr(self, name, value)

    def dump(self) -> bytes:
        return dump(*[np.asarray(getattr(self, f), k) for f, k in zip(self.FIELDS, self.KINDS.split())])

    def contexts(self, deal: Deal):
        """(contexts of kept pairs in order of home and hash, their homes, place of every pair's context)."""
        own, _, place, _ = flat.distinct(self.before)
        home = deal.home(own)
        order = np.argsort(home, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return own[order], home[order], back[place]


def _gathered(deal: Deal, single: bool = False):
    """Count a bucket's pairs; tell homes the customers of contexts and the parts of split words. With ``single`` also the
    hashes of the pairs seen once, in order."""

    def run(table: pa.Table) -> pa.Table:
        dest = table["dest"][0].as_py()
        parts = [load(b.as_buffer(), "u8 u4 u1 u4 u8 u4") for b in table["blob"]]
        names, first, inverse, _ = flat.distinct(np.concatenate([p[0] for p in parts]))
        size = np.concatenate([p[1] for p in parts]).astype(np.int64)
        ends = np.cumsum(size)
        letters, _ = take(np.concatenate([p[2] for p in parts]), (ends - size)[first], ends[first])
        size = size[first]
        word = np.repeat(inverse, np.concatenate([p[3] for p in parts]))
        before, count = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        del parts
        code = pair_hash(names[word], before)
        code, first, inverse, _ = flat.distinct(code)
        count = np.bincount(inverse, count, len(code)).astype(np.int64)
        word, before = word[first], before[first]
        k = len(names)
        n, kinds = np.bincount(word, count, k).astype(np.int64), np.bincount(word, minlength=k)
        once = np.bincount(word[count == 1], minlength=k)
        sums = [float((count == 1).sum()), float((count == 2).sum())]
        keep = np.flatnonzero(count > 1)
        keep = keep[np.argsort(word[keep], kind="stable")]
        lone = [(dest, -1, ONCE, _short(code[count == 1], PAIR_BYTES).tobytes(), None)] if single else []
        word, before, count = word[keep], before[keep], count[keep]
        dish, run_ = np.unique(word, return_counts=True)
        wide = deal.is_split(names)
        rows = []
        if wide.any():
            at, ends = np.flatnonzero(wide), np.cumsum(size)
            order = np.argsort(deal.home(names[at]), kind="stable")
            at = at[order]
            for b, lo, hi in pieces(deal.home(names[at])):
                own = at[lo:hi]
                raw, _ = take(letters, (ends - size)[own], ends[own])
                rows.append((b, dest, WORDS, dump(names[own], size[own].astype(np.uint32), raw, n[own], once[own], kinds[own]), None))
        at, ends = np.flatnonzero(~wide), np.cumsum(size)
        zero = np.zeros(len(at))
        state = State(
            word=names[at], n=n[at], once=once[at], kinds=kinds[at], kept=zero, tables=zero, c0=zero, t0=zero, spelt=zero, p0=zero, back=zero,
            size=size[at], letters=take(letters, (ends - size)[at], ends[at])[0], dish=names[dish], run=run_, before=before, count=count, t=np.ones(len(count)), own=np.zeros(len(count)),
        )
        own, home, place = state.contexts(deal)
        kept = np.bincount(place, count, len(own)).astype(np.int64)
        rows += [(b, dest, TABLES, dump(own[lo:hi], kept[lo:hi].astype(np.float64), np.bincount(place, minlength=len(own))[lo:hi].astype(np.float64)), None) for b, lo, hi in pieces(home)]
        return _table([(dest, -1, STATE, state.dump(), sums), *rows, *lone])

    return run


def _mine(table: pa.Table, kind: int):
    """(source, blob) of the messages of a kind."""
    kinds = table["kind"].to_numpy()
    for i in np.flatnonzero(kinds == kind).tolist():
        yield table["source"][i].as_py(), table["blob"][i].as_buffer()


def _empty() -> State:
    return State(**{f: np.zeros(0, k) for f, k in zip(State.FIELDS, State.KINDS.split())})


def _settled(deal: Deal, docs: int, first: bool, root, kept: bool, spelling=None):
    """Homes: add up contexts' tables and split words, seat the parent (not at first), and answer."""

    def run(table: pa.Table) -> pa.Table:
        dest = table["dest"][0].as_py()
        held = [b for _, b in _mine(table, STATE)]
        x = State(held[0]) if held else _empty()
        tables, words = list(_mine(table, TABLES)), [(s, load(b, "u8 u4 u1 i8 i8 i8" if first else "u8 f8")) for s, b in _mine(table, WORDS)]
        if first:
            parts = [(x.word, x.size, x.letters, x.n, x.once, x.kinds), *[p for _, p in words]]
            if dest == int(deal.home(np.array([START]))[0]):
                one = np.zeros(1, np.int64)
                parts.append((np.array([START]), one, np.zeros(0, np.uint8), one + docs, one, one))
            x.word, at, inverse, _ = flat.distinct(np.concatenate([p[0] for p in parts]))
            size = np.concatenate([p[1] for p in parts]).astype(np.int64)
            ends = np.cumsum(size)
            x.letters, x.size = take(np.concatenate([p[2] for p in parts]), (ends - size)[at], ends[at])[0], size[at]
            x.n, x.once, x.kinds = (np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(x.word)).astype(np.int64) for k in (3, 4, 5))
            x.kept, x.tables, x.c0, x.t0, x.spelt, x.p0, x.back = (np.zeros(len(x.word)) for _ in range(7))
        some = x.word != START
        totals, tables_of = np.zeros(len(x.word)), []
        for source, blob in tables:
            before, *values = load(blob, "u8 f8 f8" if first else "u8 f8")
            at = np.searchsorted(x.word, before)
            if first:
                x.kept[at] += values[0]
            totals[at] += values[-1]
            tables_of.append((source, at))
        x.tables = totals
        once = x.n - x.kept  # of contexts: customers of pairs seen once, each at a table
        if first:
            x.c0, x.t0 = np.where(some, x.kinds, 0).astype(float), np.where(some, 1.0, 0.0)
            sums = [float(some.sum()), float(x.n[some].sum()), float((x.c0 == 1).sum()), float((x.c0 == 2).sum()), x.c0.sum(), x.t0.sum(), 0.0]
        else:
            if len(x.letters):
                offs = np.concatenate([[0], np.cumsum(x.size.astype(np.int64))])
                x.spelt, x.letters, x.size, x.kinds = np.where(some, spelling.value.log_prob(x.letters, offs), -1e9), *[np.zeros(0, np.uint8)] * 3
            x.c0 = x.c0.copy()
            for _, (word, tables_in) in words:
                x.c0[np.searchsorted(x.word, word)] += tables_in
            base = np.exp(np.maximum(x.spelt, -700)) * some
            seeds = flat.mix(x.word + np.uint64(root["sweep"]))
            x.t0 = seat(x.c0.astype(np.int64), root["d0"], root["t0"] - x.t0, base, seeds) * some
            sums = [0.0, 0.0, 0.0, 0.0, x.c0.sum(), x.t0.sum(), base.sum()]
            if kept:
                x.back = x.back + (STRENGTH + root["d1"] * x.tables + root["lone"] * once) / (STRENGTH + x.n)
        rows = [(source, dest, TOTALS, dump((x.tables + once)[at], x.n[at].astype(float)), None) for source, at in tables_of]
        for source, (word, *_) in words:
            at = np.searchsorted(x.word, word)
            rows.append((source, dest, DISHES, dump(word, x.c0[at], x.t0[at], x.spelt[at].astype(float), x.n[at].astype(float)), None))
        return _table([(dest, -1, STATE, x.dump(), sums), *rows])

    return run


def _parent(c0, t0, spelt, n, root):
    """Probability of dishes in the parent (before the first sweep: their share of the tokens)."""
    if root["first"]:
        return n / (root["n"] + 1.0)
    return (c0 - root["d0"] * t0 + (STRENGTH + root["d0"] * root["t0"]) * np.exp(np.maximum(spelt, -700))) / (STRENGTH + root["c0"])


def _seated(deal: Deal, root, kept: bool):
    """Buckets: seat all pairs anew given the totals, and tell homes the tables."""

    def run(table: pa.Table) -> pa.Table:
        dest = table["dest"][0].as_py()
        x = State(next(_mine(table, STATE))[1])
        own, home, place = x.contexts(deal)
        answers = [load(b, "f8 f8") for _, b in sorted(_mine(table, TOTALS), key=lambda m: m[0])]
        tables, customers = (np.concatenate([a[k] for a in answers] or [np.zeros(0)])[place] for k in (0, 1))
        names, values = [x.word], [_parent(x.c0, x.t0, x.spelt, x.n, root)]
        for _, b in _mine(table, DISHES):
            word, c0, t0, spelt, n = load(b, "u8 f8 f8 f8 f8")
            names.append(word)
            values.append(_parent(c0, t0, spelt, n, root))
        if not root["first"] and root["kept"]:
            x.p0 = x.p0 + values[0]
        names, values = np.concatenate(names), np.concatenate(values)
        order = np.argsort(names)
        p0 = values[order][np.searchsorted(names[order], x.dish)] if len(x.dish) else np.zeros(0)
        dish = np.repeat(np.arange(len(x.dish)), x.run)
        seeds = pair_hash(x.dish[dish], x.before) + np.uint64(100_003 * (root["sweep"] + 1))
        x.t = seat(x.count.astype(np.int64), root["d1"], tables - x.t, p0[dish], seeds)
        if kept:
            x.own = x.own + (x.count - root["d1"] * x.t) / (STRENGTH + customers)
        inside = np.bincount(dish, x.t, len(x.dish))
        x.c0 = np.where(x.word != START, x.once, 0).astype(float)
        wide = deal.is_split(x.dish)
        x.c0[np.searchsorted(x.word, x.dish[~wide])] += inside[~wide]
        sent = np.bincount(place, x.t, len(own))
        rows = [(b, dest, TABLES, dump(own[lo:hi], sent[lo:hi]), None) for b, lo, hi in pieces(home)]
        # Words without a kept pair here ask too: every split word of the bucket must know its parent's answer.
        at = np.flatnonzero(wide)
        at = at[np.argsort(deal.home(x.dish[at]), kind="stable")]
        rows += [(b, dest, WORDS, dump(x.dish[at[lo:hi]], inside[at[lo:hi]]), None) for b, lo, hi in pieces(deal.home(x.dish[at]))]
        return _table([(dest, -1, STATE, x.dump(), None), *rows])

    return run


def _finished(root, sweeps: int, single: bool = False):
    """A bucket of the model: words (hash, count, parent probability, back-off weight as a context) and kept pairs
    (hash, own part), sorted by hash; averages over the kept sweeps. Then the pairs seen once, where the model has them."""

    def run(table: pa.Table) -> pa.Table:
        dest = table["dest"][0].as_py()
        x = State(next(_mine(table, STATE))[1])
        p0 = (x.p0 + _parent(x.c0, x.t0, x.spelt, x.n, root)) / sweeps
        n = np.where(x.word == START, 0, x.n)
        code = pair_hash(x.dish[np.repeat(np.arange(len(x.dish)), x.run)], x.before)
        order = np.argsort(code)
        lone = [b"".join(memoryview(b) for _, b in _mine(table, ONCE))] if single else []  # at most one
        return _table([(dest, -1, STATE, dump(x.word, n, p0.astype(np.float32), (x.back / sweeps).astype(np.float32), code[order], (x.own[order] / sweeps).astype(np.float32), *[np.frombuffer(b, np.uint8) if b else np.zeros(0, np.uint8) for b in lone]), None)])

    return run


def _spelling_counts(batches):
    """Byte triples of the home words, each word once."""
    for batch in batches:
        for blob in batch.column(0):
            x = State(blob.as_buffer())
            some = np.repeat(x.word != START, x.size)
            offs = np.concatenate([[0], np.cumsum(x.size[x.word != START].astype(np.int64))])
            code, _ = triples(x.letters[some], offs)
            code, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


class Model:
    """The buckets as a table, how words are dealt, the spelling model, and what all restaurants share; ``lone``: the customers
    that a pair seen once leaves for its own part (None: those pairs are not in the buckets); ``docs``: training texts."""

    def __init__(self, buckets: DataFrame | None, deal: Deal, spelling: Spelling, n: int, v: int, new: float, others: float, lone: float | None = None, docs: int = 0):
        self.buckets, self.deal, self.spelling, self.n, self.v, self.new, self.others, self.lone, self.docs = buckets, deal, spelling, n, v, new, others, lone, docs

    def forget(self) -> None:
        """Remove the buckets; what ``score`` has returned does not read them."""
        flat.forget(self.buckets)

    def shared(self) -> Model:
        return Model(None, self.deal, self.spelling, self.n, self.v, self.new, self.others, self.lone, self.docs)


def fit(training: DataFrame, text: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN, bucket: int = BUCKET_BYTES, often: int = 4096, once: bool = False) -> Model:
    """The model of all training texts. A word is only split if it occurs more than ``often`` times. ``once``: pairs seen
    once have their own part of the prediction, too."""
    spark = training.sparkSession
    texts = training.select(text)
    flat.shared_folder(spark)
    seen = texts.mapInArrow(flat.tidy(_frequent), "word long, what int, n long").groupBy("word", "what").agg(F.sum("n").alias("n"))
    seen = flat.saved(seen)
    n, docs, size = ({r.what: r.n for r in seen.filter("word is null").collect()}.get(k, 0) for k in range(3))
    split = seen.filter(F.col("word").isNotNull() & (F.col("n") > max(often, n // SPLIT))).select("word").toArrow()["word"].to_numpy()
    deal = Deal(max(1, -(-size // bucket)), split.view(np.uint64))

    def exchange(rows: DataFrame, step, old=None) -> DataFrame:
        new = flat.saved(rows.groupBy("dest").applyInArrow(flat.trimmed(step), _ROW), "zstd")
        if old is not None:
            flat.forget(old)
        return new

    def added(world: DataFrame, k: int) -> list[float]:
        return [r or 0.0 for r in world.filter("sums is not null").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(k)]).first()]

    world = exchange(texts.mapInArrow(flat.tidy(_count(deal, COUNT_BYTES)), _ROW), _gathered(deal, once))
    ones, twos = added(world, 2)
    lone = flat.saved(world.filter(F.col("kind") == ONCE), "zstd") if once else None
    world = exchange(world.filter(F.col("kind") != ONCE), _settled(deal, docs, True, None, False), world)
    v, tokens_, ones0, twos0, c0, t0, _ = added(world, 7)
    counts = world.filter(F.col("kind") == STATE).select("blob").mapInArrow(_spelling_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    spelling = Spelling(counts["code"].to_numpy(), counts["n"].to_numpy())
    held = spark.sparkContext.broadcast(spelling)
    root = {"first": True, "n": tokens_, "d1": discount(ones, twos), "d0": discount(ones0, twos0), "c0": c0, "t0": t0, "kept": False, "lone": discount(ones, twos) if once else 1.0}
    new, known, total = [], 0.0, max(1, sweeps - burn_in)
    for sweep in range(sweeps):
        root["sweep"], kept = sweep, sweep >= burn_in
        world = exchange(world, _seated(deal, dict(root), kept), world)
        world = exchange(world, _settled(deal, docs, False, dict(root), kept, held), world)
        *_, c0, t0, known = added(world, 7)
        root |= {"first": False, "c0": c0, "t0": t0, "kept": kept}
        if kept:
            new.append((STRENGTH + root["d0"] * t0) / (STRENGTH + c0))
    last = world.filter(F.col("kind") == STATE)
    done = exchange(last.unionByName(lone) if once else last, _finished(root, total, once), world)
    if once:
        flat.forget(lone)
    held.destroy()
    return Model(done, deal, spelling, int(tokens_), int(v), float(np.mean(new)) if new else 1.0, max(1.0 - known, 1e-12), 1.0 - root["lone"] if once else None, int(docs))


# --- scores -----------------------------------------------------------------------------------------------------

class _Block:
    """The texts of a block: its distinct words (the start too) and pairs, in order of bucket and hash; the numbers of each
    pair's word and context, and the number of each token's pair."""

    def __init__(self, deal: Deal, word: np.ndarray, before: np.ndarray):
        code, self.first, self.pair, _ = flat.distinct(pair_hash(word, before))
        own, context = word[self.first], before[self.first]
        names, _, number, _ = flat.distinct(np.append(own, START))
        self.start, self.word = number[-1], number[:-1]
        self.context = np.where(context == START, self.start, self.word[self.pair[self.first - 1]])
        home, bucket = deal.home(names), deal.bucket(own, code)
        self.by_home, self.by_bucket = np.argsort(home, kind="stable"), np.argsort(bucket, kind="stable")
        self.words, self.home, self.pairs, self.bucket = names[self.by_home], home[self.by_home], code[self.by_bucket], bucket[self.by_bucket]

    @staticmethod
    def back(values: np.ndarray, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(values), float)
        out[order] = values
        return out


def _asked(deal: Deal, block_at: int, text_at: int):
    """One row (bucket, block) with the words and pairs that the block needs of the bucket."""

    def requests(b, parts):
        x = _Block(deal, *(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        dests = np.unique(np.concatenate([x.home, x.bucket]))
        (a, b_), (c, d) = ([np.searchsorted(v, dests, side) for side in ("left", "right")] for v in (x.home, x.bucket))
        for k, dest in enumerate(dests.tolist()):
            yield dest, b, WORDS, dump(_short(x.words[a[k] : b_[k]], _WORD_BYTES), _short(x.pairs[c[k] : d[k]], PAIR_BYTES)), None

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(block_at).to_numpy()
            for b in np.unique(ids).tolist():
                for _, data, offs in flat.text_blocks(batch.column(text_at).filter(pa.array(ids == b))):
                    held.setdefault(b, []).append(tokens(data, offs)[1:3])
        for b in list(held):
            yield from _batches(requests(b, held.pop(b)))

    return run


def _find(keys: np.ndarray, wanted: np.ndarray):
    """Places of the wanted high bytes among keys (sorted by them), -1 where there are none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _parts(part: np.ndarray) -> list[np.ndarray]:
    """Own parts of pairs (0: none, -1: that of a pair seen once) as their number, two bits for each, and the others."""
    return [np.array([len(part)], np.uint32), np.packbits(part > 0), np.packbits(part < 0), part[part > 0]]


def _unparted(n: np.ndarray, stored: np.ndarray, lone: np.ndarray, values: np.ndarray) -> np.ndarray:
    part = -np.unpackbits(lone, count=int(n[0])).astype(np.float32)
    part[np.unpackbits(stored, count=int(n[0])).astype(bool)] = values
    return part


def _answered(single: bool):
    """Per asked word: count, parent probability, back-off weight; per asked pair: its own part (see ``_parts``)."""
    kinds = "u8 i8 f4 f4 u8 f4 u1" if single else "u8 i8 f4 f4 u8 f4"

    def run(asked: pa.Table, bucket: pa.Table) -> pa.Table:
        names, n, p0, back, code, own, *lone = load(bucket["blob"][0].as_buffer(), kinds) if len(bucket) else [np.zeros(0, k) for k in kinds.split()]
        names, code = names >> np.uint64(64 - 8 * _WORD_BYTES), code >> np.uint64(64 - 8 * PAIR_BYTES)
        n, p0, back, own = np.append(n, 0), np.append(p0, 0), np.append(back, np.float32(1)), np.append(own, 0)  # -1 reads the last
        lone = [_long(x, PAIR_BYTES) for x in lone]
        rows = []
        for i, blob in enumerate(asked["blob"]):
            words, pairs = load(blob.as_buffer(), "u1 u1")
            w, pairs = _find(names, _long(words, _WORD_BYTES)), _long(pairs, PAIR_BYTES)
            p = _find(code, pairs)
            part = own[p].astype(np.float32)
            for x in lone:
                part[(p < 0) & (_find(x, pairs) >= 0)] = -1
            rows.append((asked["source"][i].as_py(), asked["dest"][0].as_py(), TOTALS, dump(n[w], p0[w].astype(np.float32), back[w].astype(np.float32), *_parts(part)), None))
        return _table(rows)

    return run


def _score(held, text_at: int, names: list[str], kept: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        m, parts, n = held.value, [], 0
        for chunk in docs.column(text_at).chunks:
            for _, data, offs in flat.text_blocks(chunk):
                low, word, before, doc, s, e = tokens(data, offs)
                parts.append((low, word, before, doc + n, s, e))
                n += len(offs) - 1
        x = _Block(m.deal, *(np.concatenate([p[k] for p in parts]) for k in (1, 2)))
        told = [load(answers["blob"][i].as_buffer(), "i8 f4 f4 u4 u1 u1 f4") for i in np.argsort(answers["dest"].to_numpy())]
        count, p0, back = (x.back(np.concatenate([t[k] for t in told]), x.by_home) for k in range(3))
        own = x.back(np.concatenate([_unparted(*t[3:]) for t in told]), x.by_bucket)
        number, context = x.word, x.context
        once = np.flatnonzero(own < 0)
        customers = np.where(context[once] == x.start, m.docs, count[context[once]])
        own[once] = (m.lone or 0.0) / (STRENGTH + customers)
        c, p = count[number], p0[number]
        fresh = np.flatnonzero(c == 0)
        p[fresh] = m.new * m.others
        log_p = np.log10(own + back[context] * p)
        spelled, spelt = np.zeros(len(p)), np.zeros(len(count))
        at = 0
        for low, word, _, _, s, e in parts:  # each unknown word of the chunk once
            own_number = x.word[x.pair[at : at + len(word)]]
            at += len(word)
            new, place = np.unique(own_number[count[own_number] == 0], return_index=True)
            if len(new):
                place = np.flatnonzero(count[own_number] == 0)[place]
                spelt[new] = m.spelling.log_prob(*take(low, s[place], e[place]))
        spelled[fresh] = spelt[number[fresh]] / np.log(10) - np.log10(m.others)
        base = np.log10((c + 1) / (m.n + m.v + 1))
        doc = np.concatenate([p_[3] for p_ in parts])
        sums = [np.bincount(doc, v[x.pair], n) for v in ((c > 0).astype(float), base, log_p, log_p + spelled)]
        out = [pa.array(np.bincount(doc, minlength=n)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, m.n), pa.int64()), *[pa.array(v) for v in sums[1:]]]
        return pa.table([*[docs.column(k) for k in range(kept)], *out], names=names)

    return run


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """Documents with n_tokens, n_known, train_tokens, base_score, score and spelled_score."""
    docs = flat.unclash(docs, (*OUTPUTS, "__t", "__block", "__k1", "__k2"))
    keep = docs.columns if keep is None else keep
    kept = [f"`{c}`" for c in keep]
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(*kept, body.alias("__t"), *[k.alias(f"__{x}") for k, x in zip(flat.text_key(body), ("k1", "k2"))])
    each = flat.saved(keyed.groupBy("__k1", "__k2").agg(F.count("*").alias("n"), F.max(F.octet_length("__t") + F.lit(64)).alias("size")))
    sizes = each.agg(F.sum(F.col("n") * F.col("size")), F.sum("n")).first()
    many = each.filter(F.col("n") > F.lit(max(64, (sizes[1] or 0) // SPLIT))).select("__k1", "__k2")  # at most SPLIT texts
    if many.isEmpty():
        return _scored(keyed, model, keep, sizes[0] or 0, block)
    often = F.broadcast(many)
    single = keyed.join(often, ["__k1", "__k2"], "left_anti").select(*keyed.columns)
    copied = keyed.join(often, ["__k1", "__k2"])
    once = flat.saved(copied.groupBy("__k1", "__k2").agg(F.first("__t").alias("__t")))
    size = once.agg(F.sum(F.octet_length("__t"))).first()[0]
    each = _scored(once, model, ["__k1", "__k2"], size or 0, block)
    rest = _scored(single, model, keep, sizes[0] or 0, block)
    return rest.unionByName(copied.select(*kept, "__k1", "__k2").join(F.broadcast(each), ["__k1", "__k2"]).select(*kept, *OUTPUTS))


def _scored(keyed: DataFrame, model: Model, keep: list[str], size: int, block: int) -> DataFrame:
    spark = keyed.sparkSession
    blocks = max(1, -(-int(size) // block))
    placed = keyed.select(*[f"`{c}`" for c in keep], "__t", F.pmod(F.xxhash64("__k1", "__k2"), F.lit(blocks)).cast("long").alias("__block"))
    dealt = placed.repartition(blocks, "__block")
    text_at, answers = len(keep), None
    passes = min(PASSES, blocks)
    for k in range(passes):  # every block in one pass; a pass's shuffle files go before the next one's are written
        own = placed.filter(F.col("__block") % passes == k).select("__t", "__block").repartition(-(-blocks // passes), "__block")
        asked = own.mapInArrow(flat.tidy(_asked(model.deal, 1, 0)), _ROW)
        told = asked.groupBy("dest").cogroup(model.buckets.select("dest", "blob").groupBy("dest")).applyInArrow(flat.trimmed(_answered(model.lone is not None)), _ROW)
        part = flat.saved(told.withColumnRenamed("source", "__s").select(F.col("dest").alias("__block"), F.col("__s").alias("dest"), "blob"), "zstd")
        answers = part if answers is None else answers.unionByName(part)
    flat.release(spark)
    fields = [T.StructField(x, T.LongType()) for x in OUTPUTS[:3]] + [T.StructField(x, T.DoubleType()) for x in OUTPUTS[3:]]
    schema = T.StructType([keyed.schema[c] for c in keep] + fields)
    held = spark.sparkContext.broadcast(model.shared())
    return dealt.groupBy("__block").cogroup(answers.groupBy("__block")).applyInArrow(flat.trimmed(_score(held, text_at, [f.name for f in schema], len(keep))), schema)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.filter(~held_out("doc_id", 7, 2)), once=True)
    found = score(docs, model, keep=["doc_id"])
    model.forget()
    return found.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), *OUTPUTS)
