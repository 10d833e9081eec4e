"""Orders of hashes that the language model rests on."""

import numpy as np

from quire.llm import flat, lmscore


def test_distinct_hashes_however_alike_their_high_bits():
    rng = np.random.default_rng(3)
    for codes in (flat.mix(rng.integers(0, 900, 5_000).astype(np.uint64)), rng.integers(0, 900, 5_000).astype(np.uint64), np.zeros(0, np.uint64)):
        values, place, number, count = flat.distinct(codes)
        want, many = np.unique(codes, return_counts=True)
        assert (values == want).all() and (count == many).all()
        assert (codes[place] == values).all() and (values[number] == codes).all()


def test_what_is_asked_of_a_bucket_is_in_order():
    codes = np.sort(flat.mix(np.arange(1_000, dtype=np.uint64)))
    sent = lmscore._long(lmscore._short(codes, lmscore.PAIR_BYTES), lmscore.PAIR_BYTES)
    assert (sent[1:] >= sent[:-1]).all() and (sent == codes >> np.uint64(64 - 8 * lmscore.PAIR_BYTES)).all()
