"""Words of texts without spaces: the best path against all paths, generated Thai and Chinese text, hard rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import words as W

THAI = ["ฉัน", "รัก", "ภาษา", "ไทย", "ภาษาไทย", "มาก", "กิน", "ข้าว", "ตาก", "ลม", "ตา", "กลม"]
CHINESE = ["我", "喜欢", "读书", "读", "书", "图书馆", "图书", "馆", "北京", "大学", "北京大学", "大学生", "生", "前来"]


def all_paths(run: str, counts: dict[str, int], unknown: float) -> float:
    """Least cost over every way to cut the run."""
    total, best = sum(counts.values()), math.inf
    for cuts in itertools.product([False, True], repeat=max(0, len(run) - 1)):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        cost = 0.0
        for a, b in zip(edges, edges[1:]):
            part = run[a:b]
            cost += -math.log(counts[part] / total) if part in counts else unknown if b - a == 1 else math.inf
        best = min(best, cost)
    return best


@pytest.mark.parametrize("vocabulary", [THAI, CHINESE, ["a", "ab", "abc", "b", "bc", "ca"]])
def test_path_is_the_best_of_all(vocabulary):
    rng = random.Random(5)
    for _ in range(60):
        counts = {w: rng.randrange(1, 50) for w in rng.sample(vocabulary, rng.randrange(1, len(vocabulary)))}
        book = W.Dictionary(counts)
        run = "".join(rng.choice([*vocabulary, "x", "z"]) for _ in range(4))[:12]
        starts = book.cut(run)
        edges, total, cost = [*starts, len(run)], sum(counts.values()), 0.0
        for a, b in zip(edges, edges[1:]):
            cost += -math.log(counts[run[a:b]] / total) if run[a:b] in counts else book.unknown * (b - a)
        assert starts[0] == 0 and math.isclose(cost, all_paths(run, counts, book.unknown)), (run, counts, starts)


def test_generated_texts_are_cut_at_their_words(spark):
    rng = random.Random(6)
    plain = [w for w in [*THAI, *CHINESE] if w not in ("ตาก", "ลม", "ตา", "กลม", "生", "前来", "大学生")]
    made = [[rng.choice(plain) for _ in range(rng.randrange(1, 200))] for _ in range(30)]
    counts = {w: 100 * len(w) ** 3 for w in plain}
    dictionary = spark.createDataFrame([*counts.items(), (None, 3), ("", 3), ("ไทย", 0)], "word string, n long")
    rows = [(i, "".join(m)) for i, m in enumerate(made)] + [(100, None), (101, ""), (102, "。 !?"), (103, "我 喜欢,读书。xyz我"), (104, "ไทย" * 20_000)]
    starts = W.word_starts(dictionary, "word", "n")
    got = {r.id: r for r in spark.createDataFrame(rows, "id long, text string").select("id", "text", starts(F.col("text")).alias("s")).select("id", "s", W.cut_words(F.col("text"), F.col("s")).alias("w")).collect()}
    right = total = 0
    for i, m in enumerate(made):
        want = set(itertools.accumulate([0, *map(len, m[:-1])]))
        right, total = right + len(want & set(got[i].s)), total + len(want)
    assert right > 0.9 * total  # words that are also two words side by side are read as one
    assert (got[100].s, got[101].s, got[102].s) == (None, [], [])
    assert got[103].w == ["我", "喜欢", "读书", "xyz", "我"] and len(got[104].s) == 20_000
    with pytest.raises(ValueError):
        W.word_starts(dictionary, "word", "n", most=3)
    none = W.word_starts(dictionary.limit(0), "word", "n")
    assert spark.range(1).select(none(F.lit("ab c")).alias("s")).first().s == [0, 3]
