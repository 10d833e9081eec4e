"""Words of scripts without spaces: the best path over a dictionary.

An automaton over all dictionary words (failure links, so a text is read once) gives every word that ends at each place; the
path of least cost through them cuts the text. A word costs ``-log`` of its share of all counts; a character that stands in no chosen word
costs more than any word, and characters like it next to each other are one word.

Cases: null texts give null, empty ones no word. Equal words in the dictionary add their counts; null, empty and uncounted
ones are left out. Of paths of equal cost the one whose last word is longest wins, at every place. White space and
punctuation belong to no word and end one."""

from __future__ import annotations

import math

import ahocorasick
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import kernel

#: Characters of all dictionary words together that one automaton may hold.
DICTIONARY_CHARS = 32 << 20
_RUN = regex.compile(r"[\p{L}\p{M}\p{N}]+")


class Dictionary:
    """Words with their costs."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values())
        self.automaton = ahocorasick.Automaton()
        for word, n in counts.items():
            self.automaton.add_word(word, (len(word), -math.log(n / total)))
        if counts:
            self.automaton.make_automaton()
        self.unknown = 2.0 + max((-math.log(n / total) for n in counts.values()), default=0.0)

    def cut(self, run: str) -> list[int]:
        """Starts of the words of a run of letters."""
        n = len(run)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for end, word in self.automaton.iter(run):
                ending[end + 1].append(word)
        best, last = [0.0] + [math.inf] * n, [0] * (n + 1)  # last: length of the last word; 0 for an unknown character
        for end in range(1, n + 1):
            best[end] = best[end - 1] + self.unknown
            for size, cost in sorted(ending[end]):
                if best[end - size] + cost <= best[end]:
                    best[end], last[end] = best[end - size] + cost, size
        starts, at = [], n
        while at:
            known = last[at]
            at -= known or 1
            if known or not at or last[at]:  # unknown characters side by side are one word
                starts.append(at)
        return starts[::-1]

    def starts(self, text: str) -> list[int]:
        return [m.start() + s for m in _RUN.finditer(text) for s in self.cut(m[0])]


def dictionary_of(words: DataFrame, word: str, count: str, most: int = DICTIONARY_CHARS) -> Dictionary:
    """The dictionary of (word, count) rows; its size is checked before anything is collected."""
    own = words.filter(F.col(word).isNotNull() & (F.col(word) != "") & (F.col(count) > 0)).groupBy(F.col(word).alias("w")).agg(F.sum(count).alias("n"))
    chars = own.agg(F.sum(F.length("w"))).first()[0] or 0
    if chars > most:
        raise ValueError(f"the dictionary has {chars} characters, more than {most}")
    return Dictionary({r.w: r.n for r in own.collect()})


def word_starts(words: DataFrame, word: str, count: str, most: int = DICTIONARY_CHARS):
    """A column function: starts of the words (characters from 0) of a text, by the dictionary of (word, count) rows."""
    held = words.sparkSession.sparkContext.broadcast(dictionary_of(words, word, count, most))  # of a checked size
    found = kernel(lambda text: held.value.starts(text), T.ArrayType(T.IntegerType()))
    return lambda text: found(text)


def cut_words(text: Column, starts: Column) -> Column:
    """The words that begin at ``starts``, each up to the next one or to what is no letter."""
    stop = lambda i: F.coalesce(F.get(starts, i + 1), F.length(text))
    return F.transform(starts, lambda s, i: F.regexp_extract(F.substring(text, s + 1, stop(i) - s), r"^[\p{L}\p{M}\p{N}]+", 0))
