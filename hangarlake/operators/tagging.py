"""A sequence tagger: hidden Markov chain of tags, counted in one aggregation each, decoded row by row in Arrow batches."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different (tag, word) pairs of a model at most; it goes to every executor.
PAIRS = 500_000


def word_class(word: str) -> str:
    """What an unknown word looks like."""
    if any(ch.isdigit() for ch in word):
        return "<digits>"
    return "<signs>" if not any(ch.isalpha() for ch in word) else f"<{word[-2:]}>" if len(word) > 4 else "<short>"


class Tagger:
    """Transitions with add-one counts; a word's emissions by its own counts, an unknown one's by those of its class."""

    def __init__(self, transitions: list[tuple[str, str, int]], emissions: list[tuple[str, str, int]]):
        self.tags = sorted({t for _, t, _ in transitions} | {"O"})
        place = {t: i for i, t in enumerate(self.tags)}
        moves = np.ones((len(self.tags) + 1, len(self.tags)))
        for before, tag, n in transitions:
            moves[place.get(before, len(self.tags)), place[tag]] += n
        # An I- may only follow its own type.
        for before in [*self.tags, "^"]:
            for tag in self.tags:
                if tag.startswith("I-") and before[1:] != tag[1:]:
                    moves[place.get(before, len(self.tags)), place[tag]] = 1e-6
        self.moves = np.log(moves / moves.sum(1, keepdims=True))
        self.words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.tags)))
        classes: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.tags)))
        totals = np.full(len(self.tags), 1.0)
        for tag, word, n in emissions:
            self.words[word][place[tag]] += n
            classes[word_class(word)][place[tag]] += n
            totals[place[tag]] += n
        self.totals, self.unseen = totals, totals / totals.sum()
        self.words, self.classes = dict(self.words), dict(classes)

    def _emission(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return np.log((known + 0.01 * self.unseen) / self.totals)
        return np.log((self.classes.get(word_class(word), 0) + self.unseen) / self.totals) - 5.0

    def decode(self, words: list[str]) -> tuple[list[str], float]:
        """The likeliest tags, and how much likelier per word than the best ones that end otherwise."""
        if not len(words):
            return [], 0.0
        score = self.moves[-1] + self._emission(words[0])
        back = []
        for word in words[1:]:
            step = score[:, None] + self.moves[:-1]
            back.append(step.argmax(0))
            score = step.max(0) + self._emission(word)
        order = np.sort(score)
        at = [int(score.argmax())]
        for choice in reversed(back):
            at.append(int(choice[at[-1]]))
        return [self.tags[i] for i in reversed(at)], float(order[-1] - order[-2]) / len(words) if len(order) > 1 else 0.0


def fitted(train: DataFrame, tokens: str, bio: str) -> Tagger:
    """A tagger from rows of tokens and tags; more pairs than a model may hold are a ValueError."""
    pairs = F.arrays_zip(F.concat(F.array(F.lit("^")), F.slice(bio, 1, F.greatest(F.size(bio) - 1, F.lit(0)))).alias("before"), F.col(bio).alias("tag"), F.transform(tokens, F.lower).alias("word"))
    rows = train.filter(F.size(tokens) > 0).filter(F.size(tokens) == F.size(bio)).select(F.explode(pairs).alias("p")).select("p.*")
    moves = rows.groupBy("before", "tag").agg(F.count("*").alias("n")).collect()
    words = rows.groupBy("tag", "word").agg(F.count("*").alias("n")).limit(PAIRS + 1).collect()
    if len(words) > PAIRS:
        raise ValueError(f"more than {PAIRS} pairs of tag and word")
    return Tagger([tuple(r) for r in moves], [tuple(r) for r in words])


def tagged(tokens: Column, model: Tagger) -> Column:
    """struct(tags, margin) of an array of tokens."""

    @F.pandas_udf("struct<tags:array<string>,margin:double>")
    def run(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.decode([] if r is None else [(w or "").lower() for w in r]) for r in rows], columns=["tags", "margin"])

    return run(tokens)
