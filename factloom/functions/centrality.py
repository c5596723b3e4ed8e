"""How central each sentence of a text is, by the rare words it shares with others.

The graph is sparse by construction: the sentences that hold a word are chained in
order, so a text has at most as many links as words, however long it is.  Scores are
whole numbers, so every order of adding gives the same ones.  The function travels to
the workers by value, so they need not have this package.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A word of more than a fifth of the sentences (and more than two) is common and links none.
COMMON_SHARE, COMMON_LEAST = 5, 2
#: Score of a sentence at the start, percent of it that travels along links, and rounds.
UNIT, TRAVELS, ROUNDS = 1_000_000, 85, 10


def scores(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of sentences with ``sizes`` distinct words each, ``words`` being those of all."""
    holder = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((holder, words))
    word, holder = words[order], holder[order]
    _, times = np.unique(word, return_counts=True)
    rare = np.repeat(times <= max(COMMON_LEAST, len(sizes) // COMMON_SHARE), times)
    linked = (word[1:] == word[:-1]) & rare[1:]
    left, right = holder[:-1][linked], holder[1:][linked]
    degree = np.bincount(np.concatenate([left, right]), minlength=len(sizes))
    score = np.full(len(sizes), UNIT, dtype=np.int64)
    for _ in range(ROUNDS):
        share = score * TRAVELS // (100 * np.maximum(degree, 1))
        score = np.full(len(sizes), UNIT * (100 - TRAVELS) // 100, dtype=np.int64)
        np.add.at(score, right, share[left])
        np.add.at(score, left, share[right])
    return score


@F.pandas_udf(ArrayType(LongType()))
def central(words: pd.Series, sizes: pd.Series) -> pd.Series:
    """Scores by sentence from word hashes and numbers of words; null stays null."""
    return pd.Series(
        [
            None if held is None or many is None
            else scores(np.asarray(held, dtype=np.int64), np.asarray(many, dtype=np.int64))
            for held, many in zip(words, sizes)
        ],
        dtype=object,
    )
