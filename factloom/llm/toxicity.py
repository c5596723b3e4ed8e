"""Toxicity: a weighted lexicon found by an Aho-Corasick automaton in folded text.

Folding lower-cases, reads look-alike letters, accents, digits and symbols as the plain
letters they stand for, and turns everything else into single spaces.  The lexicon is
learned from labelled rows: words, and word beginnings that cover unseen forms, which
stand in more toxic documents than chance allows and are several times as frequent per
thousand words there as in clean ones.  Weights are logs of the ratio of these rates.
A word inside an exception phrase does not count.  Hits are summed, also per thousand
words of the text, and a logistic curve turns both into a score.

Null text counts as the empty text; a text without a hit has the score of the curve at
zero.  Without labelled rows of both classes the lexicon is empty and the score is the
share of label 1 (0 without any).  Repeated rows get equal scores.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned, remainder, sample_labels, unused, with_code

#: Labelled rows per class that the lexicon and the curve are learned from.
SAMPLE = 12000
#: A document is toxic from this score on.
THRESHOLD = 0.7
#: Remainder of crc32(doc_id) that labels are never learned from.
DIVISOR, HELD_OUT = 3, 1
#: Largest number of words, beginnings and exception phrases in a lexicon.
LEXICON = 5000
#: Lengths of word beginnings.
BEGINNINGS = range(4, 8)
#: Share of the toxic rate (occurrences per word) in both rates of a term, from which on it is a
#: lexicon term.  A long clean text may hold any word once, so its mere presence tells little.
PURITY = 0.8
#: Harmless uses of words that may be in a lexicon.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "no idiot", "not stupid")

# --- fixed values: look-alike letters, digits and symbols, and the letters they stand for
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ѵ": "v",
    "ԛ": "q", "ԝ": "w", "ь": "b", "г": "r", "п": "n", "һ": "h", "ո": "n", "օ": "o", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o",
    "ρ": "p", "σ": "o", "ς": "c", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ı": "i",
    "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t",
}
STANDS_FOR = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "i", "€": "e",
}
#: Characters without width, dropped.
UNSEEN = "­​‌‍⁠﻿"
# ----------------------------------------------------------------------------


def _table() -> dict[int, str | None]:
    """Character by character, what folding makes of lower-case text."""
    table: dict[int, str | None] = {}
    for first, last in ((0x80, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for code in range(first, last):
            plain = unicodedata.normalize("NFKD", chr(code)).lower()
            table[code] = "".join(c for c in plain if not unicodedata.combining(c))
    for mark in string.punctuation + string.whitespace:
        table[ord(mark)] = " "
    table |= {ord(mark): letter for mark, letter in (LOOK_ALIKE | STANDS_FOR).items()}
    return table | {ord(mark): None for mark in UNSEEN}


_FOLDED = _table()
#: Symbols that stand for a letter only with one right after them; runs of marks do not.
_LOOSE = re.compile(r"[@$!|€]+(?![^\W\d_])|(?<![^\W_])[!|]+")
_SPACED = re.compile(r"[^\w]+|_+")


def fold(text: str) -> str:
    """The folded text, words apart by one space, with a space at both ends."""
    text = text.lower()
    if not text.isascii() or any(mark in text for mark in "@$!|"):
        text = _LOOSE.sub(" ", text)
    text = text.translate(_FOLDED)
    if not text.isascii():
        text = _SPACED.sub(" ", text)
    return f" {' '.join(text.split())} "


@dataclass(frozen=True)
class Lexicon:
    """Terms with a space in front, whole words with one behind too, and their weights."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def covered(places: Iterable[int], ranges: list[tuple[int, int]]) -> list[int]:
    """The places that lie in one of the ranges (end excluded); both are walked once, in order."""
    found, reach, after = [], -1, 0
    ranges = sorted(ranges)
    for at in sorted(places) if ranges else ():
        while after < len(ranges) and ranges[after][0] <= at:
            reach = max(reach, ranges[after][1])
            after += 1
        if at < reach:
            found.append(at)
    return found


def measures(folded: str, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    """Sum of weights, sum per thousand words, and the largest weight, on log scales."""
    hits: dict[int, float] = {}
    harmless = []
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                harmless.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
    for at in covered(hits, harmless):
        del hits[at]
    if not hits:
        return 0.0, 0.0, 0.0
    total = sum(hits.values())
    return log1p(total), log1p(1000 * total / folded.count(" ")), max(hits.values())


def chance(values: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    margin = np.clip(curve[0] + values @ np.array(curve[1:]), -30, 30)
    return 1 / (1 + np.exp(-margin))


def fit_curve(values: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small ridge."""
    rows = np.column_stack([np.ones(len(values)), values])
    ridge = np.diag([1e-3, *[1e-1] * values.shape[1]])
    beta = np.zeros(rows.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (weights * (labels - p)) - ridge @ beta
        bend = (rows * (weights * p * (1 - p))[:, None]).T @ rows + ridge
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def tail(hits: int, rows: int, share: float) -> float:
    """Log of the chance of at least ``hits`` among ``rows`` at this share."""
    terms: list[float] = []
    for k in range(hits, rows + 1):
        term = lgamma(rows + 1) - lgamma(k + 1) - lgamma(rows - k + 1) + k * log(share) + (rows - k) * log1p(-share)
        if terms and k > share * rows + 1 and term < terms[0] - 50:
            break  # what follows is smaller still, and adds nothing
        terms.append(term)
    top = max(terms)
    return top + log(sum(exp(term - top) for term in terms))


def _terms(folded: str) -> Counter[str]:
    """How often each word and each beginning occurs."""
    terms: Counter[str] = Counter()
    for word, times in Counter(folded.split()).items():
        terms[f" {word} "] += times
        for length in BEGINNINGS:
            if len(word) > length:
                terms[f" {word[:length]}"] += times
    return terms


def ratio(toxic: float, clean: float, toxic_words: float, clean_words: float) -> float:
    """Log of the toxic by the clean rate, with one more occurrence dealt by the words of both."""
    part = toxic_words / (toxic_words + clean_words)
    return log((toxic + part) / (clean + 1 - part)) - log(toxic_words / clean_words)


def signature(folded: str) -> int:
    """The smallest hash of any five words in a row: mostly equal for near copies only."""
    words = folded.split()
    wide = min(5, len(words))
    return min(
        (xxhash.xxh64_intdigest(" ".join(words[at : at + wide])) >> 1 for at in range(len(words) - wide + 1)),
        default=0,
    )


def learn(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Lexicon and curve from a bounded sample; texts stay in the tasks."""
    with_code(documents.sparkSession)
    # Bounded by ``sample`` per class, so it may be broadcast.
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(sample_labels(labels, "toxic", DIVISOR, HELD_OUT, sample)), "doc_id"
    )

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signed = [signature(fold(text or "")) for text in batch["text"]]
            yield batch[["doc_id", "label"]].assign(sign=np.array(signed, dtype=np.int64))

    # Copies of one document would make all its words look like terms; they count once.
    once = (
        known.mapInPandas(sign, "doc_id long, label int, sign long")
        .groupBy("label", "sign").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, times = (Counter(), Counter()), (Counter(), Counter())
            for text, label in zip(batch["text"], batch["label"]):
                folded = fold(text or "")
                terms = _terms(folded)
                found[label].update(terms.keys())
                times[label].update(terms)
                found[label][""] += 1
                times[label][""] += len(folded.split())
            names = list(found[0] | found[1])
            yield pd.DataFrame(
                {
                    "term": names,
                    "clean": [found[0][name] for name in names],
                    "toxic": [found[1][name] for name in names],
                    "clean_times": [times[0][name] for name in names],
                    "toxic_times": [times[1][name] for name in names],
                }
            )

    numbers = ("clean", "toxic", "clean_times", "toxic_times")
    counted = pinned(
        known.join(F.broadcast(once), "doc_id", "left_semi")
        .mapInPandas(count, "term string, " + ", ".join(f"{name} long" for name in numbers))
        .groupBy("term")
        .agg(*[F.sum(name).alias(name) for name in numbers])
        .filter((F.col("term") == "") | (F.col("toxic") >= 2))
    )
    whole = counted.filter("term = ''").first()
    if not whole or not whole["toxic"] or not whole["clean"]:
        share = 1.0 if whole and whole["toxic"] else 0.0
        return Lexicon({}, (), (30.0 if share else -30.0, 0.0, 0.0, 0.0))
    clean, toxic = whole["clean"], whole["toxic"]
    words = max(1, whole["toxic_times"]), max(1, whole["clean_times"])
    part, odds = words[0] / sum(words), PURITY / (1 - PURITY) * words[0] / words[1]
    frequent = F.col("toxic_times") + part >= odds * (F.col("clean_times") + 1 - part)
    share, limit = toxic / (clean + toxic), log(0.01 / (clean + toxic))
    often = F.col("toxic") > share * (F.col("toxic") + F.col("clean"))
    best = counted.filter((F.col("term") != "") & frequent & often).orderBy(F.desc("toxic"), "term").limit(LEXICON)
    weights = {
        row["term"]: ratio(row["toxic_times"], row["clean_times"], *words)
        for row in best.collect()
        if tail(row["toxic"], row["toxic"] + row["clean"], share) < limit
    }
    lexicon = Lexicon(weights, tuple(fold(phrase) for phrase in exceptions), ())

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            values = [measures(fold(text or ""), automaton) for text in batch["text"]]
            yield batch[["doc_id", "label", "weight"]].assign(values=values)

    seen = (
        known.mapInPandas(measure, "doc_id long, label int, weight double, values array<double>")
        .toPandas()
        .sort_values("doc_id", kind="stable")
    )
    curve = fit_curve(
        np.array([*seen["values"]], dtype=float).reshape(-1, 3),
        seen["label"].to_numpy(float),
        seen["weight"].to_numpy(float),
    )
    return Lexicon(lexicon.weights, lexicon.exceptions, curve)


def with_score(documents: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of the whole text."""
    with_code(documents.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            values = np.array(
                [measures(fold(text or ""), automaton) for text in texts], dtype=float
            ).reshape(-1, 3)
            yield pd.Series(chance(values, lexicon.curve), dtype=float)

    return documents.withColumn(name, score(F.col("text").cast("string")))


def predictions(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    lexicon = learn(documents, labels, sample)
    return with_score(documents.select("doc_id", "text"), lexicon).select(
        "doc_id",
        (remainder("doc_id", DIVISOR) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    name = unused(documents, "_toxic_score")
    scored = with_score(documents, learn(documents, labels, sample), name)
    return scored.filter(F.col(name) < THRESHOLD).drop(name)
