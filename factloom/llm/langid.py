"""Language identification by word-first backoff.

A known word counts with its log frequency in each language.  A word that no language
knows is read as character n-grams from its start: at each place the longest known
n-gram counts, so unseen words fall back to shorter and shorter n-grams.  The language
with the largest sum wins; the score is its share after normalising the sums.

Frequencies are learned from a bounded sample of documents per language.  Null texts
and texts without a letter are ``und`` with score 0, as is every text when there is
nothing to learn from.  Documents with null language teach nothing but are predicted.
Ties go to the first language in alphabetical order.  Repeated rows get equal results.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, with_code

#: Documents per language that frequencies are learned from.
SAMPLE = 4000
#: Words and n-grams that a model holds, over all languages.
WORDS, GRAMS = 160_000, 120_000
#: Longest n-gram.
LONGEST = 5
#: Remainder of crc32(doc_id) of documents that are never learned from.
DIVISOR, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Unseen words that a worker remembers.
REMEMBERED = 100_000

_NO_LETTER = {ord(mark): " " for mark in string.punctuation + string.digits + "\t\n\r\x0b\x0c«»„“”‘’¿¡–—…"}


def words_of(text: str) -> list[str]:
    return text.lower().translate(_NO_LETTER).split()


def grams_of(word: str) -> Iterator[str]:
    """All n-grams of a word with its edges marked."""
    edged = f" {word} "
    for length in range(1, LONGEST + 1):
        for at in range(len(edged) - length + 1):
            yield edged[at : at + length]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest known n-grams from left to right."""
        edged, known, found = f" {word} ", self.grams.get, []
        for at in range(len(edged)):
            for end in range(min(at + LONGEST, len(edged)), at, -1):
                number = known(edged[at:end])
                if number is not None:
                    found.append(number)
                    break
        if not found:
            return np.zeros(len(self.languages))
        return self.gram_scores[found].sum(axis=0) / len(found)

    def predict(self, text: str | None, memory: dict[str, np.ndarray]) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        known, often, fresh, times = [], [], [], []
        for word, count in Counter(words_of(text)).items():
            number = self.words.get(word)
            if number is not None:
                known.append(number)
                often.append(count)
                continue
            scores = memory.get(word)
            if scores is None:
                scores = self.unseen(word)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[word] = scores
            fresh.append(scores)
            times.append(count)
        total = np.array(often, dtype=float) @ self.word_scores[known] if known else 0.0
        if fresh:
            total = total + np.array(times, dtype=float) @ np.array(fresh)
        total = np.zeros(len(self.languages)) + total
        shares = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(shares[best] / shares.sum())


def _scores(table: pd.DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Smoothed log frequency of each unit in each language."""
    counts = table.pivot_table(index="unit", columns="lang", values="n", fill_value=0).reindex(
        columns=languages, fill_value=0
    )
    numbers = counts.to_numpy(float) + 0.5
    return {unit: at for at, unit in enumerate(counts.index)}, np.log(numbers / numbers.sum(axis=0))


def learn(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """Count words and n-grams per language in the tasks; only the most frequent reach the driver."""
    with_code(documents.sparkSession)
    usable = documents.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", DIVISOR) != HELD_OUT)
    )
    sizes = {row["lang"]: row["n"] for row in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model((), {}, np.zeros((0, 0)), {}, np.zeros((0, 0)))
    share = F.lit(0.0)
    for name, rows in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, sample / rows)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_000)) / 1_000_000

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = Counter()
                for text in texts:
                    words.update(words_of(text))
                grams = Counter()
                for word, n in words.items():
                    for gram in grams_of(word):
                        grams[gram] += n
                for kind, found in (("w", words), ("g", grams)):
                    yield pd.DataFrame(
                        {"lang": lang, "kind": kind, "unit": list(found), "n": list(found.values())}
                    )

    counted = (
        usable.filter(draw < share)
        .select("lang", F.col("text").cast("string").alias("text"))
        .mapInPandas(count, "lang string, kind string, unit string, n long")
        .groupBy("kind", "lang", "unit")
        .agg(F.sum("n").alias("n"))
    )
    most = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "unit")
    limit = F.when(F.col("kind") == "w", WORDS // len(languages)).otherwise(GRAMS // len(languages))
    kept = (
        counted.withColumn("_at", F.row_number().over(most))
        .filter((F.col("_at") <= max(WORDS, GRAMS) // len(languages)) & (F.col("_at") <= limit))
        .drop("_at")
        .toPandas()
        .sort_values(["kind", "lang", "unit"])
    )
    words, word_scores = _scores(kept[kept["kind"] == "w"], languages)
    grams, gram_scores = _scores(kept[kept["kind"] == "g"], languages)
    return Model(tuple(languages), words, word_scores, grams, gram_scores)


def predictions(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = learn(documents, sample)
    # Bounded by WORDS and GRAMS, whatever the number of documents.
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory: dict[str, np.ndarray] = {}
        for texts in batches:
            yield pd.DataFrame(
                [sent.value.predict(text, memory) for text in texts], columns=["lang_pred", "score"]
            )

    return documents.select(
        "doc_id",
        (remainder("doc_id", DIVISOR) == HELD_OUT).alias("held_out"),
        predict(F.col("text").cast("string")).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")
