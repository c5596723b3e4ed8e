"""Many marks looked for in many texts at once.

An automaton of all marks reads each text once, so work grows with the length of marks and
texts together, not with their product.  The function travels to the workers by value.
"""

from __future__ import annotations

import sys

import ahocorasick
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def places(texts: list[str | None], marks: list[str]) -> list[int]:
    """Places of the texts that hold a mark (no mark is empty)."""
    automaton = ahocorasick.Automaton()
    for mark in marks:
        automaton.add_word(mark, True)
    if not len(automaton):
        return []
    automaton.make_automaton()
    return [at for at, text in enumerate(texts) if text and next(automaton.iter(text), None)]


@F.pandas_udf(ArrayType(IntegerType()))
def places_of_marks(texts: pd.Series, marks: pd.Series) -> pd.Series:
    """Per row, the places of ``texts`` that hold one of ``marks``; null where either is null."""
    found = [None if t is None or m is None else places(t, m) for t, m in zip(texts, marks)]
    return pd.Series(found, dtype=object)
