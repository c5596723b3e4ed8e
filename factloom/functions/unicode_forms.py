"""Unicode composition for texts that need it.

Spark has no function for it.  The function is deterministic to the optimiser, so
filters pass below it, and callers hand it only the stretches of a text that may change,
and null for texts that have none.
It travels to the workers by value, so they need not have this package.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Canonical composition (NFC); null stays null."""
    return texts.map(lambda text: unicodedata.normalize("NFC", text), na_action="ignore")
