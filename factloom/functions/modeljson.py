"""Reading the JSON object out of a model's raw reply.

A reply is parsed once into a VARIANT column; fields are then read with the
loose typing that reply contracts ask for (numbers written as strings, any
value used as a boolean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

_NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def braces_slice(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty where there is no such stretch."""
    return F.regexp_extract(raw, r"(?s)\A[^{]*+(\{.*\})", 1)


def fenced_or_braced(raw: Column) -> Column:
    """The JSON part of a reply: a ``json`` fence, else any fence, else the braces.

    A fence that is present but empty gives the empty string; a reply with none of
    the three is returned trimmed.
    """
    body = strip(raw)
    tagged, plain = r"(?s)```json(.*?)```", r"(?s)```(.*?)```"
    return (
        F.when(body.rlike(tagged), strip(F.regexp_extract(body, tagged, 1)))
        .when(body.rlike(plain), strip(F.regexp_extract(body, plain, 1)))
        .when(body.rlike(r"(?s)\A[^{]*+\{.*\}"), braces_slice(body))
        .otherwise(body)
    )


def without_fences(raw: Column) -> Column:
    """Trimmed reply without an opening fence at its start and a closing one at its end."""
    body = F.regexp_replace(strip(raw), r"\A```(?i:json)?\s*", "")
    return strip(F.regexp_replace(body, r"```\s*\z", ""))


def parse(text: Column) -> Column:
    """VARIANT of a JSON text, or null if it is not valid JSON."""
    return F.try_parse_json(text)


def accept_repeated_keys(frame: DataFrame) -> DataFrame:
    """Have the session read the last value of a key that an object repeats.

    To be called before a frame gets its parsed column.
    """
    frame.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return frame


def is_object(doc: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))


def with_fields(frame: DataFrame, doc: str, names: list[str]) -> DataFrame:
    """Add the type name and the text of each field, for :class:`Field` to read.

    Both are looked up once here, however many rules read them later.
    """
    columns = {}
    for name in names:
        item = F.try_variant_get(doc, f"$.{name}", "variant")
        columns[f"_{name}_kind"] = F.schema_of_variant(item)
        columns[f"_{name}_text"] = F.try_variant_get(doc, f"$.{name}", "string")
    return frame.withColumns(columns)


def without_fields(frame: DataFrame, names: list[str]) -> DataFrame:
    return frame.drop(*[f"_{name}_{part}" for name in names for part in ("kind", "text")])


class Field:
    """Loose readings of one field that :func:`with_fields` prepared.

    ``kind`` is null if the field is missing and ``VOID`` for JSON null.
    """

    def __init__(self, name: str):
        self.kind, self.raw = F.col(f"_{name}_kind"), F.col(f"_{name}_text")

    def text(self, default: str) -> Column:
        """Rendered as text; only a missing field takes the default."""
        return (
            F.when(self.kind.isNull(), F.lit(default))
            .when(self.kind == "VOID", F.lit("None"))
            .when(self.kind == "BOOLEAN", F.initcap(self.raw))
            .otherwise(self.raw)
        )

    def number(self) -> Column:
        """As a double: numbers, numeric strings and booleans; otherwise null."""
        return (
            F.when(self.kind == "BOOLEAN", (self.raw == "true").cast("double"))
            .when(self.raw.rlike(_NUMBER), self.raw.try_cast("double"))
        )

    def truthy(self) -> Column:
        """Whether it counts as true; any non-empty string does, ``"false"`` included."""
        text = self.raw
        return F.coalesce(
            F.when(self.kind == "STRING", text != "")
            .when(self.kind == "BOOLEAN", text == "true")
            .when(F.startswith(self.kind, F.lit("ARRAY")), text != "[]")
            .when(F.startswith(self.kind, F.lit("OBJECT")), text != "{}")
            .otherwise(text.try_cast("double") != 0),
            F.lit(False),
        )

    def is_fractional(self) -> Column:
        """Whether it is a number written with a fraction or an exponent."""
        decimal = F.startswith(self.kind, F.lit("DECIMAL"))
        return F.coalesce(decimal | self.kind.isin("DOUBLE", "FLOAT"), F.lit(False))

    def is_list(self) -> Column:
        return F.coalesce(F.startswith(self.kind, F.lit("ARRAY")), F.lit(False))


def list_item(doc: str, name: str) -> Column:
    """A list field as an array of texts."""
    return F.try_variant_get(doc, f"$.{name}", "array<string>")


def clamped(value: Column, low: float, high: float) -> Column:
    """The value moved into [low, high]; null stays null (``least`` alone would skip it)."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.when(value.isNotNull(), bounded)


def unit_interval(value: Column) -> Column:
    """Clamp to [0, 1]; null stays null."""
    return clamped(value, 0.0, 1.0)
