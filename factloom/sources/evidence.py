"""Evidence: defaults, contract check, loose input and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modeljson as mj
from ..functions.modeljson import Field
from ..operators.groups import OrderedGroups
from .schemas import RETRIEVAL_METHOD

#: Columns an evidence row must bring (fixed values).
REQUIRED = [
    "chunk_id", "document_id", "text", "domain", "source", "language", "similarity_score", "metadata",
]
#: What an absent id is made from, as far as a row has it.
ID_PARTS = ["claim_id", "attempt_no", "chunk_id", "document_id", "text", "position"]
#: Columns read from loose JSON input, with their types.  What else an object holds is
#: kept in the map ``other``.
LOOSE_FIELDS = {
    "evidence_id": "string",
    "chunk_id": "string",
    "document_id": "string",
    "text": "string",
    "source": "string",
    "url": "string",
    "title": "string",
    "similarity_score": "double",
    "authority_score": "double",
    "domain": "string",
    "language": "string",
    "retrieval_method": "string",
    "retrieved_date": "string",
    "publication_date": "string",
    "metadata": "string",
}


def with_defaults(evidence: DataFrame) -> DataFrame:
    """Fill the id, retrieval date (now) and retrieval method where absent.

    The id is a hash of what the row says, so it is the same each time the row is read.
    """
    parts = [
        F.coalesce(F.col(name).cast("string"), F.lit(""))
        for name in ID_PARTS
        if name in evidence.columns
    ]
    return evidence.withColumns(
        {
            "evidence_id": F.coalesce("evidence_id", F.md5(F.concat_ws("\x1f", *parts))),
            "retrieved_date": F.coalesce("retrieved_date", F.current_timestamp()),
            "retrieval_method": F.coalesce("retrieval_method", F.lit(RETRIEVAL_METHOD)),
        }
    )


def with_numbered_ids(evidence: DataFrame, order: list[str], **options: int) -> DataFrame:
    """Give ids and a title by position within the claim, where they are absent.

    Identifiers read ``evidence_1``, ``chunk_1``, ``document_1`` and so on.
    """
    numbered = OrderedGroups.of(evidence, ["claim_id"], order, **options).position("position").frame()

    def label(prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.col("position").cast("string"))

    return numbered.withColumns(
        {
            "evidence_id": F.coalesce("evidence_id", label("evidence_")),
            "chunk_id": F.coalesce("chunk_id", label("chunk_")),
            "document_id": F.coalesce("document_id", label("document_")),
            "title": F.coalesce(F.nullif("title", F.lit("")), label("Test Evidence ")),
        }
    )


def contract_violations(evidence: DataFrame) -> DataFrame:
    """Add ``violations``: the reasons a row breaks the evidence contract, maybe none."""
    missing = [
        F.when(F.col(name).isNull(), F.lit(f"missing {name}")) for name in REQUIRED
    ]
    method = F.when(
        F.col("retrieval_method") != RETRIEVAL_METHOD, F.lit("unknown retrieval_method")
    )
    return evidence.withColumn("violations", F.array_compact(F.array(*missing, method)))


def split_valid(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that meet the contract, rows that do not with their ``violations``)."""
    checked = contract_violations(evidence)
    broken = F.size("violations") > 0
    return checked.filter(~broken).drop("violations"), checked.filter(broken)


def coerce_loose(items: DataFrame, raw: str) -> DataFrame:
    """Evidence columns from loose input: a JSON object gives its fields, anything else its text."""
    mj.accept_repeated_keys(items)
    parsed = items.withColumn("_doc", mj.parse(F.col(raw)))
    usable = mj.with_fields(
        parsed.withColumn("_object", mj.is_object(F.col("_doc"))), "_doc", list(LOOSE_FIELDS)
    )

    def read(name: str, kind: str) -> Column:
        if kind == "double":
            return F.when(F.col("_object"), Field(name).number())
        value = F.when(F.col("_object"), Field(name).raw)
        return value.otherwise(F.col(raw)) if name == "text" else value

    every = F.try_variant_get("_doc", "$", "map<string, string>")
    other = F.map_filter(F.when(F.col("_object"), every), lambda key, _: ~key.isin(*LOOSE_FIELDS))
    coerced = usable.withColumns(
        {**{name: read(name, kind) for name, kind in LOOSE_FIELDS.items()}, "other": other}
    )
    return mj.without_fields(coerced, list(LOOSE_FIELDS)).drop("_doc", "_object")


def with_source_authority(evidence: DataFrame, authorities: DataFrame) -> DataFrame:
    """Fill missing ``authority_score`` from a table ``(source, source_authority)``.

    One row per source is enforced here.  How the small side travels is left to
    adaptive execution, which knows its real size; skewed sources are split by it.
    """
    one_each = authorities.groupBy("source").agg(F.avg("source_authority").alias("source_authority"))
    return (
        evidence.join(one_each, "source", "left")
        .withColumn("authority_score", F.coalesce("authority_score", "source_authority"))
        .drop("source_authority")
    )
