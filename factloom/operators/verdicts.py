"""The verdict step: inputs, choice among tries, and validation against the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modeljson as mj
from ..functions.automaton import places_of_marks
from ..functions.modeljson import Field
from ..functions.phrases import VERDICT_PHRASES, singular_sources
from ..functions.text import as_text, let, strip
from ..session import ensure_checkpoint_dir
from .groups import GROUP_ROW_LIMIT, OrderedGroups

# --- fixed values -----------------------------------------------------------
VERDICTS = ["Real", "Fake", "Unverified"]
UNVERIFIED = "Unverified"
DEFAULT_SCORE = 50
DEFAULT_SUMMARY = "Evaluation completed."
MAX_TRIES = 3
PLACEHOLDERS = [
    "item 1", "item 2", "source 1", "source 2", "evidence item 1", "evidence item 2",
]
#: A source must be longer than this to be recognised inside an item.
SHORTEST_SOURCE = 2
UNKNOWN_SOURCE = "Unknown Source"
REQUIRED_INPUTS = {"claim": "claim_text", "domain": "domain", "evidence_attempt": "evidence_list"}
MISSING_INPUT = "Missing required key in supervisor_input: "
# ----------------------------------------------------------------------------

#: Rows of evidence whose marks make one automaton, and tests of items with marks up to which none is made.
MARK_BLOCK, FEW_TESTS = 100_000, 1000
#: Rows and bytes of a claim's evidence up to which a row may hold it for the steps after reflection.
#: Each cited item is tested with up to four marks of a row, so the rows are fewer than for prompts.
PASSAGE_ROWS, PASSAGE_BYTES = 2_500, 16 * 1024 * 1024

#: Fields read from a reply.
REPLY_FIELDS = [
    "final_verdict", "confidence_score", "trust_score", "reasoning_summary", "key_evidence_used",
]


def verdict_inputs(stopped: DataFrame) -> DataFrame:
    """Hand-over rows: the stopped claims plus the two constants the step expects."""
    return stopped.withColumns(
        {"original_language": F.lit("en"), "was_translated": F.lit(False)}
    )


def missing_inputs(inputs: DataFrame) -> DataFrame:
    """Add ``reason``: the first required input a row lacks, or null."""
    reasons = [
        F.when(F.col(column).isNull(), F.lit(f"{MISSING_INPUT}'{name}'"))
        for column, name in REQUIRED_INPUTS.items()
    ]
    return inputs.withColumn("reason", F.coalesce(*reasons))


def final_evidence(evidence: DataFrame, stopped: DataFrame) -> DataFrame:
    """The evidence rows each claim goes on with.

    The attempt is compared as no join key, so rows are dealt by claim alone; later steps
    group and join by claim and need no other shuffle.
    """
    chosen = stopped.select(
        F.col("claim_id").alias("_claim"), F.col("evidence_attempt").alias("_attempt")
    )
    same = (F.col("claim_id") == F.col("_claim")) & (F.col("attempt_no") - F.col("_attempt") == 0)
    return evidence.join(chosen, same, "left_semi")


def with_passage(evidence: DataFrame, order: list[str], block: Column) -> DataFrame:
    """Add ``passage``: a row's place in ``order`` within its attempt, its rendered ``block``
    and what citations are made of.  Rows that ``order`` leaves open stay as they come.

    For claims whose evidence a row may hold by :data:`PASSAGE_ROWS` and :data:`PASSAGE_BYTES`:
    :func:`passages` gathers it.  A column of its own, since an aggregate reads what it
    collects from one that is compiled, but would interpret the expression.
    """
    passage = F.struct(
        "attempt_no", *[F.col(name).alias(f"order_{n}") for n, name in enumerate(order)],
        F.monotonically_increasing_id().alias("row"), block.alias("block"), _marks().alias("marks"),
        F.coalesce("source", F.lit(UNKNOWN_SOURCE)).alias("source"),
        F.coalesce(F.nullif("evidence_id", F.lit("")), "chunk_id").alias("name"),
    )
    return evidence.withColumn("passage", passage)


def passages() -> Column:
    """The evidence of a claim as one aggregate: its passages by attempt, in order."""
    return F.sort_array(F.collect_list("passage"))


def final_passages(stopped: DataFrame) -> DataFrame:
    """:func:`final_evidence` for claims that hold their ``passages``: those of the chosen attempt."""
    chosen = F.filter("passages", lambda passage: passage["attempt_no"] == F.col("evidence_attempt"))
    return stopped.withColumn("passages", chosen)


def first_parseable(replies: DataFrame, stage: str = "supervisor") -> DataFrame:
    """Per claim, the first of its tries that holds a JSON object (``try_no``, ``reply``).

    A minimum with map-side combine over the numbers of the usable tries, so every
    reply is cut out and parsed once; claims without a usable try have no row.
    """
    mj.accept_repeated_keys(replies)
    tries = replies.filter((F.col("stage") == stage) & (F.col("try_no") <= MAX_TRIES))
    sliced = tries.select("claim_id", "try_no", mj.braces_slice(F.col("raw")).alias("reply"))
    # A reply without braces is none; to have it fail as JSON would cost more than a good one.
    usable = F.when((F.col("reply") != "") & mj.parse(F.col("reply")).isNotNull(), F.col("try_no"))
    return (
        sliced.withColumn("usable", usable)
        .groupBy("claim_id")
        .agg(F.min("usable").alias("try_no"), F.min_by("reply", "usable").alias("reply"))
        .filter(F.col("try_no").isNotNull())
    )


def without_verdict(claims: DataFrame, chosen: DataFrame) -> DataFrame:
    """Claims for which every try failed."""
    return claims.join(chosen, "claim_id", "left_anti")


def verdict_name(value: Column) -> Column:
    """One of the three verdicts, whatever the letter case; anything else is Unverified."""
    name = F.initcap(F.lower(strip(value)))
    return F.when(name.isin(VERDICTS), name).otherwise(UNVERIFIED)


def percent(field: Field) -> Column:
    """A score in 0..100.

    Only a number written with a fraction or exponent is read as a share of one:
    ``1.0`` is 100 but ``1`` is 1, and the text ``"0.9"`` rounds to 1.
    """
    number = field.number()
    share = field.is_fractional() & (number > 0) & (number <= 1)
    scaled = F.bround(F.when(share, number * 100).otherwise(number), 0)
    bounded = mj.clamped(scaled, 0.0, 100.0)
    return F.coalesce(bounded, F.lit(float(DEFAULT_SCORE))).cast("int")


def parse_verdicts(chosen: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the verdict columns and the cited ``items`` from the chosen reply.

    Rows carry the ``evidence_count`` of their claim.  A single text counts as one
    item, and anything but a text or a list as none.
    """
    verdict, confidence, trust, summary, items = (Field(name) for name in REPLY_FIELDS)
    mj.accept_repeated_keys(chosen)
    read = mj.with_fields(chosen.withColumn("_doc", mj.parse(F.col(reply))), "_doc", REPLY_FIELDS)
    parsed = read.withColumns(
        {
            "final_verdict": verdict_name(verdict.text(UNVERIFIED)),
            "confidence_score": percent(confidence),
            "trust_score": percent(trust),
            "reasoning_summary": singular_sources(
                summary.text(DEFAULT_SUMMARY), F.col("evidence_count"), VERDICT_PHRASES
            ),
            "items": F.when(items.kind == "STRING", F.array(items.raw))
            .when(items.is_list(), mj.list_item("_doc", "key_evidence_used"))
            .otherwise(F.array().cast("array<string>")),
        }
    )
    return mj.without_fields(parsed, REPLY_FIELDS).drop("_doc", reply)


def _marks() -> Column:
    """The ids and the source that name a row of evidence, in small letters."""
    names = F.array(
        *[F.lower(name) for name in ("evidence_id", "chunk_id", "document_id")],
        F.when(
            F.length(strip(F.col("source"))) > SHORTEST_SOURCE, F.lower(strip(F.col("source")))
        ),
    )
    return F.array_except(names, F.array(F.lit(""), F.lit(None).cast("string")))


def _tidy() -> Column:
    """The cited items in small letters."""
    return F.transform("items", lambda item: F.lower(strip(as_text(item))))


def _is_numbered(item: Column) -> Column:
    """Whether an item has the numbered form of a passage that there is."""
    return F.contains(item, F.lit("evidence_")) & F.exists(
        F.regexp_extract_all(item, F.lit("evidence_([1-9])"), F.lit(1)),
        lambda digit: digit.cast("int") <= F.col("evidence_count"),
    )


def _kept(known) -> Column:
    """The items that stay: those whose place is ``known``, but for placeholders."""
    return F.filter(
        F.transform(
            "items",
            lambda item, at: F.when(
                ~F.col("_items")[at].isin("", *PLACEHOLDERS) & known(at), strip(as_text(item))
            ),
        ),
        lambda item: item.isNotNull(),
    )


def _label(source: Column, name: Column, number: Column) -> Column:
    """How a verdict that falls back cites a row of evidence."""
    numbered = F.concat(F.lit("evidence_"), number.cast("string"))
    return F.concat(source, F.lit(" ("), F.coalesce(name, numbered), F.lit(")"))


def _with_citations(
    cited: DataFrame, evidence: DataFrame, row_limit: int, measured: DataFrame
) -> DataFrame:
    """Add ``_named``: the places of the items that name an id or source of the claim's evidence.

    The marks of a claim's evidence are gathered without repeats, and its items are read
    once for all of them: by an automaton, or by plain tests where these are few
    (:data:`FEW_TESTS`).  Evidence of a claim with more than a block of rows is dealt to
    several automata, each with a copy of the items.  Work grows with marks plus items, and
    pairs of items and evidence never exist as rows.
    """
    block = min(row_limit, MARK_BLOCK)
    carried = [name for name in cited.columns if name != "claim_id"]
    hot = (
        measured.groupBy("claim_id")
        .agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_salts"))
        .filter("_salts > 1")
    )
    salt = F.pmod(F.xxhash64("document_id", "chunk_id", "text"), F.col("_salts")).cast("int")
    gathered = (
        evidence.select("claim_id", _marks().alias("_mark"), "document_id", "chunk_id", "text")
        .join(hot, "claim_id", "left")
        .select("claim_id", F.coalesce(salt, F.lit(0)).alias("_salt"), F.explode("_mark").alias("_mark"))
        .groupBy("claim_id", "_salt")
        .agg(F.collect_set("_mark").alias("_marks"))
    )
    few = F.size("_items") * F.size("_marks") <= FEW_TESTS
    plain = F.filter(
        F.transform(
            "_items",
            lambda item, at: F.when(F.exists("_marks", lambda mark: F.contains(item, mark)), at),
        ),
        lambda at: at.isNotNull(),
    )
    # Rows with few tests hand nulls to the automaton, which costs next to nothing.
    many = places_of_marks(F.when(~few, F.col("_items")), F.when(~few, F.col("_marks")))
    none = F.array().cast("array<int>")
    return (
        cited.join(hot, "claim_id", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .join(gathered, ["claim_id", "_salt"], "left")
        .withColumn("_many", many)
        .select(
            "claim_id", F.struct(*carried).alias("_row"),
            F.coalesce(F.when(few, plain).otherwise(F.col("_many")), none).alias("_some"),
        )
        .groupBy("claim_id")
        .agg(F.first("_row").alias("_row"), F.collect_list("_some").alias("_parts"))
        .select("claim_id", "_row.*", F.array_distinct(F.flatten("_parts")).alias("_named"))
    )


def key_evidence(
    verdicts: DataFrame,
    evidence: DataFrame,
    order: list[str],
    row_limit: int = GROUP_ROW_LIMIT,
    measured: DataFrame | None = None,
) -> DataFrame:
    """The evidence a verdict may cite, one row per item: claim_id, item_no, item.

    ``verdicts`` has ``claim_id``, ``items`` and ``evidence_count``.  An item stays
    if it mentions an id or source of the claim's evidence, as a substring and
    ignoring case, and is no placeholder.  The numbered form ``evidence_<n>`` is
    known from the count alone: since mentions are substrings, its first digit
    decides.  A verdict left without items cites all evidence of its claim in
    ``order``, and one without evidence cites nothing.  The rows stay flat, so a
    claim may have any amount of evidence, and only the claims that fall back have
    theirs ordered.
    """
    cited = verdicts.filter(F.col("evidence_count") > 0).select(
        "claim_id", "items", "evidence_count", _tidy().alias("_items")
    )
    numbered = F.transform("_items", _is_numbered)
    judged = _with_citations(
        cited, evidence, row_limit, evidence if measured is None else measured
    ).withColumn("_numbered", numbered)
    kept = _kept(lambda at: F.array_contains("_named", at) | F.col("_numbered")[at])
    # One narrow row per claim, read twice below.
    ensure_checkpoint_dir(verdicts.sparkSession)
    answered = judged.select("claim_id", kept.alias("_kept")).checkpoint()
    sound = answered.select("claim_id", F.posexplode("_kept").alias("item_no", "item"))
    bare = answered.filter(F.size("_kept") == 0).select("claim_id")
    fallen_back = OrderedGroups.of(
        evidence.join(bare, "claim_id", "left_semi"),
        ["claim_id"],
        order,
        row_limit,
        evidence if measured is None else measured,
    )
    label = _label(
        F.coalesce("source", F.lit(UNKNOWN_SOURCE)),
        F.coalesce(F.nullif("evidence_id", F.lit("")), "chunk_id"),
        F.col("item_no"),
    )
    everything = fallen_back.position("item_no").frame()
    return sound.select("claim_id", (F.col("item_no") + 1).alias("item_no"), "item").unionByName(
        everything.select("claim_id", "item_no", label.alias("item"))
    )


def with_key_evidence(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Nest the items of :func:`key_evidence` into their verdict as ``key_evidence_used``.

    For reports, where one verdict with its citations is one row.
    """
    listed = F.sort_array(F.collect_list(F.struct("item_no", "item")))
    nested = items.groupBy("claim_id").agg(
        F.transform(listed, lambda row: row["item"]).alias("key_evidence_used")
    )
    none = F.array().cast("array<string>")
    return (
        verdicts.drop("items")
        .join(nested, "claim_id", "left")
        .withColumn("key_evidence_used", F.coalesce("key_evidence_used", none))
    )


def with_key_passages(verdicts: DataFrame) -> DataFrame:
    """:func:`key_evidence` and :func:`with_key_evidence` for verdicts that hold their ``passages``.

    These have the final evidence of the claim in order, so nothing is shuffled.
    """
    held = verdicts.withColumn("_items", _tidy())

    def known(at: Column, marks: Column) -> Column:
        item = F.col("_items")[at]
        return _is_numbered(item) | F.exists(marks, lambda mark: F.contains(item, mark))

    # Most marks are in no item: those are put aside by one look at all items.
    told = let(
        F.array_join("_items", "\n"),
        lambda items: F.filter(
            F.flatten(F.col("passages")["marks"]), lambda mark: F.contains(items, mark)
        ),
    )
    kept = let(told, lambda marks: _kept(lambda at: known(at, marks)))
    everything = F.transform(
        "passages", lambda passage, at: _label(passage["source"], passage["name"], at + 1)
    )
    cited = F.when(
        F.col("evidence_count") > 0,
        F.when(F.size("_kept") == 0, everything).otherwise(F.col("_kept")),
    )
    return (
        held.withColumn("_kept", kept)
        .withColumn("key_evidence_used", F.coalesce(cited, F.array().cast("array<string>")))
        .drop("items", "_items", "_kept")
    )
