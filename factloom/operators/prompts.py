"""Prompt tables for batch inference: one row per model call of a stage.

Prompts carry the same information, limits and answer schema that each stage's
reply checks rely on.  Evidence blocks are rendered per row and joined in order
per claim; see ``groups`` for claims with very much evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from ..session import ensure_checkpoint_dir
from .explanations import baseline_confidence
from .groups import GROUP_ROW_LIMIT, OrderedGroups, group_sizes
from .reflection import RESULT
from .verdicts import MAX_TRIES

# --- prompt texts of our own; the names of answer fields are what the reply checks read ---
CLAIM_TEMPLATE = (
    "Read the text below and state its main factual claim in one sentence of 10 to 30 words. "
    "Keep names, events, numbers, dates and percentages; add nothing and judge nothing.\n\n"
    "TEXT:\n{text}\n\nAnswer with the claim only."
)

DOMAIN_TEMPLATE = (
    "Decide which subject the claim below is mainly about: Medical, Politics, Finance, "
    "Technology or Unknown. Use Unknown for weather, sports, entertainment, accidents, crime, "
    "travel, education and anything else outside the first four.\n"
    'Answer with JSON only: {"domain": "", "confidence": 0.0, "reason": ""}, '
    "the confidence between 0.0 and 1.0.\n\nClaim:\n{claim}\n"
)

REFLECTION_TEMPLATE = (
    "Judge whether the evidence below is sufficient and reliable for the claim. "
    "Do not judge the claim itself.\n\n"
    "Claim ({domain}): {claim}\n\nPassages found: {count}\n{evidence}\n\n"
    "- Similarity is relevance, authority is reliability; high similarity from a source "
    "with authority below 0.40 is weak evidence and means NO.\n"
    "- Evidence that opposes the claim is not a conflict among the evidence; only two or more "
    "items can contradict each other.\n"
    "- Name no source that is not listed above.\n"
    'Answer with JSON only: {"decision": "YES" or "NO", "is_evidence_sufficient": bool, '
    '"contradictions_found": bool, "confidence": 0.0-1.0, "notes": "", "support_score": 0.0-1.0, '
    '"source_credibility_score": 0.0-1.0, "evidence_quality_score": 0.0-1.0, '
    '"claim_supported": bool, "claim_contradicted": bool, '
    '"evidence_items_contradict_each_other": bool}'
)

VERDICT_TEMPLATE = (
    "Claim ({domain}): {claim}\nSearches made: {attempts}, limit reached: {exhausted}\n\n"
    "Passages to cite: {count}\n{evidence}\nEarlier assessment: {reflection}\n\n"
    "Decide Real, Fake or Unverified from the evidence above only. Weak or conflicting evidence "
    "is Unverified; similarity without authority is never enough for Real. Cite evidence as "
    "'SourceName (evidence_id)' and nothing that is not listed.\n"
    'Answer with JSON only: {"final_verdict": "", "confidence_score": 0-100, '
    '"trust_score": 0-100, "reasoning_summary": "", "key_evidence_used": [""]}'
)
NO_REFLECTION = "No reflection analysis is available."
NO_EVIDENCE = "No evidence provided."
RETRY_REMINDER = (
    "\n\nThe answer before this one was not valid JSON. Answer with the JSON object alone."
)

EXPLANATION_TEMPLATE = (
    'Explain the verdict "{verdict}" to a general reader. Do not change it, invent no source, '
    "and tell relevance from authority.\n\n"
    "Claim ({domain}): {claim}\nSearches made: {attempts}, limit reached: {exhausted}\n\n"
    "{count} passages as JSON: [{evidence}]\nAssessment as JSON: {reflection}\n"
    "Verdict as JSON: {result}\n\n"
    'Answer with JSON only: {"final_verdict": "{verdict}", "explanation": "", '
    '"evidence_summary": [""], "source_analysis": "", "reasoning": "", "confidence": {baseline}}'
)


#: What a block adds to its text, roughly.
BLOCK_BYTES = 400
#: Characters up to which a prompt is one part, and the position of what follows its blocks.
PART_CHARS = 400_000
TAIL = 2**31 - 1
#: Rows and bytes of a claim's evidence up to which its prompts are cut inside the row.
IN_ROW, IN_ROW_BYTES = 10_000, 64 * 1024 * 1024
#: Fields of evidence and of a verdict that an explanation is told.
EVIDENCE_FIELDS = [
    "evidence_id", "chunk_id", "document_id", "text", "domain", "source", "language",
    "retrieved_date", "similarity_score", "authority_score", "retrieval_method", "metadata",
    "url", "title", "publication_date",
]
VERDICT_FIELDS = [
    "final_verdict", "confidence_score", "trust_score", "reasoning_summary", "key_evidence_used",
]


def fill(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced by a column; nulls become empty text."""
    parts, rest = [], template
    while rest:
        spots = [(rest.find("{%s}" % name), name) for name in values]
        found = min((spot for spot in spots if spot[0] >= 0), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, name = found
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def _or(name: str, absent: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(absent))


def _evidence_name() -> Column:
    numbered = F.concat(F.lit("evidence_"), F.col("position").cast("string"))
    return F.coalesce(F.nullif("evidence_id", F.lit("")), "chunk_id", numbered)


def reflection_block() -> Column:
    return fill(
        "<passage no={n} id={id} found_by={method}>\n"
        "{source} | {title} | {url}\n"
        "authority {authority}, similarity {similarity}\n{text}\n</passage>",
        n=F.col("position"),
        id=_evidence_name(),
        source=_or("source", "Unknown Source"),
        authority=_or("authority_score", "N/A"),
        similarity=_or("similarity_score", "N/A"),
        title=_or("title", "N/A"),
        url=_or("url", "N/A"),
        method=_or("retrieval_method", "N/A"),
        text=F.col("text"),
    )


def verdict_block() -> Column:
    return fill(
        "{n}. {source} ({id}), authority {authority}, similarity {similarity}, "
        "link {url}:\n{text}",
        n=F.col("position"),
        id=_evidence_name(),
        source=_or("source", "Unknown Source"),
        authority=_or("authority_score", "unknown"),
        similarity=_or("similarity_score", "unknown"),
        url=F.coalesce(F.nullif("url", F.lit("")), F.lit("not available")),
        text=F.col("text"),
    )


def json_block(evidence: DataFrame) -> Column:
    """One evidence item as a JSON object with all its fields; absent ones are left out."""
    dates = ["retrieved_date", "publication_date"]
    return F.to_json(
        F.struct(
            *[
                F.col(name).cast("string").alias(name) if name in dates else F.col(name)
                for name in EVIDENCE_FIELDS
                if name in evidence.columns
            ]
        )
    )


def evidence_text(
    evidence: DataFrame, order: list[str], block: Column, separator: str,
    row_limit: int = GROUP_ROW_LIMIT, keys: tuple[str, ...] = ("claim_id",),
    measured: DataFrame | None = None,
) -> DataFrame:
    """Per claim, its rendered evidence (``evidence``) and how many items it has.

    ``measured`` is a table whose claims hold at least as many rows, for sizing groups.
    """
    groups = OrderedGroups.of(
        evidence, keys, order, row_limit, measured, size=F.octet_length("text") + BLOCK_BYTES,
        dealt=keys[:1],
    )
    numbered = groups.position("position")
    joined = numbered.join_text(
        block, separator, "evidence", "position", count_items=F.count(F.lit(1))
    )
    return joined.withColumnRenamed("count_items", "evidence_count")


def prompt_blocks(
    evidence: DataFrame, order: list[str], block: Column,
    row_limit: int = GROUP_ROW_LIMIT, keys: tuple[str, ...] = ("claim_id",),
    measured: DataFrame | None = None,
) -> DataFrame:
    """The flat form of :func:`evidence_text`: keys, ``position`` (from 1) and ``block``."""
    groups = OrderedGroups.of(
        evidence, keys, order, row_limit, measured, size=F.octet_length("text") + BLOCK_BYTES
    )
    return groups.position("position").frame().select(*keys, "position", block.alias("block"))


def prompt_parts(
    framed: DataFrame, blocks: DataFrame, separator: str,
    keys: tuple[str, ...] = ("claim_id",), size: int = PART_CHARS,
    row_limit: int = GROUP_ROW_LIMIT,
) -> DataFrame:
    """Prompts as numbered parts of bounded size; strung together they are the prompts.

    ``framed`` has the text before (``head``) and after the blocks (``tail``), one row per
    prompt; blocks of other keys are left out.  A prompt of up to ``size`` characters is one
    part.  A longer one is cut between blocks, so that every part holds less than twice
    ``size``; only what is longer than ``size`` by itself is cut inside.  Part numbers are
    gapless from 1, and ``is_last`` marks the part that completes a prompt.  No task holds
    more of a prompt than a part, or a bucket of ``groups``.
    """
    known = blocks.join(framed.select(*keys), list(keys), "left_semi")
    joint = F.when(F.col("position") > 1, separator).otherwise("")
    texts = (
        framed.select(*keys, F.lit(0).alias("position"), F.col("head").alias("text"))
        .unionByName(known.select(*keys, "position", F.concat(joint, "block").alias("text")))
        .unionByName(framed.select(*keys, F.lit(TAIL).alias("position"), F.col("tail").alias("text")))
    )
    pieces = (
        texts.withColumn("_cut", _cut(F.col("text"), size))
        .select(*keys, "position", F.size("_cut").alias("_many"), F.posexplode("_cut").alias("_piece", "text"))
        .filter(F.length("text") > 0)
    )
    groups = OrderedGroups.of(
        pieces, keys, ["position", "_piece"], row_limit, size=F.octet_length("text")
    )
    placed = groups.running_sum("_upto", F.length("text")).frame()
    start = F.col("_upto") - F.length("text")
    listed = F.sort_array(F.collect_list(F.struct("position", "_piece", "text")))
    return (
        placed.withColumn("part_no", (F.floor(start / size) + 1).cast("int"))
        .groupBy(*keys, "part_no")
        .agg(
            F.array_join(F.transform(listed, lambda piece: piece["text"]), "").alias("part"),
            F.bool_or((F.col("position") == TAIL) & (F.col("_piece") == F.col("_many") - 1)).alias("is_last"),
        )
    )


def _cut(text: Column, size: int) -> Column:
    """The text in pieces of at most ``size`` characters."""
    two = F.array(F.substring(text, 1, size), F.substring(text, size + 1, size))
    return (
        F.when(F.length(text) <= size, F.array(text))
        .when(F.length(text) <= 2 * size, two)
        .otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)))
    )


def _parts_in_row(pieces: Column, size: int) -> Column:
    """The parts of one prompt as structs, from its ``pieces`` in order; none is empty or
    longer than ``size``.  A part holds the pieces that start in its ``size`` characters, so
    each of these stretches has one, and only where parts begin is to be found."""

    def place(state: Column, piece: Column) -> Column:
        opens = state["upto"] >= F.size(state["firsts"]) * F.lit(size).cast("long")
        firsts = F.when(opens, F.array_append(state["firsts"], state["at"])).otherwise(state["firsts"])
        return F.struct(
            firsts.alias("firsts"), (state["at"] + 1).alias("at"),
            (state["upto"] + F.length(piece)).alias("upto"),
        )

    none = F.struct(
        F.array().cast("array<int>").alias("firsts"), F.lit(1).alias("at"), F.lit(0).cast("long").alias("upto")
    )

    def parts(firsts: Column) -> Column:
        def part(first: Column, at: Column) -> Column:
            end = F.coalesce(F.get(firsts, at + 1), F.size(pieces) + 1)
            return F.struct(
                (at + 1).alias("part_no"),
                F.array_join(F.slice(pieces, first, end - first), "").alias("part"),
                (at + 1 == F.size(firsts)).alias("is_last"),
            )

        return F.transform(firsts, part)

    return let(F.aggregate(pieces, none, place, lambda state: state["firsts"]), parts)


def _cut_in_row(framed: DataFrame, keys: list[str], separator: str, size: int) -> DataFrame:
    """Prompts as :func:`prompt_parts` has them, from rows with ``head``, ``tail`` and an array of ``blocks``.

    Head and tail stand in columns of their own: inside a function of arrays they would be
    interpreted, not compiled.
    """
    none = F.array().cast("array<string>")

    def cut(text: Column) -> Column:
        return F.when(F.length(text) > 0, _cut(text, size)).otherwise(none)

    listed = F.transform(
        "blocks", lambda text, at: F.when(at > 0, F.concat(F.lit(separator), text)).otherwise(text)
    )
    between = F.coalesce(F.flatten(F.transform(listed, cut)), none)
    pieces = F.concat(cut(F.col("head")), between, cut(F.col("tail")))
    return framed.select(*keys, pieces.alias("_pieces")).select(
        *keys, F.inline(_parts_in_row(F.col("_pieces"), size))
    )


def _stage_parts(
    inputs: DataFrame, how: str, head: Column, tail: Column, evidence: DataFrame, order: list[str],
    block: Column, separator: str, keys: tuple[str, ...], size: int, row_limit: int,
    measured: DataFrame | None,
) -> DataFrame:
    """Prompts of a stage in parts, see :func:`prompt_parts`.

    ``inputs`` are joined with the evidence on the claim (``how``); ``head`` and ``tail`` read
    their columns and ``_count``, the number of blocks.  Evidence is shuffled once, by claim,
    before anything is rendered, and prompts are cut inside the row.  Claims with more
    evidence than :data:`IN_ROW` take the flat form.
    """
    claim, weight = list(keys[:1]), F.octet_length("text") + BLOCK_BYTES
    sizes = group_sizes(evidence if measured is None else measured, claim, weight)
    large = sizes.filter((F.col("_rows") > min(row_limit, IN_ROW)) | (F.col("_bytes") > IN_ROW_BYTES))
    any_large = not large.isEmpty()
    little, few = evidence, inputs
    if any_large:
        ensure_checkpoint_dir(evidence.sparkSession)
        large = large.select(*claim).checkpoint()
        little, few = (rows.join(large, claim, "left_anti") for rows in (evidence, inputs))
    numbered = OrderedGroups.ordinary(little, keys, order, claim).position("position").frame()
    listed = F.sort_array(F.collect_list(F.struct("position", block.alias("block"))))
    blocks = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_count"), F.transform(listed, lambda row: row["block"]).alias("_blocks")
    )
    framed = few.join(blocks, claim, how).select(
        *keys, head.alias("head"), F.col("_blocks").alias("blocks"), tail.alias("tail")
    )
    parts = _cut_in_row(framed, list(keys), separator, size)
    if not any_large:
        return parts
    much, many = (rows.join(large, claim, "left_semi") for rows in (evidence, inputs))
    counts = much.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    framed = many.join(counts, claim, how).select(*keys, head.alias("head"), tail.alias("tail"))
    flat = prompt_blocks(much, order, block, row_limit, keys)
    return parts.unionByName(prompt_parts(framed, flat, separator, keys, size, row_limit))


def _framed(template: str, **values: Column) -> dict[str, Column]:
    """``head`` and ``tail`` of a template: what stands around its ``{evidence}``."""
    head, tail = template.split("{evidence}")
    return {"head": fill(head, **values), "tail": fill(tail, **values)}


def claim_prompts(processed: DataFrame, text: str = "processed_text") -> DataFrame:
    return processed.withColumn("prompt", fill(CLAIM_TEMPLATE, text=strip(F.col(text))))


def domain_prompts(claims: DataFrame, claim: str = "claim") -> DataFrame:
    return claims.withColumn("prompt", fill(DOMAIN_TEMPLATE, claim=F.col(claim)))


def reflection_prompts(claims: DataFrame, evidence: DataFrame, order: list[str],
                       row_limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """One prompt per claim and attempt that has evidence."""
    blocks = evidence_text(
        evidence, order, reflection_block(), "\n", row_limit, ("claim_id", "attempt_no")
    )
    return claims.join(blocks, "claim_id").withColumn(
        "prompt",
        fill(
            REFLECTION_TEMPLATE,
            claim=F.col("claim"),
            domain=F.col("domain"),
            count=F.col("evidence_count"),
            evidence=F.col("evidence"),
        ),
    ).select("claim_id", "attempt_no", "prompt")


def reflection_parts(claims: DataFrame, evidence: DataFrame, order: list[str],
                     size: int = PART_CHARS, row_limit: int = GROUP_ROW_LIMIT) -> DataFrame:
    """:func:`reflection_prompts` in numbered parts, for claims with more evidence than a row holds."""
    frame = _framed(
        REFLECTION_TEMPLATE,
        claim=F.col("claim"),
        domain=F.col("domain"),
        count=F.col("_count"),
    )
    return _stage_parts(
        claims, "inner", frame["head"], frame["tail"], evidence, order, reflection_block(), "\n",
        ("claim_id", "attempt_no"), size, row_limit, None,
    )


def _flag(name: str) -> Column:
    return F.initcap(F.col(name).cast("string"))


def reflection_summary() -> Column:
    """The reflection of a stopped claim as lines; a fixed line where there is none."""
    lines = fill(
        "{decision} (sufficient {sufficient}, sure {confidence}); credibility {credibility}, "
        "quality {quality}; supported {supported}, opposed {contradicted}, "
        "passages at odds {conflict}. {notes}",
        decision=F.col("decision"),
        sufficient=_flag("is_evidence_sufficient"),
        confidence=F.col("confidence"),
        credibility=F.col("source_credibility_score"),
        quality=F.col("evidence_quality_score"),
        supported=_flag("claim_supported"),
        contradicted=_flag("claim_contradicted"),
        conflict=_flag("evidence_items_contradict_each_other"),
        notes=F.col("notes"),
    )
    return F.when(F.col("decision").isNull(), NO_REFLECTION).otherwise(lines)


def verdict_prompts(inputs: DataFrame, evidence: DataFrame, order: list[str],
                    tries: int = MAX_TRIES, row_limit: int = GROUP_ROW_LIMIT,
                    measured: DataFrame | None = None) -> DataFrame:
    """One prompt per stopped claim; from the second try on it carries a reminder."""
    blocks = evidence_text(
        evidence, order, verdict_block(), "\n", row_limit, measured=measured
    ).drop("evidence_count")
    base = inputs.join(blocks, "claim_id", "left").withColumn(
        "_base",
        fill(
            VERDICT_TEMPLATE,
            claim=F.col("claim"),
            domain=F.col("domain"),
            attempts=F.col("attempt_count"),
            exhausted=_flag("maximum_attempts_reached"),
            count=F.col("evidence_count"),
            evidence=F.coalesce("evidence", F.lit(NO_EVIDENCE)),
            reflection=reflection_summary(),
        ),
    )
    reminder = F.when(F.col("try_no") > 1, RETRY_REMINDER).otherwise("")
    return base.withColumn(
        "try_no", F.explode(F.array(*[F.lit(n) for n in range(1, tries + 1)]))
    ).select("claim_id", "try_no", F.concat("_base", reminder).alias("prompt"))


def verdict_parts(inputs: DataFrame, evidence: DataFrame, order: list[str],
                  size: int = PART_CHARS, row_limit: int = GROUP_ROW_LIMIT,
                  measured: DataFrame | None = None) -> DataFrame:
    """:func:`verdict_prompts` in numbered parts, for the first try.

    A later try is the same parts with ``RETRY_REMINDER`` at the end, so they are not written again.
    """
    frame = _framed(
        VERDICT_TEMPLATE,
        claim=F.col("claim"),
        domain=F.col("domain"),
        attempts=F.col("attempt_count"),
        exhausted=_flag("maximum_attempts_reached"),
        count=F.col("evidence_count"),
        reflection=reflection_summary(),
    )
    absent = F.when(F.col("_count").isNull(), NO_EVIDENCE).otherwise("")
    return _stage_parts(
        inputs, "left", F.concat(frame["head"], absent), frame["tail"], evidence, order,
        verdict_block(), "\n", ("claim_id",), size, row_limit, measured,
    )


def explanation_prompts(inputs: DataFrame, evidence: DataFrame, verdicts: DataFrame,
                        order: list[str], row_limit: int = GROUP_ROW_LIMIT,
                        measured: DataFrame | None = None) -> DataFrame:
    """One prompt per verdict, with evidence, reflection and verdict as JSON, all their fields.

    ``verdicts`` carry ``key_evidence_used``, see ``verdicts.with_key_evidence``.
    """
    blocks = evidence_text(
        evidence, order, json_block(evidence), ",", row_limit, measured=measured
    ).drop("evidence_count")
    joined = inputs.join(verdicts.select("claim_id", *VERDICT_FIELDS), "claim_id").join(
        blocks, "claim_id", "left"
    )
    prompt = fill(EXPLANATION_TEMPLATE, evidence=F.col("evidence"), **_explanation_values())
    return joined.select("claim_id", prompt.alias("prompt"))


def explanation_parts(inputs: DataFrame, evidence: DataFrame, verdicts: DataFrame,
                      order: list[str], size: int = PART_CHARS,
                      row_limit: int = GROUP_ROW_LIMIT,
                      measured: DataFrame | None = None) -> DataFrame:
    """:func:`explanation_prompts` in numbered parts, for claims with more evidence than a row holds."""
    frame = _framed(EXPLANATION_TEMPLATE, **_explanation_values())
    judged = inputs.join(verdicts.select("claim_id", *VERDICT_FIELDS), "claim_id")
    return _stage_parts(
        judged, "left", frame["head"], frame["tail"], evidence, order, json_block(evidence), ",",
        ("claim_id",), size, row_limit, measured,
    )


def explanation_prompts_in_row(judged: DataFrame) -> DataFrame:
    """:func:`explanation_prompts` of claims that hold their verdict and, as ``passages``, the
    final evidence with JSON blocks; see ``verdicts.with_key_passages``."""
    evidence = F.array_join(F.col("passages")["block"], ",")
    prompt = fill(EXPLANATION_TEMPLATE, evidence=evidence, **_explanation_values())
    return judged.select("claim_id", prompt.alias("prompt"))


def explanation_parts_in_row(judged: DataFrame, size: int = PART_CHARS) -> DataFrame:
    """:func:`explanation_parts` of claims that hold their verdict and passages."""
    frame = _framed(EXPLANATION_TEMPLATE, **_explanation_values())
    framed = judged.select(
        "claim_id", frame["head"].alias("head"), F.col("passages")["block"].alias("blocks"),
        frame["tail"].alias("tail"),
    )
    return _cut_in_row(framed, ["claim_id"], ",", size)


def _explanation_values() -> dict[str, Column]:
    return {
        "verdict": F.col("final_verdict"),
        "claim": F.col("claim"),
        "domain": F.col("domain"),
        "attempts": F.col("attempt_count"),
        "exhausted": _flag("maximum_attempts_reached"),
        "count": F.col("evidence_count"),
        "reflection": F.to_json(F.struct(*RESULT)),
        "result": F.to_json(F.struct(*VERDICT_FIELDS)),
        "baseline": baseline_confidence(F.col("confidence_score")),
    }
