"""Evidence retrieval: the passages nearest to each claim, by shared words or by vectors.

Both searches are exact, and neither pairs claims with passages that can't be among the results.

**Words** (:func:`retrieve_lexical`).  The likeness of two texts is that of their sets of words,
shared words over all words (Jaccard).  Words are put in one order, rare ones first.  Sets of
likeness ``least`` or more share a word among the first ``n - ceil(least n) + 1`` of each, so only
these go into the inverted index; frequent words come last and are seldom in it.  Sizes and the
places of the word that met bound the words that can be shared, and what passes is counted in
full.  How often words occur is kept in :data:`SLOTS` counters that words share by hash, so the
statistic has one size whatever the vocabulary; it steers work, never results.  A word with more
than :data:`POSTINGS` occurrences is dealt to several tasks.

**Vectors** (:func:`retrieve_topk`).  Passages are grouped around pivots and, inside a group, cut
by their angle to the pivot.  The angle of a claim to the pivot bounds its angle to all passages
of a cell (the Cauchy-Schwarz inequality on what lies across the pivot), hence their best cosine.
Cells are visited in rounds, best bound first, until a claim's k-th score beats the bounds of all
cells left.

Claims with equal sets of words are searched once, as are equal vectors, which carry as many of
their smallest ids as a result can use.  Null ids take no part, nor do texts without words and vectors
that are null, zero, or hold a null or non-finite component; vectors of different length don't meet.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Functions of this module travel to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Counters of word occurrences (a power of two), and occurrences of a word that one task is given.
SLOTS, POSTINGS = 65_536, 200_000
#: Room for rounding in thresholds on counts.
SLACK = 1e-9
#: Pivots at most, passages per cell, and claims that travel together.
PIVOTS, CELL, BLOCK = 1024, 16_384, 16_384
#: Cells that a claim visits in the rounds before the last.
ROUNDS = (2, 16)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(_words(text))


def _pinned(frame: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def _first_of_each(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each key as ``at`` = 1..k; Spark cuts groups before it shuffles them."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("at", F.row_number().over(window)).filter(F.col("at") <= k)


# --- words ----------------------------------------------------------------------------


def _slot(number: Column) -> Column:
    """The slot of a word, from its hash or from its number in :func:`_postings`."""
    return number.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _constant(values: Sequence[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def word_counts(texts: DataFrame, text: str = "text") -> Column:
    """Occurrences by slot in all texts, as a constant array."""
    word = texts.select(F.explode(_words(F.col(text))).alias("word"))
    counted = word.groupBy(_slot(F.xxhash64("word")).alias("slot")).count()
    counts = [0] * SLOTS
    for row in counted.collect():
        counts[row["slot"]] = min(row["count"], 2**30)
    return _constant(counts, "long")


def _sets(rows: DataFrame, ids: Sequence[str], text: str) -> DataFrame:
    """id (a struct) and the sorted words of the texts that have any."""
    known = rows.select(F.struct(*ids).alias("id"), F.sort_array(words(F.col(text))).alias("words"))
    for name in ids:
        known = known.filter(F.col(f"id.{name}").isNotNull())
    return known.filter(F.size("words") > 0)


def _postings(sets: DataFrame, counts: Column, least: float, wanted: Column | None = None) -> DataFrame:
    """The first words of each set, rare ones first: all columns, place, word, salts of the word.

    A word is its count and half a hash in one number.  Words that agree in it meet in vain.
    Only words whose slot is ``wanted`` become rows.
    """
    number = lambda h: F.call_function("shiftleft", F.get(counts, _slot(h)), F.lit(32)).bitwiseOR(
        h.bitwiseAND(F.lit(0xFFFFFFFF))
    )
    ranked = F.sort_array(F.transform(F.transform("words", lambda w: F.xxhash64(w)), number))
    size = F.size("words")
    length = (size - F.ceil(size * least - SLACK) + 1).cast("int")
    first = F.transform(F.slice(ranked, F.lit(1), length), lambda w, at: F.struct(at.alias("place"), w.alias("word")))
    if wanted is not None:
        first = F.filter(first, lambda p: F.get(wanted, _slot(p["word"])) == 1)
    salts = F.floor(F.call_function("shiftright", F.col("word"), F.lit(32)) / POSTINGS) + 1
    return sets.select("*", F.inline(first)).withColumn("salts", salts.cast("int"))


def lexical_candidates(claims: DataFrame, passages: DataFrame, counts: Column, least: float) -> DataFrame:
    """Pairs that may be ``least`` alike or more, with the words of both.

    ``claims`` has key and words, ``passages`` id and words.  A pair may come several times.
    """
    asked = (
        _postings(claims.select("key", "words"), counts, least)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .select("word", "salt", F.col("key").alias("claim_key"), F.col("words").alias("claim_words"), F.col("place").alias("claim_place"))
    )
    flags = [0] * SLOTS
    for row in asked.select(_slot(F.col("word")).alias("slot")).distinct().collect():
        flags[row["slot"]] = 1
    given = _postings(passages, counts, least, _constant(flags, "tinyint"))
    given = given.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    claim_size, size = F.size("claim_words"), F.size("words")
    left = F.least(claim_size - F.col("claim_place"), size - F.col("place"))
    return (
        given.join(asked, ["word", "salt"])
        # As if this were the first word that both share.
        .filter(left >= F.ceil((claim_size + size) * (least / (1 + least)) - SLACK))
        .select("claim_key", "claim_words", "id", "words")
    )


def retrieve_lexical(
    claims: DataFrame, passages: DataFrame, claim_ids: Sequence[str], passage_ids: Sequence[str],
    least: float = 0.5, k: int = 5, text: str = "text", counts: Column | None = None,
) -> DataFrame:
    """claim ids, rank, passage ids, shared, likeness: each claim's ``k`` most alike passages.

    Only passages of likeness ``least`` (above 0) or more count; ties go to smaller ids.
    ``counts`` are :func:`word_counts` of any texts, by default those of the passages.
    Passages are shuffled only if the claims are too many to be broadcast, which adaptive
    execution sees; the first k hits of a claim are cut in each task before they travel.
    """
    key = F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"))
    asked = _sets(claims, claim_ids, text).withColumn("key", key)
    given = _sets(passages, passage_ids, text)
    counts = word_counts(passages, text) if counts is None else counts
    shared = F.size(F.array_intersect("words", "claim_words"))
    sizes = F.size("words") + F.size("claim_words")
    hits = (
        lexical_candidates(asked.dropDuplicates(["key"]), given, counts, least)
        .select("claim_key", "id", shared.alias("shared"), sizes.alias("sizes"))
        .withColumn("likeness", F.col("shared") / (F.col("sizes") - F.col("shared")))
        .filter(F.col("likeness") >= least - SLACK)
        .select("claim_key", "id", "shared", "likeness")
        .distinct()
    )
    ranked = _first_of_each(hits, ["claim_key"], [F.desc("likeness"), "id"], k)
    best = ranked.groupBy("claim_key").agg(
        F.sort_array(F.collect_list(F.struct("at", "id", "shared", "likeness"))).alias("best")
    )
    return (
        asked.select("id", F.col("key").alias("claim_key")).join(best, "claim_key")
        .select("id", F.explode("best").alias("b"))
        .select("id.*", F.col("b.at").alias("rank"), "b.id.*", F.col("b.shared").alias("shared"), F.col("b.likeness").alias("likeness"))
    )


# --- vectors --------------------------------------------------------------------------


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return (
        rows.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter(sound)
        .withColumn("width", F.size("v"))
    )


def _by_width(widths: pd.Series, vectors: pd.Series):
    for width in widths.unique():
        places = np.flatnonzero(widths.to_numpy() == width)
        yield int(width), places, _stacked(vectors.iloc[places])


def _bounds(pivots: np.ndarray, cells: tuple[np.ndarray, ...], vectors: np.ndarray) -> np.ndarray:
    """The best cosine that each vector can have in each cell.

    A cell has a pivot, and a least and a largest angle of its passages to it; angles obey
    the triangle inequality.
    """
    _, pivot, low, high = cells
    angle = np.arccos(np.clip(_units(vectors) @ pivots.T, -1, 1))[:, pivot]
    return np.cos(np.clip(np.maximum(low - angle, angle - high), 0, np.pi)) + SLACK


def retrieve_topk(
    claims: DataFrame, passages: DataFrame, claim_id: str, passage_id: str, vector: str = "embedding",
    k: int = 5, not_itself: bool = False, visits: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """claim id as ``claim_id``, rank, passage id as ``passage_id``, score: the ``k`` largest cosines of each claim.

    Ties go to smaller ids.  ``not_itself`` leaves out the passage whose id is the claim's.
    ``visits`` gets, per round, how many pairs of a claim and a cell were visited and how many
    of a claim and a passage were scored.
    """
    spark = passages.sparkSession
    keep = k + int(not_itself)
    rows = _vectors(passages, passage_id, vector).withColumn(
        "key", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ","))
    )
    ids = _first_of_each(rows.select("key", "id").distinct(), ["key"], ["id"], keep).groupBy("key").agg(
        F.sort_array(F.collect_list("id")).alias("ids")
    )
    points = rows.groupBy("key").agg(F.first("v").alias("v"), F.first("width").alias("width")).join(ids, "key")
    counts = {r["width"]: r["count"] for r in rows.groupBy("width").count().collect()}
    drawn: dict[int, list] = {}
    for row in _first_of_each(rows.select("width", "v"), ["width"], [F.xxhash64("v")], PIVOTS).collect():
        if row["at"] <= np.ceil(np.sqrt(counts[row["width"]])):
            drawn.setdefault(row["width"], []).append(row["v"])
    # At most PIVOTS vectors of each width.
    pivots = spark.sparkContext.broadcast({width: _units(np.array(v, dtype=float)) for width, v in drawn.items()})

    @F.pandas_udf("pivot int, angle double")
    def grouped(width: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(v), 2))
        for w, places, vectors in _by_width(width, v):
            cosine = np.clip(_units(vectors) @ pivots.value[w].T, -1, 1)
            nearest = cosine.argmax(axis=1)
            out[places] = np.column_stack([nearest, np.arccos(cosine[np.arange(len(places)), nearest])])
        return pd.DataFrame({"pivot": out[:, 0].astype(int), "angle": out[:, 1]})

    parts = max(1, -(-sum(counts.values()) // CELL))
    placed = _pinned(
        points.select("*", grouped("width", "v").alias("g")).select("v", "width", "ids", "g.*")
        .repartitionByRange(parts, "width", "pivot", "angle", "ids")
        .withColumn("part", F.spark_partition_id())
    )
    sides = placed.groupBy("width", "part", "pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    listed: dict[int, list] = {}
    for row in sides.collect():
        listed.setdefault(row["width"], []).append((row["part"], row["pivot"], row["low"], row["high"]))
    cells = {}
    for width, some in listed.items():
        part, pivot, low, high = map(np.array, zip(*some))
        cells[width] = np.column_stack([part, pivot]), pivot, low, high
    # One entry per pivot and one per part at most.
    known = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("array<struct<part: int, pivot: int>>")
    def next_cells(width: pd.Series, v: pd.Series, kth: pd.Series, done: pd.Series, end: pd.Series) -> pd.Series:
        """The cells of this round, in order of bound, that may beat the k-th score."""
        out = pd.Series([[] for _ in range(len(v))], dtype=object)
        for w, places, vectors in _by_width(width, v):
            if w not in known.value:
                continue
            names = known.value[w][0]
            for at, row in zip(places, _bounds(pivots.value[w], known.value[w], vectors)):
                order = np.argsort(-row, kind="stable")[done.iat[at] : end.iat[at]]
                out.iat[at] = [(int(p), int(g)) for p, g in names[order[row[order] >= kth.iat[at]]]]
        return out

    def look(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best of one cell for each claim of a block; ties at the end of the list stay."""
        out = [pd.DataFrame({"id": left["id"].head(0), "score": [], "passage": left["id"].head(0)})]
        if len(left) and len(right):
            vectors = _units(_stacked(right["in_v"]))
            ids = right["in_ids"].to_numpy()
            for base in range(0, len(left), 256):
                some = left.iloc[base : base + 256]
                score = np.clip(_units(_stacked(some["v"])) @ vectors.T, -1, 1)
                least = np.partition(score, -keep, axis=1)[:, -keep] if len(right) > keep else np.full(len(some), -2.0)
                at, row = np.nonzero(score >= np.maximum(least, some["kth"].to_numpy())[:, None] - SLACK)
                times = np.array([len(ids[r]) for r in row], dtype=int)
                every = np.concatenate([ids[r] for r in row]) if len(row) else []
                best = pd.DataFrame(
                    {"id": some["id"].to_numpy()[np.repeat(at, times)], "score": np.repeat(score[at, row], times), "passage": every}
                )
                best = best.sort_values(["id", "score", "passage"], ascending=[True, False, True])
                out.append(best.groupby("id").head(keep))
        return pd.concat(out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    asked = _vectors(claims, claim_id, vector).dropDuplicates(["id"])
    blocks = max(1, -(-claims.count() // BLOCK))
    asked = _pinned(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")))
    best = spark.createDataFrame([], f"id {asked.schema['id'].dataType.simpleString()}, score double, passage {kinds['id']}")
    done = 0
    for end in (*ROUNDS, 2**30):
        kth = best.groupBy("id").agg(F.when(F.count(F.lit(1)) >= keep, F.min("score")).alias("kth"))
        going = (
            asked.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
            .withColumn("cell", F.explode(next_cells("width", "v", "kth", F.lit(done), F.lit(end))))
            .select("id", "v", "width", "kth", "block", "cell.*")
        )
        going = _pinned(going) if visits is not None else going
        wanted = going.select(*[F.col(name).alias(f"for_{name}") for name in ("width", "part", "pivot", "block")]).distinct()
        alike = [F.col(name) == F.col(f"for_{name}") for name in ("width", "part", "pivot")]
        given = placed.join(wanted, alike).select(
            "for_width", "for_part", "for_pivot", "for_block", F.col("v").alias("in_v"), F.col("ids").alias("in_ids")
        )
        if visits is not None:
            sizes = placed.groupBy("width", "part", "pivot").agg(F.count(F.lit(1)).alias("n"))
            row = going.join(sizes, ["width", "part", "pivot"]).agg(F.count(F.lit(1)), F.sum("n")).first()
            visits.append((row[0], row[1] or 0))
        fresh = (
            going.groupBy("width", "part", "pivot", "block")
            .cogroup(given.groupBy("for_width", "for_part", "for_pivot", "for_block"))
            .applyInPandas(look, f"id {kinds_of(asked)}, score double, passage {kinds['id']}")
        )
        best = _pinned(
            _first_of_each(best.unionByName(fresh), ["id"], [F.desc("score"), "passage"], keep).drop("at")
        )
        done = end
    if not_itself:
        best = best.filter(F.col("id") != F.col("passage"))
    ranked = _first_of_each(best, ["id"], [F.desc("score"), "passage"], k)
    return ranked.select(
        F.col("id").alias("claim_id"), F.col("at").alias("rank"), F.col("passage").alias("passage_id"), "score"
    )


def kinds_of(frame: DataFrame) -> str:
    return frame.schema["id"].dataType.simpleString()
