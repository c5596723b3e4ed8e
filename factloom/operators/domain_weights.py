"""Subject domain of a claim by word weights learned from labelled claims.

The weight of a word for a domain is its log-odds there against all other domains, smoothed by
a Dirichlet prior: each word is given in advance :data:`PRIOR` times its share of all words, so
rare words start near zero.  A claim scores the sum of its words' weights plus the log share of
the domain's claims; the largest score wins, ties go to the domain named first, and a claim
without a known word is Unknown.  Counts are aggregates with map-side combine; the vocabulary is
a table with one row per word, and only one number per domain reaches the driver.

Labels other than the named domains teach nothing, nor do null ones or claims without words.
Without labels at all every claim is Unknown; the lexicon in :mod:`.domains` needs none.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .domains import DOMAINS, UNKNOWN, words_of

#: Words given in advance to all domains together.
PRIOR = 100.0
_LEAST = 1e-9
#: A word with more than this share of all words (1 in so many) is joined by broadcast; as the
#: shares add up to one, there are at most so many of them.
OFTEN = 1000


def word_weights(
    labelled: DataFrame, claim: str = "claim", label: str = "label", prior: float = PRIOR
) -> tuple[DataFrame, dict[str, float]]:
    """(word with its ``weights``, one per domain in order, and whether it is said ``often``; log share of
    claims per domain that has any)."""
    taught = labelled.select(F.col(label).alias("label"), words_of(F.col(claim)).alias("words")).filter(
        F.col("label").isin(DOMAINS) & (F.size("words") > 0)
    )
    totals = {
        r["label"]: (r["claims"], r["words"])
        for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("claims"), F.sum(F.size("words")).alias("words")).collect()
    }
    claims, words = (sum(t[at] for t in totals.values()) for at in (0, 1))
    here = [F.count_if(F.col("label") == name).alias(f"n_{at}") for at, name in enumerate(DOMAINS)]
    counted = taught.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *here)

    def odds(count: Column, whole: float) -> Column:
        given = F.col("n") * F.lit(prior / max(words, 1))
        return F.log((count + given) / F.greatest(F.lit(whole + prior) - count - given, F.lit(_LEAST)))

    def weight(at: int, name: str) -> Column:
        whole = totals.get(name, (0, 0))[1]
        if whole in (0, words):
            return F.lit(0.0)
        return odds(F.col(f"n_{at}"), whole) - odds(F.col("n") - F.col(f"n_{at}"), words - whole)

    weights = F.array(*[weight(at, name) for at, name in enumerate(DOMAINS)])
    often = (F.col("n") * OFTEN > F.lit(words)).alias("often")
    return counted.select("word", weights.alias("weights"), often), {n: log(c / claims) for n, (c, _) in totals.items()}


def classify(
    claims: DataFrame, weights: DataFrame, shares: dict[str, float], key: str = "claim_id", claim: str = "claim"
) -> DataFrame:
    """(key, domain, confidence) of each claim; confidence is the domain's part of all odds.

    ``key`` is unique.  Words said often are looked up where the claims are, so that no task of
    the join on words gets all claims that hold one.
    """
    spoken = claims.select(key, F.explode(words_of(F.col(claim))).alias("word"))
    sums = [F.sum(F.col("weights")[at]).alias(f"s_{at}") for at in range(len(DOMAINS))]
    often = weights.filter("often").select("word", "weights")
    tagged = spoken.join(F.broadcast(often), "word", "left")
    rare = tagged.filter(F.col("weights").isNull()).select(key, "word").join(
        weights.filter(~F.col("often")).select("word", "weights"), "word"
    )
    found = tagged.filter(F.col("weights").isNotNull()).select(key, "weights").unionByName(rare.select(key, "weights"))
    scored = found.groupBy(key).agg(*sums)
    named = [(F.col(f"s_{at}") + F.lit(shares[name]), name) for at, name in enumerate(DOMAINS) if name in shares]
    none = claims.select(key, F.lit(UNKNOWN).alias("domain"), F.lit(0.0).alias("confidence"))
    if not named:
        return none
    scores = F.array(*[score for score, _ in named])
    best = F.array_max("scores")
    place = F.array_position("scores", best).cast("int")
    odds = F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.exp(s - best))
    found = scored.select(key, scores.alias("scores")).select(
        key, F.element_at(F.array(*[F.lit(name) for _, name in named]), place).alias("domain"), (1 / odds).alias("confidence")
    )
    return none.select(key).join(found, key, "left").select(
        key, F.coalesce("domain", F.lit(UNKNOWN)).alias("domain"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def quality(judged: DataFrame, expected: str = "expected_domain") -> DataFrame:
    """Per domain: claims that expect it, precision and recall (null where there is nothing to divide by)."""
    each = judged.select(F.explode(F.array_distinct(F.array("domain", expected))).alias("name"), "domain", expected)
    hits = F.count_if((F.col("domain") == F.col("name")) & (F.col(expected) == F.col("name")))
    guessed, real = F.count_if(F.col("domain") == F.col("name")), F.count_if(F.col(expected) == F.col("name"))
    return each.groupBy(F.col("name").alias("domain_name")).agg(
        real.alias("claims"),
        F.round(hits / F.nullif(guessed, F.lit(0)), 4).alias("precision"),
        F.round(hits / F.nullif(real, F.lit(0)), 4).alias("recall"),
    )
