"""Rewriting of plural-source wording when a claim has at most one evidence item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: phrase -> replacement, applied in this order ----------------
NOTES_PHRASES = [
    ("multiple sources", "the single retrieved source"),
    ("various sources", "the retrieved source"),
    ("sources confirm", "the source confirms"),
    ("sources agree", "the source states"),
    ("sources contradict each other", "no conflicting sources exist"),
]
VERDICT_PHRASES = [
    ("multiple authoritative sources", "an authoritative source"),
    ("multiple sources", "the single provided source"),
    ("various sources", "the provided source"),
    ("sources confirm", "the source confirms"),
    ("across sources", "in the source"),
]
# ----------------------------------------------------------------------------


def singular_sources(text: Column, evidence_count: Column, phrases: list[tuple[str, str]]) -> Column:
    """Apply the phrase list, ignoring case, where ``evidence_count`` is at most one."""
    rewritten = text
    for phrase, replacement in phrases:
        rewritten = F.regexp_replace(rewritten, rf"(?iU)\b{phrase}\b", replacement)
    return F.when(evidence_count <= 1, rewritten).otherwise(text)
