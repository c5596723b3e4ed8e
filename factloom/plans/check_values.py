"""Fixed values of the checks, written out on purpose.

The checks must not take them from the code they check, or a slip there would not show.
"""

# --- fixed values -----------------------------------------------------------
#: Every character that counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
#: Phrases that claim several sources, and what they become where there is one.
NOTES = [
    ("multiple sources", "the single retrieved source"),
    ("various sources", "the retrieved source"),
    ("sources confirm", "the source confirms"),
    ("sources agree", "the source states"),
    ("sources contradict each other", "no conflicting sources exist"),
]
REASONING = [
    ("multiple authoritative sources", "an authoritative source"),
    ("multiple sources", "the single provided source"),
    ("various sources", "the provided source"),
    ("sources confirm", "the source confirms"),
    ("across sources", "in the source"),
]
PLACEHOLDERS = [
    "item 1", "item 2", "source 1", "source 2", "evidence item 1", "evidence item 2",
]
LEAD_INS = [
    "Claim:", "CLAIM:", "Main Claim:", "Main claim:",
    "Extracted Claim:", "Extracted claim:", "Output:", "OUTPUT:",
]
DOMAINS = ["Medical", "Politics", "Finance", "Technology", "Unknown"]
#: Words that tell a domain.
LEXICON = {
    "Medical": [
        "disease", "diseases", "doctor", "doctors", "healthcare", "hospital", "medical",
        "medicine", "patients", "treatment", "treatments", "vaccine", "vaccines",
        "covid", "flu", "malaria", "vaccination", "variant",
    ],
    "Politics": [
        "election", "elections", "government", "law", "laws", "parliament", "party",
        "policies", "political", "politician", "politicians", "bill", "minister",
        "polling", "prime",
    ],
    "Finance": [
        "bank", "banking", "currencies", "currency", "economic", "economy", "interest",
        "investment", "investments", "market", "markets", "stock", "stocks", "tax",
        "taxes", "bitcoin", "rate", "rbi", "repo", "sebi", "trading",
    ],
    "Technology": [
        "ai", "cybersecurity", "gadget", "gadgets", "hardware", "software",
        "technology", "gemini", "google", "microsoft", "multimodal", "openai", "windows",
    ],
}
# --- prompt texts
CLAIM_TEMPLATE = (
    'Read the text below and state its main factual claim in one sentence of 10 to 30 words. '
    'Keep names, events, numbers, dates and percentages; add nothing and judge nothing.\n'
    '\n'
    'TEXT:\n'
    '{text}\n'
    '\n'
    'Answer with the claim only.'
)
DOMAIN_TEMPLATE = (
    'Decide which subject the claim below is mainly about: Medical, Politics, Finance, '
    'Technology or Unknown. Use Unknown for weather, sports, entertainment, accidents, '
    'crime, travel, education and anything else outside the first four.\n'
    'Answer with JSON only: {"domain": "", "confidence": 0.0, "reason": ""}, the confidence '
    'between 0.0 and 1.0.\n'
    '\n'
    'Claim:\n'
    '{claim}\n'
)
REFLECTION_TEMPLATE = (
    'Judge whether the evidence below is sufficient and reliable for the claim. Do not judge '
    'the claim itself.\n'
    '\n'
    'Claim ({domain}): {claim}\n'
    '\n'
    'Passages found: {count}\n'
    '{evidence}\n'
    '\n'
    '- Similarity is relevance, authority is reliability; high similarity from a source with '
    'authority below 0.40 is weak evidence and means NO.\n'
    '- Evidence that opposes the claim is not a conflict among the evidence; only two or '
    'more items can contradict each other.\n'
    '- Name no source that is not listed above.\n'
    'Answer with JSON only: {"decision": "YES" or "NO", "is_evidence_sufficient": bool, '
    '"contradictions_found": bool, "confidence": 0.0-1.0, "notes": "", "support_score": '
    '0.0-1.0, "source_credibility_score": 0.0-1.0, "evidence_quality_score": 0.0-1.0, '
    '"claim_supported": bool, "claim_contradicted": bool, '
    '"evidence_items_contradict_each_other": bool}'
)
VERDICT_TEMPLATE = (
    'Claim ({domain}): {claim}\n'
    'Searches made: {attempts}, limit reached: {exhausted}\n'
    '\n'
    'Passages to cite: {count}\n'
    '{evidence}\n'
    'Earlier assessment: {reflection}\n'
    '\n'
    'Decide Real, Fake or Unverified from the evidence above only. Weak or conflicting '
    'evidence is Unverified; similarity without authority is never enough for Real. Cite '
    "evidence as 'SourceName (evidence_id)' and nothing that is not listed.\n"
    'Answer with JSON only: {"final_verdict": "", "confidence_score": 0-100, "trust_score": '
    '0-100, "reasoning_summary": "", "key_evidence_used": [""]}'
)
RETRY_REMINDER = (
    '\n'
    '\n'
    'The answer before this one was not valid JSON. Answer with the JSON object alone.'
)
EXPLANATION_TEMPLATE = (
    'Explain the verdict "{verdict}" to a general reader. Do not change it, invent no '
    'source, and tell relevance from authority.\n'
    '\n'
    'Claim ({domain}): {claim}\n'
    'Searches made: {attempts}, limit reached: {exhausted}\n'
    '\n'
    '{count} passages as JSON: [{evidence}]\n'
    'Assessment as JSON: {reflection}\n'
    'Verdict as JSON: {result}\n'
    '\n'
    'Answer with JSON only: {"final_verdict": "{verdict}", "explanation": "", '
    '"evidence_summary": [""], "source_analysis": "", "reasoning": "", "confidence": '
    '{baseline}}'
)
# ----------------------------------------------------------------------------
