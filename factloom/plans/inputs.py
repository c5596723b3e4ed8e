"""Inputs of the catalogue queries, derived from the given tables.

The given tables hold no submissions, evidence or model replies, so these are
derived from them, row by row and over whole tables.  The SQL is plain enough to
run on other engines as it stands, which lets a check start from equal inputs.
Braces name tables; doubled braces are literal.
"""

from __future__ import annotations

import string
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Telugu sentences used in the inputs, with the translation the memory holds.
TELUGU_A = "తెలంగాణ ప్రభుత్వం ప్రకటించింది."
TELUGU_B = "కొత్త పథకం మొదలైంది https://t.example/a?b=1 చూడండి."
TELUGU_C = "వర్షం పడింది।"

INPUTS: dict[str, str] = {
    # Documents with every kind of noise, script and layout that cleaning looks at.
    "noisy_documents": f"""
        SELECT doc_id, source, concat(
            CASE WHEN doc_id % 7 = 0 THEN '@@## ^^ ' ELSE '' END,
            text,
            CASE WHEN doc_id % 9 = 0 THEN ' bell\a\x1b rings' ELSE '' END,
            CASE WHEN doc_id % 5 = 0 THEN ' {TELUGU_A} {TELUGU_B}' ELSE '' END,
            CASE WHEN doc_id % 10 = 0 THEN ' {TELUGU_C} It is 2 . 5 , no ? ! really !?!? .....' ELSE '' END,
            CASE WHEN doc_id % 3 = 0 THEN ' It rose by 0 . 50 % to ₹ 5,000 !!!' ELSE '' END,
            CASE WHEN doc_id % 6 = 0 THEN ' cafe\u0301 \ufefface\u200bs\u00a0 end' ELSE '' END,
            CASE WHEN doc_id % 8 = 0 THEN ' See https://a.example/x?id=1, WWW.B.example and http://a.example .' ELSE '' END,
            CASE WHEN doc_id % 11 = 0 THEN ' one\ufdd0two three. four\ufdd0. Five!\ufdd0' ELSE '' END,
            CASE WHEN doc_id % 4 = 0 THEN '\n Breaking\t  news today\nBREAKING news TODAY\n\n  \nBreaking news today \nother ~~ || **++ line\n' ELSE '' END
        ) AS text
        FROM {{documents}}""",
    # Short texts of every script mix, with empty ones.
    "short_posts": """
        SELECT o_orderkey AS post_id, CASE o_orderkey % 12
            WHEN 0 THEN 'తెలంగాణ ప్రభుత్వం'
            WHEN 1 THEN concat('Order ', o_orderpriority, ' హైదరాబాద్')
            WHEN 2 THEN concat(CAST(o_orderkey AS STRING), ' !!')
            WHEN 3 THEN ''
            WHEN 4 THEN '  \t '
            WHEN 5 THEN 'Hi'
            WHEN 6 THEN 'హా'
            WHEN 7 THEN concat('హైదరాబాద్ నగరం గురించి ', o_orderstatus)
            WHEN 8 THEN concat('A long English line about order ', o_orderpriority, ' with two letters హా')
            WHEN 9 THEN NULL
            WHEN 10 THEN concat('https://s.example/', CAST(o_orderkey AS STRING))
            ELSE concat('Priority ', o_orderpriority, ' status ', o_orderstatus, ' వార్త') END AS text
        FROM {orders}""",
    # Documents as submissions: some without text, some with an image, some with neither.
    "submissions": """
        SELECT doc_id AS submission_id,
            CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 4 THEN '   '
                 WHEN doc_id % 50 = 9 THEN ' @@@ ## ' ELSE text END AS text,
            CASE WHEN doc_id % 4 = 1 THEN NULL
                 WHEN doc_id % 11 = 0 THEN concat('missing-', CAST(doc_id AS STRING))
                 WHEN doc_id % 4 = 2 THEN '' ELSE CAST(doc_id AS STRING) END AS image_id
        FROM {noisy_documents}""",
    "images": "SELECT CAST(o_orderkey AS STRING) AS image_id FROM {orders}",
    # Line items as blocks of text recognised in images, boxes given by corner and size.
    "ocr_blocks": f"""
        SELECT CAST(l_orderkey AS STRING) AS image_id,
            l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS block_no,
            CAST(l_partkey % 600 AS DOUBLE) AS x,
            CAST((l_suppkey % 20) * 12 AS DOUBLE) AS y,
            CAST(CASE WHEN l_partkey % 9 = 0 THEN 0.25 ELSE 8 + l_quantity % 9 END AS DOUBLE) AS h,
            CASE WHEN l_partkey % 19 = 0 THEN '  '
                 WHEN l_orderkey % 15 = 0 THEN concat(p_name, ' {TELUGU_A}')
                 ELSE concat(' ', p_name) END AS text,
            CAST(l_partkey % 17 AS DOUBLE) / 16 AS confidence
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "translation_memory": f"""
        SELECT source_sentence, translated FROM (
            SELECT '{TELUGU_A}' AS source_sentence, 'The Telangana government announced.' AS translated
            UNION ALL
            SELECT 'కొత్త పథకం మొదలైంది __PROTECTED_URL_0__ చూడండి', ' A new scheme began, see __PROTECTED_URL_0__ now '
        ) AS known""",
    # Orders as claims, with the subject each one was written for.
    "claims": """
        SELECT o_orderkey AS claim_id,
            CASE WHEN o_orderkey % 50 = 7 THEN '  ' WHEN o_orderkey % 50 = 8 THEN NULL
            ELSE CASE o_orderkey % 6
                WHEN 0 THEN concat('Doctors tested vaccine batch ', CAST(o_orderkey AS STRING), ' on 40% of patients.')
                WHEN 1 THEN concat('The government tabled bill ', CAST(o_custkey AS STRING), ' in parliament.')
                WHEN 2 THEN concat('The central bank moved the repo rate by ', CAST(o_custkey % 90 AS STRING), ' basis points.')
                WHEN 3 THEN concat('A software update ', CAST(o_orderkey AS STRING), ' fixes the hardware driver.')
                WHEN 4 THEN concat('Heavy rain stopped match ', CAST(o_orderkey AS STRING), '.')
                ELSE concat('The bank bought new software for branch ', CAST(o_custkey AS STRING), '.') END
            END AS claim,
            CASE WHEN o_orderkey % 40 = 1 THEN '' WHEN o_orderkey % 40 = 2 THEN '  '
                 WHEN o_orderkey % 40 = 3 THEN NULL
            ELSE CASE o_orderkey % 6 WHEN 0 THEN 'Medical' WHEN 1 THEN ' Politics ' WHEN 2 THEN 'Finance'
                WHEN 3 THEN 'Technology' WHEN 4 THEN 'Unknown' ELSE 'Finance' END END AS domain
        FROM {orders}""",
    # Line items as evidence; scores are multiples of 1/128, so sums are exact in any order.
    "evidence": """
        SELECT l_orderkey AS claim_id, 1 + (l_linenumber - 1) % 3 AS attempt_no,
            l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS arrival,
            CASE WHEN l_suppkey % 10 = 0 THEN NULL
                 ELSE concat('ev-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS evidence_id,
            CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE concat('chunk-', CAST(l_partkey AS STRING)) END AS chunk_id,
            concat('doc-', CAST(l_suppkey AS STRING)) AS document_id,
            concat('Lot ', CAST(l_partkey AS STRING), ' left under flag ', l_returnflag) AS text,
            'Finance' AS domain,
            CASE WHEN l_suppkey % 31 = 0 THEN NULL WHEN l_suppkey % 29 = 0 THEN 'AB' ELSE s_name END AS source,
            CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE 'en' END AS language,
            CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 129 AS DOUBLE) / 128 END AS similarity_score,
            CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_suppkey % 129 AS DOUBLE) / 128 END AS authority_score,
            CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN 'manual' ELSE 'faiss_local' END AS retrieval_method,
            CASE WHEN l_partkey % 47 = 0 THEN NULL ELSE 'none' END AS metadata,
            CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN ''
                 ELSE concat('https://e.example/', CAST(l_partkey AS STRING)) END AS url,
            CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('Lot ', CAST(l_partkey AS STRING)) END AS title,
            CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST('2024-03-01 08:30:00' AS TIMESTAMP) END AS retrieved_date,
            CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST('2023-05-06 00:00:00' AS TIMESTAMP) END AS publication_date
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    # Evidence as it may arrive: JSON objects, JSON of other kinds, plain text.
    "loose_evidence": """
        SELECT l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS arrival, l_orderkey AS claim_id,
            CASE WHEN l_partkey % 7 = 0 THEN concat('Plain text about lot ', CAST(l_partkey AS STRING))
                 WHEN l_partkey % 7 = 1 THEN concat('[', CAST(l_partkey AS STRING), ', 2]')
                 WHEN l_partkey % 7 = 2 THEN CAST(l_partkey AS STRING)
                 WHEN l_partkey % 7 = 4 THEN concat('{{"text": "kept whole", "domain": "Finance", "language": "en", "retrieval_method": "faiss_local", "retrieved_date": "2024-03-01", "publication_date": null, "metadata": {{"lot":"', CAST(l_partkey AS STRING), '"}}, "page": ', CAST(l_suppkey AS STRING), ', "section": "A"}}')
                 WHEN l_partkey % 7 = 3 THEN concat('{{"text": "Lot ', CAST(l_partkey AS STRING), '", "similarity_score": "0.', CAST(10 + l_partkey % 90 AS STRING), '", "authority_score": "high"}}')
                 ELSE concat('{{"chunk_id": "c', CAST(l_partkey AS STRING), '", "source": "S', CAST(l_suppkey AS STRING), '", "text": "seen", "url": null, "similarity_score": 0.',
                             CAST(10 + l_suppkey % 90 AS STRING), ', "authority_score": ', CASE WHEN l_suppkey % 2 = 0 THEN 'true' ELSE '1' END, '}}') END AS raw
        FROM {lineitem}""",
    "attempt_keys": """
        SELECT o_orderkey AS claim_id, 1 AS attempt_no, o_orderkey + 1 AS k FROM {orders}
        UNION ALL SELECT o_orderkey, 2, o_orderkey + 2 FROM {orders}
        UNION ALL SELECT o_orderkey, 3, o_orderkey + 3 FROM {orders}""",
    "reflection_replies": """
        SELECT 'reflection' AS stage, claim_id, attempt_no, 1 AS try_no, CASE
            WHEN k % 11 = 0 THEN 'not json'
            WHEN k % 13 = 0 THEN 'Sure: {{"decision": "YES" "confidence": 1}}'
            WHEN k % 17 = 0 THEN '{{}}'
            WHEN k % 23 = 0 THEN '{{"decision": "superseded", "confidence": 0.8, "decision": "YES", "notes": "superseded", "notes": "Sources agree on it."}}'
            WHEN k % 7 = 0 THEN concat('```json\n{{"decision": "yes", "confidence": "0.9", "support_score": 1.7, ',
                '"claim_supported": "false", "evidence_quality_score": "high", ',
                '"notes": "Multiple sources confirm it."}}\n```')
            WHEN k % 19 = 0 THEN '{{"decision": true, "confidence": true, "notes": null, "claim_contradicted": [], "support_score": [1]}}'
            ELSE concat('Here it is: {{"decision": "', CASE WHEN k % 5 = 0 THEN 'no' ELSE ' YES ' END,
                '", "confidence": 0.', CAST(10 + k % 90 AS STRING),
                ', "support_score": 0.', CAST(10 + k % 70 AS STRING),
                CASE WHEN k % 3 = 0 THEN '' ELSE concat(', "source_credibility_score": 0.', CAST(30 + k % 60 AS STRING)) END,
                CASE WHEN k % 4 = 0 THEN ', "evidence_quality_score": null'
                     ELSE concat(', "evidence_quality_score": 0.', CAST(50 + k % 49 AS STRING)) END,
                ', "claim_supported": ', CASE WHEN k % 2 = 0 THEN 'true' ELSE '0' END,
                ', "claim_contradicted": ', CASE WHEN k % 9 = 0 THEN '"no"' ELSE 'false' END,
                ', "evidence_items_contradict_each_other": ', CASE WHEN k % 6 = 0 THEN 'true' ELSE 'false' END,
                ', "contradictions_found": ', CASE WHEN k % 8 = 0 THEN '{{"a": 1}}' ELSE '""' END,
                ', "notes": "Various sources and SOURCES AGREE; sources contradict each other."}} done')
            END AS raw
        FROM {attempt_keys}""",
    "verdict_replies": """
        SELECT 'supervisor' AS stage, claim_id, 1 AS attempt_no, attempt_no AS try_no, CASE
            WHEN k % 5 = 0 THEN 'I cannot say.'
            WHEN k % 7 = 0 THEN '{{"final_verdict": '
            WHEN k % 11 = 0 THEN concat('```\n{{"final_verdict": "REAL", "confidence_score": 1.0, "trust_score": 1, ',
                '"key_evidence_used": "evidence_1 says so"}}\n```')
            WHEN k % 13 = 0 THEN '{{"final_verdict": null, "confidence_score": "0.9", "trust_score": "n/a", "key_evidence_used": {{"a": 1}}, "reasoning_summary": null}}'
            WHEN k % 19 = 0 THEN '{{"final_verdict": "superseded", "confidence_score": 70, "final_verdict": "Fake", "reasoning_summary": "superseded", "reasoning_summary": "Said twice."}}'
            WHEN k % 17 = 0 THEN '{{"final_verdict": "maybe", "confidence_score": true, "trust_score": 250, "key_evidence_used": []}}'
            ELSE concat('Verdict {{"final_verdict": "', CASE WHEN k % 3 = 0 THEN ' fake ' WHEN k % 3 = 1 THEN 'Real' ELSE 'unverified' END,
                '", "confidence_score": ', CASE WHEN k % 2 = 0 THEN '0.' ELSE '' END, CAST(10 + k % 90 AS STRING),
                ', "trust_score": ', CAST(k % 130 - 10 AS STRING), '.5',
                ', "reasoning_summary": "Multiple authoritative sources and multiple sources across sources confirm.", ',
                '"key_evidence_used": ["Supplier (EV-', CAST(claim_id AS STRING), '-1)", "Item 1", " ", "evidence_', CAST(1 + k % 12 AS STRING),
                '", "per DOC-', CAST(k % 100 AS STRING), ' only", "made up", 7]}} end') END AS raw
        FROM {attempt_keys}""",
    "explanation_replies": """
        SELECT 'explanation' AS stage, o_orderkey AS claim_id, 1 AS attempt_no, 1 AS try_no, CASE
            WHEN o_orderkey % 11 = 0 THEN 'No answer'
            WHEN o_orderkey % 13 = 0 THEN '[{{"explanation": "in a list"}}]'
            WHEN o_orderkey % 7 = 0 THEN '```json\n{{"final_verdict": "Real", "confidence": 95, "evidence_summary": "one point", "explanation": "Various sources say so."}}\n```'
            WHEN o_orderkey % 17 = 0 THEN '{{"explanation": "superseded", "confidence": 0.4, "explanation": "Multiple sources say it.", "evidence_summary": ["x"]}}'
            WHEN o_orderkey % 5 = 0 THEN 'Text {{"final_verdict": "fake", "confidence": "0", "evidence_summary": null, "reasoning": null, "source_analysis": 3}} more'
            ELSE concat('{{"final_verdict": "Unverified", "confidence": ', CASE WHEN o_orderkey % 3 = 0 THEN '180' ELSE concat('0.', CAST(10 + o_orderkey % 90 AS STRING)) END,
                ', "explanation": "Multiple sources confirm.", "evidence_summary": ["a", "b"], "source_analysis": "across sources", "reasoning": "Sources confirm it"}}') END AS raw
        FROM {orders}""",
    "domain_replies": """
        SELECT 'domain' AS stage, o_orderkey AS claim_id, 1 AS attempt_no, 1 AS try_no, CASE
            WHEN o_orderkey % 11 = 0 THEN 'not json'
            WHEN o_orderkey % 13 = 0 THEN 'list: ```[1, 2]```'
            WHEN o_orderkey % 17 = 0 THEN 'empty ```json``` fence {{"domain": "Medical"}}'
            WHEN o_orderkey % 19 = 0 THEN 'It is {{"domain": "superseded", "confidence": 0.7, "domain": "Politics", "reason": "said twice"}}'
            WHEN o_orderkey % 7 = 0 THEN concat('```json\n{{"domain": "Medical", "confidence": "0.', CAST(10 + o_orderkey % 90 AS STRING), '", "reason": "fenced"}}\n```')
            WHEN o_orderkey % 5 = 0 THEN '{{"domain": "Sports", "confidence": 0.5, "reason": "not a known one"}}'
            WHEN o_orderkey % 9 = 0 THEN '{{"domain": "Finance", "confidence": 1.5, "reason": "too sure"}}'
            WHEN o_orderkey % 8 = 0 THEN '{{"domain": "Finance", "confidence": true, "reason": "boolean"}}'
            WHEN o_orderkey % 6 = 0 THEN '{{"domain": "Finance", "confidence": 0.5, "reason": 4}}'
            ELSE concat('I think {{"domain": "', CASE WHEN o_orderkey % 2 = 0 THEN 'Politics' ELSE 'Technology' END,
                '", "confidence": 0.', CAST(10 + o_orderkey % 90 AS STRING), ', "reason": "prose", "extra": 1}} ok') END AS raw
        FROM {orders}""",
    "claim_replies": """
        SELECT 'claim' AS stage, doc_id AS claim_id, 1 AS attempt_no, 1 AS try_no,
            CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat(CASE doc_id % 6 WHEN 0 THEN ' Claim: Main Claim: ' WHEN 1 THEN 'Main Claim: Claim: ' WHEN 2 THEN 'OUTPUT: 1. '
                WHEN 3 THEN '"1. ' WHEN 4 THEN '''"' ELSE '1.' END,
                source, ' published  a \n text of ', CAST(n_chars AS STRING), ' letters.',
                CASE WHEN doc_id % 6 IN (3, 4) THEN '"' ELSE ' ' END) END AS raw
        FROM {documents}""",
    "replies": """
        SELECT * FROM {reflection_replies} UNION ALL SELECT * FROM {verdict_replies}
        UNION ALL SELECT * FROM {explanation_replies} UNION ALL SELECT * FROM {domain_replies}
        UNION ALL SELECT * FROM {claim_replies}""",
    "source_authority": """
        SELECT source, avg(quality) AS source_authority
        FROM {documents} JOIN {labels} USING (doc_id) GROUP BY source""",
}


def tables_in(sql: str) -> list[str]:
    """Names in braces."""
    return sorted({name for _, name, _, _ in string.Formatter().parse(sql) if name})


class Inputs:
    """Given tables of a folder and everything in :data:`INPUTS`, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        self._spark, self._folder = spark, folder
        self._load = cache(self._build)

    def __getattr__(self, name: str) -> DataFrame:
        return self._load(name)

    def _build(self, name: str) -> DataFrame:
        if name == "ocr_blocks":
            return with_boxes(self._query(name))
        if name == "evidence":
            return with_metadata(self._query(name))
        if name in INPUTS:
            return self._query(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def _query(self, name: str) -> DataFrame:
        sql = INPUTS[name]
        return self._spark.sql(sql, **{table: self._load(table) for table in tables_in(sql)})


class StagedInputs(Inputs):
    """The same inputs with the derived ones written out first, ``files`` files each.

    The given tables come as single files that one task reads.  Staging spreads the
    rows as a large table would be, and keeps the cost of deriving inputs apart from
    that of the queries.
    """

    def __init__(self, spark: SparkSession, folder: str, staging: str, files: int):
        super().__init__(spark, folder)
        self._staging, self._files = staging, files

    def _build(self, name: str) -> DataFrame:
        path = f"{self._staging}/{name}"
        super()._build(name).repartition(self._files).write.parquet(path)
        return self._spark.read.parquet(path)


def with_metadata(evidence: DataFrame) -> DataFrame:
    """Metadata as a map of one entry."""
    entry = F.create_map(F.lit("origin"), F.col("metadata"))
    return evidence.withColumn("metadata", F.when(F.col("metadata").isNotNull(), entry))


def with_boxes(blocks: DataFrame) -> DataFrame:
    """Corner points from corner and size: clockwise, 80 wide."""
    x, y, right, bottom = F.col("x"), F.col("y"), F.col("x") + 80, F.col("y") + F.col("h")
    corners = [(x, y), (right, y), (right, bottom), (x, bottom)]
    box = F.array(*[F.struct(px.alias("x"), py.alias("y")) for px, py in corners])
    return blocks.select("image_id", "block_no", box.alias("box"), "text", "confidence")
