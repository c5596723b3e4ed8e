"""SQL that recomputes each catalogue query on another engine (DuckDB dialect).

It is written from the rules, not from the Spark expressions: where Spark uses a
look-around pattern the SQL filters token lists, where Spark works inside an
array the SQL unnests rows and uses windows, and so on.  ``@name`` stands for a
derived input of ``inputs`` or a shared step of :data:`STEPS`.
"""

from __future__ import annotations

import re

from . import check_values as fixed
from .check_values import NOTES, PLACEHOLDERS, REASONING, WHITESPACE
from .inputs import INPUTS, tables_in

WS = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def swap(value: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({value}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def trimmed(value: str) -> str:
    return f"trim({value}, {quoted(WHITESPACE)})"


def rounded(value: str, digits: int) -> str:
    """Half-up rounding on the decimal value."""
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


def two_digits(value: str) -> str:
    return f"CAST(CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DECIMAL(12, 2)) AS VARCHAR)"


def numbers_joined(value: str) -> str:
    gap = rf"(\p{{Nd}})(?:[{WS}]+([.,])[{WS}]*|[{WS}]*([.,])[{WS}]+)(\p{{Nd}})"
    value = swap(swap(value, gap, r"\1\2\3\4"), gap, r"\1\2\3\4")
    value = swap(value, rf"([₹$€£¥])[{WS}]+(\p{{Nd}})", r"\1\2")
    return swap(value, rf"(\p{{Nd}})[{WS}]+([%％])", r"\1\2")


def punctuation_calmed(value: str) -> str:
    return swap(swap(value, "(?:[!?])+([!?])", r"\1"), r"\.{4,}", "...")


def normalized(value: str) -> str:
    value = f"nfc_normalize(coalesce({value}, ''))"
    value = swap(value, r"\r\n|\r|\n|\t", " ")
    value = swap(swap(value, r"[\x{feff}\x{200b}]", ""), r"\x{a0}", " ")
    value = numbers_joined(value)
    value = swap(
        value, rf"([a-zA-Z\x{{0C00}}-\x{{0C7F}})\]'\"])[{WS}]+([.,!?;:])([{WS}]|$)", r"\1\2\3"
    )
    return trimmed(swap(punctuation_calmed(value), f"[{WS}]+", " "))


def uncontrolled(value: str) -> str:
    return swap(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", "")


def noise_free(value: str) -> str:
    """Token lists with the noise tokens filtered out."""
    kept = ", ".join(
        quoted(token)
        for token in ["...", "..", "!!", "!!!", "??", "???", "--", "---", "==", "-", "+", "%", "$", "₹", "€"]
    )
    noise = (
        rf"(NOT regexp_matches(w, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(w, '^[{WS}]+$') "
        rf"AND w NOT IN ({kept}) AND (regexp_matches(w, '[@#^~|\\_`]') OR "
        rf"(length(w) > 1 AND regexp_matches(w, '[^.,!?;:''\"\-–—()\[\]{{}}]'))))"
    )
    tokens = f"regexp_extract_all({value}, '[{WS}]+|[^{WS}]+')"
    return f"coalesce(array_to_string(list_filter({tokens}, lambda w: NOT {noise}), ''), '')"


def lettered(value: str, letters: str) -> str:
    return f"length(regexp_replace({value}, '[^{letters}]', '', 'g'))"


def telugu(value: str) -> str:
    return lettered(value, r"\x{0C00}-\x{0C7F}")


def has_telugu(value: str) -> str:
    return rf"regexp_matches({value}, '[\x{{0C00}}-\x{{0C7F}}]')"


def language(value: str) -> tuple[str, str]:
    te, en = telugu(value), lettered(value, "a-zA-Z")
    blank = f"coalesce({trimmed(value)}, '') = ''"
    mixed = (
        f"({te} >= 3 AND {en} >= 3 AND {te} / CAST({te} + {en} AS DOUBLE) >= 0.1 "
        f"AND {en} / CAST({te} + {en} AS DOUBLE) >= 0.1)"
    )
    code = f"CASE WHEN {blank} THEN 'en' WHEN {mixed} THEN 'mixed' WHEN {te} > {en} THEN 'te' ELSE 'en' END"
    total = f"CAST({te} + {en} AS DOUBLE)"
    share = rounded(
        f"""CASE WHEN {blank} THEN 0.0::DOUBLE
            WHEN {mixed} THEN least(0.98::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * least(1.0::DOUBLE, {total} / 15))
            WHEN {te} > 0 AND {en} > 0 THEN least(0.99::DOUBLE, 0.75::DOUBLE + 0.25::DOUBLE * greatest({te}, {en}) / {total})
            WHEN {total} > 0 THEN least(0.99::DOUBLE, 0.75::DOUBLE + 0.25::DOUBLE * least(1.0::DOUBLE, {total} / 10))
            ELSE 0.5::DOUBLE END""",
        3,
    )
    return code, share


def worded_set(value: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({value}), '[\p{{L}}\p{{N}}]+'))"


def sentences(value: str) -> str:
    cut = "\U0010fffd"
    end = rf"([.?!।\n]+(?:[{WS}]+|$))"
    pieces = f"string_split({swap(value, end, chr(92) + '1' + cut)}, '{cut}')"
    body = f"regexp_replace(p, '{end}', '', 'g')"
    finished = trimmed(f"CASE WHEN regexp_matches({body}, '[.?!।\\n]') THEN {body} ELSE p END")
    kept = (
        f"list_filter(list_transform({pieces}, lambda p: {finished}), "
        rf"lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]'))"
    )
    return (
        f"CASE WHEN coalesce({value}, '') = '' THEN CAST([] AS VARCHAR[]) "
        f"WHEN len({kept}) > 0 THEN {kept} ELSE [{trimmed(value)}] END"
    )


def cleaned_steps(name: str, source: str, key: str, value: str) -> dict[str, str]:
    """Steps that end in ``<name>`` with columns key, cleaned_text, quality_flags."""
    raw, rows, kept, text = (f"{name}_{part}" for part in ("raw", "rows", "kept", "text"))
    return {
        raw: f"SELECT *, {noise_free('t1')} AS t2 FROM (SELECT *, {uncontrolled('t0')} AS t1 FROM "
             f"(SELECT {key}, coalesce({value}, '') AS t0 FROM {source}))",
        rows: f"""SELECT {key}, pos, {trimmed(swap('line', '[ ' + chr(9) + ']+', ' '))} AS line FROM (
            SELECT {key}, unnest(string_split(t2, chr(10))) AS line,
                   unnest(range(len(string_split(t2, chr(10))))) AS pos FROM @{raw})""",
        kept: f"""SELECT {key}, pos, line FROM (SELECT *, lag(lower(line)) OVER (PARTITION BY {key} ORDER BY pos) AS before
            FROM @{rows} WHERE line <> '') WHERE before IS NULL OR before <> lower(line)
            UNION ALL SELECT {key}, pos, line FROM @{rows} WHERE line = ''""",
        text: f"""SELECT {key}, string_agg(line, chr(10) ORDER BY pos) AS joined, count(*) AS n FROM @{kept} GROUP BY {key}""",
        name: f"""SELECT {key}, {trimmed('joined')} AS cleaned_text, array_to_string(list_filter([
                CASE WHEN t1 <> t0 THEN 'control_characters_removed' END,
                CASE WHEN t2 <> t1 THEN 'ocr_symbol_noise_cleaned' END,
                CASE WHEN n < all_lines THEN 'repeated_lines_removed' END], lambda f: f IS NOT NULL), ', ') AS quality_flags
            FROM @{text} JOIN @{raw} USING ({key})
            JOIN (SELECT {key}, count(*) AS all_lines FROM @{rows} GROUP BY {key}) USING ({key})""",
    }


def number(doc: str, name: str) -> str:
    """A field read as a number: numbers, numeric strings, booleans."""
    kind, text = f"json_type({doc}, '$.{name}')", f"json_extract_string({doc}, '$.{name}')"
    return (
        f"CASE WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
        f"WHEN {kind} IN ('VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT') THEN TRY_CAST({text} AS DOUBLE) END"
    )


def truth(doc: str, name: str) -> str:
    kind, text = f"json_type({doc}, '$.{name}')", f"json_extract_string({doc}, '$.{name}')"
    return (
        f"coalesce(CASE {kind} WHEN 'VARCHAR' THEN {text} <> '' WHEN 'BOOLEAN' THEN {text} = 'true' "
        f"WHEN 'ARRAY' THEN {text} <> '[]' WHEN 'OBJECT' THEN {text} <> '{{}}' WHEN 'NULL' THEN false "
        f"ELSE TRY_CAST({text} AS DOUBLE) <> 0 END, false)"
    )


def worded(doc: str, name: str, default: str) -> str:
    kind, text = f"json_type({doc}, '$.{name}')", f"json_extract_string({doc}, '$.{name}')"
    return (
        f"CASE WHEN {kind} IS NULL THEN {quoted(default)} WHEN {kind} = 'NULL' THEN 'None' "
        f"WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {text} = 'true' THEN 'True' ELSE 'False' END ELSE {text} END"
    )


def braced(value: str) -> str:
    """From the first opening to the last closing brace, or null."""
    return f"nullif(regexp_extract({value}, '(?s)(\\{{.*\\}})', 1), '')"


def parsed(value: str) -> str:
    """JSON or null.  Of a repeated key the last value counts; inputs mark the others."""
    last = swap(value, '"[a-z_]+": "superseded", ', "")
    return f"CASE WHEN json_valid({value}) THEN {last} END"


def rewritten(value: str, count: str, phrases: list[tuple[str, str]]) -> str:
    text = value
    for phrase, replacement in phrases:
        text = f"regexp_replace({text}, '\\b{phrase}\\b', '{replacement}', 'gi')"
    return f"CASE WHEN {count} <= 1 THEN {text} ELSE {value} END"


def filled(template: str, **values: str) -> str:
    """SQL that fills a prompt template; nulls become empty text."""
    pattern = "|".join(r"\{%s\}" % name for name in values)
    parts, at = [], 0
    for match in re.finditer(pattern, template):
        parts.append(quoted(template[at : match.start()]))
        parts.append(f"coalesce(CAST({values[match.group()[1:-1]]} AS VARCHAR), '')")
        at = match.end()
    return "concat(" + ", ".join([*parts, quoted(template[at:])]) + ")"


def flag(value: str) -> str:
    return f"CASE WHEN {value} THEN 'True' ELSE 'False' END"


URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"


def urls(value: str) -> str:
    return f"regexp_extract_all({value}, {quoted('(?i)' + URL)})"


def masked(value: str) -> str:
    parts = f"string_split_regex({value}, {quoted('(?i)' + URL)})"
    keyed = (
        f"p || CASE WHEN i < len({parts}) THEN '__PROTECTED_URL_' || (i - 1) || '__' ELSE '' END"
    )
    return f"array_to_string(list_transform({parts}, lambda p, i: {keyed}), '')"


def translated_steps(name: str, source: str, key: str, value: str) -> dict[str, str]:
    """Steps that end in ``<name>`` with key and translated_text, sentence by sentence."""
    rows, said = f"{name}_rows", f"{name}_said"
    return {
        rows: f"""SELECT {key}, unnest({sentences(value)}) AS s, unnest(range(len({sentences(value)}))) AS pos
            FROM {source} WHERE {has_telugu(value)}""",
        said: f"""SELECT {key}, pos, CASE WHEN {has_telugu('s')} AND translated IS NOT NULL
                THEN {trimmed(f"replace(translated, '__PROTECTED_URL_0__', coalesce({urls('s')}[1], ''))")} ELSE s END AS s
            FROM @{rows} LEFT JOIN @translation_memory ON source_sentence = {masked('s')}""",
        name: f"""SELECT {key}, {trimmed("string_agg(s, ' ' ORDER BY pos)")} AS translated_text FROM @{said} GROUP BY {key}
            UNION ALL SELECT {key}, {trimmed(f"coalesce({value}, '')")} FROM {source}
            WHERE NOT {has_telugu(f"coalesce({value}, '')")}""",
    }


def claim_steps(name: str, source: str, key: str, value: str) -> dict[str, str]:
    """Steps that end in ``<name>`` with key and the tidied claim of a raw answer."""
    body = f"SELECT {key}, {trimmed(f'coalesce({value}, {quoted(str())})')} AS c FROM {source}"
    for lead in fixed.LEAD_INS:
        cut = trimmed(f"substr(c, {len(lead) + 1})")
        body = f"SELECT {key}, CASE WHEN starts_with(c, '{lead}') THEN {cut} ELSE c END AS c FROM ({body})"
    body = f"SELECT {key}, trim(trim(c, '\"'), '''') AS c FROM ({body})"
    body = f"SELECT {key}, CASE WHEN starts_with(c, '1.') THEN substr(c, 3) ELSE c END AS c FROM ({body})"
    return {name: f"SELECT {key}, {trimmed(swap('c', f'[{WS}]+', ' '))} AS claim FROM ({body})"}


def central_steps(name: str, source: str, key: str, value: str) -> dict[str, str]:
    """Steps that end in ``<name>`` with key, s and centrality of each text's most central sentence."""
    split = sentences(trimmed(value))
    rows, words, links, degrees = (f"{name}_{part}" for part in ("rows", "words", "links", "degrees"))
    steps = {
        rows: f"SELECT {key}, unnest({split}) AS s, unnest(range(len({split}))) AS pos FROM {source}",
        words: rf"""SELECT {key}, pos, unnest(list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{M}}\p{{N}}]{{4,}}'))) AS word
            FROM @{rows}""",
        links: f"""WITH pairs AS (SELECT {key}, pos AS a, after AS b FROM (
                SELECT *, lead(pos) OVER (PARTITION BY {key}, word ORDER BY pos) AS after,
                    count(*) OVER (PARTITION BY {key}, word) AS held FROM @{words})
                JOIN (SELECT {key}, count(*) AS n FROM @{rows} GROUP BY {key}) USING ({key})
                WHERE after IS NOT NULL AND held <= greatest(2, n // 5))
            SELECT {key}, a, b FROM pairs UNION ALL SELECT {key}, b, a FROM pairs""",
        degrees: f"SELECT {key}, a, count(*) AS d FROM @{links} GROUP BY {key}, a",
        f"{name}_after_": f"SELECT {key}, pos, CAST(1000000 AS BIGINT) AS score FROM @{rows}",
    }
    for at in range(10):
        steps[f"{name}_after_{'x' * (at + 1)}"] = f"""SELECT {key}, pos, CAST(150000 + coalesce(came, 0) AS BIGINT) AS score
            FROM @{rows} LEFT JOIN (SELECT {key}, b AS pos, sum(score * 85 // (100 * d)) AS came
                FROM @{links} JOIN @{degrees} USING ({key}, a)
                JOIN (SELECT {key}, pos AS a, score FROM @{name}_after_{'x' * at}) USING ({key}, a)
                GROUP BY {key}, b) USING ({key}, pos)"""
    steps[name] = f"""SELECT {key}, s, score AS centrality FROM @{rows} JOIN @{name}_after_{'x' * 10} USING ({key}, pos)
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {_likeness_to_claim('s')} DESC, pos) = 1"""
    return steps


def _likeness_to_claim(value: str) -> str:
    return rf"""(CASE WHEN len(string_split_regex({value}, '[{WS}]+')) BETWEEN 10 AND 30 THEN 2 ELSE 0 END
        + CASE WHEN regexp_matches({value}, '\p{{Nd}}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({value}, '[%₹$€]') THEN 1 ELSE 0 END
        + least(3, len(regexp_extract_all({value}, '[{WS}]\p{{Lu}}'))))"""


def parted(framed: str, blocks: str, separator: str, keys: str, size: int) -> str:
    """SQL that cuts the prompts of ``framed`` (keys, head, tail) with their blocks into numbered parts."""
    return f"""SELECT {keys}, CAST(start // {size} + 1 AS INTEGER) AS part_no, string_agg(piece, '' ORDER BY position, piece_no) AS part,
            max(position * 1000000 + piece_no) = any_value(final) AS is_last
        FROM (SELECT *, sum(length(piece)) OVER w - length(piece) AS start, max(position * 1000000 + piece_no) OVER (PARTITION BY {keys}) AS final
            FROM (SELECT {keys}, position, i AS piece_no, substring(whole, i * {size} + 1, {size}) AS piece
                FROM (SELECT {keys}, position, whole, unnest(range((length(whole) + {size - 1}) // {size})) AS i FROM (
                    SELECT {keys}, 0 AS position, head AS whole FROM {framed} UNION ALL
                    SELECT {keys}, position, CASE WHEN position > 1 THEN {separator} ELSE '' END || block FROM {blocks} SEMI JOIN {framed} USING ({keys}) UNION ALL
                    SELECT {keys}, 2147483647, tail FROM {framed})))
            WINDOW w AS (PARTITION BY {keys} ORDER BY position, piece_no)) GROUP BY {keys}, start // {size}"""


_TE, _CONF = language("original_text")

STEPS: dict[str, str] = {
    # --- cleaning
    **cleaned_steps("cleaned", "@noisy_documents", "doc_id", "text"),
    **translated_steps("translated", "@noisy_documents", "doc_id", "text"),
    # --- text blocks
    "geo": f"""SELECT image_id, block_no, {trimmed('text')} AS text, x AS min_x, x + 80 AS max_x, y AS min_y,
            y + h AS max_y, (y + y + h) / 2 AS center_y, greatest(1.0::DOUBLE, h) AS height, confidence
        FROM @ocr_blocks WHERE {trimmed('text')} <> ''""",
    "lined": """SELECT * EXCLUDE (py, ph), sum(CASE WHEN py IS NULL OR NOT abs(center_y - py) < 0.55::DOUBLE * greatest(ph, height) THEN 1 ELSE 0 END)
            OVER (PARTITION BY image_id ORDER BY center_y, block_no ROWS UNBOUNDED PRECEDING) AS line_no
        FROM (SELECT *, lag(center_y) OVER w AS py, lag(height) OVER w AS ph FROM @geo
              WINDOW w AS (PARTITION BY image_id ORDER BY center_y, block_no))""",
    "ordered": """SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY line_no, min_x, center_y, block_no) - 1 AS reading_order
        FROM @lined""",
    "image_docs": f"""SELECT image_id, string_agg(text, ' ' ORDER BY reading_order) AS text,
            {rounded('sum(confidence) / count(*)', 4)} AS average_confidence, count(*) AS block_count,
            array_to_string(list_filter([CASE WHEN sum(confidence) / count(*) < 0.5 THEN 'low_average_ocr_confidence' END,
                CASE WHEN count(*) FILTER (confidence < 0.4) > count(*) / 3 THEN 'multiple_low_confidence_blocks' END],
                lambda f: f IS NOT NULL), ', ') AS quality_flags
        FROM @ordered GROUP BY image_id""",
    "all_image_docs": """SELECT image_id, coalesce(text, '') AS text, coalesce(average_confidence, 0.0) AS average_confidence,
            coalesce(block_count, 0) AS block_count, coalesce(quality_flags, 'empty_ocr_result') AS quality_flags
        FROM (SELECT DISTINCT image_id FROM @images) LEFT JOIN @image_docs USING (image_id)""",
    # --- submissions and their segments
    "checked": f"""SELECT s.*, coalesce({trimmed('text')}, '') <> '' AS had_text, coalesce(s.image_id, '') <> '' AS had_image,
            CASE WHEN coalesce({trimmed('text')}, '') = '' AND coalesce(s.image_id, '') = '' THEN 'Neither text nor image was provided.'
                 WHEN coalesce(s.image_id, '') <> '' AND k.image_id IS NULL
                 THEN concat('Provided image path does not exist: ', s.image_id) END AS reason
        FROM @submissions s LEFT JOIN (SELECT DISTINCT image_id FROM @images) k ON s.image_id = k.image_id""",
    "seg_text": f"""SELECT submission_id, 'user_text' AS source, {trimmed('text')} AS original_text, had_text,
            CAST(NULL AS DOUBLE) AS ocr_confidence FROM @checked WHERE reason IS NULL AND had_text
        UNION ALL SELECT submission_id, 'ocr', {trimmed('d.text')}, had_text, average_confidence
        FROM @checked c JOIN @all_image_docs d USING (image_id) WHERE reason IS NULL AND {trimmed('d.text')} <> ''""",
    "seg_known": f"""SELECT *, {_TE} AS detected_language, {_CONF} AS language_confidence,
            {normalized('original_text')} AS n0 FROM @seg_text""",
    "seg_clean": f"""SELECT *, {trimmed(swap('n2', '[ ' + chr(9) + ']+', ' '))} AS normalized_text,
            array_to_string(list_filter([CASE WHEN n1 <> n0 THEN 'control_characters_removed' END,
                CASE WHEN n2 <> n1 THEN 'ocr_symbol_noise_cleaned' END], lambda f: f IS NOT NULL), ', ') AS quality_flags,
            concat(source, submission_id) AS seg
        FROM (SELECT *, {noise_free('n1')} AS n2 FROM (SELECT *, {uncontrolled('n0')} AS n1 FROM @seg_known))""",
    **translated_steps("seg_said", "@seg_clean", "seg", "normalized_text"),
    "segs": """SELECT submission_id, CASE WHEN source = 'ocr' AND had_text THEN 1 ELSE 0 END AS "order", source, original_text,
            detected_language, language_confidence, normalized_text,
            CASE WHEN detected_language IN ('te', 'mixed') THEN translated_text END AS translated_text, ocr_confidence, quality_flags
        FROM @seg_clean JOIN @seg_said USING (seg)""",
    "merged": f"""SELECT submission_id, had_text, had_image,
            CASE WHEN had_text AND coalesce(o.normalized_text, '') <> '' THEN
                CASE WHEN u.detected_language = 'mixed' OR o.detected_language = 'mixed' OR u.detected_language <> o.detected_language
                     THEN 'mixed' ELSE u.detected_language END
                 ELSE coalesce(u.detected_language, o.detected_language, 'en') END AS original_language,
            CASE WHEN had_text AND coalesce(o.normalized_text, '') <> ''
                 THEN {rounded('(u.language_confidence + o.language_confidence) / 2', 3)}
                 ELSE coalesce(u.language_confidence, o.language_confidence, 1.0) END AS language_confidence,
            d.average_confidence AS ocr_confidence, u.quality_flags AS user_flags, o.quality_flags AS ocr_flags,
            d.quality_flags AS image_flags, had_image AND o.source IS NULL AS empty_image
        FROM @checked c LEFT JOIN @segs u ON c.submission_id = u.submission_id AND u.source = 'user_text'
        LEFT JOIN @segs o ON c.submission_id = o.submission_id AND o.source = 'ocr'
        LEFT JOIN @all_image_docs d ON c.image_id = d.image_id WHERE reason IS NULL""".replace(
        "SELECT submission_id", "SELECT c.submission_id"
    ),
    "processed": f"""SELECT m.submission_id, {trimmed('coalesce(processed_text, ' + "''" + ')')} AS processed_text,
            {trimmed('coalesce(pre_translation_text, ' + "''" + ')')} AS pre_translation_text, original_language, language_confidence,
            translated_segments > 0 AS was_translated, had_text, had_image, segment_count, ocr_confidence,
            array_to_string(list_filter([user_flags, image_flags, ocr_flags, CASE WHEN empty_image THEN 'empty_ocr_text' END],
                lambda f: coalesce(f, '') <> ''), ', ') AS flag_text, translated_segments, usable
        FROM @merged m JOIN (SELECT c.submission_id, count(s.source) AS segment_count,
                string_agg(coalesce(nullif(translated_text, ''), normalized_text), chr(10) ORDER BY "order")
                    FILTER (coalesce(nullif(translated_text, ''), normalized_text) <> '') AS processed_text,
                string_agg(normalized_text, chr(10) ORDER BY "order") FILTER (normalized_text <> '') AS pre_translation_text,
                count(translated_text) AS translated_segments, count(*) FILTER (normalized_text <> '') > 0 AS usable
            FROM @checked c LEFT JOIN @segs s USING (submission_id) WHERE reason IS NULL GROUP BY c.submission_id) t USING (submission_id)""",
    "failed": """SELECT submission_id, text, had_image, reason FROM @checked WHERE reason IS NOT NULL
        UNION ALL SELECT submission_id, text, c.had_image, 'No usable text was extracted from inputs.'
        FROM @checked c JOIN @processed p USING (submission_id) WHERE NOT usable""",
    # --- claims
    "best": rf"""SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY
                CASE WHEN len(string_split_regex(s, '[{WS}]+')) BETWEEN 10 AND 30 THEN 2 ELSE 0 END
                + CASE WHEN regexp_matches(s, '\p{{Nd}}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(s, '[%₹$€]') THEN 1 ELSE 0 END
                + least(3, len(regexp_extract_all(s, '[{WS}]\p{{Lu}}'))) DESC, pos) AS place
            FROM (SELECT doc_id, unnest({sentences(trimmed('text'))}) AS s, unnest(range(len({sentences(trimmed('text'))}))) AS pos
                  FROM @noisy_documents)) WHERE place = 1""",
    **claim_steps("best_claim", "@best", "doc_id", "s"),
    **central_steps("central", "@noisy_documents", "doc_id", "text"),
    **claim_steps("central_claim", "@central", "doc_id", "s"),
    **claim_steps("answer_claim", "@claim_replies", "claim_id", "raw"),
    "claimed": f"""SELECT submission_id AS claim_id, CASE WHEN {trimmed('source_text')} = '' THEN ''
                WHEN raw IS NULL THEN {trimmed('source_text')} ELSE claim END AS claim,
            CASE WHEN {trimmed('source_text')} <> '' AND raw IS NULL THEN 'claim_extraction_error: no model reply' ELSE '' END AS errors,
            processed_text
        FROM (SELECT submission_id, processed_text, coalesce(nullif(processed_text, ''), nullif(text, ''), '') AS source_text
              FROM (SELECT submission_id, text, {normalized('text')} AS processed_text FROM @submissions))
        LEFT JOIN @claim_replies r ON r.claim_id = submission_id LEFT JOIN @answer_claim a ON a.claim_id = submission_id""",
}


def _lexicon_step() -> str:
    """Claims with their leading domain by unnesting words against the term table."""
    terms = ", ".join(
        f"({quoted(name)}, {quoted(term)})"
        for name, listed in fixed.LEXICON.items()
        for term in listed
    )
    return f"""SELECT c.claim_id, c.claim, c.domain AS expected,
            CASE WHEN top.n IS NULL OR top.ties > 1 THEN 'Unknown' ELSE top.name END AS domain,
            CASE WHEN top.n IS NULL OR top.ties > 1 THEN 0.0::DOUBLE ELSE {rounded('CAST(top.n AS DOUBLE) / top.total', 3)} END AS confidence,
            CASE WHEN top.n IS NULL OR top.ties > 1 THEN 'no single leading domain' ELSE 'matched: ' || top.terms END AS reason
        FROM @claims c LEFT JOIN (
            SELECT claim_id, min(name) AS name, max(n) AS n, count(*) AS ties, min(terms) AS terms, min(total) AS total
            FROM (SELECT *, sum(n) OVER (PARTITION BY claim_id) AS total, max(n) OVER (PARTITION BY claim_id) AS most
                  FROM (SELECT claim_id, name, count(*) AS n, string_agg(word, ', ' ORDER BY word) AS terms
                        FROM (SELECT DISTINCT claim_id, unnest(regexp_extract_all(lower(claim), '[a-z0-9]+')) AS word FROM @claims)
                        JOIN (VALUES {terms}) AS lexicon(name, term) ON word = term GROUP BY claim_id, name))
            WHERE n = most GROUP BY claim_id) top ON c.claim_id = top.claim_id"""


def _domain_reply_step() -> str:
    doc = "doc"
    sound = (
        f"json_type({doc}, '$.domain') = 'VARCHAR' AND json_extract_string({doc}, '$.domain') IN "
        f"('Medical', 'Politics', 'Finance', 'Technology', 'Unknown') AND {number(doc, 'confidence')} BETWEEN 0 AND 1 "
        f"AND json_type({doc}, '$.reason') = 'VARCHAR'"
    )
    return f"""SELECT claim_id, body, doc, status,
            CASE WHEN status = 'valid' THEN json_extract_string(doc, '$.domain') ELSE 'Unknown' END AS domain,
            CASE WHEN status = 'valid' THEN {number(doc, 'confidence')} ELSE 0.0::DOUBLE END AS confidence,
            CASE status WHEN 'valid' THEN json_extract_string(doc, '$.reason') WHEN 'unparsed' THEN 'Invalid JSON returned by LLM.'
                WHEN 'invalid' THEN 'Validation failed.' ELSE 'The reply is not a JSON object.' END AS reason
        FROM (SELECT *, CASE WHEN doc IS NULL THEN 'unparsed' WHEN json_type(doc) <> 'OBJECT' THEN 'not_object'
                WHEN coalesce({sound}, false) THEN 'valid' ELSE 'invalid' END AS status
            FROM (SELECT claim_id, body, {parsed('body')} AS doc FROM (
                SELECT claim_id, CASE WHEN regexp_matches(raw, '(?s)```json.*```') THEN {trimmed("regexp_extract(raw, '(?s)```json(.*?)```', 1)")}
                    WHEN regexp_matches(raw, '(?s)```.*```') THEN {trimmed("regexp_extract(raw, '(?s)```(.*?)```', 1)")}
                    ELSE coalesce({trimmed(braced('raw'))}, {trimmed('raw')}) END AS body
                FROM @domain_replies)))"""


def _metrics(keys: str, where: str = "") -> str:
    return f"""SELECT {keys}, count(*) AS evidence_count, {rounded('avg(sim)', 4)} AS avg_similarity,
            {rounded('avg(auth)', 4)} AS avg_authority, {rounded('max(auth)', 4)} AS max_authority,
            {rounded('min(auth)', 4)} AS min_authority, max(auth) <= 0.35 AS low_authority_only, max(auth) >= 0.6 AS has_authoritative
        FROM (SELECT *, coalesce(similarity_score, 0.5) AS sim, coalesce(authority_score, 0.3) AS auth FROM @evidence) {where}
        GROUP BY {keys}"""


def _scores(source: str, extra: str) -> str:
    """Reply scores of rows with metrics, ``doc`` and ``reply_error``."""
    def score(name: str, default: str) -> str:
        return (
            f"CASE WHEN doc IS NULL THEN 0.0::DOUBLE WHEN ({number('doc', name)}) IS NULL THEN {default} "
            f"ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {number('doc', name)})) END AS {name}"
        )

    items = f"(evidence_count > 1 AND {truth('doc', 'evidence_items_contradict_each_other')})"
    notes = f"coalesce(reply_error, {worded('doc', 'notes', 'Evidence evaluation completed.')})"
    return f"""SELECT {extra}, evidence_count, avg_authority, max_authority, low_authority_only,
            CASE WHEN {trimmed(f"upper({worded('doc', 'decision', 'NO')})")} = 'YES' THEN 'YES' ELSE 'NO' END AS decision,
            {truth('doc', 'claim_supported')} AS claim_supported, {truth('doc', 'claim_contradicted')} AS claim_contradicted,
            {items} AS evidence_items_contradict_each_other,
            {items} OR (evidence_count > 1 AND {truth('doc', 'contradictions_found')}) AS contradictions_found,
            {score('support_score', '0.0::DOUBLE')}, {score('source_credibility_score', 'avg_authority')},
            {score('evidence_quality_score', 'avg_similarity * 0.4::DOUBLE + avg_authority * 0.6::DOUBLE')},
            {score('confidence', '0.0::DOUBLE')}, {rewritten(notes, 'evidence_count', NOTES)} AS notes
        FROM {source}"""


def _guarded(source: str) -> str:
    """The three safeguards in order, then rounding."""
    low = "low_authority_only"
    over = f"({low} AND (decision = 'YES' OR confidence > 0.5))"
    first = f"""SELECT * REPLACE (
            CASE WHEN {low} THEN least(source_credibility_score, max_authority) ELSE source_credibility_score END AS source_credibility_score,
            CASE WHEN {low} THEN least(evidence_quality_score, max_authority) ELSE evidence_quality_score END AS evidence_quality_score,
            CASE WHEN {over} THEN 'NO' ELSE decision END AS decision,
            CASE WHEN {over} THEN least(confidence, 0.4::DOUBLE) ELSE confidence END AS confidence,
            CASE WHEN {over} THEN concat('Low source credibility detected (max authority: ', {two_digits('max_authority')},
                '). Even if semantic similarity is high, unverified/blog sources are insufficient.') ELSE notes END AS notes)
        FROM {source}"""
    clash = "evidence_items_contradict_each_other"
    second = f"""SELECT * REPLACE (CASE WHEN {clash} THEN 'NO' ELSE decision END AS decision,
            CASE WHEN {clash} THEN least(confidence, 0.5::DOUBLE) ELSE confidence END AS confidence,
            CASE WHEN {clash} THEN notes || ' Unresolved contradictions found between retrieved evidence items.' ELSE notes END AS notes)
        FROM ({first})"""
    poor = "(decision = 'YES' AND (evidence_quality_score < 0.6 OR source_credibility_score < 0.35))"
    third = f"""SELECT * REPLACE (CASE WHEN {poor} THEN 'NO' ELSE decision END AS decision,
            CASE WHEN {poor} THEN least(confidence, 0.45::DOUBLE) ELSE confidence END AS confidence,
            CASE WHEN {poor} THEN concat(notes, ' Evidence quality score (', {two_digits('evidence_quality_score')},
                ') or source credibility (', {two_digits('source_credibility_score')}, ') falls below threshold.') ELSE notes END AS notes)
        FROM ({second})"""
    names = ["confidence", "support_score", "source_credibility_score", "evidence_quality_score"]
    return f"""SELECT * REPLACE ({', '.join(f'{rounded(n, 2)} AS {n}' for n in names)}),
            decision = 'YES' AS is_evidence_sufficient FROM ({third})"""


def _percent(name: str) -> str:
    share = f"json_type(doc, '$.{name}') = 'DOUBLE' AND {number('doc', name)} > 0 AND {number('doc', name)} <= 1"
    value = f"round_even(CASE WHEN {share} THEN {number('doc', name)} * 100 ELSE {number('doc', name)} END, 0)"
    return f"CAST(CASE WHEN ({value}) IS NULL THEN 50 ELSE greatest(0, least(100, {value})) END AS INTEGER) AS {name}"


def _verdicts(source: str) -> str:
    name = f"lower({trimmed(worded('doc', 'final_verdict', 'Unverified'))})"
    kind = "json_type(doc, '$.key_evidence_used')"
    return f"""SELECT claim_id, try_no, evidence_count,
            CASE {name} WHEN 'real' THEN 'Real' WHEN 'fake' THEN 'Fake' ELSE 'Unverified' END AS final_verdict,
            {_percent('confidence_score')}, {_percent('trust_score')},
            {rewritten(worded('doc', 'reasoning_summary', 'Evaluation completed.'), 'evidence_count', REASONING)} AS reasoning_summary,
            CASE {kind} WHEN 'VARCHAR' THEN [json_extract_string(doc, '$.key_evidence_used')]
                WHEN 'ARRAY' THEN json_extract_string(doc, '$.key_evidence_used[*]') ELSE CAST([] AS VARCHAR[]) END AS items
        FROM {source}"""


def _citations(verdicts: str, numbered: str) -> str:
    """Items of verdicts checked one by one against every id and source of the claim."""
    spoken = trimmed("item")
    return f"""SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY place) AS item_no, item FROM (
            SELECT DISTINCT v.claim_id, place, {spoken} AS item
            FROM (SELECT claim_id, unnest(items) AS item, unnest(range(len(items))) AS place FROM {verdicts}) v
            JOIN {numbered} e ON v.claim_id = e.claim_id
            WHERE lower({spoken}) NOT IN ('', {', '.join(quoted(p) for p in PLACEHOLDERS)}) AND (
                contains(lower({spoken}), lower(evidence_id)) OR contains(lower({spoken}), lower(chunk_id))
                OR contains(lower({spoken}), lower(document_id)) OR contains(lower({spoken}), concat('evidence_', position))
                OR (length(source) > 2 AND contains(lower({spoken}), lower({trimmed('source')})))))"""


def _key_evidence(verdicts: str, numbered: str, cited: str) -> str:
    return f"""SELECT claim_id, CAST(item_no AS INTEGER) AS item_no, item FROM {cited}
        UNION ALL SELECT e.claim_id, CAST(position AS INTEGER),
            concat(coalesce(source, 'Unknown Source'), ' (', coalesce(nullif(evidence_id, ''), chunk_id, concat('evidence_', position)), ')')
        FROM {numbered} e JOIN {verdicts} v USING (claim_id) WHERE claim_id NOT IN (SELECT claim_id FROM {cited})"""


def _explained(source: str) -> str:
    own = number("doc", "confidence")
    own = rounded(f"CASE WHEN {own} > 1 AND {own} <= 100 THEN {own} / 100 WHEN {own} BETWEEN 0 AND 1 THEN {own} END", 2)
    theirs = rounded("CASE WHEN confidence_score > 1 THEN confidence_score / 100.0::DOUBLE ELSE confidence_score END", 2)
    kind = "json_type(doc, '$.evidence_summary')"
    texts = ", ".join(
        f"{rewritten(worded('doc', name, 'N/A'), 'evidence_count', REASONING)} AS {name}"
        for name in ("explanation", "source_analysis", "reasoning")
    )
    return f"""SELECT claim_id, final_verdict, {texts},
            CASE WHEN {kind} = 'ARRAY' THEN array_to_string(json_extract_string(doc, '$.evidence_summary[*]'), '|')
                WHEN {truth('doc', 'evidence_summary')} THEN {worded('doc', 'evidence_summary', '')} ELSE 'Summary provided.' END AS evidence_summary,
            CASE WHEN coalesce({own}, 0) = 0 AND {theirs} > 0 THEN {theirs} ELSE coalesce({own}, 0.85::DOUBLE) END AS confidence
        FROM {source} WHERE doc IS NOT NULL"""


_BY_ATTEMPT = "claim_id, attempt_no"
_NUMBERED = "*, row_number() OVER (PARTITION BY claim_id ORDER BY arrival) AS position"

STEPS |= {
    "lexicon_domains": _lexicon_step(),
    "domain_answers": _domain_reply_step(),
    "metrics": _metrics(_BY_ATTEMPT),
    "claim_metrics": _metrics("claim_id"),
    "reflection_docs": f"""SELECT claim_id, attempt_no, CASE WHEN doc = '{{}}' THEN NULL ELSE doc END AS doc,
            CASE WHEN slice IS NULL OR doc = '{{}}' THEN 'Failed to parse valid JSON from LLM.'
                 WHEN doc IS NULL THEN 'LLM execution error: the reply is not valid JSON' END AS reply_error
        FROM (SELECT *, {parsed('slice')} AS doc FROM (SELECT *, {braced('raw')} AS slice FROM @reflection_replies))""",
    "scored": _scores("@reflection_docs JOIN @metrics USING (claim_id, attempt_no)", _BY_ATTEMPT),
    "judged": _guarded("@scored"),
    # --- attempts: an empty attempt looks back to the latest one with evidence
    "carried": """SELECT k.claim_id, k.attempt_no, m.attempt_no AS evidence_attempt, m.* EXCLUDE (claim_id, attempt_no)
        FROM @attempt_keys k ASOF JOIN @metrics m ON k.claim_id = m.claim_id AND k.attempt_no >= m.attempt_no
        WHERE k.claim_id IN (SELECT claim_id FROM @metrics WHERE attempt_no = 1)""",
    "attempt_scored": _scores(
        "@carried LEFT JOIN @reflection_docs USING (claim_id, attempt_no)",
        "claim_id, attempt_no, evidence_attempt",
    ),
    "attempt_judged": f"""SELECT j.* REPLACE (
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN 'NO' ELSE decision END AS decision,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN 0.0::DOUBLE ELSE confidence END AS confidence,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN 0.0::DOUBLE ELSE support_score END AS support_score,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN false ELSE contradictions_found END AS contradictions_found,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN 0.0::DOUBLE ELSE source_credibility_score END AS source_credibility_score,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN 0.0::DOUBLE ELSE evidence_quality_score END AS evidence_quality_score,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN false ELSE is_evidence_sufficient END AS is_evidence_sufficient,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN false ELSE claim_supported END AS claim_supported,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN false ELSE claim_contradicted END AS claim_contradicted,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN false ELSE evidence_items_contradict_each_other END AS evidence_items_contradict_each_other,
            CASE WHEN {trimmed("coalesce(claim, '')")} = '' THEN 'No claim was provided.' ELSE notes END AS notes), claim, domain
        FROM ({_guarded('@attempt_scored')}) j JOIN @claims USING (claim_id)""",
    "stopped": """SELECT * EXCLUDE (attempt_no, passed, place), attempt_no AS attempt_count, NOT passed AS maximum_attempts_reached
        FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY passed DESC,
                CASE WHEN passed THEN attempt_no ELSE -attempt_no END) AS place
            FROM (SELECT *, decision = 'YES' AND confidence >= 0.7 AS passed FROM @attempt_judged)) WHERE place = 1""",
    # --- verdicts
    "tries": f"""SELECT claim_id, try_no, doc FROM (SELECT claim_id, try_no, {parsed('slice')} AS doc
            FROM (SELECT *, {braced('raw')} AS slice FROM @verdict_replies)) WHERE doc IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY try_no) = 1""",
    "claim_sizes": "SELECT claim_id, count(*) AS evidence_count FROM @evidence GROUP BY claim_id",
    "counted_tries": """SELECT claim_id, try_no, doc, coalesce(evidence_count, 0) AS evidence_count
        FROM @tries LEFT JOIN @claim_sizes USING (claim_id)""",
    "decided": _verdicts("@counted_tries"),
    "numbered": f"SELECT {_NUMBERED} FROM @evidence",
    "cited": _citations("@decided", "@numbered"),
    "explanation_docs": f"""SELECT claim_id, CASE WHEN json_type(doc) = 'OBJECT' THEN doc END AS doc,
            CASE WHEN doc IS NULL THEN 'XAI Agent did not return valid JSON.' WHEN json_type(doc) <> 'OBJECT'
                 THEN 'XAI output is not a JSON object.' END AS reply_error
        FROM (SELECT claim_id, coalesce({parsed('body')}, {parsed(braced('body'))}) AS doc FROM (SELECT claim_id,
            {trimmed("regexp_replace(regexp_replace(trim(raw), '^```(?i:json)?', ''), '```$', '')")} AS body FROM @explanation_replies))""",
    "explained": _explained("@decided JOIN @explanation_docs USING (claim_id)"),
    # --- the whole run, on the evidence each claim stopped with
    "final_evidence": f"""SELECT {_NUMBERED} FROM (SELECT e.* FROM @evidence e JOIN @stopped s
            ON e.claim_id = s.claim_id AND e.attempt_no = s.evidence_attempt)""",
    "run_tries": "SELECT claim_id, try_no, doc, evidence_count FROM @tries JOIN @stopped USING (claim_id)",
    "run_decided": _verdicts("@run_tries"),
    "run_cited": _citations("@run_decided", "@final_evidence"),
    "run_key": _key_evidence("@run_decided", "@final_evidence", "@run_cited"),
    "run_explained": _explained("@run_decided JOIN @explanation_docs USING (claim_id)"),
}


def _evidence_id() -> str:
    return "coalesce(nullif(evidence_id, ''), chunk_id, concat('evidence_', position))"


_REFLECTION_BLOCK = filled(
    "<passage no={n} id={id} found_by={method}>\n{source} | {title} | {url}\n"
    "authority {authority}, similarity {similarity}\n{text}\n</passage>",
    n="position", id=_evidence_id(), source="coalesce(source, 'Unknown Source')",
    authority="coalesce(CAST(authority_score AS VARCHAR), 'N/A')",
    similarity="coalesce(CAST(similarity_score AS VARCHAR), 'N/A')", title="coalesce(title, 'N/A')",
    url="coalesce(url, 'N/A')", method="coalesce(retrieval_method, 'N/A')", text="text",
)
_VERDICT_BLOCK = filled(
    "{n}. {source} ({id}), authority {authority}, similarity {similarity}, link {url}:\n{text}",
    n="position", id=_evidence_id(), source="coalesce(source, 'Unknown Source')",
    authority="coalesce(CAST(authority_score AS VARCHAR), 'unknown')",
    similarity="coalesce(CAST(similarity_score AS VARCHAR), 'unknown')",
    url="coalesce(nullif(url, ''), 'not available')", text="text",
)
_REFLECTION_LINES = filled(
    "{a} (sufficient {b}, sure {c}); credibility {d}, quality {e}; supported {f}, opposed {g}, "
    "passages at odds {h}. {i}",
    a="decision", b=flag("is_evidence_sufficient"), c="confidence", d="source_credibility_score",
    e="evidence_quality_score", f=flag("claim_supported"), g=flag("claim_contradicted"),
    h=flag("evidence_items_contradict_each_other"), i="notes",
)
_JSON_ITEM = """json_merge_patch('{}', json_object('evidence_id', evidence_id, 'chunk_id', chunk_id, 'document_id', document_id,
    'text', text, 'domain', domain, 'source', source, 'language', language,
    'retrieved_date', CAST(retrieved_date AS VARCHAR), 'similarity_score', similarity_score,
    'authority_score', authority_score, 'retrieval_method', retrieval_method,
    'metadata', CASE WHEN metadata IS NOT NULL THEN json_object('origin', metadata) END,
    'url', url, 'title', title, 'publication_date', CAST(publication_date AS VARCHAR)))"""


def _collected(source: str, block: str, separator: str, keys: str = "claim_id") -> str:
    return (
        f"(SELECT {keys}, string_agg(block, {separator} ORDER BY position) AS evidence, count(*) AS n "
        f"FROM (SELECT *, {block} AS block FROM {source}) GROUP BY {keys})"
    )


def _doc_text(value: str) -> str:
    return f"SELECT doc_id, {value} AS text FROM @noisy_documents"


_FOUND, _SURE = language("text")

CHECKS: dict[str, str] = {
    "submissions_profile": f"""SELECT coalesce({trimmed('text')}, '') <> '' AS had_text, coalesce(image_id, '') <> '' AS had_image,
        count(*) AS submissions FROM @submissions GROUP BY 1, 2""",
    "submissions_quarantine": "SELECT submission_id, reason FROM @checked WHERE reason IS NOT NULL",
    "submissions_fallback": f"""SELECT submission_id, {trimmed("coalesce(text, '')")} AS processed_text,
        {trimmed("coalesce(text, '')")} AS pre_translation_text, 'en' AS original_language, 0.0::DOUBLE AS language_confidence,
        false AS was_translated, coalesce(text, '') <> '' AS had_text, had_image, 'input_processing_error' AS quality_flags,
        reason AS errors FROM @failed""",
    "normalize_text": _doc_text(normalized("text")),
    "normalize_nfc": _doc_text("nfc_normalize(text)"),
    "normalize_numeric": _doc_text(numbers_joined("text")),
    "normalize_punct": _doc_text(punctuation_calmed("text")),
    "clean_control": _doc_text(uncontrolled("text")),
    "clean_tokens": _doc_text(noise_free("text")),
    "clean_lines": "SELECT doc_id, cleaned_text AS text FROM @cleaned",
    "dedupe_lines": f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
        SELECT doc_id, pos, line FROM @plain_lines WHERE line = '' UNION ALL
        SELECT doc_id, pos, line FROM (SELECT *, lag(lower(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS before
            FROM @plain_lines WHERE line <> '') WHERE before IS NULL OR before <> lower(line)) GROUP BY doc_id""",
    "dedupe_lines_window": """SELECT doc_id, CAST(pos AS INTEGER) AS line_no, line FROM @plain_lines WHERE line = '' UNION ALL
        SELECT doc_id, CAST(pos AS INTEGER), line FROM (SELECT *, lag(lower(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS before
            FROM @plain_lines WHERE line <> '') WHERE before IS NULL OR before <> lower(line)""",
    "dedupe_lines_variant": f"""SELECT doc_id, text FROM @noisy_documents WHERE NOT contains(text, chr(10)) UNION ALL
        SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
            SELECT doc_id, pos, line FROM @raw_lines WHERE line = '' UNION ALL
            SELECT doc_id, pos, line FROM (SELECT *, lag(word_key) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (
                SELECT *, lower({swap('line', f'[{WS}]+', ' ')}) AS word_key FROM @raw_lines WHERE line <> ''))
            WHERE before IS NULL OR before <> word_key)
        WHERE doc_id IN (SELECT doc_id FROM @noisy_documents WHERE contains(text, chr(10))) GROUP BY doc_id""",
    "clean_flags": "SELECT doc_id, cleaned_text, quality_flags FROM @cleaned",
    "quality_flag_counts": """SELECT flag, count(*) AS rows FROM (
        SELECT unnest(string_split(quality_flags, ', ')) AS flag FROM @cleaned WHERE quality_flags <> '') GROUP BY flag""",
    "script_counts": f"""SELECT doc_id, CAST({telugu('text')} AS INTEGER) AS telugu,
        CAST({lettered('text', 'a-zA-Z')} AS INTEGER) AS latin FROM @noisy_documents""",
    "lang_detect": f"SELECT post_id, {_FOUND} AS language, {_SURE} AS confidence FROM (SELECT post_id, coalesce(text, '') AS text FROM @short_posts)",
    "lang_profile": f"""SELECT coalesce(source, 'all') AS source, coalesce(detected_language, 'all') AS detected_language,
        CAST(grouping_id(source, detected_language) AS INTEGER) AS level, count(*) AS documents, {rounded('avg(c)', 4)} AS confidence
        FROM (SELECT source, {_FOUND} AS detected_language, {_SURE} AS c FROM @noisy_documents)
        GROUP BY ROLLUP (source, detected_language)""",
    "split_sentences": "SELECT doc_id, CAST(pos AS INTEGER) AS sentence_no, s AS sentence FROM @sentence_rows",
    "retrieve_lexical": """
        SELECT item_id, claim_no,
            CAST(row_number() OVER (PARTITION BY item_id, claim_no ORDER BY shared / (c + p - shared) DESC, doc_id, sentence_no) AS INTEGER) AS rank,
            doc_id, sentence_no, CAST(shared AS INTEGER) AS shared, round(shared / (c + p - shared), 6) AS likeness
        FROM @words_shared WHERE 2 * shared >= c + p - shared
        QUALIFY row_number() OVER (PARTITION BY item_id, claim_no ORDER BY shared / (c + p - shared) DESC, doc_id, sentence_no) <= 5""",
    "retrieve_topk": """
        WITH scored AS (
            SELECT a.vec_id AS claim_id, b.vec_id AS passage_id,
                list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, passage_id) AS INTEGER) AS rank,
            passage_id, round(score, 6) AS score
        FROM scored QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, passage_id) <= 5""",
    "telugu_sentences": f"SELECT doc_id, CAST(pos AS INTEGER) AS sentence_no, s AS sentence FROM @sentence_rows WHERE {has_telugu('s')}",
    "protect_urls": f"""SELECT page_id, {masked('t')} AS masked, array_to_string({urls('t')}, ' ') AS urls, true AS restored
        FROM (SELECT page_id, concat('See ', url, ', WWW.a.example or ', url, ' in ', html) AS t FROM pages)""",
    "translate_segments": "SELECT doc_id, translated_text FROM @translated",
    "translation_metadata": f"""SELECT doc_id, CAST(count(*) FILTER ({has_telugu('s')}) AS INTEGER) AS sentences_translated,
        CAST(count(*) FILTER (NOT {has_telugu('s')}) AS INTEGER) AS sentences_skipped, bool_or({has_telugu('s')}) AS was_translated
        FROM @sentence_rows GROUP BY doc_id""",
    "ocr_geometry": "SELECT * EXCLUDE (confidence) FROM @geo",
    "ocr_lines": "SELECT image_id, block_no, CAST(line_no AS BIGINT) AS line_no FROM @lined",
    "ocr_reading_order": "SELECT image_id, block_no, CAST(reading_order AS INTEGER) AS reading_order, text, round(confidence, 4) AS confidence FROM @ordered",
    "ocr_documents": "SELECT * FROM @image_docs",
    "ocr_empty": "SELECT image_id, average_confidence, block_count, quality_flags FROM @all_image_docs WHERE text = ''",
    "segments": "SELECT * FROM @segs",
    "segment_blocks": """SELECT submission_id, CAST(had_text AS INTEGER) AS "order", CAST(reading_order AS INTEGER) AS block_order, block_no,
        text, round(confidence, 4) AS confidence, min_x, min_y, max_x, max_y
        FROM (SELECT submission_id, image_id, had_text, reason FROM @checked) JOIN @ordered USING (image_id) WHERE reason IS NULL""",
    "segment_language_merge": "SELECT submission_id, original_language, language_confidence FROM @merged",
    "segment_aggregate": """SELECT p.* EXCLUDE (usable, flag_text, segment_count, translated_segments),
        CAST(segment_count AS INTEGER) AS segment_count, CAST(translated_segments AS INTEGER) AS translated_segments,
        array_to_string(list_transform(list_filter(list_zip(parts, range(len(parts))),
            lambda z: list_position(parts, z[1]) = z[2] + 1), lambda z: z[1]), ', ') AS quality_flags
        FROM (SELECT *, list_filter(string_split(flag_text, ', '), lambda f: f <> '') AS parts FROM @processed WHERE usable) p""".replace(
        "EXCLUDE (usable,", "EXCLUDE (parts, usable,"
    ),
    "claim_input": f"""SELECT submission_id, coalesce(nullif({normalized('text')}, ''), nullif(text, ''), '') AS claim_input FROM @submissions""",
    "claim_extract": "SELECT doc_id, claim FROM @best_claim",
    "claim_central": "SELECT doc_id, claim, centrality FROM @central_claim JOIN @central USING (doc_id)",
    "claim_clean": "SELECT claim_id, claim FROM @answer_claim",
    "claim_list": f"SELECT claim_id, {trimmed('claim')} AS claim FROM @claims WHERE coalesce({trimmed('claim')}, '') <> ''",
    "claim_quality": """SELECT count(*) AS texts, count(*) FILTER (claim <> '') AS with_claim,
        count(*) FILTER (claim <> '' AND length(claim) * 2 < length(text)) AS brief FROM @best_claim JOIN @noisy_documents USING (doc_id)""",
    "claim_stage": "SELECT claim_id, claim, errors FROM @claimed",
    "domain_lexicon": "SELECT claim_id, domain, confidence, reason FROM @lexicon_domains",
    "domain_eval": f"""SELECT expected_domain, {', '.join(f"count(*) FILTER (domain = '{d}') AS {d.lower()}" for d in fixed.DOMAINS)},
        {rounded('count(*) FILTER (domain = expected_domain) / CAST(count(*) AS DOUBLE)', 4)} AS accuracy
        FROM (SELECT domain, coalesce({trimmed('expected')}, 'none') AS expected_domain FROM @lexicon_domains) GROUP BY expected_domain""",
    "domain_learned": "SELECT claim_id, held_out, domain, round(confidence, 4) AS confidence FROM @learned",
    "domain_learned_eval": """SELECT name AS domain_name, count(*) FILTER (expected = name) AS claims,
        round(count(*) FILTER (domain = name AND expected = name) / CAST(nullif(count(*) FILTER (domain = name), 0) AS DOUBLE), 4) AS precision,
        round(count(*) FILTER (domain = name AND expected = name) / CAST(nullif(count(*) FILTER (expected = name), 0) AS DOUBLE), 4) AS recall
        FROM (SELECT domain, expected, unnest(list_distinct([domain, expected])) AS name FROM @learned WHERE held_out AND expected IS NOT NULL)
        GROUP BY name""",
    "response_json": "SELECT claim_id, body FROM @domain_answers",
    "domain_parse": "SELECT claim_id, coalesce(json_type(doc) = 'OBJECT', false) AS is_object FROM @domain_answers",
    "domain_validate": "SELECT claim_id, domain, confidence, reason, status FROM @domain_answers",
    "response_quality": "SELECT status, count(*) AS replies FROM @domain_answers GROUP BY status",
    "domain_stage": f"""SELECT claim_id, CASE WHEN given = '' OR missing THEN 'Unknown' ELSE domain END AS domain,
        CASE WHEN given = '' OR missing THEN 0.0::DOUBLE ELSE confidence END AS confidence,
        CASE WHEN given = '' THEN 'No claim available for domain detection.' WHEN missing THEN 'domain_detection_error: no model reply' ELSE reason END AS reason,
        CASE WHEN missing AND given <> '' THEN concat(errors, CASE WHEN errors = '' THEN '' ELSE ', ' END, 'domain_detection_error: no model reply') ELSE errors END AS errors
        FROM (SELECT c.claim_id, {trimmed("coalesce(nullif(CASE WHEN c.claim_id % 8 = 5 THEN '' ELSE claim END, ''), nullif(processed_text, ''), '')")} AS given,
            a.claim_id IS NULL AS missing, a.domain, a.confidence, a.reason, errors FROM @claimed c LEFT JOIN @domain_answers a USING (claim_id))""",
    "evidence_load": """SELECT claim_id, arrival, coalesce(evidence_id, concat('evidence_', position)) AS evidence_id,
        coalesce(chunk_id, concat('chunk_', position)) AS chunk_id, document_id,
        coalesce(nullif(title, ''), concat('Test Evidence ', position)) AS title, coalesce(retrieval_method, 'faiss_local') AS retrieval_method,
        true AS dated, metadata AS origin, publication_date FROM @numbered""",
    "evidence_defaults": """SELECT claim_id, arrival, coalesce(evidence_id, md5(concat_ws(chr(31), claim_id, attempt_no,
            coalesce(chunk_id, ''), coalesce(document_id, ''), text))) AS evidence_id,
        coalesce(retrieval_method, 'faiss_local') AS retrieval_method, retrieved_date AS known_date FROM @evidence""",
    "evidence_quarantine": """SELECT claim_id, arrival, violations FROM (SELECT claim_id, arrival, array_to_string(list_filter([
        CASE WHEN chunk_id IS NULL THEN 'missing chunk_id' END, CASE WHEN document_id IS NULL THEN 'missing document_id' END,
        CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN domain IS NULL THEN 'missing domain' END,
        CASE WHEN source IS NULL THEN 'missing source' END, CASE WHEN language IS NULL THEN 'missing language' END,
        CASE WHEN similarity_score IS NULL THEN 'missing similarity_score' END, CASE WHEN metadata IS NULL THEN 'missing metadata' END,
        CASE WHEN retrieval_method <> 'faiss_local' THEN 'unknown retrieval_method' END], lambda v: v IS NOT NULL), ', ') AS violations
        FROM @evidence) WHERE violations <> ''""",
    "evidence_coerce": f"""SELECT arrival, claim_id, {', '.join(f"json_extract_string(doc, '$.{n}') AS {n}" for n in ('evidence_id', 'chunk_id', 'document_id', 'source', 'url', 'title'))},
        CASE WHEN doc IS NULL THEN raw ELSE json_extract_string(doc, '$.text') END AS text,
        {number('doc', 'similarity_score')} AS similarity_score, {number('doc', 'authority_score')} AS authority_score,
        {', '.join(f"json_extract_string(doc, '$.{n}') AS {n}" for n in ('domain', 'language', 'retrieval_method', 'retrieved_date', 'publication_date', 'metadata'))},
        coalesce((SELECT string_agg(k || '=' || coalesce(json_extract_string(doc, '$.' || k), 'null'), ', ' ORDER BY k)
            FROM (SELECT unnest(json_keys(doc)) AS k) WHERE k NOT IN ('evidence_id', 'chunk_id', 'document_id', 'text', 'source', 'url', 'title',
                'similarity_score', 'authority_score', 'domain', 'language', 'retrieval_method', 'retrieved_date', 'publication_date', 'metadata')), '') AS other
        FROM (SELECT *, CASE WHEN json_type({parsed('raw')}) = 'OBJECT' THEN raw END AS doc FROM @loose_evidence)""",
    "evidence_authority": f"""SELECT doc_id, source, round(CASE WHEN doc_id % 3 = 0 THEN 0.5::DOUBLE ELSE source_authority END, 6) AS authority_score
        FROM documents LEFT JOIN @source_authority USING (source)""",
    "evidence_metrics": "SELECT * FROM @metrics",
    "reflection_guards": f"""SELECT claim_id, CASE WHEN coalesce({trimmed('claim')}, '') = '' THEN 'No claim was provided.'
            WHEN m.claim_id IS NULL THEN 'No evidence was provided. Evidence retrieval is required.' ELSE '' END AS guard,
        CASE WHEN coalesce(domain, '') = '' THEN 'General' ELSE {trimmed('domain')} END AS domain,
        coalesce(evidence_count, 0) AS evidence_count, coalesce(avg_similarity, 0.0) AS avg_similarity,
        coalesce(low_authority_only, true) AS low_authority_only, coalesce(has_authoritative, false) AS has_authoritative
        FROM @claims LEFT JOIN @claim_metrics m USING (claim_id)""",
    "reflection_parse": "SELECT claim_id, attempt_no, doc IS NOT NULL AS usable, coalesce(reply_error, '') AS reply_error FROM @reflection_docs",
    "reflection_scores": f"""SELECT claim_id, attempt_no, decision, claim_supported, claim_contradicted, evidence_items_contradict_each_other,
        contradictions_found, {', '.join(f"{rounded(n, 6)} AS {n}" for n in ('support_score', 'source_credibility_score', 'evidence_quality_score', 'confidence'))}
        FROM @scored""",
    "notes_rewrite": f"""SELECT doc_id, {rewritten('t', 'doc_id % 3', NOTES)} AS notes FROM (
        SELECT doc_id, concat('Multiple sources, ', text, ' SOURCES AGREE; sources contradict each other') AS t FROM documents)""",
    "reflection_safeguards": "SELECT * EXCLUDE (evidence_count, avg_authority, max_authority, low_authority_only) FROM @judged",
    "attempt_grid": """SELECT claim_id, count(*) FILTER (attempt_no = 1) AS items_1, count(*) FILTER (attempt_no = 2) AS items_2,
        count(*) FILTER (attempt_no = 3) AS items_3 FROM @evidence GROUP BY claim_id""",
    "attempt_carry": """SELECT claim_id, attempt_no, evidence_attempt, evidence_count, avg_authority FROM @carried""",
    "attempt_aborted": "SELECT claim_id FROM @claims WHERE claim_id NOT IN (SELECT claim_id FROM @evidence WHERE attempt_no = 1)",
    "attempt_stop": """SELECT claim_id, attempt_count, evidence_attempt, decision, confidence, maximum_attempts_reached, evidence_count, notes
        FROM @stopped""",
    "verdict_inputs": """SELECT claim_id, attempt_count, evidence_count, 'en' AS original_language, false AS was_translated,
        CASE WHEN claim IS NULL THEN 'Missing required key in supervisor_input: ''claim_text'''
             WHEN domain IS NULL THEN 'Missing required key in supervisor_input: ''domain''' ELSE '' END AS reason FROM @stopped""",
    "verdict_retry": "SELECT claim_id, coalesce(try_no, 0) AS try_no FROM @claims LEFT JOIN @tries USING (claim_id)",
    "verdict_parse": "SELECT claim_id, try_no, final_verdict, reasoning_summary, array_to_string(items, '|') AS items FROM @decided",
    "verdict_scores": "SELECT claim_id, confidence_score, trust_score FROM @decided",
    "key_evidence": _key_evidence("@decided", "@numbered", "@cited"),
    "reasoning_rewrite": f"""SELECT doc_id, {rewritten('t', 'doc_id % 3', REASONING)} AS reasoning FROM (
        SELECT doc_id, concat('Multiple authoritative sources across sources: ', text) AS t FROM documents)""",
    "explain_parse": "SELECT claim_id, doc IS NOT NULL AS usable, coalesce(reply_error, '') AS reply_error FROM @explanation_docs",
    "explain_validate": "SELECT * FROM @explained",
    "verification_report": """SELECT s.claim_id, attempt_count, maximum_attempts_reached, s.decision AS reflection_decision,
        s.is_evidence_sufficient AS reflection_is_evidence_sufficient, s.contradictions_found AS reflection_contradictions_found,
        s.confidence AS reflection_confidence, s.notes AS reflection_notes, s.support_score AS reflection_support_score,
        s.source_credibility_score AS reflection_source_credibility_score, s.evidence_quality_score AS reflection_evidence_quality_score,
        s.claim_supported AS reflection_claim_supported, s.claim_contradicted AS reflection_claim_contradicted,
        s.evidence_items_contradict_each_other AS reflection_evidence_items_contradict_each_other, d.final_verdict, confidence_score, trust_score, coalesce(listed, '') AS key_evidence_used,
        x.explanation AS explanation_explanation, x.confidence AS explanation_confidence
        FROM @stopped s JOIN @run_decided d USING (claim_id) JOIN @run_explained x USING (claim_id) LEFT JOIN (
            SELECT claim_id, string_agg(item, '|' ORDER BY item_no) AS listed FROM @run_key GROUP BY claim_id) k USING (claim_id)""",
    "verification_citations": "SELECT * FROM @run_key WHERE claim_id IN (SELECT claim_id FROM @run_explained)",
    "verification_rejects": """SELECT claim_id, CASE WHEN NOT found THEN 'evidence' WHEN NOT judged THEN 'verdict' ELSE 'explanation' END AS stage,
        CASE WHEN NOT found THEN 'No evidence was provided. Evidence retrieval is required.'
            WHEN NOT judged THEN 'No try of the verdict held a JSON object.' ELSE coalesce(reply_error, 'No explanation was recorded.') END AS reason
        FROM (SELECT c.claim_id, c.claim_id IN (SELECT claim_id FROM @evidence WHERE attempt_no = 1) AS found,
                c.claim_id IN (SELECT claim_id FROM @tries) AS judged, x.doc IS NOT NULL AS explained, reply_error
            FROM @claims c LEFT JOIN @explanation_docs x USING (claim_id))
        WHERE NOT (found AND judged AND explained)""",
    "claim_prompts": f"SELECT doc_id, {filled(fixed.CLAIM_TEMPLATE, text=trimmed('text'))} AS prompt FROM documents",
    "domain_prompts": f"SELECT claim_id, {filled(fixed.DOMAIN_TEMPLATE, claim='claim')} AS prompt FROM @claims",
    "reflection_prompts": f"""SELECT claim_id, attempt_no, {filled(fixed.REFLECTION_TEMPLATE, claim='claim', domain='domain', count='n', evidence='evidence')} AS prompt
        FROM @claims JOIN {_collected('(SELECT *, row_number() OVER (PARTITION BY claim_id, attempt_no ORDER BY arrival) AS position FROM @evidence)', _REFLECTION_BLOCK, 'chr(10)', 'claim_id, attempt_no')} USING (claim_id)""",
    "verdict_prompts": f"""SELECT claim_id, try_no, prompt || CASE WHEN try_no > 1 THEN {quoted(fixed.RETRY_REMINDER)} ELSE '' END AS prompt
        FROM (SELECT claim_id, unnest([1, 2, 3]) AS try_no, {filled(fixed.VERDICT_TEMPLATE, claim='claim', domain='domain', attempts='attempt_count', exhausted=flag('maximum_attempts_reached'), count='n', evidence='evidence', reflection=_REFLECTION_LINES)} AS prompt
        FROM @stopped JOIN {_collected('@final_evidence', _VERDICT_BLOCK, 'chr(10)')} USING (claim_id))""",
    "explanation_prompts": f"""SELECT claim_id, {filled(
            fixed.EXPLANATION_TEMPLATE, verdict='final_verdict', claim='claim', domain='domain', attempts='attempt_count',
            exhausted=flag('maximum_attempts_reached'), count='n', evidence='evidence',
            reflection="json_object('decision', decision, 'is_evidence_sufficient', is_evidence_sufficient, 'contradictions_found', contradictions_found, 'confidence', confidence, 'notes', notes, 'support_score', support_score, 'source_credibility_score', source_credibility_score, 'evidence_quality_score', evidence_quality_score, 'claim_supported', claim_supported, 'claim_contradicted', claim_contradicted, 'evidence_items_contradict_each_other', evidence_items_contradict_each_other)",
            result="json_object('final_verdict', final_verdict, 'confidence_score', confidence_score, 'trust_score', trust_score, 'reasoning_summary', reasoning_summary, 'key_evidence_used', listed)",
            baseline=rounded('CASE WHEN confidence_score > 1 THEN confidence_score / 100.0::DOUBLE ELSE confidence_score END', 2))} AS prompt
        FROM @stopped JOIN (SELECT claim_id, final_verdict, confidence_score, trust_score, reasoning_summary FROM @run_decided) USING (claim_id)
        JOIN (SELECT claim_id, coalesce(list(item ORDER BY item_no) FILTER (item IS NOT NULL), CAST([] AS VARCHAR[])) AS listed
            FROM @run_decided LEFT JOIN @run_key USING (claim_id) GROUP BY claim_id) USING (claim_id)
        JOIN {_collected('@final_evidence', _JSON_ITEM, quoted(','))} USING (claim_id)""",
}

_PLACED = "*, row_number() OVER (PARTITION BY claim_id, attempt_no ORDER BY arrival) AS position"
_HEAD, _TAIL = fixed.REFLECTION_TEMPLATE.split("{evidence}")
_REFLECTED = {"claim": "claim", "domain": "domain", "count": "n"}
_VERDICT_HEAD, _VERDICT_TAIL = fixed.VERDICT_TEMPLATE.split("{evidence}")
_JUDGED = {
    "claim": "claim", "domain": "domain", "attempts": "attempt_count", "exhausted": flag("maximum_attempts_reached"),
    "count": "n", "reflection": _REFLECTION_LINES,
}

STEPS |= {
    "reflection_framed": f"""SELECT claim_id, attempt_no, {filled(_HEAD, **_REFLECTED)} AS head, {filled(_TAIL, **_REFLECTED)} AS tail
        FROM @claims JOIN (SELECT claim_id, attempt_no, count(*) AS n FROM @evidence GROUP BY ALL) USING (claim_id)""",
    "reflection_listed": f"SELECT claim_id, attempt_no, position, {_REFLECTION_BLOCK} AS block FROM (SELECT {_PLACED} FROM @evidence)",
    "verdict_framed": f"""SELECT claim_id, {filled(_VERDICT_HEAD, **_JUDGED)} AS head, {filled(_VERDICT_TAIL, **_JUDGED)} AS tail
        FROM @stopped JOIN (SELECT claim_id, count(*) AS n FROM @final_evidence GROUP BY claim_id) USING (claim_id)""",
    "verdict_listed": f"SELECT claim_id, position, {_VERDICT_BLOCK} AS block FROM @final_evidence",
    "explanation_whole": CHECKS["explanation_prompts"],
    "explanation_listed": f"SELECT claim_id, position, {_JSON_ITEM} AS block FROM @final_evidence",
    # The blocks lie between known words, so head and tail are what is left of the whole prompt.
    "explanation_framed": """SELECT claim_id, substring(prompt, 1, opened) AS head, substring(prompt, opened + 1 + long) AS tail
        FROM (SELECT claim_id, prompt, strpos(prompt, ' passages as JSON: [') + 19 AS opened FROM @explanation_whole) JOIN (
            SELECT claim_id, CAST(sum(length(block)) + count(*) - 1 AS BIGINT) AS long FROM @explanation_listed GROUP BY claim_id) USING (claim_id)""",
}

CHECKS |= {
    "reflection_blocks": "SELECT claim_id, attempt_no, CAST(position AS INTEGER) AS position, block FROM @reflection_listed",
    "reflection_prompt_parts": parted("@reflection_framed", "@reflection_listed", "chr(10)", "claim_id, attempt_no", 300),
    "verdict_prompt_parts": parted("@verdict_framed", "@verdict_listed", "chr(10)", "claim_id", 300),
    "explanation_prompt_parts": parted("@explanation_framed", "@explanation_listed", quoted(","), "claim_id", 300),
}

STEPS |= {
    "sentence_rows": f"""SELECT doc_id, unnest({sentences('text')}) AS s, unnest(range(len({sentences('text')}))) AS pos FROM @noisy_documents""",
    "claim_words": f"""SELECT item_id, claim_no, len(words) AS n, unnest(words) AS word FROM (
        SELECT item_id, CAST(pos AS INTEGER) AS claim_no, {worded_set('s')} AS words FROM (
            SELECT item_id, unnest({sentences('text')}) AS s, unnest(range(len({sentences('text')}))) AS pos FROM benchmark))""",
    "passage_words": f"""SELECT doc_id, sentence_no, len(words) AS n, unnest(words) AS word FROM (
        SELECT doc_id, CAST(pos AS INTEGER) AS sentence_no, {worded_set('s')} AS words FROM (
            SELECT doc_id, unnest({sentences('text')}) AS s, unnest(range(len({sentences('text')}))) AS pos FROM documents))""",
    "words_shared": """SELECT item_id, claim_no, doc_id, sentence_no, any_value(c.n) AS c, any_value(p.n) AS p, count(*) AS shared
        FROM @claim_words c JOIN @passage_words p ON c.word = p.word GROUP BY item_id, claim_no, doc_id, sentence_no""",
    "label_words": f"""SELECT claim_id, claim_id % 5 = 0 AS held_out, CASE WHEN label IN ({', '.join(quoted(d) for d in fixed.DOMAINS)}) THEN label END AS label,
        unnest(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9]+'))) AS word
        FROM (SELECT claim_id, claim, {trimmed('domain')} AS label FROM @claims)""",
    "taught_words": "SELECT * FROM @label_words WHERE NOT held_out AND label IS NOT NULL",
    "taught_counts": """SELECT word, label, coalesce(here, 0) AS y, total - coalesce(here, 0) AS r, whole, (SELECT count(*) FROM @taught_words) - whole AS other,
            100 * total / CAST((SELECT count(*) FROM @taught_words) AS DOUBLE) AS a, ln(claims / CAST((SELECT count(DISTINCT claim_id) FROM @taught_words) AS DOUBLE)) AS share
        FROM (SELECT word, count(*) AS total FROM @taught_words GROUP BY word)
        CROSS JOIN (SELECT label, count(*) AS whole, count(DISTINCT claim_id) AS claims FROM @taught_words GROUP BY label)
        LEFT JOIN (SELECT word, label, count(*) AS here FROM @taught_words GROUP BY word, label) USING (word, label)""",
    "learned_scores": """SELECT claim_id, c.label, share + sum(ln((y + a) / (whole + 100 - y - a)) - ln((r + a) / (other + 100 - r - a))) AS score
        FROM @label_words w JOIN @taught_counts c ON w.word = c.word GROUP BY claim_id, c.label, share""",
    "learned": f"""SELECT claim_id, claim_id % 5 = 0 AS held_out, coalesce(best, 'Unknown') AS domain, coalesce(sure, 0) AS confidence,
            CASE WHEN {trimmed('c.domain')} IN ({', '.join(quoted(d) for d in fixed.DOMAINS)}) THEN {trimmed('c.domain')} END AS expected
        FROM @claims c LEFT JOIN (
            SELECT claim_id, arg_max(label, score) AS best, 1 / sum(exp(score - top)) AS sure
            FROM (SELECT *, max(score) OVER (PARTITION BY claim_id) AS top FROM @learned_scores) GROUP BY claim_id) USING (claim_id)""",
    "plain_lines": f"""SELECT doc_id, pos, {trimmed(swap('line', '[ ' + chr(9) + ']+', ' '))} AS line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM @noisy_documents)""",
    "raw_lines": f"""SELECT doc_id, pos, {trimmed('line')} AS line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM @noisy_documents)""",
}


def _input_sql(name: str) -> str:
    tables = {table: f"@{table}" if table in INPUTS else table for table in tables_in(INPUTS[name])}
    return INPUTS[name].format(**tables)


_REFERENCE = re.compile(r"@([a-z][a-z_]*)")


def with_steps(sql: str) -> str:
    """The query with every input and step it refers to as a common table expression."""
    found: dict[str, str] = {}

    def visit(text: str) -> str:
        def name_of(match: re.Match) -> str:
            name = match.group(1)
            if name not in INPUTS and name not in STEPS:
                return match.group()
            if name not in found:
                found[name] = ""
                body = visit(STEPS[name] if name in STEPS else _input_sql(name))
                found.pop(name)
                found[name] = body
            return name

        return _REFERENCE.sub(name_of, text)

    main = visit(sql)
    if not found:
        return main
    steps = ",\n".join(f"{name} AS MATERIALIZED ({body})" for name, body in found.items())
    return f"WITH {steps}\n{main}"


def check_sql() -> dict[str, str]:
    """Runnable SQL per query name."""
    return {name: with_steps(sql) for name, sql in CHECKS.items()}
