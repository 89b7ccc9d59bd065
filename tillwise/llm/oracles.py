"""Equivalent SQL of the operators that SQL can express."""

from __future__ import annotations

from tillwise.llm.licenses import KNOWN, SPELLINGS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    form = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"regexp_replace({form}, '(^|\\n)[ \\t]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*', '\\1', 'g')"
    form = f"regexp_replace({form}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F©“”‘’–—]+', ' ', 'g')"
    for spelling, one in SPELLINGS:
        form = f"replace({form}, {_text(spelling)}, {_text(one)})"
    return f"trim({form}, ' ')"


def licenses() -> str:
    rows = ", ".join(f"({_text(name)}, {_text(text)})" for name, text in KNOWN)
    return f"""
WITH given(license, text) AS (VALUES {rows}),
known AS (
    SELECT sha256({_canonical("text")}) AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license
    FROM given GROUP BY 1
),
docs AS (
    SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS text,
           sha256({_canonical("coalesce(text, '')")}) AS digest
    FROM documents
),
lines AS (
    SELECT DISTINCT place, license
    FROM (SELECT place, unnest(string_split(text, chr(10))) AS line FROM docs)
    JOIN known ON known.digest = sha256({_canonical("line")})
),
found AS (SELECT place, string_agg(license, ';' ORDER BY license) AS line_licenses FROM lines GROUP BY place)
SELECT doc_id, docs.digest AS canonical_sha256, known.license AS license, coalesce(line_licenses, '') AS line_licenses
FROM docs LEFT JOIN known USING (digest) LEFT JOIN found USING (place)"""


def lexical_search() -> str:
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS place, doc_id, {words} AS words FROM documents),
sizes AS (SELECT place, doc_id, len(words)::BIGINT AS n FROM docs WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS docs, coalesce(sum(n), 0)::BIGINT AS words FROM sizes),
items AS (SELECT row_number() OVER () AS item, item_id, {words} AS words FROM benchmark),
asked AS (
    SELECT item, item_id, term, count(*)::BIGINT AS times
    FROM (SELECT item, item_id, unnest(words) AS term FROM items) GROUP BY ALL
),
held AS (
    SELECT place, term, count(*)::BIGINT AS tf
    FROM (SELECT place, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
    FROM held, total GROUP BY term
),
scores AS (
    SELECT item, item_id, place, doc_id,
        sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total.docs) // total.words))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (place), total
    GROUP BY ALL
),
ranked AS (
    SELECT item_id, doc_id, score,
        row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, place)::INTEGER AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


ORACLES: dict[str, str] = {"op1_licenses": licenses(), "op11_lexical_search": lexical_search()}
