"""DuckDB SQL of the URL filter: rules, training and scoring of url_filter in one statement.

crc32 is folded bit by bit, and the gradient descent is one fold of list_reduce,
in the order and with the arithmetic of the DataFrame form.
"""

from __future__ import annotations

from lodestone.llm.url_filter import BUCKETS, DECAY, EPOCHS, LABELLED, LOWER, RATE, RULES, UPPER

_PATTERN = "(?s)^.*?://([^/?#]*)([^?#]*)"
_ROWS = ", ".join(f"('{url}', {label})" for url, label in LABELLED)
_GRAMS = " || ".join(
    f"list_transform(range(1, greatest(len({t}) - {n - 1}, 1) + 1), lambda i: '{t}' || substr({t}, i, {n}))" for t in "hp" for n in (3, 4, 5)
)


def _ruled(rules, other: str, value) -> str:
    """CASE over the rules, the longest first."""
    cases = ""
    for text, what in sorted(rules, key=lambda r: -len(r[0])):
        host, _, rest = text.partition("/")
        cases += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}') THEN '{value(text, what)}'"
    return f"CASE{cases} ELSE {other} END"


URL_FILTER_SQL = rf"""
    WITH labelled(url, label) AS (VALUES {_ROWS}),
    parts AS MATERIALIZED (
        SELECT url, translate(regexp_extract(url, '{_PATTERN}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '{_PATTERN}', 2) AS path
        FROM (SELECT coalesce(url, '') AS url FROM pages UNION SELECT url FROM labelled)),
    marked AS (SELECT DISTINCT host, path, '^' || host || '$' AS h, '^' || translate(path, '123456789', '000000000') || '$' AS p FROM parts),
    grams AS MATERIALIZED (SELECT host, path, {_GRAMS} AS grams FROM marked),
    hexed AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT unnest(grams) AS g FROM grams)),
    crc AS MATERIALIZED (
        SELECT g, xor(4294967295, list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
            lambda c, b: list_reduce(range(8), lambda k, j: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, xor(c, b)), 4294967295)) % {BUCKETS} AS f
        FROM hexed),
    f AS MATERIALIZED (
        SELECT host, path, list(f ORDER BY i) FILTER (g[1] = 'h') AS fh, list(f ORDER BY i) FILTER (g[1] = 'p') AS fp
        FROM (SELECT host, path, unnest(grams) AS g, generate_subscripts(grams, 1) AS i FROM grams) JOIN crc USING (g) GROUP BY host, path),
    x AS (
        SELECT list(list_transform(range({BUCKETS}), lambda d: len(list_filter(fh, lambda y: y = d)) / sqrt(len(fh)::DOUBLE) + len(list_filter(fp, lambda y: y = d)) / sqrt(len(fp)::DOUBLE)) || [1.0::DOUBLE, label::DOUBLE]
            ORDER BY md5(url), label) AS rows
        FROM labelled JOIN parts USING (url) JOIN f USING (host, path)),
    w AS MATERIALIZED (
        SELECT list_reduce(flatten(list_transform(range({EPOCHS}), lambda e: rows)),
            lambda w, r: list_transform([{RATE}::DOUBLE * (r[{BUCKETS + 2}] - 1 / (1 + exp(-list_sum(
                    [w[{BUCKETS + 1}]] || list_transform(list_zip(w[:{BUCKETS}], r[:{BUCKETS}]), lambda z: z[1] * z[2])))))],
                lambda g: list_transform(list_zip(w, r[:{BUCKETS + 1}]), lambda z: z[1] * {1 - DECAY}::DOUBLE + g * z[2]))[1],
            list_transform(range({BUCKETS + 1}), lambda d: 0::DOUBLE)) AS w
        FROM x),
    scored AS (SELECT host, path, 1 / (1 + exp(-(list_sum(list_transform(fh, lambda i: w[i + 1])) / sqrt(len(fh)::DOUBLE) + list_sum(list_transform(fp, lambda i: w[i + 1])) / sqrt(len(fp)::DOUBLE) + w[{BUCKETS + 1}]))) AS score FROM f, w)
    SELECT page_id, host, path, {_ruled(RULES, "NULL", lambda text, what: text)} AS rule,
        {_ruled(RULES, "CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END", lambda text, what: what)} AS verdict, round(score, 9) AS score
    FROM (SELECT page_id, coalesce(url, '') AS url FROM pages) JOIN parts USING (url) JOIN scored USING (host, path)"""
