"""The queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import class_lm, contamination, filter_audit, fingerprint, hard_negatives, html_text, jaccard_join, packing, quality, suffix_dedup, toxicity, url_filter, warc
from lodestone.llm.url_sql import URL_FILTER_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.classify(_table(spark, sf_dir, "pages"), url_filter.train(spark)).withColumn("score", F.round("score", 9))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_jaccard_join, op3_toxicity, op4_html_text, op5_packing, op6_lm_score, op7_fingerprint, op8_decontaminate, op9_suffix_dedup, op10_url_filter, op11_warc, op12_hard_negatives, op13_filter_audit)
}

ORACLE_SQL: dict[str, str] = {
    # Links by joining the shingles of all texts, components by walking the links.
    "op2_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM i),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, coalesce(k.n_links, 0) AS n_links
        FROM documents d JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = d.doc_id LEFT JOIN n USING (doc_id)
        LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = d.doc_id""",
    # Windows of hexadecimal text by their hash; runs of covered bytes; what lies between them. Passages: the runs of the shorter windows.
    "op9_suffix_dedup": """
        WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        k AS MATERIALIZED (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) AS f FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM h WHERE len(x) >= 800)),
        dup AS (SELECT doc_id, i FROM k WHERE f IN (SELECT f FROM k GROUP BY f HAVING count(*) > 1)),
        cut AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM dup),
        runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut) GROUP BY doc_id, g),
        pieces AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs),
        kept AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS head FROM pieces JOIN h USING (doc_id) GROUP BY doc_id),
        pk AS MATERIALIZED (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 500)) AS f FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 249)) AS i FROM h WHERE len(x) >= 500)),
        pd AS (SELECT doc_id, i FROM pk WHERE f IN (SELECT f FROM pk GROUP BY f HAVING count(*) > 1)),
        pn AS (SELECT doc_id, sum(least(250, coalesce(next - i, 250))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM pd) GROUP BY doc_id)
        SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
            sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n, 0)::BIGINT AS n_passage
        FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN pn USING (doc_id)""",
    "op10_url_filter": URL_FILTER_SQL,
    # Base 32 from the hexadecimal digest: 20 bits of a piece of five digits are four digits of five bits.
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT *, sha1(h) AS x FROM p),
        b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS n FROM d)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
            list_reduce(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((n[j // 4 + 1] >> (15 - 5 * (j % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), lambda a, b: a || b) AS payload_digest,
            CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> max(page_id) OVER (PARTITION BY h) THEN max(page_id) OVER (PARTITION BY h) END AS refers_to FROM b""",
    "op12_hard_negatives": """
        WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS s FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS i FROM s WHERE same) WHERE i <= 5),
        n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b, s.s, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS i FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
        SELECT a AS anchor_id, p AS positive_id, i::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE i <= 3""",
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        f AS MATERIALIZED (SELECT part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': doc_id > first} AS f,
            coalesce(quality = 1, FALSE) AS good, coalesce(toxic = 1, FALSE) AS bad FROM w LEFT JOIN labels USING (doc_id)),
        m AS MATERIALIZED (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS m, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM f GROUP BY ALL),
        l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        st AS (SELECT o, unnest(range(1, 6)) AS i FROM o),
        r AS (SELECT part, array_to_string(o, '') AS filter_order, i::INT AS step, o[i] AS x,
            coalesce(sum(n) FILTER (NOT list_has_any(m, o[1 : i])), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (list_contains(m, o[i]) AND NOT list_has_any(m, o[1 : i - 1])), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (list_contains(m, o[i]) AND list_has_any(m, o[1 : i - 1])), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (m = [o[i]]), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (list_contains(m, o[i]) AND NOT list_has_any(m, o[1 : i - 1])), 0)::BIGINT AS good_lost,
            coalesce(sum(bad) FILTER (list_contains(m, o[i]) AND NOT list_has_any(m, o[1 : i - 1])), 0)::BIGINT AS toxic_lost
            FROM m, st GROUP BY part, o, i)
        SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r""",
}
