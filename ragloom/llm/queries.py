"""A query for each operator of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragloom.llm import decontaminate, licenses, line_dedup, mixing, ngram_join, quality, token_rollup, toxicity, url_filter, warc_zip
from ragloom.llm.scratch import new_path

#: Folder of vocabulary files; pass another to ``token_rollup.maintain`` elsewhere.
VOCABULARIES = "/opt/tokenizers"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "action string, host string, path string"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_rollup.Rollup(spark, new_path(spark, "rollup"))
    return token_rollup.maintain(table(spark, sf_dir, "documents"), store, "byte_bpe_50k", "byte_bpe_multi_50k", VOCABULARIES)


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_zip.write(table(spark, sf_dir, "pages"))
    return warc_zip.read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs).withColumnsRenamed({"_n_lines": "n_lines", "_n_dropped": "n_dropped"})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_license_scan, op4_mixing, op5_toxicity, op6_url_filter, op7_token_rollup, op8_warc_zip, op9_line_dedup, op10_decontamination, pipeline)}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op2_ngram_join": f"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
        t AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
        links AS MATERIALIZED (SELECT a.doc_id AS p, b.doc_id AS q FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS p, doc_id AS q FROM documents UNION SELECT r.p, l.q FROM reach r JOIN links l ON r.q = l.p),
        least_of AS (SELECT p, min(q) AS c FROM reach GROUP BY p),
        classes AS MATERIALIZED (SELECT doc_id, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(g)) END AS class_id FROM s),
        degrees AS (SELECT p, count(DISTINCT y.class_id) AS k FROM links JOIN classes x ON p = x.doc_id JOIN classes y ON q = y.doc_id WHERE x.class_id <> y.class_id GROUP BY p)
        SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c AS component_id, class_id, coalesce(k, 0)::BIGINT AS n_links
        FROM s JOIN least_of ON s.doc_id = least_of.p JOIN classes USING (doc_id) LEFT JOIN degrees ON s.doc_id = degrees.p""",
    "op4_mixing": f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS tokens FROM documents),
        r AS MATERIALIZED (SELECT * FROM d WHERE tokens > 0),
        totals AS MATERIALIZED (SELECT source, sum(tokens)::BIGINT AS n FROM r GROUP BY source),
        g AS MATERIALIZED (SELECT list(n::DOUBLE ORDER BY n) AS ns, max(n)::DOUBLE AS top, min(n)::DOUBLE AS low, sum(n)::DOUBLE AS whole, count(*)::DOUBLE AS k FROM totals),
        a AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
            UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
                SELECT i, lo, hi, mid, ln(s) - t / s >= {mixing.ENTROPY} * ln(k) AS ok FROM (
                    SELECT i, lo, hi, mid, k, list_sum(list_transform(ls, lambda x: exp(mid * x))) AS s, list_sum(list_transform(ls, lambda x: exp(mid * x) * mid * x)) AS t FROM (
                        SELECT i, lo, hi, (lo + hi) / 2 AS mid, k, list_transform(ns, lambda x: ln(x / top)) AS ls FROM a, g WHERE i < {mixing.STEPS})))),
        natural_ok AS (SELECT ln(s) - t / s >= {mixing.ENTROPY} * ln(k) AS ok FROM (SELECT k, list_sum(list_transform(ls, lambda x: exp(x))) AS s, list_sum(list_transform(ls, lambda x: exp(x) * x)) AS t FROM (SELECT k, list_transform(ns, lambda x: ln(x / top)) AS ls FROM g))),
        first_alpha AS MATERIALIZED (SELECT CASE WHEN (SELECT ok FROM natural_ok) OR (SELECT k < 2 FROM g) THEN 1.0 ELSE lo END AS alpha FROM a WHERE i = {mixing.STEPS}),
        b AS (SELECT 0 AS i, alpha AS lo, 1.0::DOUBLE AS hi FROM first_alpha
            UNION ALL SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
                SELECT i, lo, hi, mid, pow(low / top, mid) / s * whole <= {mixing.MOST_REPEATS} * low AS ok FROM (
                    SELECT i, lo, hi, mid, low, top, whole, list_sum(list_transform(ns, lambda x: pow(x / top, mid))) AS s FROM (
                        SELECT i, lo, hi, (lo + hi) / 2 AS mid, g.* FROM b, g WHERE i < {mixing.STEPS})))),
        alpha_of AS MATERIALIZED (SELECT CASE WHEN (SELECT pow(low / top, alpha) / list_sum(list_transform(ns, lambda x: pow(x / top, alpha))) * whole <= {mixing.MOST_REPEATS} * low FROM g, first_alpha) THEN (SELECT alpha FROM first_alpha) ELSE (SELECT hi FROM b WHERE i = {mixing.STEPS}) END AS alpha),
        shares AS MATERIALIZED (SELECT source, n, floor(pow(n / top, alpha) / sum(pow(n / top, alpha)) OVER () * whole + 1e-6)::BIGINT AS budget FROM totals, g, alpha_of),
        plan AS MATERIALIZED (SELECT source, n, budget // n AS whole_passes, budget % n AS rest, ceil(n / {mixing.BLOCK_TOKENS}.0) AS blocks FROM shares),
        e AS (SELECT r.doc_id, r.source, r.tokens, p.whole_passes, p.rest, p.blocks, unnest(range(0, whole_passes + 1)) AS epoch FROM r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
        o AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS order_key FROM e),
        c AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY order_key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM o)
        SELECT doc_id, source, tokens, epoch::INTEGER AS epoch, floor(order_key / {float(1 << mixing.KEY_BITS)} * blocks)::BIGINT AS block, order_key
        FROM c WHERE epoch < whole_passes OR upto <= rest""",
    "op6_url_filter": f"""
        WITH rules(action, rh, rp) AS (VALUES {", ".join(str(r) for r in RULES)}),
        u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        m AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS verdict
            FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
        SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op8_warc_zip": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= {warc_zip.MIN_REVISIT} AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= {warc_zip.MIN_REVISIT} AND page_id <> first_page THEN first_page END AS refers_to FROM f""",
    "op9_line_dedup": rf"""
        WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
        x AS (SELECT source, text, unnest(list_distinct(list_filter(lines, lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')))) AS line FROM l),
        n AS (SELECT source, count(DISTINCT text) AS pages FROM documents GROUP BY source),
        c AS (SELECT x.source, line FROM x JOIN n ON x.source IS NOT DISTINCT FROM n.source GROUP BY x.source, line, pages
            HAVING count(DISTINCT text) > 1 AND count(DISTINCT text) > pages * {line_dedup.RATIO}::DOUBLE),
        b AS (SELECT source, list(line) AS common FROM c GROUP BY source),
        z AS (SELECT doc_id, l.source, text, lines, CASE WHEN common IS NULL THEN lines ELSE list_filter(lines, lambda s: NOT list_contains(common, s)) END AS kept FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, source, CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
            coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped FROM z""",
}
