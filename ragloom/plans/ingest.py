"""Queries over the corpus: scan, duplicates, hold-out, chunks, embeddings, index, prompts and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import answers, index, ingest, metrics
from ragloom.plans.fixtures import SQL_QUERIES, queries, table
from ragloom.plans.registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE n_chars >= 1000 AND lang = 'en'")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both predicates and the four columns reach the Parquet scan."""
    return _docs(spark, sf_dir).where((F.col("n_chars") >= 1000) & (F.col("lang") == "en")).select("doc_id", "lang", "source", "n_chars")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position, turn, role, length(text)::BIGINT AS chars FROM conversations")
def nested_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays, validated and exploded. Turns of one conversation are few; the array is per conversation."""
    c = table(spark, sf_dir, "conversations")
    nested = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("chars")))).alias("turns"))
    nested = nested.withColumn("roles", F.col("turns.role")).where(F.size("roles") == F.size("turns")).drop("roles")
    return ingest.exploded(nested, "turns")


@query("SELECT doc_id, md5(nfc_normalize(text || chr(101) || chr(769))) AS digest FROM documents")
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text gets a decomposed letter, so that the normalisation has work to do."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.nfc(F.concat("text", F.lit("é"))).cast("binary")).alias("digest"))


@query("SELECT doc_id, sha256(source || '|' || doc_id || '|' || text) AS document_id FROM documents")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.document_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("document_id"))


@query("""WITH h AS (SELECT doc_id, sha1(source || '|' || doc_id) AS h FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.uuid_of(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("point_id"))


@query("SELECT sha256(text) AS text_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicate_report(_docs(spark, sf_dir))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.keep_first(_docs(spark, sf_dir)).select("doc_id", "source")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def holdout_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.exclude_heldout(_docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")).select("doc_id")


@query("""SELECT lang, grouping(lang)::INT AS is_total, count(*) AS documents, sum(length(text))::BIGINT AS chars, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest,
    round(avg(length(text)), 6) AS mean_chars, round(avg((lang = 'en')::INT), 6) AS english_share FROM documents GROUP BY GROUPING SETS ((lang), ())""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.profile(_docs(spark, sf_dir))


_PARTS = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query(f"""WITH r AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, sha256(doc_id || '|' || sha256(text)) AS h FROM documents)
    SELECT split, count(*) AS rows, sha256(concat_ws('|', {_PARTS})) AS manifest FROM r GROUP BY split""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.split_manifest(_docs(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")), "split")


_SQL_CHUNKS = """c AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 50) / 150.0) - 1)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0),
    chunks AS (SELECT doc_id, i AS position, i * 150 AS start, substr(text, i * 150 + 1, 200) AS chunk FROM c)"""


@query(f"WITH {_SQL_CHUNKS} SELECT doc_id, position::INT AS position, start::INT AS start, md5(chunk) AS digest FROM chunks")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"))).alias("position", "c"))
    return c.select("doc_id", "position", F.col("c.start").alias("start"), F.md5(F.col("c.text").cast("binary")).alias("digest"))


_SQL_SENTENCES = "s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?।]+[.!?।]*'), lambda x: trim(x)), lambda x: length(x) > 0) AS s FROM documents)"


@query(f"WITH {_SQL_SENTENCES} SELECT doc_id, len(s)::INT AS sentences, md5(array_to_string(s, '|')) AS digest FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"""WITH {_SQL_SENTENCES}, p AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: {{'done': []::VARCHAR[], 'open': x}}), lambda a, x: CASE WHEN length(a.open) + 1 + length(x.open) <= 200
        THEN {{'done': a.done, 'open': a.open || ' ' || x.open}} ELSE {{'done': list_append(a.done, a.open), 'open': x.open}} END) AS r FROM s WHERE len(s) > 0),
    u AS (SELECT doc_id, unnest(list_append(r.done, r.open)) AS text, unnest(range(0, len(r.done) + 1)) AS position FROM p)
    SELECT doc_id, position::INT AS position, length(text)::INT AS chars, md5(text) AS digest FROM u""")
def chunk_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.packed(T.sentences(F.col("text")))).alias("position", "text"))
    return c.select("doc_id", "position", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(rf"""WITH {_SQL_SENTENCES}, e AS (SELECT doc_id, unnest(s) AS s, unnest(range(0, len(s))) AS i FROM s),
    t AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS w FROM e),
    n AS (SELECT doc_id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS c FROM t GROUP BY ALL),
    l AS (SELECT doc_id, i, sqrt(sum(c * c)) AS l FROM n GROUP BY doc_id, i),
    d AS (SELECT b.doc_id, b.i, sum(a.c * b.c) AS d FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.i = b.i - 1 AND a.slot = b.slot GROUP BY b.doc_id, b.i),
    near AS (SELECT d.doc_id, d.i FROM d JOIN l x ON x.doc_id = d.doc_id AND x.i = d.i JOIN l y ON y.doc_id = d.doc_id AND y.i = d.i - 1 WHERE round(d / (x.l * y.l), 9) >= 0.3),
    g AS (SELECT e.doc_id, e.i, s, sum((near.i IS NULL)::INT) OVER (PARTITION BY e.doc_id ORDER BY e.i) - 1 AS position FROM e LEFT JOIN near ON near.doc_id = e.doc_id AND near.i = e.i),
    j AS (SELECT doc_id, position, string_agg(s, ' ' ORDER BY i) AS text FROM g GROUP BY doc_id, position)
    SELECT doc_id, position::INT AS position, length(text)::INT AS chars, md5(text) AS digest FROM j""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring sentences whose hashed vectors have a cosine under 0.3 part."""
    sentences = _docs(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    c = sentences.select("doc_id", F.posexplode(T.semantic(F.col("s"))).alias("position", "text"))
    return c.select("doc_id", "position", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_SQL_EMBED = r"""t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS w FROM conversations),
    n AS (SELECT conv_id, turn, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS c FROM t GROUP BY ALL),
    l AS (SELECT conv_id, turn, sqrt(sum(c * c)) AS l FROM n GROUP BY conv_id, turn)"""


@query(f"WITH {_SQL_EMBED} SELECT conv_id, turn, slot, round(c / l, 6) AS value FROM n JOIN l USING (conv_id, turn)")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots that are not 0."""
    v = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.hash_embed(F.col("text"))).alias("slot", "value")).where("value > 0")
    return v.select("conv_id", "turn", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.lit(1).alias("version"), F.col("embedding").alias("vector"), "label")


@query("SELECT vec_id AS point_id, CASE WHEN vec_id % 7 = 0 THEN 3 WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN vec_id % 7 = 0 THEN label + 200 WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of changes, the first sent twice."""
    p = _points(spark, sf_dir).drop("vector")
    first = p.where("point_id % 5 = 0").withColumn("version", F.lit(2)).withColumn("label", F.col("label") + 100)
    second = p.where("point_id % 7 = 0").withColumn("version", F.lit(3)).withColumn("label", F.col("label") + 200)
    return index.upsert(index.upsert(index.upsert(p, first), second), first)


_SQL_SUMMARY = """SELECT count(*) AS points, count(DISTINCT vec_id) AS distinct_points, 0::BIGINT AS bad_dimension, 0::BIGINT AS not_finite,
    round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS least_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS most_norm{} FROM embeddings"""


@query(_SQL_SUMMARY.format(", 'hash-64' AS model, 'cosine' AS distance, 64 AS dimension"))
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.summary(_points(spark, sf_dir), 64).select("*", F.lit("hash-64").alias("model"), F.lit("cosine").alias("distance"), F.lit(64).alias("dimension"))


_SQL_VERIFY = _SQL_SUMMARY.format(", {} AS ready") + " WHERE {}"


@query(f"SELECT 'whole' AS state, * FROM ({_SQL_VERIFY.format('true', 'true')}) UNION ALL SELECT 'lacking', * FROM ({_SQL_VERIFY.format('false', 'vec_id <> 7')})")
def index_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against the number that their manifest gives: all there, and one missing."""
    p = _points(spark, sf_dir)
    expected = p.count()  # what write_snapshot puts into the manifest
    check = lambda points, state: index.verify(points, 64, expected).select(F.lit(state).alias("state"), "*")
    return check(p, "whole").unionByName(check(p.where("point_id != 7"), "lacking"))


_SQL_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}]+'))"
_A, _C = _SQL_TOKENS.format("a"), _SQL_TOKENS.format("c")
_SQL_GROUNDING = f"g AS (SELECT d.doc_id, quality, round(CASE WHEN len({_A}) > 0 THEN len(list_intersect({_A}, {_C})) / len({_A}) ELSE 0 END, 6) AS score FROM (SELECT c.doc_id, a.text AS a, c.text AS c FROM documents c JOIN documents a ON a.doc_id = c.doc_id - c.doc_id % 3) d LEFT JOIN labels USING (doc_id))"


def _grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every third document stands for an answer, the whole texts of it and the two after it for contexts."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    answer = d.where("doc_id % 3 = 0").select(F.col("doc_id").alias("_a"), F.col("text").alias("answer"))
    both = d.withColumn("_a", F.col("doc_id") - F.col("doc_id") % 3).join(answer, "_a")
    scored = both.select("doc_id", "lang", F.round(answers.overlap(F.col("answer"), F.col("text")), 6).alias("score"))
    return scored.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query(f"WITH {_SQL_GROUNDING} SELECT doc_id, score, score >= 0.6 AS grounded FROM g")
def grounding_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grounding(spark, sf_dir).select("doc_id", "score", (F.col("score") >= answers.GROUNDED_AT).alias("grounded"))


@query(f"""WITH {_SQL_GROUNDING}, c AS (SELECT count(*) FILTER (score >= 0.6 AND quality = 1) AS tp, count(*) FILTER (score >= 0.6 AND quality = 0) AS fp, count(*) FILTER (score < 0.6 AND quality = 1) AS fn FROM g)
    SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def grounding_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grounding(spark, sf_dir).where("quality IS NOT NULL")
    return g.agg(*metrics.prf(F.col("score") >= answers.GROUNDED_AT, F.col("quality") == 1))


@query(f"WITH {_SQL_GROUNDING} SELECT lang, grouping(lang)::INT AS is_total, count(*) AS answers, round(avg((score < 0.6)::INT), 6) AS not_grounded FROM g JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def grounded_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grounding(spark, sf_dir)
    return g.rollup("lang").agg(F.grouping("lang").cast("int").alias("is_total"), F.count("*").alias("answers"), F.round(F.avg((F.col("score") < answers.GROUNDED_AT).cast("double")), 6).alias("not_grounded"))


@query(f"""WITH {SQL_QUERIES}, c AS (SELECT conv_id, string_agg('[' || r || '] ' || t, chr(10) ORDER BY r) AS context FROM (SELECT conv_id, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'assistant') GROUP BY conv_id)
    SELECT request_id, 'Answer in ' || language || ' and only from the context.' || chr(10) || 'Context:' || chr(10) || context || chr(10) || 'Question: ' || query AS prompt FROM q JOIN c USING (conv_id)""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's answers, all of them, stand for the context."""
    q, c = queries(spark, sf_dir), _context(spark, sf_dir)
    return q.join(c, "conv_id").select("request_id", answers.prompt(F.col("query"), F.col("context"), F.col("language")).alias("prompt"))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    turns = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return told.groupBy("conv_id").agg(turns.alias("_t")).select("conv_id", F.col("_t.text").alias("context"))


_Q_TOKENS = _SQL_TOKENS.format("query")
_S_TOKENS = _SQL_TOKENS.format("s")


@query(f"""WITH {SQL_QUERIES}, c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS context FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    s AS (SELECT request_id, query, unnest(list_filter(list_transform(regexp_extract_all(context, '[^.!?।]+[.!?।]*'), lambda x: trim(x)), lambda x: length(x) > 0)) AS s, generate_subscripts(list_filter(list_transform(regexp_extract_all(context, '[^.!?।]+[.!?।]*'), lambda x: trim(x)), lambda x: length(x) > 0), 1) AS i FROM q JOIN c USING (conv_id)),
    r AS (SELECT request_id, s, row_number() OVER (PARTITION BY request_id ORDER BY len(list_intersect({_Q_TOKENS}, {_S_TOKENS})) DESC, i) AS r FROM s)
    SELECT request_id, s AS answer FROM r WHERE r = 1""")
def fixture_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _context(spark, sf_dir).select("conv_id", F.array_join("context", "\n").alias("context"))
    return queries(spark, sf_dir).join(told, "conv_id").select("request_id", answers.extractive(F.col("query"), F.col("context")).alias("answer")).where("answer IS NOT NULL")
