"""The engine behind one object: index documents, answer texts and audio, run sessions, report status.

What embeds, chunks and generates is passed in as ``Parts``; the defaults are
fixtures, which production refuses. A remote engine takes the place of search
and generation; the contracts, the codes and the outcomes stay.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import audio, contracts, locales
from ragloom.functions import text as T
from ragloom.functions.fixed import DEFAULT_LOCALE, DEFAULT_TOP_K, FETCH_K, LOCALES, MAX_AUDIO_MB, MAX_QUERY_CHARS
from ragloom.operators import answers, index, ingest, retrieval
from ragloom.operators.sessions import Limits
from ragloom.sources import providers
from ragloom.streaming import sessions


@dataclass(frozen=True)
class Settings:
    """Each field can be set by the environment variable RAGLOOM_<NAME>. 0 for a limit of frames or milliseconds: none."""

    floor: float = 0.35
    fetch_k: int = FETCH_K
    rerank: bool = True
    dim: int = 64
    chunk: int = 200
    overlap: int = 50
    max_query_chars: int = MAX_QUERY_CHARS
    max_audio_mb: float = MAX_AUDIO_MB
    max_frame_bytes: int = 0
    max_audio_ms: int = 0
    provider_attempts: int = providers.ATTEMPTS
    production: bool = False

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        given = {f.name: env[k] for f in fields(Settings) if (k := f"RAGLOOM_{f.name.upper()}") in env}
        kinds = {f.name: type(f.default) for f in fields(Settings)}
        return Settings(**{k: v.lower() in ("1", "true", "yes") if kinds[k] is bool else kinds[k](v) for k, v in given.items()})


def _numbered(parts: Column) -> Column:
    return F.transform(parts, lambda x, i: F.struct(i.alias("start"), x.alias("text")))


#: Chunkers by name: text and settings to an array of (start, text); start is the place in the text, or among the chunks.
CHUNKERS: dict[str, Callable[[Column, Settings], Column]] = {
    "fixed": lambda text, s: T.fixed_chunks(text, s.chunk, s.overlap),
    "sentence": lambda text, s: _numbered(T.packed(T.sentences(text), s.chunk)),
    "semantic": lambda text, s: _numbered(T.semantic(T.sentences(text), dim=s.dim)),
}


@dataclass(frozen=True)
class Parts:
    """embed: text and dimension to a vector; chunk: see ``CHUNKERS``; generate: question and evidence (texts in order of
    rank) to an answer or null. fixtures names those that are for tests only."""

    embed: Callable[[Column, int], Column] = T.hash_embed
    chunk: Callable[[Column, Settings], Column] = field(default_factory=lambda: CHUNKERS["fixed"])
    generate: Callable[[Column, Column], Column] = lambda question, evidence: answers.extractive(question, evidence[0])
    fixtures: tuple[str, ...] = ("embed", "generate")


LATENCY = ("total_ms", "embedding_ms", "retrieval_ms", "reranking_ms", "generation_ms")
SOURCES = "array<struct<id:string,text:string,score:double>>"


class Engine:
    """points: id long, document string, start int, text string, vector array<double>. expected: how many there should be,
    as the snapshot's manifest says; without it the index is not ready."""

    def __init__(self, spark: SparkSession, points: DataFrame, settings: Settings | None = None, stt: providers.Provider | None = None, parts: Parts | None = None, remote: providers.Provider | None = None, expected: int | None = None):
        self.spark, self.points, self.settings, self.parts = spark, points, settings or Settings(), parts or Parts()
        self.stt = providers.select_stt(self.settings.production, exact=stt)
        self.remote = None
        if remote is not None or (self.settings.production and self.parts.fixtures):
            self.remote = providers.select_engine(self.settings.production, remote)  # refuses fixtures in production
        self.expected, self.started = expected, time.time()

    @staticmethod
    def load(spark: SparkSession, folder: str, settings: Settings | None = None, **given) -> Engine:
        """From the newest snapshot in folder, which says how many points there are."""
        points, meta = index.read_snapshot(spark, folder)
        return Engine(spark, points, settings, expected=meta["points"], **given)

    @staticmethod
    def index(docs: DataFrame, settings: Settings, heldout: DataFrame | None = None, parts: Parts | None = None) -> DataFrame:
        """docs (doc_id, source, text) to points: normalised, without held-out texts, chunked, embedded."""
        parts = parts or Parts()
        clean = docs.select(F.col("doc_id"), "source", T.nfc(F.col("text")).alias("text"))
        clean = ingest.exclude_heldout(clean, heldout) if heldout is not None else clean
        chunks = clean.select(T.document_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("document"), F.explode(parts.chunk(F.col("text"), settings)).alias("c"))
        key = F.xxhash64("document", F.col("c.start"))
        return chunks.select(key.alias("id"), "document", F.col("c.start").alias("start"), F.col("c.text").alias("text"), parts.embed(F.col("c.text"), settings.dim).alias("vector"))

    def check(self, queries: DataFrame) -> DataFrame:
        """queries (request_id, query, language, top_k, session_id) with defaults and error_code (null if valid)."""
        q = queries.withColumn("top_k", F.coalesce(F.col("top_k").cast("int"), F.lit(DEFAULT_TOP_K))).withColumn("language", F.coalesce("language", F.lit(DEFAULT_LOCALE)))
        bad = contracts.query(F.col("request_id"), F.trim("query"), F.col("language"), F.col("top_k"), F.col("session_id"))
        code = F.when(~F.col("language").isin(LOCALES), "UNSUPPORTED_LANGUAGE").when((bad != "") | (F.length("query") > self.settings.max_query_chars), "INVALID_REQUEST")
        return q.withColumn("error_code", code)

    def retrieve(self, valid: DataFrame) -> DataFrame:
        """Evidence above the floor: query_id, request_id, rank, item_id, score, text. Text is fetched for the hits only."""
        s = self.settings
        q = valid.select(F.xxhash64("request_id").alias("query_id"), "request_id", "query", "top_k", self.parts.embed(F.col("query"), s.dim).alias("vector"))
        hits = retrieval.topk(q.select("query_id", "vector"), self.points.select("id", "vector"), s.fetch_k, s.floor)
        hits = retrieval.hydrate(hits, self.points.select(F.col("id").alias("item_id"), "text"), s.fetch_k * q.count()).join(q.drop("vector"), "query_id")
        if s.rerank:
            hits = retrieval.rerank(hits, 0.7 * F.col("score") + 0.3 * answers.overlap(F.col("query"), F.col("text")), s.fetch_k)
        return hits.where(F.col("rank") <= F.col("top_k")).select("query_id", "request_id", "query", "rank", "item_id", "score", "text")

    def answer(self, queries: DataFrame) -> DataFrame:
        """An answer per request, whatever its outcome. latency: what was measured for the request, else null; a batch's
        search is not timed by request, a remote engine's calls are."""
        checked = self.check(queries)
        return self._ask(checked) if self.remote else self._search(checked)

    def _search(self, checked: DataFrame) -> DataFrame:
        hits = self.retrieve(checked.where("error_code IS NULL"))
        rows = checked.withColumn("query_id", F.xxhash64("request_id")).join(answers.sources(hits), "query_id", "left")
        evidence = F.transform("sources", lambda s: s["text"])
        rows = rows.withColumn("answer", F.when(F.col("sources").isNotNull(), self.parts.generate(F.col("query"), evidence)))
        n = F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources"))
        rows = rows.withColumn("_ok", answers.overlap(F.col("answer"), F.array_join(evidence, " ")) >= answers.GROUNDED_AT)
        code, _, grounded = answers.outcome(n, F.lit(None).cast("string"), F.col("answer").isNotNull(), F.col("_ok"))
        return self._shaped(rows, F.coalesce("error_code", code), F.col("answer"), grounded, F.col("sources"), F.struct(*(F.lit(None).cast("double").alias(x) for x in LATENCY)))

    def _ask(self, checked: DataFrame) -> DataFrame:
        """Answers of the remote engine; a request that fails there has the error's code."""
        output = {"answer": "string", "grounded": "boolean", "sources_json": "string", "latency_json": "string"}
        valid = checked.where("error_code IS NULL").drop("error_code")
        got = providers.apply(valid, self.remote, output, kind="RAG", attempts=self.settings.provider_attempts)
        said = F.from_json("latency_json", ", ".join(f"{x} double" for x in LATENCY))
        latency = F.struct(*(F.coalesce(said[x], F.col("elapsed_ms")).alias(x) if x == "total_ms" else said[x].alias(x) for x in LATENCY))
        done = self._shaped(got, F.col("error_code"), F.col("answer"), F.col("grounded"), F.from_json("sources_json", SOURCES), latency)
        null = lambda kind: F.lit(None).cast(kind)
        lost = self._shaped(checked.where("error_code IS NOT NULL"), F.col("error_code"), null("string"), null("boolean"), null(SOURCES), F.struct(*(null("double").alias(x) for x in LATENCY)))
        return done.unionByName(lost)

    @staticmethod
    def _shaped(rows: DataFrame, code: Column, answer: Column, grounded: Column, sources: Column, latency: Column) -> DataFrame:
        sound = code.isNull()
        return rows.select(
            "request_id", answer.alias("answer"), "language", F.coalesce(sound & grounded, F.lit(False)).alias("grounded"), F.coalesce(sources, F.array().cast(SOURCES)).alias("sources"),
            latency.alias("latency"), F.when(sound, "success").otherwise("failed").alias("status"), code.alias("error_code"),
        )

    def transcribe(self, uploads: DataFrame) -> DataFrame:
        """uploads (request_id, audio, language): transcript rows with error_code where guard or provider failed."""
        guarded = uploads.withColumn("fault", audio.guard(F.col("audio")))
        heard = providers.apply(guarded.where("fault IS NULL"), self.stt, {"transcript": "string", "language_code": "string", "confidence": "double"}, attempts=self.settings.provider_attempts)
        locale = locales.resolve_exact(F.col("language_code"), F.col("language"), strict=True)
        fine = heard.select("request_id", F.col("transcript").alias("text"), F.when(F.col("error_code").isNull(), locale).alias("language"), "confidence", F.coalesce("error_code", F.when(locale.isNull(), "UNSUPPORTED_LANGUAGE")).alias("error_code"))
        null = lambda kind: F.lit(None).cast(kind)
        return fine.unionByName(guarded.where("fault IS NOT NULL").select("request_id", null("string").alias("text"), null("string").alias("language"), null("double").alias("confidence"), F.lit("INVALID_REQUEST").alias("error_code")))

    def answer_audio(self, uploads: DataFrame) -> DataFrame:
        """Answers for uploads (request_id, audio, language, and top_k if there is one); requests whose transcript is missing
        or empty fail with their code."""
        t = self.transcribe(uploads)
        spoken = F.coalesce(F.col("error_code").isNull() & (F.length(F.trim("text")) > 0), F.lit(False))
        heard = t.where(spoken).select("request_id", F.col("text").alias("query"), "language", F.lit(None).cast("string").alias("session_id"))
        asked = heard.join(uploads.select("request_id", "top_k"), "request_id") if "top_k" in uploads.columns else heard.withColumn("top_k", F.lit(DEFAULT_TOP_K))
        null = lambda kind: F.lit(None).cast(kind)
        lost = self._shaped(t.where(~spoken), F.coalesce("error_code", F.lit("INVALID_REQUEST")), null("string"), F.lit(False), null(SOURCES), F.struct(*(null("double").alias(x) for x in LATENCY)))
        return self.answer(asked).unionByName(lost)

    def limits(self) -> Limits:
        s = self.settings
        return Limits(int(s.max_audio_mb * 1024 * 1024), s.max_frame_bytes or None, s.max_audio_ms or None)

    def stream_sessions(self, messages: DataFrame) -> DataFrame:
        return sessions.machine(messages, self.limits())

    def verify_index(self) -> DataFrame:
        return index.verify(self.points, self.settings.dim, -1 if self.expected is None else self.expected, key="id")

    def status(self) -> DataFrame:
        """One row: status, uptime_seconds, stt_provider, ready (what answers can be reached), stt_ready (always true, as
        the service reports it), index_ready."""
        indexed = bool(self.verify_index().first()["ready"])
        ready = self.remote.health() if self.remote else indexed
        return self.spark.createDataFrame([("ok", round(time.time() - self.started, 1), self.stt.name, ready, True, indexed)], "status string, uptime_seconds double, stt_provider string, ready boolean, stt_ready boolean, index_ready boolean")
