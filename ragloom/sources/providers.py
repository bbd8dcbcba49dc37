"""Speech-to-text, engine and embedding providers behind one protocol, with retries, and the fixtures used in tests.

A provider is a factory called once per partition; what it returns is called
per row. Fixtures are here, live clients in ``http``. ``select_stt`` and
``select_engine`` fail closed in production.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ATTEMPTS, BASE_WAIT, LEAST_WAIT, MOST_WAIT, TIMEOUT_S = 3, 1.0, 1.0, 16.0, 30.0


class ProviderError(Exception):
    """retryable follows the cause: timeouts, network failures and 5xx are, 4xx are not."""

    def __init__(self, code: str, message: str, retryable: bool, status: int | None = None):
        super().__init__(message[:300])
        self.code, self.retryable, self.status = code, retryable, status


def classify(status: int | None, timed_out: bool = False, kind: str = "STT") -> ProviderError | None:
    """status None: no response."""
    if timed_out:
        return ProviderError(f"{kind}_TIMEOUT", "timeout", True)
    if status is None:
        return ProviderError(f"{kind}_ERROR", "network error", True)
    if status >= 500:
        return ProviderError(f"{kind}_ERROR", f"server error {status}", True, status)
    return ProviderError(f"{kind}_ERROR", f"client error {status}", False, status) if status >= 400 else None


def with_retries(call: Callable[[], object], attempts: int = ATTEMPTS, base: float = BASE_WAIT, sleep: Callable[[float], None] = time.sleep):
    """attempts in total, exponential waits within [1, 16] seconds, the last error raised."""
    for n in range(attempts):
        try:
            return call()
        except ProviderError as e:
            if not e.retryable or n == attempts - 1:
                raise
            sleep(min(MOST_WAIT, max(LEAST_WAIT, base * 2**n)))
    raise AssertionError


@dataclass(frozen=True)
class Provider:
    name: str
    start: Callable[[], Callable[[dict], dict]]
    fixture: bool = False
    health: Callable[[], bool] = lambda: True


def fixture_stt() -> Provider:
    """The text that the audio bytes spell; the provider column says what produced it."""
    return Provider("fixture", lambda: lambda row: {"transcript": bytes(row["audio"]).decode("utf-8", "replace"), "language_code": row.get("language"), "confidence": 1.0}, True)


def fixture_engine() -> Provider:
    return Provider("fixture", lambda: lambda row: {"answer": row["query"], "grounded": False}, True)


def select_stt(production: bool, forced: str | None = None, exact: Provider | None = None, folded: Provider | None = None) -> Provider:
    """A forced name, else the first provider there is, else the fixture, which production refuses."""
    named = {"sarvam": exact, "voxtral": folded, "mock": fixture_stt()}
    if forced:
        found = named.get(forced)
        if found is None:
            raise ValueError(f"no provider {forced}")
    else:
        found = exact or folded or named["mock"]
    if production and found.fixture:
        raise ValueError("fixtures do not serve production")
    return found


def select_engine(production: bool, remote: Provider | None = None) -> Provider:
    if production and remote is None:
        raise ValueError("fixtures do not serve production")
    return remote or fixture_engine()


def form_fields(provider: str, model: str, language: str | None = None, mode: str | None = None) -> dict[str, str]:
    """Form fields beside the audio file: the first provider takes mode and language_code, the second language."""
    fields = {"model": model}
    if provider == "sarvam" and mode:
        fields["mode"] = mode
    if language:
        fields["language_code" if provider == "sarvam" else "language"] = language
    return fields


def endpoint(url: str) -> str:
    return url.rstrip("/")


def apply(df: DataFrame, provider: Provider, output: dict[str, str], sleep: Callable[[float], None] | None = None, kind: str = "STT", attempts: int = ATTEMPTS) -> DataFrame:
    """df with the provider's output columns, elapsed_ms, and error_code, error_message, retryable where it failed: any
    error that is no ProviderError is a <kind>_ERROR. One client a partition."""
    schema = T.StructType(list(df.schema.fields))
    for name, of in (output | {"elapsed_ms": "double", "error_code": "string", "error_message": "string", "retryable": "boolean"}).items():
        schema.add(name, of)
    names = list(output)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = provider.start()
        for b in batches:
            rows = []
            for row in b.to_dict("records"):
                began, got, fault = time.perf_counter(), {}, [None, None, None]
                try:
                    got = with_retries(lambda row=row: call(row), attempts, sleep=sleep or time.sleep)
                except ProviderError as e:
                    fault = [e.code, str(e), e.retryable]
                except Exception as e:  # noqa: BLE001  whatever a client raises fails its row, not the job
                    fault = [f"{kind}_ERROR", f"{type(e).__name__}: {e}"[:300], True]
                rows.append([got.get(n) for n in names] + [round(1000 * (time.perf_counter() - began), 1), *fault])
            more = pd.DataFrame(rows, columns=[*names, "elapsed_ms", "error_code", "error_message", "retryable"], index=b.index, dtype=object)
            yield pd.concat([b, more], axis=1)

    return df.mapInPandas(run, schema)
