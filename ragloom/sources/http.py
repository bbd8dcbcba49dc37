"""Live clients: speech-to-text by multipart upload, an answering engine by JSON, over urllib."""

from __future__ import annotations

import json
import socket
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

from ragloom.functions.fixed import LOCALES
from ragloom.sources.providers import TIMEOUT_S, Provider, ProviderError, classify, endpoint, form_fields

JSON = {"Content-Type": "application/json"}


def request(url: str, headers: dict[str, str], body: bytes | None, timeout: float, kind: str) -> bytes:
    """The body of a successful response; every failure is a ProviderError of its class."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers), timeout=timeout) as r:
            return r.read()
    except urllib.error.HTTPError as e:
        fault = classify(e.code, kind=kind) or ProviderError(f"{kind}_ERROR", f"unexpected status {e.code}", False, e.code)
        detail = e.read(300).decode("utf-8", "replace")
        raise ProviderError(fault.code, f"{fault}: {detail}", fault.retryable, e.code) from e
    except urllib.error.URLError as e:
        raise classify(None, isinstance(e.reason, TimeoutError | socket.timeout), kind) from e
    except TimeoutError as e:
        raise classify(None, True, kind) from e
    except OSError as e:
        raise classify(None, kind=kind) from e


def multipart(fields: dict[str, str], name: str, content: bytes, mime: str) -> tuple[bytes, str]:
    """Body and content type of a form with one file."""
    edge = uuid.uuid4().hex
    parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    parts.append(f'--{edge}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: {mime}\r\n\r\n'.encode() + content + b"\r\n")
    return b"".join([*parts, f"--{edge}--\r\n".encode()]), f"multipart/form-data; boundary={edge}"


def _parsed(body: bytes, kind: str) -> dict:
    try:
        found = json.loads(body)
    except ValueError as e:
        raise ProviderError(f"{kind}_ERROR", "response is not JSON", False) from e
    if not isinstance(found, dict):
        raise ProviderError(f"{kind}_ERROR", "response is not an object", False)
    return found


def stt(name: str, url: str, key: str, model: str, mode: str | None = None, timeout: float = TIMEOUT_S) -> Provider:
    """name 'sarvam' or 'voxtral': rows (audio, language) to transcript, language_code, confidence."""
    header = {"api-subscription-key": key} if name == "sarvam" else {"Authorization": f"Bearer {key}"}

    def call(row: dict) -> dict:
        body, kind = multipart(form_fields(name, model, row.get("language"), mode), "audio.wav", bytes(row["audio"]), "audio/wav")
        got = _parsed(request(url, header | {"Content-Type": kind}, body, timeout, "STT"), "STT")
        text = got.get("transcript" if name == "sarvam" else "text")
        if not isinstance(text, str):
            raise ProviderError("STT_ERROR", "response has no transcript", False)
        return {"transcript": text, "language_code": got.get("language_code" if name == "sarvam" else "language"), "confidence": got.get("confidence")}

    return Provider(name, lambda: call)


def _answer(got: dict) -> dict:
    """An answer that the contract allows, with sources and latency as JSON."""
    latency, sources = got.get("latency"), got.get("sources")
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and x >= 0
    sound = (
        isinstance(got.get("answer"), str) and got["answer"] != "" and got.get("language") in LOCALES and isinstance(got.get("grounded"), bool)
        and isinstance(sources, list) and all(isinstance(s, dict) and {"id", "text", "score"} <= s.keys() for s in sources)
        and isinstance(latency, dict) and number(latency.get("total_ms")) and all(v is None or number(v) for v in latency.values())
    )
    if not sound:
        raise ProviderError("RAG_ERROR", "response violates the answer contract", False)
    return {"answer": got["answer"], "grounded": got["grounded"], "sources_json": json.dumps(sources), "latency_json": json.dumps(latency)}


def engine(url: str, timeout: float = TIMEOUT_S) -> Provider:
    """An engine behind POST {url}/api/v1/query: rows of the query contract to answers."""
    base = endpoint(url)

    def call(row: dict) -> dict:
        body = json.dumps({k: row[k] for k in ("request_id", "query", "language", "top_k", "session_id") if row.get(k) is not None}).encode()
        return _answer(_parsed(request(f"{base}/api/v1/query", JSON, body, timeout, "RAG"), "RAG"))

    return Provider("http", lambda: call, health=lambda: healthy(url, timeout))


def healthy(url: str, timeout: float = TIMEOUT_S) -> bool:
    try:
        request(f"{endpoint(url)}/health", {}, None, timeout, "RAG")
    except ProviderError:
        return False
    return True


def from_env(env: dict[str, str]) -> tuple[Provider | None, Provider | None, Provider | None]:
    """The exact and the folded speech-to-text provider and the engine that the settings name; None where there is none."""
    get: Callable[[str, str], str] = lambda k, default="": env.get(f"RAGLOOM_{k}", default)
    sarvam = stt("sarvam", get("SARVAM_URL"), get("SARVAM_KEY"), get("SARVAM_MODEL"), get("SARVAM_MODE") or None) if get("SARVAM_KEY") else None
    voxtral = stt("voxtral", get("VOXTRAL_URL"), get("VOXTRAL_KEY"), get("VOXTRAL_MODEL")) if get("VOXTRAL_KEY") else None
    return sarvam, voxtral, engine(get("ENGINE_URL")) if get("ENGINE_URL") else None
