"""Values that the contracts fix. Each list stands here once."""

# Contract enumerations.
LOCALES = ["en-IN", "hi-IN", "bn-IN", "ta-IN", "te-IN", "kn-IN", "ml-IN", "mr-IN", "gu-IN", "pa-IN", "od-IN"]
PROVIDERS = ["sarvam", "voxtral"]
CLIENT_EVENTS = ["session_start", "audio_end", "cancel"]
SERVER_EVENTS = ["transcript", "processing", "answer", "error", "complete"]
STAGES = ["transcription", "preprocessing", "embedding", "retrieval", "reranking", "generation", "grounding"]
ERROR_CODES = ["INVALID_REQUEST", "UNSUPPORTED_LANGUAGE", "STT_ERROR", "STT_TIMEOUT", "RAG_ERROR", "RAG_TIMEOUT", "NO_RELEVANT_CONTEXT", "GROUNDING_FAILED", "CANCELLED", "INTERNAL_ERROR"]
COMPLETIONS = ["success", "cancelled", "failed"]

# Codes of the first provider that are not locales themselves (exact, case-sensitive).
ALIASES_EXACT = {"en": "en-IN", "hi": "hi-IN", "bn": "bn-IN", "ta": "ta-IN", "te": "te-IN", "kn": "kn-IN", "ml": "ml-IN", "mr": "mr-IN", "gu": "gu-IN", "pa": "pa-IN", "od": "od-IN", "or": "od-IN"}

# Codes of the second provider (lower case, trimmed).
ALIASES_FOLDED = {"en": "en-IN", "hi": "hi-IN", "bn": "bn-IN", "ta": "ta-IN", "te": "te-IN", "kn": "kn-IN", "ml": "ml-IN", "mr": "mr-IN", "gu": "gu-IN", "pa": "pa-IN", "or": "od-IN", "od": "od-IN", "english": "en-IN", "hindi": "hi-IN"}

# Error code -> (HTTP status, retryable).
ERRORS = {
    "INVALID_REQUEST": (400, False),
    "UNSUPPORTED_LANGUAGE": (400, False),
    "STT_ERROR": (502, True),
    "STT_TIMEOUT": (504, True),
    "RAG_ERROR": (502, True),
    "RAG_TIMEOUT": (504, True),
    "INTERNAL_ERROR": (500, False),
}

# Leading bytes (hexadecimal) of audio files and their types.
AUDIO_MAGIC = [("52494646", "audio/wav"), ("FFFB", "audio/mpeg"), ("FFF3", "audio/mpeg"), ("FFF2", "audio/mpeg"), ("494433", "audio/mpeg"), ("664C6143", "audio/flac"), ("4F676753", "audio/ogg")]

# Content types that need no warning.
AUDIO_TYPES = ["audio/wav", "audio/wave", "audio/x-wav", "audio/mpeg", "audio/mp3", "audio/flac", "audio/ogg", "audio/webm", "audio/aac", "audio/mp4", "application/octet-stream"]

DEFAULT_LOCALE = "en-IN"
MAX_AUDIO_MB = 25.0
DEFAULT_TOP_K, MOST_TOP_K, FETCH_K = 5, 20, 20
MAX_QUERY_CHARS = 2000
SLO_MS, PROVIDER_MS = 200.0, 150.0
