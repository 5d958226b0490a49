"""Settings, with the environment's values and their defaults."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

# The variables that settings are read from, and their defaults.
_DEFAULTS = {
    "SIMILARITY_TOP_K": 12, "CHUNK_SIZE_TOKENS": 1024, "CHUNK_OVERLAP_TOKENS": 128, "CONTEXT_BUDGET_TOKENS": 32000,
    "HIGH_RELEVANCE_THRESHOLD": 0.8, "MEDIUM_RELEVANCE_THRESHOLD": 0.5, "MAX_CYCLES": 2, "MAX_EXPLORER_TURNS": 8,
    "MAX_EXTRACTOR_TURNS": 6, "MAX_REVIEWER_TURNS": 8, "VISION_CALL_LIMIT": 6, "MAX_TOKENS": 8192, "TEMPERATURE": 0.1,
}


def _setting(name: str):
    default = _DEFAULTS[name]
    return field(default_factory=lambda: type(default)(os.environ.get(name, default)))


@dataclass(frozen=True)
class Settings:
    top_k: int = _setting("SIMILARITY_TOP_K")
    chunk_tokens: int = _setting("CHUNK_SIZE_TOKENS")
    overlap_tokens: int = _setting("CHUNK_OVERLAP_TOKENS")
    context_tokens: int = _setting("CONTEXT_BUDGET_TOKENS")
    high_relevance: float = _setting("HIGH_RELEVANCE_THRESHOLD")
    medium_relevance: float = _setting("MEDIUM_RELEVANCE_THRESHOLD")
    max_cycles: int = _setting("MAX_CYCLES")
    explorer_turns: int = _setting("MAX_EXPLORER_TURNS")
    extractor_turns: int = _setting("MAX_EXTRACTOR_TURNS")
    reviewer_turns: int = _setting("MAX_REVIEWER_TURNS")
    vision_calls: int = _setting("VISION_CALL_LIMIT")
    max_tokens: int = _setting("MAX_TOKENS")
    temperature: float = _setting("TEMPERATURE")


# The variables with the keys of a tracing service and of a model service.
TRACING_KEYS = ("LANGFUSE_PUBLIC_KEY", "LANGFUSE_SECRET_KEY")
MODEL_KEY = "OPENAI_API_KEY"


def tracing_hook(make: Callable[[str, str], Callable[[dict], None]], environ: Mapping[str, str] = os.environ) -> Callable[[dict], None] | None:
    """make(public key, secret key), a function that engine.run_query's on_step can be; None unless both keys are set
    and what make needs can be imported."""
    keys = [environ.get(k, "") for k in TRACING_KEYS]
    if not all(keys):
        return None
    try:
        return make(*keys)
    except ImportError:
        return None


def model_client(make: Callable[[str], object], environ: Mapping[str, str] = os.environ) -> object:
    """make(key), the client that an adapter asks; made where it is called, as on an executor, never on import."""
    return make(environ.get(MODEL_KEY, ""))
