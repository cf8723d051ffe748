"""Settings: which values are accepted, and in which form."""

from __future__ import annotations

from typing import Any
from urllib.parse import urlsplit

# fixed values: what settings may be
CHOICES = {
    "provider": ("ollama", "claude", "openai", "gemini"),
    "theme": ("light", "dark", "system"),
    "uiLanguage": ("ko", "en"),
    "defaultSummaryType": ("full", "chapter", "keywords"),
    "summaryLanguage": ("ko", "en", "ja", "zh", "auto"),
}
SWITCHES = ("enableImageAnalysis", "enableOcrFallback", "enableAnswerVerification", "persistSessions", "autoCheckUpdates")
CHUNK_SIZES = range(1000, 16001)
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
MAX_MODEL, MAX_TEMPLATES, MAX_TEMPLATE_ID, MAX_TEMPLATE_NAME, MAX_TEMPLATE_PROMPT = 100, 20, 64, 60, 4000


def _templates(value: list) -> list[dict[str, str]]:
    """The good ones of the given templates, the first twenty, cut to their limits."""
    text = lambda t, k: t.get(k) if isinstance(t, dict) and isinstance(t.get(k), str) else ""
    good = [t for t in value if 0 < len(text(t, "id")) <= MAX_TEMPLATE_ID and text(t, "name").strip() and text(t, "prompt").strip()]
    return [
        {"id": t["id"], "name": t["name"][:MAX_TEMPLATE_NAME], "prompt": t["prompt"][:MAX_TEMPLATE_PROMPT], "strategy": "chunked" if t.get("strategy") == "chunked" else "single"}
        for t in good[:MAX_TEMPLATES]
    ]


def _local(value: Any) -> bool:
    try:
        url = urlsplit(value) if isinstance(value, str) else None
        return url is not None and url.scheme in ("http", "https") and url.hostname in LOCAL_HOSTS
    except ValueError:
        return False


def accepted(key: str, value: Any) -> tuple[bool, Any]:
    """Whether a setting may have the value, and the value that is kept. Unknown settings are refused."""
    if key == "customSummaryTemplates":
        return (True, _templates(value)) if isinstance(value, list) else (False, None)
    if key in CHOICES:
        good = isinstance(value, str) and value in CHOICES[key]
    elif key in SWITCHES:
        good = isinstance(value, bool)
    elif key == "model":
        good = isinstance(value, str) and 0 < len(value) <= MAX_MODEL
    elif key == "maxChunkSize":
        good = isinstance(value, int | float) and not isinstance(value, bool) and value == int(value) and int(value) in CHUNK_SIZES
    else:
        good = key == "ollamaBaseUrl" and _local(value)
    return (True, value) if good else (False, None)


def cleaned(settings: dict[str, Any]) -> dict[str, Any]:
    """The accepted ones of the given settings."""
    checked = {k: accepted(k, v) for k, v in settings.items()}
    return {k: v for k, (good, v) in checked.items() if good}
