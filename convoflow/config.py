"""Settings of a run: one immutable value, changed with dataclasses.replace."""

from __future__ import annotations

import os
from dataclasses import dataclass


#: Fixed value: how far back a reply reaches.
REPLY_WINDOW = 6


def _window(text: str) -> int:
    try:
        return int(text)
    except ValueError:
        return REPLY_WINDOW


@dataclass(frozen=True)
class Settings:
    max_tokens: int = 1000
    cover_tokens: int = 100
    reply_window: int = REPLY_WINDOW
    reply_confidence: float = 0.65
    min_confidence: float | None = 0.8
    max_retries: int = 3
    retry_delay: float = 2.0
    parallelism: int = 8
    wave_chunks: int = 512
    temperature: float = 1.0
    fail_on_parse_error: bool = False
    remap_targets: bool = False

    def __post_init__(self) -> None:
        if self.max_tokens <= self.cover_tokens:
            raise ValueError("max_tokens must be greater than cover_tokens")
        if not 0 <= self.temperature <= 2:
            raise ValueError("temperature must lie in [0, 2]")
        # A window that is no number is the usual one, and none is less than nothing.
        try:
            window = int(self.reply_window)
        except (TypeError, ValueError):
            window = REPLY_WINDOW
        object.__setattr__(self, "reply_window", max(0, window))

    @classmethod
    def from_env(cls, environ=os.environ, prefix: str = "CONVOFLOW_") -> Settings:
        """Fields that the environment names, as their own types; null and unknown names are left alone. A reply window is at least
        1 there, and a threshold lies between 0 and 1."""
        kinds = {"max_tokens": int, "cover_tokens": int, "reply_window": _window, "reply_confidence": float, "min_confidence": float, "max_retries": int, "retry_delay": float, "parallelism": int, "wave_chunks": int, "temperature": float}
        found = {k: kind(environ[prefix + k.upper()]) for k, kind in kinds.items() if environ.get(prefix + k.upper())}
        if "reply_window" in found:
            found["reply_window"] = max(1, found["reply_window"])
        if "reply_confidence" in found:
            found["reply_confidence"] = min(1.0, max(0.0, found["reply_confidence"]))
        for name in ("fail_on_parse_error", "remap_targets"):
            if flag := environ.get(f"{prefix}{name.upper()}"):
                found[name] = flag.strip().lower() in ("1", "true", "yes", "on")
        return cls(**found)

    @classmethod
    def from_file(cls, path: str, environ=os.environ) -> Settings:
        """The same from NAME=value lines; what the environment itself names goes before."""
        with open(path, encoding="utf-8") as found:
            pairs = (line.partition("=") for line in map(str.strip, found) if line and not line.startswith("#") and "=" in line)
            named = {k.strip().removeprefix("export ").strip(): v.strip().strip("'\"") for k, _, v in pairs}
        return cls.from_env({**named, **environ})


#: Chat endpoints by name, with the variables that hold their key and address, and their usual address and model.
PLATFORMS = {
    "deepseek": ("DEEPSEEK_API", "DEEPSEEK_BASE_URL", "https://api.deepseek.com", "deepseek-chat"),
    "siliconflow": ("SILICONFLOW_API_KEY", "SILICONFLOW_BASE_URL", "https://api.siliconflow.cn/v1", "Qwen/Qwen3-30B-A3B-Instruct-2507"),
    "bailian": ("DASHSCOPE_API_KEY", "BAILIAN_BASE_URL", "https://dashscope.aliyuncs.com/compatible-mode/v1", "qwen-plus"),
    "moonshot": ("MOONSHOT_API_KEY", "MOONSHOT_BASE_URL", "https://api.moonshot.cn/v1", "kimi-k2-0905-preview"),
    "openai": ("OPENAI_API_KEY", "OPENAI_BASE_URL", "https://api.openai.com/v1", "gpt-5-mini"),
    "gemini": ("GEMINI_API_KEY", "GEMINI_BASE_URL", "https://generativelanguage.googleapis.com/v1beta/openai/", "gemini-2.0-flash"),
    "aws_bedrock": ("AWS_BEDROCK_API_KEY", "AWS_BEDROCK_BASE_URL", "https://bedrock-runtime.us-west-2.amazonaws.com/openai/v1", "openai.gpt-oss-20b-1:0"),
    "custom": ("CUSTOM_API_KEY", "CUSTOM_BASE_URL", "https://your-custom-endpoint.com/v1", "custom-model"),
}


def platform(name: str, environ=os.environ) -> dict[str, str]:
    """Key, address and model of a named chat endpoint: what the environment says (the model as NAME_MODEL_NAME), else the usual ones.

    A key must be there: without it the error says which variable to set, and which other endpoints have theirs.
    """
    if name not in PLATFORMS:
        raise ValueError(f"unknown platform {name!r}; known: {', '.join(PLATFORMS)}")
    key, base, address, model = PLATFORMS[name]
    if not environ.get(key):
        others = [other for other, (k, *_) in PLATFORMS.items() if environ.get(k)]
        ready = f"or choose one that has its key: {', '.join(others)}" if others else f"or the key of another: {', '.join(k for k, *_ in PLATFORMS.values())}"
        raise ValueError(f"platform {name} has no key: set {key}, {ready}")
    return {"name": name, "api_key": environ[key], "base_url": environ.get(base, address), "model": environ.get(f"{name.upper()}_MODEL_NAME", model)}


#: Beginnings of the names of models that the newer of the two endpoints serves.
RESPONSES_MODELS = ("gpt-5", "o3", "o4", "gpt-4.1", "gpt-4o")


def endpoint(platform_name: str, model: str, base_url: str | None = None) -> str:
    """"responses" where the platform or its address is that of the maker of those models and the name is one of theirs, else "chat"."""
    makers = platform_name.lower() == "openai" or "openai" in (base_url or "").lower()
    return "responses" if makers and any(m in model.lower() for m in RESPONSES_MODELS) else "chat"
