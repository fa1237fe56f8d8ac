"""Configuration of an index: defaults, merging, validation, and query input checks."""

from __future__ import annotations

import copy
import json
import os
from typing import Any

from codeatlas.sources.tree import DEFAULT_EXCLUDE, DEFAULT_INCLUDE, INDEX_FOLDER

#: The defaults, and patterns of older configurations with what replaces them.
DEFAULTS: dict[str, Any] = {
    "projectRoot": ".",
    "include": list(DEFAULT_INCLUDE),
    "exclude": list(DEFAULT_EXCLUDE),
    "languageParsers": {"typescript": True, "javascript": True},
    "chunking": {"strategy": "symbol", "maxLines": 120, "maxTokens": 800},
    "embeddings": {"enabled": False, "provider": "openai", "model": "text-embedding-3-small", "dimensions": 1536},
    "retrieval": {"topK": 8, "graphExpansionDepth": 1},
    "mcp": {"transport": "stdio"},
    "git": {"installHooks": False, "autoIndexOnQuery": True},
}
OLD_INCLUDE = ["src/**/*.ts", "src/**/*.tsx", "src/**/*.js", "src/**/*.jsx"]
_SECTIONS = ("languageParsers", "chunking", "embeddings", "retrieval", "mcp", "git")


class InvalidInput(ValueError):
    """An input or configuration that breaks a rule; its text says which."""


def _unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(values))


def parse_config(raw: Any) -> dict[str, Any]:
    """Defaults overlaid with ``raw``, checked, with old patterns rewritten."""
    given = raw if isinstance(raw, dict) else {}
    merged = copy.deepcopy(DEFAULTS) | {k: v for k, v in given.items() if k in DEFAULTS and k not in (*_SECTIONS, "include", "exclude")}
    for section in _SECTIONS:
        value = given.get(section, {})
        if not isinstance(value, dict):
            raise InvalidInput(f"{section}: an object is expected")
        merged[section] = merged[section] | value
    if isinstance(given.get("include"), list):
        merged["include"] = list(given["include"])
    merged["exclude"] = _unique([*DEFAULTS["exclude"], *(given["exclude"] if isinstance(given.get("exclude"), list) else [])])
    _check(merged)
    if merged["include"] == OLD_INCLUDE:
        merged["include"] = list(DEFAULT_INCLUDE)
    anchored = {p.removeprefix("**/"): p for p in DEFAULT_EXCLUDE}
    merged["exclude"] = _unique([anchored.get(p, p) for p in merged["exclude"]])
    return merged


def _check(config: dict[str, Any]) -> None:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise InvalidInput(what)

    whole = lambda x, lo: isinstance(x, int) and not isinstance(x, bool) and x >= lo
    need(isinstance(config["projectRoot"], str), "projectRoot: a string is expected")
    for name in ("include", "exclude"):
        need(all(isinstance(p, str) for p in config[name]), f"{name}: strings are expected")
    for name in ("maxLines", "maxTokens"):
        need(whole(config["chunking"][name], 1), f"chunking.{name}: a positive integer is expected")
    need(whole(config["embeddings"]["dimensions"], 1), "embeddings.dimensions: a positive integer is expected")
    need(isinstance(config["embeddings"]["enabled"], bool), "embeddings.enabled: a boolean is expected")
    need(whole(config["retrieval"]["topK"], 1), "retrieval.topK: a positive integer is expected")
    need(whole(config["retrieval"]["graphExpansionDepth"], 0) and config["retrieval"]["graphExpansionDepth"] <= 3, "retrieval.graphExpansionDepth: 0 to 3 is expected")


def config_path(root: str) -> str:
    return os.path.join(root, INDEX_FOLDER, "config.json")


def load_config(root: str) -> dict[str, Any]:
    path = config_path(root)
    if not os.path.exists(path):
        return parse_config({})
    with open(path, encoding="utf-8") as file:
        return parse_config(json.load(file))


def save_config(root: str, config: dict[str, Any]) -> str:
    path = config_path(root)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(config, file, indent=2)
        file.write("\n")
    return path


def find_root(start: str) -> str:
    """Root of the repository around a folder.

    The nearest folder with ``.git``; else the highest one with an index; else the highest
    one with a ``package.json``; else the folder itself.
    """
    indexed = packaged = None
    at = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        if os.path.isdir(os.path.join(at, INDEX_FOLDER)):
            indexed = at
        if os.path.exists(os.path.join(at, "package.json")):
            packaged = at
        parent = os.path.dirname(at)
        if parent == at:
            return indexed or packaged or os.path.abspath(start)
        at = parent


def check_query(query: str, limit: int = 8) -> tuple[str, int]:
    """A query of 2 to 500 characters and a limit of 1 to 20."""
    query = query.strip()
    if not 2 <= len(query) <= 500:
        raise InvalidInput("query: 2 to 500 characters are expected")
    return query, check_limit(limit, 20)


def check_limit(limit: int, most: int) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= most:
        raise InvalidInput(f"limit: an integer from 1 to {most} is expected")
    return limit


#: What a request may be for and the text that it must hold then, and how it may treat a stale index.
INTENTS = {"hybrid-search": "query", "symbol-lookup": "symbolName", "find-callers": "symbolName"}
STALE_POLICIES = ("fail", "warn", "auto-index-light")


def check_request(request: dict[str, Any]) -> dict[str, Any]:
    """A request with its texts trimmed, its limit and policy filled in, and its intent's text there."""
    root, intent, policy = request.get("repoRoot"), request.get("intent"), request.get("stalePolicy", "warn")
    if not isinstance(root, str) or not root:
        raise InvalidInput("repoRoot: a path is expected")
    if intent not in INTENTS:
        raise InvalidInput(f"intent: one of {', '.join(INTENTS)} is expected")
    if policy not in STALE_POLICIES:
        raise InvalidInput(f"stalePolicy: one of {', '.join(STALE_POLICIES)} is expected")
    out = {"repoRoot": root, "intent": intent, "stalePolicy": policy, "limit": check_limit(request.get("limit", 8), 20)}
    for field, (least, most) in {"query": (2, 500), "symbolName": (1, 200)}.items():
        text = request.get(field)
        if text is not None:
            if not isinstance(text, str) or not least <= len(text.strip()) <= most:
                raise InvalidInput(f"{field}: {least} to {most} characters are expected")
            out[field] = text.strip()
    if INTENTS[intent] not in out:
        raise InvalidInput(f"{INTENTS[intent]}: {intent} needs it")
    return out
