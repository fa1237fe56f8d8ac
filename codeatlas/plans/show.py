"""Results as text."""

from __future__ import annotations

import json


def shown(command: str, result: dict) -> str:
    """A result as lines of text."""
    if not result["ok"]:
        return f"{result['error']['code']}: {result['error']['message']}"
    if command == "query":
        lines = [f"route: {result['route']}" + (" (stale)" if result["stale"] else "")]
        for n, hit in enumerate(result["hits"], 1):
            lines.append(f"{n}. {hit['file_path']}:{hit['start_line']}-{hit['end_line']} {hit.get('symbol_name', '')} [{hit['score']:g}] {hit['rationale']}")
        return "\n".join(lines)
    if command in ("symbol", "callers", "callees"):
        side = {"symbol": "", "callers": "caller_", "callees": "callee_"}[command]
        lines = []
        for n, hit in enumerate(result["hits"], 1):
            parent = hit.get(f"{side}parent_symbol_name") or hit.get("parent_symbol_name")
            name = hit[f"{side}symbol_name"]
            lines.append(f"{n}. {f'{parent}.' if parent else ''}{name} ({hit.get(f'{side}kind') or hit.get('kind')}) {hit['file_path']}:{hit['start_line']}-{hit['end_line']}")
        return "\n".join(lines) or "nothing found"
    if command == "doctor":
        return "\n".join([result["summary"], *(f"{'ok ' if c['ok'] else 'NOT'} {c['name']}: {c['details']}" for c in result["checks"])])
    return json.dumps(result, indent=2)
