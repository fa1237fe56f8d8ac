"""Tools over standard input and output: JSON-RPC, one message a line."""

from __future__ import annotations

import json
import signal
import sys
import threading
from typing import Any, TextIO

from codeatlas import __version__
from codeatlas.plans.service import CodeAtlas
from codeatlas.plans.show import shown

PROTOCOL = "2024-11-05"


def _tool(name: str, about: str, field: str, longest: int, most: int, default: int) -> dict[str, Any]:
    return {
        "name": name,
        "description": about,
        "inputSchema": {
            "type": "object",
            "properties": {field: {"type": "string", "minLength": 1, "maxLength": longest}, "limit": {"type": "integer", "minimum": 1, "maximum": most, "default": default}},
            "required": [field],
        },
    }


TOOLS = {
    "search_code": ("query", _tool("search_code", "Search code by text or symbol name", "query", 500, 20, 8)),
    "get_symbol": ("symbol", _tool("get_symbol", "Find where a symbol is defined", "symbol", 200, 20, 10)),
    "find_callers": ("callers", _tool("find_callers", "Find who calls a symbol", "symbol", 200, 50, 20)),
    "find_callees": ("callees", _tool("find_callees", "Find what a symbol calls", "symbol", 200, 50, 20)),
}


def call(atlas: CodeAtlas, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """Run a tool: text for reading, and the whole result as structured content."""
    operation, spec = TOOLS[name]
    field = spec["inputSchema"]["required"][0]
    value = arguments.get(field)
    if not isinstance(value, str):
        raise ValueError(f"{field}: a string is expected")
    limit = arguments.get("limit", spec["inputSchema"]["properties"]["limit"]["default"])
    result = getattr(atlas, operation)(value, limit)
    content = [{"type": "text", "text": shown(operation, result)}]
    return {"content": content, "isError": True} if not result["ok"] else {"content": content, "structuredContent": result}


def answer(atlas: CodeAtlas, message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to a request; none to a notification."""
    method, number = message.get("method"), message.get("id")
    if number is None:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": number}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codeatlas", "version": __version__}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [spec for _, spec in TOOLS.values()]}}
    if method == "tools/call":
        params = message.get("params", {})
        if params.get("name") not in TOOLS:
            return reply | {"error": {"code": -32602, "message": f"no such tool: {params.get('name')}"}}
        try:
            return reply | {"result": call(atlas, params["name"], params.get("arguments", {}))}
        except ValueError as error:
            return reply | {"error": {"code": -32602, "message": str(error)}}
    return reply | {"error": {"code": -32601, "message": f"no such method: {method}"}}


class Stopped(Exception):
    """A signal asked the server to end."""


def _stop(*_: object) -> None:
    raise Stopped


def serve(atlas: CodeAtlas, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answer until the input ends or a signal asks to stop; a line that is no JSON gets a parse error."""
    held = {}
    if threading.current_thread() is threading.main_thread():
        held = {number: signal.signal(number, _stop) for number in (signal.SIGINT, signal.SIGTERM)}
    try:
        _serve(atlas, source, sink)
    except Stopped:
        print("codeatlas has stopped", file=sys.stderr)
    finally:
        for number, handler in held.items():
            signal.signal(number, handler)


def _serve(atlas: CodeAtlas, source: TextIO, sink: TextIO) -> None:
    print("codeatlas is ready", file=sys.stderr)
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            reply: dict[str, Any] | None = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
        else:
            reply = answer(atlas, message)
        if reply is not None:
            sink.write(json.dumps(reply) + "\n")
            sink.flush()
