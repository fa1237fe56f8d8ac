"""Requests, signals, the command line and a remote provider."""

import http.server
import io
import json
import os
import signal
import threading

import pytest

from codeatlas import __version__
from codeatlas.__main__ import main
from codeatlas.packaging import ship
from codeatlas.plans import providers, server
from codeatlas.sources.config import InvalidInput, check_request, parse_config


def test_requests():
    whole = check_request({"repoRoot": "/r", "intent": "hybrid-search", "query": "  two words "})
    assert whole == {"repoRoot": "/r", "intent": "hybrid-search", "query": "two words", "limit": 8, "stalePolicy": "warn"}
    assert check_request({"repoRoot": "/r", "intent": "find-callers", "symbolName": "f", "limit": 20})["symbolName"] == "f"
    wrong = [{"intent": "find-callers", "query": "ab"}, {"intent": "hybrid-search", "symbolName": "ab"}, {"intent": "other", "query": "ab"}, {"intent": "hybrid-search", "query": "a"}]
    wrong += [{"intent": "hybrid-search", "query": "ab", "limit": 21}, {"intent": "hybrid-search", "query": "ab", "stalePolicy": "no"}, {"intent": "symbol-lookup", "symbolName": " "}]
    for request in wrong:
        with pytest.raises(InvalidInput):
            check_request({"repoRoot": "/r"} | request)
    with pytest.raises(InvalidInput):
        check_request({"repoRoot": "", "intent": "hybrid-search", "query": "ab"})


def test_version(capsys):
    assert main(["version"]) == 0 and capsys.readouterr().out.strip() == __version__


def test_signals_end_the_server(capsys):
    class Endless(io.StringIO):
        def __iter__(self):
            yield json.dumps({"jsonrpc": "2.0", "id": 1, "method": "ping"})
            os.kill(os.getpid(), signal.SIGTERM)
            while True:
                yield ""

    before, sink = signal.getsignal(signal.SIGTERM), io.StringIO()
    server.serve(None, Endless(), sink)
    assert json.loads(sink.getvalue()) == {"jsonrpc": "2.0", "id": 1, "result": {}}
    assert signal.getsignal(signal.SIGTERM) == before and "stopped" in capsys.readouterr().err


def test_remote_provider(spark, monkeypatch):
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
            assert self.headers["authorization"] == "Bearer k" and asked["model"] == "m" and asked["dimensions"] == 2
            data = [{"index": n, "embedding": [float(len(x)), 1.0]} for n, x in enumerate(asked["input"]) if x][::-1]
            body = json.dumps({"data": data}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    service = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    config = parse_config({"embeddings": {"enabled": True, "provider": "openai", "model": "m", "dimensions": 2}})
    monkeypatch.delenv(providers.KEY_VARIABLE, raising=False)
    assert providers.resolve_provider(config) is None
    monkeypatch.setenv(providers.KEY_VARIABLE, " k ")  # workers have theirs from the session's start
    monkeypatch.setattr(providers, "ENDPOINT", f"http://127.0.0.1:{service.server_port}/")
    provider = providers.resolve_provider(config)
    ship(spark)
    rows = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(200)], "n long, text string").select("n", provider.embed("text").alias("v")).collect()
    assert all(r.v == ([float(r.n % 7), 1.0] if r.n % 7 else []) for r in rows) and len(rows) == 200
    service.shutdown()
