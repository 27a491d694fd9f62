"""The HTTP contract of the store: single keys, ranges and liveness.

``handle`` is a function of method, path, query and body, so it can sit behind any server;
``serve`` runs it on the standard library's.
"""

from __future__ import annotations

import base64
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.functions.bounds import UNBOUNDED, excluded, included
from keystrand.functions.keys import base64_plain
from keystrand.plans.table import KVTable

DEFAULT_LIMIT = 1000


def scan_response(rows: DataFrame) -> DataFrame:
    """One row: the JSON text of a scan, ``{"results": [{"key", "value" in base64}]}``, for the
    bounded rows of one page."""
    item = F.struct("key", base64_plain(F.col("value")).alias("value"))
    return rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("results"))).alias("body"))


def handle(table: KVTable, method: str, target: str, body: bytes = b"") -> tuple[int, bytes]:
    """(status, body) of a request."""
    url = urlsplit(target)
    try:
        if url.path == "/health" and method == "GET":
            return 200, b"ok"
        if url.path == "/kv" and method == "GET":
            query = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}
            try:
                limit = int(query.get("limit", DEFAULT_LIMIT))
            except ValueError:
                return 400, b"bad limit"
            if limit < 0:
                return 400, b"bad limit"
            start = included(query["start"]) if "start" in query else UNBOUNDED
            end = excluded(query["end"]) if "end" in query else UNBOUNDED
            rows = table.scan(start, end, limit).collect()
            return 200, json.dumps({"results": [{"key": r["key"], "value": base64.b64encode(bytes(r["value"])).decode()} for r in rows]}).encode()
        if url.path.startswith("/kv/") and len(url.path) > 4:
            key = unquote(url.path[4:], errors="strict")
            if method == "GET":
                value = table.get(key)
                return (404, b"") if value is None else (200, value)
            if method == "PUT":
                table.put(key, body)
                return 204, b""
            if method == "DELETE":
                table.delete(key)
                return 204, b""
            return 405, b""
        return 404, b""
    except UnicodeDecodeError:
        return 400, b"bad key"
    except Exception as e:  # noqa: BLE001
        return 500, str(e).encode()


def serve(table: KVTable, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for a table; call ``serve_forever`` and ``shutdown`` on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, out = handle(table, self.command, self.path, self.rfile.read(size))
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_PUT = do_DELETE = _reply  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
