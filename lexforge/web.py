"""The JSON API over HTTP, by the standard library's server: python -m lexforge web.

Requests run in threads of their own on one Spark session; each is a handful of Spark jobs, and Spark runs jobs of
several threads side by side. GET parameters and POST bodies become the service's dicts.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from lexforge.service import Service

#: Longest body that is read.
MOST_BYTES = 32 << 20


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, payload: dict) -> None:
            data = json.dumps(payload, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Access-Control-Allow-Headers", "*")
            self.end_headers()
            self.wfile.write(data)

        def serve(self, method: str, path: str, body: dict) -> None:
            try:
                self.answer(*service.handle(method, path, body))
            except Exception as e:  # noqa: BLE001  the next request goes on
                self.answer(500, {"detail": str(e).split("\n")[0]})

        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path)
            self.serve("GET", at.path, dict(parse_qsl(at.query)))

        def do_OPTIONS(self) -> None:  # noqa: N802
            self.answer(200, {})

        def do_POST(self) -> None:  # noqa: N802
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                self.close_connection = True
                self.answer(413, {"detail": f"a body has at most {MOST_BYTES} bytes"})
                return
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("the body isn't an object")
            except ValueError as e:
                self.answer(400, {"detail": str(e)})
                return
            self.serve("POST", urlsplit(self.path).path, body)

        def log_message(self, *args) -> None:
            return

    return Handler


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is ready to serve_forever(); port 0 takes a free one."""
    return ThreadingHTTPServer((host, port), handler(service))
