"""A small HTTP front for the verbs: JSON in and out, an optional token gate, counters for scraping."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from placebook.geocoder import Geocoder

OPEN = ("/health", "/healthz", "/readyz", "/metrics")
SECRET = "PLACEBOOK_JWT_SECRET"


def _b64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def token_holds(token: str, secret: str, now: float | None = None) -> bool:
    """True for an HS256 token with the secret's signature and an expiry to come."""
    try:
        head, body, signature = token.split(".")
        claims = json.loads(_b64(body))
        good = hmac.new(secret.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest()
        return json.loads(_b64(head))["alg"] == "HS256" and hmac.compare_digest(good, _b64(signature)) and float(claims["exp"]) >= (now if now is not None else time.time()) and "sub" in claims
    except (ValueError, KeyError, TypeError):
        return False


class Service:
    """Answers of the endpoints as (status, content type, body)."""

    def __init__(self, geocoder: Geocoder, secret: str | None = None):
        self.geocoder, self.secret = geocoder, secret
        self.counts: Counter = Counter()
        self.lock = threading.Lock()

    def allowed(self, path: str, authorization: str | None) -> bool:
        if self.secret is None or path in OPEN:
            return True
        return bool(authorization and authorization.startswith("Bearer ") and token_holds(authorization[7:], self.secret))

    def _counted(self, verb: str) -> None:
        with self.lock:
            self.counts[verb] += 1

    def answer(self, method: str, url: str, body: bytes = b"") -> tuple[int, str, str]:
        parts = urlsplit(url)
        q = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
        try:
            return self._answer(method, parts.path, q, body)
        except (KeyError, ValueError, TypeError) as bad:
            return 400, "text/plain", f"bad request: {bad}"

    def _answer(self, method: str, path: str, q: dict, body: bytes) -> tuple[int, str, str]:
        told = lambda results: (200, "application/json", json.dumps({"results": results}))
        if method == "GET" and path == "/forward":
            text = q["q"]
            self._counted("forward")
            return told(self.geocoder.forward(text))
        if method == "GET" and path == "/reverse":
            place, limit = (float(q["lon"]), float(q["lat"])), int(q.get("limit", 5))
            self._counted("reverse")
            return told(self.geocoder.reverse(*place, limit))
        if method == "GET" and path == "/autocomplete":
            text, limit, bias = q["q"], int(q.get("limit", 5)), {k: float(q[k]) for k in ("lon", "lat") if k in q}
            self._counted("autocomplete")
            return told(self.geocoder.autocomplete(text, limit, **bias))
        if method == "POST" and path == "/batch":
            texts = list(json.loads(body)["queries"])
            self._counted("batch")
            return told(self.geocoder.batch(texts))
        if method == "GET" and path == "/health":
            return 200, "application/json", json.dumps({"status": "ok", "records": len(self.geocoder)})
        if method == "GET" and path == "/healthz":
            return 200, "text/plain", "ok"
        if method == "GET" and path == "/readyz":
            return (200, "text/plain", "ready") if not self.geocoder.records.isEmpty() else (503, "text/plain", "not ready")
        if method == "GET" and path == "/metrics":
            rows = [f'placebook_{verb}_total {n}' for verb, n in sorted(self.counts.items())]
            return 200, "text/plain; version=0.0.4", "".join(f"# TYPE {r.split()[0]} counter\n{r}\n" for r in rows)
        return 404, "text/plain", "not found"


def server(geocoder: Geocoder, bind: str = "127.0.0.1:3000") -> ThreadingHTTPServer:
    service = Service(geocoder, os.environ.get(SECRET))
    host, port = bind.rsplit(":", 1)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, kind: str, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            for k, v in (("Content-Type", kind), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Methods", "*"), ("Access-Control-Allow-Headers", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def _run(self) -> None:
            if not service.allowed(urlsplit(self.path).path, self.headers.get("Authorization")):
                return self._send(401, "text/plain", "unauthorized")
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            return self._send(*service.answer(self.command, self.path, body))

        do_GET = do_POST = _run

        def do_OPTIONS(self) -> None:
            self._send(200, "text/plain", "")

    return ThreadingHTTPServer((host, int(port)), Handler)


def serve(geocoder: Geocoder, bind: str) -> None:
    server(geocoder, bind).serve_forever()
