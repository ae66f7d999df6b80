"""A small front end over HTTP and WebSocket for one published dictionary; standard library only.

GET /healthz, /readyz, /metadata; POST /match with ``{"text": ..., "options": ...}`` answers JSON lines; a WebSocket at GET /match
takes the messages of ``sessions.answer``, one session a connection. For bulk work use the DataFrame operators.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from corpuscle.operators.checks import CONTRACT
from corpuscle.operators.matching import BROADCAST_KEYS
from corpuscle.streaming.sessions import Lookup, Session, answer, interrupted

#: Largest request body, or message of a WebSocket in one frame or many; characters searched between two looks at whether to stop.
BODY_LIMIT, PIECE = 32 << 20, 1 << 16
# Fixed value of the WebSocket protocol.
_GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
_TEXT, _CLOSE, _PING, _PONG = 1, 8, 9, 10


class Service(ThreadingHTTPServer):
    """Serves until ``stop``; texts under way are then answered by an interruption."""

    daemon_threads = True

    def __init__(self, known: DataFrame, address: tuple[str, int] = ("127.0.0.1", 0)) -> None:
        rows = known.select("surface_key", "surface_id", "shard_id", "candidates").limit(BROADCAST_KEYS + 1).collect()
        if len(rows) > BROADCAST_KEYS:
            raise ValueError(f"one process serves at most {BROADCAST_KEYS} keys; larger dictionaries take the DataFrame operators")
        self.lookup = Lookup([(r[0], r[1], r[2], [tuple(c) for c in r[3]]) for r in rows])
        qids = {c.qid for r in rows for c in r[3]}
        self.facts = {"surface_normalization": CONTRACT, "surface_count": len(rows), "qid_count": len(qids), "shard_count": len({r[2] for r in rows})}
        self.stopping = threading.Event()
        super().__init__(address, _Handler)

    def stop(self) -> None:
        self.stopping.set()
        self.shutdown()
        self.server_close()


class _Handler(BaseHTTPRequestHandler):
    server: Service
    protocol_version = "HTTP/1.1"

    def log_message(self, *_) -> None:
        pass

    def _say(self, status: int, body: str, kind: str = "text/plain") -> None:
        data = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:
        if self.path == "/match" and self.headers.get("Upgrade", "").lower() == "websocket":
            self._session()
        elif self.path == "/metadata":
            self._say(200, json.dumps(self.server.facts), "application/json")
        elif self.path in ("/healthz", "/readyz"):
            self._say(200, "ok\n" if self.path == "/healthz" else "ready\n")
        else:
            self._say(404, "not found\n")

    def do_POST(self) -> None:
        length = int(self.headers.get("Content-Length") or 0)
        if self.path != "/match" or length > BODY_LIMIT:
            self.close_connection = True
            return self._say(404 if self.path != "/match" else 413, "")
        try:
            asked = json.loads(self.rfile.read(length))
            start = json.dumps({"type": "start", "options": asked.get("options")})
            text = asked["text"]
        except (ValueError, KeyError, AttributeError) as e:
            return self._say(422, f"{e}\n")
        session = Session()
        if wrong := [e for e in answer(session, start, self.server.lookup) if e["type"] == "error"]:
            return self._say(422, f"{wrong[0]['message']}\n")
        if not isinstance(text, str):
            return self._say(422, "text must be a string\n")
        self.send_response(200)
        self.send_header("Content-Type", "application/x-ndjson")
        self.send_header("Transfer-Encoding", "chunked")
        self.end_headers()
        for line in self._lines(session, text):
            # Written as it is found: a client that reads slowly holds the search up, and nothing is kept for it.
            data = f"{line}\n".encode()
            self.wfile.write(b"%x\r\n%s\r\n" % (len(data), data))
        self.wfile.write(b"0\r\n\r\n")

    def _lines(self, session: Session, text: str) -> Iterator[str]:
        for at in range(0, len(text), PIECE):
            if self.server.stopping.is_set():
                yield interrupted("shutdown")
                return
            yield from (json.dumps(e, ensure_ascii=False) for e in session.chunk(text[at : at + PIECE], self.server.lookup) if e["type"] == "match")
        yield json.dumps({"type": "done", "stats": {"matches": session.matches}})

    def _session(self) -> None:
        key = self.headers.get("Sec-WebSocket-Key", "") + _GUID
        self.send_response(101)
        for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", base64.b64encode(hashlib.sha1(key.encode()).digest()).decode())):
            self.send_header(name, value)
        self.end_headers()
        self.close_connection = True
        session, parts = Session(), b""
        while frame := self._frame():
            last, kind, data = frame
            if kind == _CLOSE:
                self._send(_CLOSE, data)
                return
            if kind == _PING:
                self._send(_PONG, data)
            elif kind in (_TEXT, 0):
                parts += data
                if len(parts) > BODY_LIMIT:
                    self._send(_CLOSE, struct.pack(">H", 1009))
                    return
                if not last:
                    continue
                if self.server.stopping.is_set():
                    self._send(_TEXT, interrupted("shutdown").encode())
                    return
                for event in answer(session, parts.decode("utf-8", "replace"), self.server.lookup):
                    self._send(_TEXT, json.dumps(event, ensure_ascii=False).encode())
                parts = b""

    def _frame(self) -> tuple[bool, int, bytes] | None:
        head = self.rfile.read(2)
        if len(head) < 2:
            return None
        length = head[1] & 127
        if length > 125:
            length = struct.unpack(">H" if length == 126 else ">Q", self.rfile.read(2 if length == 126 else 8))[0]
        if length > BODY_LIMIT:
            return None
        mask = self.rfile.read(4) if head[1] & 128 else bytes(4)
        data = self.rfile.read(length)
        return bool(head[0] & 128), head[0] & 15, bytes(b ^ mask[i % 4] for i, b in enumerate(data))

    def _send(self, kind: int, data: bytes) -> None:
        n = len(data)
        size = bytes([n]) if n < 126 else struct.pack(">BH", 126, n) if n < 1 << 16 else struct.pack(">BQ", 127, n)
        self.wfile.write(bytes([128 | kind]) + size + data)
        self.wfile.flush()
