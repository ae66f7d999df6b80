import base64
import json
import os
import socket
import struct
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import dictionary
from corpuscle.streaming import service as service_module
from corpuscle.streaming.service import Service


@pytest.fixture(scope="module")
def service(spark):
    keys = spark.createDataFrame([("北京", [956]), ("大学", [3918])], "surface_key string, qids array<long>").withColumn("qid_count", F.size("qids"))
    known = dictionary.attach_flags(dictionary.with_surface_ids(keys), spark.createDataFrame([(956, 1)], "qid long, flags int"))
    made = Service(known)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.stop()


def call(service, path, body=None):
    url = f"http://127.0.0.1:{service.server_address[1]}{path}"
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data)) as r:
        return r.read().decode()


def test_http(service):
    assert call(service, "/healthz") == "ok\n" and call(service, "/readyz") == "ready\n"
    assert json.loads(call(service, "/metadata"))["surface_count"] == 2
    lines = [json.loads(x) for x in call(service, "/match", {"text": "北京大学"}).splitlines()]
    assert [x["type"] for x in lines] == ["match", "match", "done"] and lines[-1]["stats"]["matches"] == 2
    lines = call(service, "/match", {"text": "北京", "options": {"include_disambiguation": False}}).splitlines()
    assert [json.loads(x)["type"] for x in lines] == ["done"]
    for path, body, code in (("/match", {}, 422), ("/match", {"text": 1}, 422), ("/other", None, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            call(service, path, body)
        assert e.value.code == code


def test_a_long_text_is_answered_piece_by_piece(service, monkeypatch):
    monkeypatch.setattr(service_module, "PIECE", 7)
    lines = [json.loads(x) for x in call(service, "/match", {"text": "在北京大学。" * 50}).splitlines()]
    assert len(lines) == 101 and lines[-1]["stats"]["matches"] == 100
    assert [x["match"]["start"] for x in lines[:4]] == [1, 3, 7, 9]


def frame(kind, data):
    mask = os.urandom(4)
    size = bytes([128 | len(data)]) if len(data) < 126 else struct.pack(">BH", 254, len(data))
    return bytes([128 | kind]) + size + mask + bytes(b ^ mask[i % 4] for i, b in enumerate(data))


def test_websocket(service):
    with socket.create_connection(service.server_address) as s:
        s.sendall(f"GET /match HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {base64.b64encode(bytes(16)).decode()}\r\n\r\n".encode())
        reader = s.makefile("rb")
        assert b"101" in reader.readline()
        while reader.readline().strip():
            pass

        def get():
            head = reader.read(2)
            n = head[1] if head[1] < 126 else struct.unpack(">H", reader.read(2))[0]
            return head[0] & 15, reader.read(n)

        s.sendall(frame(9, b"hi"))
        assert get() == (10, b"hi")
        for message, kinds in (('{"type":"start"}', ["started"]), ('{"type":"chunk","text":"在北"}', ["ack"]), ('{"type":"chunk","text":"京"}', ["match", "ack"]), ("x" * 200, ["error"]), ('{"type":"end"}', ["done"])):
            s.sendall(frame(1, message.encode()))
            assert [json.loads(get()[1])["type"] for _ in kinds] == kinds
        s.sendall(frame(8, b""))
        assert get()[0] == 8


def test_fragments_add_up(service, monkeypatch):
    monkeypatch.setattr(service_module, "BODY_LIMIT", 100)
    with socket.create_connection(service.server_address) as s:
        s.sendall(f"GET /match HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {base64.b64encode(bytes(16)).decode()}\r\n\r\n".encode())
        reader = s.makefile("rb")
        while reader.readline().strip():
            pass
        for _ in range(3):
            part = frame(1, b"x" * 60)
            s.sendall(bytes([part[0] & 127]) + part[1:])
        assert reader.read(4) == bytes([136, 2]) + struct.pack(">H", 1009)
