"""Contents found in pages, and images, by small cases with known results."""

import base64
import json
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import enrich, store
from quire.plans import contents
from quire.sources import files, images

BY = ["document_id"]


def _book(shift=3, wrong=None, numbers=True):
    """Pages of a book whose printed page n is page n + ``shift``; page 2 has the contents."""
    titles = [("1", "Sea", 1), ("1.1", "Deep Water", 2), ("1.2", "Shallow Water", 4), ("2", "Land", 6), ("2.1", "Hills", 7)]
    lines = [f"{c} {t} {'.' * 8} {wrong if wrong is not None and t == 'Hills' else p}" if numbers else f"{c} {t}" for c, t, p in titles]
    pages = {1: "A Book", 2: "\n".join(["Contents", *lines]), 3: "To the reader"}
    pages |= {n: "words that say nothing" for n in range(4, 12)}
    for c, t, p in titles:
        pages[p + 3] = f"{c}. {t.upper() if t == 'Land' else t}\nand what follows"
    return sorted(pages.items())


def _tree(spark, books, steps=contents.Steps()):
    rows = [(d, n, t, "x") for d, book in books.items() for n, t in book]
    nodes, outcome = contents.contents_tree(spark.createDataFrame(rows, "document_id string, page_number int, text string, title string"), BY, steps)
    found = {}
    for r in nodes.orderBy("document_id", "idx").collect():
        found.setdefault(r["document_id"], []).append((r["structure"], r["title"], r["start_index"], r["end_index"], r["parent_idx"]))
    return found, {r["document_id"]: (r["mode"], r["accuracy"]) for r in outcome.collect()}


WHOLE = [("0", "Preface", 1, 3, None), ("1", "Sea", 4, 4, None), ("1.1", "Deep Water", 5, 6, 0), ("1.2", "Shallow Water", 7, 8, 0), ("2", "Land", 9, 9, None), ("2.1", "Hills", 10, 11, 3)]


def test_contents_with_pages(spark):
    found, outcome = _tree(spark, {"right": _book(), "wrong": _book(wrong=5), "none": [(1, "just words"), (2, None)], "empty": [(1, "")]})
    assert found["right"] == WHOLE and outcome["right"] == ("page_numbers", 1.0)
    assert found["wrong"] == WHOLE and outcome["wrong"] == ("page_numbers", 0.8)  # one of five wrong, and mended
    assert set(found) == {"right", "wrong"}
    assert outcome["none"] == (None, None) == outcome["empty"]


def test_contents_without_pages(spark):
    steps = contents.Steps(is_contents=lambda text: F.startswith(text, F.lit("Contents")))
    found, outcome = _tree(spark, {"titles": _book(numbers=False), "late": [(n + 20, t) for n, t in _book(numbers=False)]}, steps)
    assert found == {"titles": WHOLE} and outcome == {"titles": ("titles", 1.0), "late": (None, None)}


def test_pages_far_off_are_not_trusted(spark):
    """Printed pages that fit no one distance: titles decide."""
    book = dict(_book())
    book[2] = "Contents\n1 Sea ..... 1\n1.1 Deep Water ..... 7\n1.2 Shallow Water ..... 1\n2 Land ..... 2\n2.1 Hills ..... 3"
    found, outcome = _tree(spark, {"d": sorted(book.items())})
    assert outcome["d"] == ("titles", 1.0) and found["d"] == WHOLE


def test_contents_of_nothing(spark):
    nodes, outcome = contents.contents_tree(spark.createDataFrame([], "document_id string, page_number int, text string"), BY)
    assert nodes.count() == 0 == outcome.count()


def _png(pixels, kind=2, depth=8, filters=None, extra=b"", interlaced=0):
    """A PNG whose row y is filtered by ``filters[y]``, made byte by byte."""
    height, width, channels = pixels.shape
    rows = pixels.reshape(height, width * channels).astype(int)
    raw = bytearray()
    for y in range(height):
        f = filters[y] if filters else 0
        raw.append(f)
        for x in range(width * channels):
            a = rows[y, x - channels] if x >= channels else 0
            b = rows[y - 1, x] if y else 0
            c = rows[y - 1, x - channels] if y and x >= channels else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            raw.append(int(rows[y, x] - (0, a, b, (a + b) // 2, paeth)[f]) % 256)
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlaced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


PICTURE = np.random.default_rng(5).integers(0, 256, (10, 7, 3)).astype(np.uint8)


def test_png():
    assert (images.read_png(images.write_png(PICTURE)) == PICTURE).all()
    assert (images.read_png(_png(PICTURE, filters=[0, 1, 2, 3, 4, 4, 3, 2, 1, 0])) == PICTURE).all()
    see = np.concatenate([PICTURE, PICTURE[:, :, :1]], axis=2)
    assert (images.read_png(_png(see, 6, filters=[4, 3, 1, 2, 4, 3, 4, 4, 1, 3])) == PICTURE).all()
    grey = PICTURE[:, :, :1]
    assert (images.read_png(_png(grey, 0, filters=[4] * 10)) == np.repeat(grey, 3, 2)).all()
    palette = bytes([9, 8, 7, 1, 2, 3])
    plte = struct.pack(">I", 6) + b"PLTE" + palette + struct.pack(">I", zlib.crc32(b"PLTE" + palette))
    assert images.read_png(_png(np.array([[[1], [0]]]), 3, extra=plte)).tolist() == [[[1, 2, 3], [9, 8, 7]]]
    bits = b"\x89PNG\r\n\x1a\n" + _png(np.array([[[0b10100000]]]), 0)[8:]
    one = bits.replace(struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0), struct.pack(">IIBBBBB", 3, 1, 1, 0, 0, 0, 0))
    assert images.read_png(one)[0, :, 0].tolist() == [255, 0, 255]
    with pytest.raises(ValueError):
        images.read_png(_png(PICTURE, interlaced=1))


def test_turned():
    a = np.arange(6).reshape(2, 3, 1)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert {t: images.upright(a, t)[:, :, 0].tolist() for t in want} == want


def test_loaded(spark):
    exif = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    mark = struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif))
    flat = np.full((300, 100, 3), 77, np.uint8)
    rows = spark.createDataFrame([("a", images.write_png(flat)), ("b", _png(PICTURE, extra=mark)), ("c", b"junk"), ("d", None)], "path string, content binary")
    out = {r["path"]: r for r in images.loaded(rows, 60).collect()}
    assert (out["a"]["width"], out["a"]["height"]) == (20, 60) and (images.read_png(base64.b64decode(out["a"]["image"])) == 77).all()
    assert (images.read_png(base64.b64decode(out["b"]["image"])) == np.rot90(PICTURE, -1)).all() and out["b"]["width"] == 10
    assert out["c"]["image"] is None and "PNG" in out["c"]["error"] and out["d"]["error"]
    assert files._size(base64.b64decode(out["a"]["image"])) == (20, 60)


def test_made_smaller():
    ramp = np.repeat(np.repeat(np.arange(0, 240, dtype=np.uint8)[None, :, None], 120, 0), 3, 2)
    small = images.fitted(ramp, 60)
    assert small.shape == (30, 60, 3)
    assert np.abs(small[5, 3:-3, 0].astype(float) - (np.arange(60) * 4 + 1.5)[3:-3]).max() <= 1  # a slope stays a slope
    assert images.fitted(ramp, 240) is ramp


def test_boxes_drawn_and_cropped(spark):
    page = np.full((40, 50, 3), 200, np.uint8)
    pages = spark.createDataFrame([("d", 1, images.write_png(page)), ("d", 2, images.write_png(PICTURE))], "document_id string, page_number int, content binary")
    rows = [("d", 1, 0, "title", 10, 10, 30, 30), ("d", 1, 1, "text", 32, 2, 60, 20), ("d", 2, 0, "Image", 2, 3, 5, 8), ("d", 2, 1, "image", -1, -1, 2, 2), ("d", 2, 2, "image", 4, 4, 4, 9), ("d", 2, 3, "text", 0, 0, 3, 3), ("d", 3, 0, "image", 0, 0, 1, 1)]
    elements = spark.createDataFrame(rows, "document_id string, page_number int, seq int, label string, x1 int, y1 int, x2 int, y2 int")
    by = ["document_id", "page_number"]
    got = {r["page_number"]: images.read_png(base64.b64decode(r["image"])) for r in images.drawn(pages, elements, by).collect()}
    title, faint = images.colour("title").tolist(), [(200 * 195 + int(c) * 60 + 127) // 255 for c in images.colour("title")]
    assert [got[1][20, x].tolist() for x in (9, 10, 14, 15, 25, 26, 30, 31)] == [[200] * 3, title, title, faint, faint, title, title, [200] * 3]
    assert got[1][2, 49].tolist() == images.colour("text").tolist() and got[1].shape == page.shape
    parts = {(r["page_number"], r["seq"]): r["crop_image"] for r in images.crops(pages, elements, by).collect()}
    assert set(parts) == {(2, 0), (2, 1), (2, 2)} and parts[2, 2] is None
    assert (images.read_png(base64.b64decode(parts[2, 0])) == PICTURE[3:8, 2:5]).all()
    beyond = images.read_png(base64.b64decode(parts[2, 1]))
    assert (beyond[1:, 1:] == PICTURE[:2, :2]).all() and not beyond[0].any() and not beyond[:, 0].any()


def test_clients():
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body, self.headers.get("Authorization")))
            text = body["messages"][-1]["content"].upper()
            out = {"choices": [{"message": {"content": text}, "finish_reason": "length"}]} if "completions" in self.path else {"message": {"content": text}, "done_reason": "stop"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        one = enrich.client("openai", model="m", key="k", base_url=f"{url}/v1")
        assert one.chat("hello") == "HELLO" and one.answer("a", [{"role": "user", "content": "b"}]) == ("A", False)
        assert enrich.client("ollama", base_url=url).answer("hi") == ("HI", True)
    finally:
        server.shutdown()
    assert [(p, a) for p, _, a in asked] == [("/v1/chat/completions", "Bearer k")] * 2 + [("/api/chat", None)]
    assert asked[1][1]["messages"][0]["content"] == "b" and asked[2][1]["stream"] is False
    with pytest.raises(ValueError):
        enrich.client("nobody")


def test_tables_taken_away(spark, tmp_path):
    there = store.Store(spark, str(tmp_path))
    there.create()
    there.drop()
    assert not any((tmp_path / name).exists() for name in store.TABLES)
    there.create()
    assert there.read("documents").count() == 0
