"""Images as rows: read, turned, made smaller, drawn on and cropped on the executors.

PNG is read and written here; any other kind through a ``read`` function of the caller's, from bytes to an array of height x width x 3.
An image that can't be read has no picture but an error; the others go on.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIGN = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from rows that say how they differ from what is left of and above them."""
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y, row in enumerate(rows):
        kind, line = row[0], row[1:]
        if kind == 0:
            above = line
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.uint8)
            padded[:stride] = line
            above = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            above = line + above
        elif kind in (3, 4):
            up, now = [0] * step + above.tolist(), [0] * step + line.tolist()
            for x in range(step, len(now)):
                a, b = now[x - step], up[x]
                if kind == 3:
                    now[x] = (now[x] + (a + b) // 2) & 255
                else:
                    c = up[x - step]
                    by_a, by_b, by_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    now[x] = (now[x] + (a if by_a <= by_b and by_a <= by_c else b if by_b <= by_c else c)) & 255
            above = np.array(now[step:], np.uint8)
        else:
            raise ValueError(f"unknown filter {kind}")
        out[y] = above
    return out


def read_png(data: bytes) -> np.ndarray:
    """Height x width x 3; transparency is left out, 16 bits are cut to 8. Interlaced images are refused."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    parts: dict[bytes, bytes] = {}
    for name, body in _chunks(data):
        parts[name] = parts.get(name, b"") + body
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if interlaced:
        raise ValueError("interlaced")
    channels = _CHANNELS[kind]
    bits = channels * depth
    rows = _unfiltered(zlib.decompress(parts[b"IDAT"]), height, -(-width * bits // 8), max(1, bits // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        single = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        rows = (single << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        if kind == 0:
            rows = rows * np.uint8(255 // (2**depth - 1))
    pixels = rows.reshape(height, width, channels)
    if kind == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3].copy()


def write_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b"")]
    return _SIGN + b"".join(struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b)) for n, b in parts)


def orientation(data: bytes) -> int:
    """The Exif orientation, 1 to 8, of PNG or JPEG bytes; 1 if there is none."""
    exif = b""
    if data[:8] == _SIGN:
        exif = next((body for name, body in _chunks(data) if name == b"eXIf"), b"")
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                exif = data[at + 10 : at + 2 + size]
                break
            at += 2 + size
    if exif[:2] not in (b"II", b"MM"):
        return 1
    end = "<" if exif[:2] == b"II" else ">"
    try:
        first = struct.unpack_from(f"{end}I", exif, 4)[0]
        for i in range(struct.unpack_from(f"{end}H", exif, first)[0]):
            tag, _, _, value = struct.unpack_from(f"{end}HHIH", exif, first + 2 + 12 * i)
            if tag == 0x0112:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """The picture as the Exif orientation means it."""
    if turn >= 5:
        pixels = pixels.swapaxes(0, 1)
    down, across = turn in (3, 4, 7, 8), turn in (2, 3, 6, 7)
    return pixels[:: -1 if down else 1, :: -1 if across else 1]


def _resampled(pixels: np.ndarray, size: int) -> np.ndarray:
    """``size`` rows from all rows by Lanczos weights over three lobes, widened when rows get fewer."""
    scale = len(pixels) / size
    wide = max(scale, 1.0)
    middle = (np.arange(size) + 0.5) * scale
    first = np.floor(middle - 3 * wide).astype(int)
    out, total = np.zeros((size, *pixels.shape[1:]), np.float32), np.zeros(size, np.float32)
    for tap in range(int(np.ceil(6 * wide)) + 2):
        at = first + tap
        x = (at + 0.5 - middle) / wide
        weight = np.where((np.abs(x) < 3) & (at >= 0) & (at < len(pixels)), np.sinc(x) * np.sinc(x / 3), 0).astype(np.float32)
        total += weight
        out += weight[:, None, None] * pixels[at.clip(0, len(pixels) - 1)]
    return out / total[:, None, None]


def fitted(pixels: np.ndarray, most: int) -> np.ndarray:
    """No side longer than ``most``, in the same proportions; smaller pictures are as they were."""
    height, width = pixels.shape[:2]
    if max(height, width) <= most:
        return pixels
    scale = most / max(height, width)
    height, width = max(1, round(height * scale)), max(1, round(width * scale))
    small = _resampled(_resampled(pixels.astype(np.float32), height).swapaxes(0, 1), width).swapaxes(0, 1)
    return np.rint(small).clip(0, 255).astype(np.uint8)


def loaded(files: DataFrame, most: int = 2048, read: Callable[[bytes], np.ndarray] = read_png) -> DataFrame:
    """(path, width, height, image as base64 PNG, error) of ``files(path, content)``: upright, and no side over ``most``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    pixels = fitted(upright(read(bytes(content)), orientation(bytes(content))), most)
                    rows.append((path, pixels.shape[1], pixels.shape[0], base64.b64encode(write_png(pixels)).decode(), None))
                except Exception as wrong:  # one damaged file doesn't end the job
                    rows.append((path, None, None, None, f"{type(wrong).__name__}: {wrong}"))
            made = pd.DataFrame(rows, columns=["path", "width", "height", "image", "error"])
            yield made.astype({"width": "Int64", "height": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, width long, height long, image string, error string")


def colour(label: str) -> np.ndarray:
    """From 50 to 254 in each channel, the same for a label everywhere."""
    h = zlib.crc32(label.encode())
    return np.array([50 + (h >> s & 1023) % 205 for s in (0, 10, 20)], np.uint8)


def with_boxes(pixels: np.ndarray, boxes: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """Outlines, 5 wide for titles and 3 for others, and a faint filling; labels are told by colour, as no typeface is at hand. Corners belong to a box."""
    out = pixels.copy()
    for label, x1, y1, x2, y2 in boxes:
        if x2 < x1 or y2 < y1:
            continue
        left, top = max(x1, 0), max(y1, 0)
        area = out[top : max(y2 + 1, 0), left : max(x2 + 1, 0)]
        y, x = np.arange(top, top + area.shape[0])[:, None], np.arange(left, left + area.shape[1])[None, :]
        wide = 5 if label == "title" else 3
        edge = (y < y1 + wide) | (y > y2 - wide) | (x < x1 + wide) | (x > x2 - wide)
        faint = (area.astype(np.uint16) * 195 + colour(label).astype(np.uint16) * 60 + 127) // 255
        area[:] = np.where(edge[:, :, None], colour(label), faint.astype(np.uint8))
    return out


def crop(pixels: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray | None:
    """What the box holds, its last row and column not included, black beyond the picture; none for an empty box."""
    if x2 <= x1 or y2 <= y1:
        return None
    out = np.zeros((y2 - y1, x2 - x1, 3), np.uint8)
    part = pixels[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
    top, left = max(-y1, 0), max(-x1, 0)
    out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


def _with_elements(pages: DataFrame, elements: DataFrame, by: list[str]) -> DataFrame:
    """Pages, each once, with the boxes on them in order."""
    boxes = elements.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("seq", "label", "x1", "y1", "x2", "y2"))).alias("boxes"))
    return pages.select(*by, "content").join(boxes, by, "left")


def _kinds(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)


def drawn(pages: DataFrame, elements: DataFrame, by: list[str], read: Callable[[bytes], np.ndarray] = read_png) -> DataFrame:
    """``pages(content)`` with image: base64 PNG with the boxes of ``elements(seq, label, x1, y1, x2, y2)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for content, boxes in zip(batch["content"], batch["boxes"]):
                found = [] if boxes is None else [(b["label"] or "", b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes if None not in (b["x1"], b["y1"], b["x2"], b["y2"])]
                made.append(None if content is None else base64.b64encode(write_png(with_boxes(read(bytes(content)), found))).decode())
            yield batch[by].assign(image=made)

    return _with_elements(pages, elements, by).mapInPandas(run, f"{_kinds(pages, by)}, image string")


def crops(pages: DataFrame, elements: DataFrame, by: list[str], read: Callable[[bytes], np.ndarray] = read_png) -> DataFrame:
    """(seq, crop_image as base64 PNG) of the elements that are labelled image, in any case; null for an empty box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                if row["content"] is None:
                    continue
                pixels = read(bytes(row["content"]))
                made = []
                for b in row["boxes"]:
                    corners = (b["x1"], b["y1"], b["x2"], b["y2"])
                    part = None if None in corners else crop(pixels, *corners)
                    made.append((*(row[c] for c in by), b["seq"], None if part is None else base64.b64encode(write_png(part)).decode()))
                yield pd.DataFrame(made, columns=[*by, "seq", "crop_image"])

    wanted = elements.where(F.lower("label") == "image")
    return _with_elements(pages, wanted, by).where("boxes is not null").mapInPandas(run, f"{_kinds(pages, by)}, seq long, crop_image string")
