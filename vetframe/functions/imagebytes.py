"""Image files read as bytes: sizes, EXIF probes and stripping, integrity, difference hashes.

No imaging library is needed.  PNG and BMP pixels are decoded here; JPEG files
are walked marker by marker up to the end of image, and their pixels are read
only where Pillow is installed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

EXIF_HEADS = (b"Exif\0\0", b"Exif\0\xff")
ORIENTATION, GPS_IFD, GPS_LATITUDE, GPS_LONGITUDE = 274, 34853, 2, 4
#: Bytes of decoded rows that a PNG may claim; larger ones count as damaged.
MOST_PIXELS = 1 << 28


class Damaged(ValueError):
    """The file is no whole image."""


def jpeg_segments(data: bytes):
    """(marker, start, end) of each segment before the scan data; start is that of its 0xFF."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Damaged("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD9)):
            yield marker, at, at + 2
            at += 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if size < 2 or at + 2 + size > len(data):
            raise Damaged("truncated segment")
        yield marker, at, at + 2 + size
        at += 2 + size
        if marker == 0xDA:
            return


def size(data: bytes) -> tuple[int, int]:
    """Width and height from the header."""
    if data[:2] == b"\xff\xd8":
        for marker, start, _ in jpeg_segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[start + 5 : start + 9])
                return w, h
        raise Damaged("no frame header")
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*"):
        tags = _ifd(data, 0, *_tiff(data, 0))
        if 256 in tags and 257 in tags:
            return tags[256], tags[257]
    raise Damaged("not an image")


def _tiff(data: bytes, base: int) -> tuple[str, int]:
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if order is None or len(data) < base + 8 or struct.unpack(order + "H", data[base + 2 : base + 4])[0] != 42:
        raise Damaged("no TIFF header")
    return order, struct.unpack(order + "I", data[base + 4 : base + 8])[0]


def _ifd(data: bytes, base: int, order: str, offset: int) -> dict[int, int]:
    """First value of each tag; of tags that hold more than one, where they lie."""
    at = base + offset
    if at + 2 > len(data):
        return {}
    n, out = struct.unpack(order + "H", data[at : at + 2])[0], {}
    for i in range(n):
        e = at + 2 + 12 * i
        if e + 12 > len(data):
            break
        tag, kind, count = struct.unpack(order + "HHI", data[e : e + 8])
        out[tag] = struct.unpack(order + "H", data[e + 8 : e + 10])[0] if kind == 3 and count == 1 else struct.unpack(order + "I", data[e + 8 : e + 12])[0]
    return out


def exif(data: bytes) -> tuple[int | None, bool]:
    """Orientation, and whether a GPS position is there; damaged metadata counts as none."""
    try:
        if data[:2] == b"\xff\xd8":
            block = next((data[s + 10 : e] for m, s, e in jpeg_segments(data) if m == 0xE1 and data[s + 4 : s + 10] in EXIF_HEADS), None)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            block = next((c for kind, c in _chunks(data) if kind == b"eXIf"), None)
        else:
            block = data if data[:4] in (b"II*\0", b"MM\0*") else None
        if not block:
            return None, False
        order, first = _tiff(block, 0)
        tags = _ifd(block, 0, order, first)
        gps = _ifd(block, 0, order, tags[GPS_IFD]) if GPS_IFD in tags else {}
        return tags.get(ORIENTATION), GPS_LATITUDE in gps or GPS_LONGITUDE in gps
    except (Damaged, struct.error):
        return None, False


def strip_exif(data: bytes) -> bytes:
    """The JPEG without its Exif segments; all other bytes stay, and other files are untouched."""
    if data[:2] != b"\xff\xd8":
        return data
    keep, last = [data[:2]], 2
    try:
        for marker, start, end in jpeg_segments(data):
            if not (marker == 0xE1 and data[start + 4 : start + 10] in EXIF_HEADS):
                keep.append(data[start:end])
            last = end
    except (Damaged, struct.error):
        return data
    return b"".join([*keep, data[last:]])


def _chunks(data: bytes):
    at = 8
    while at + 12 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack(">I", data[at + 8 + n : at + 12 + n].ljust(4, b"\0"))[0] != zlib.crc32(kind + body):
            raise Damaged("broken chunk")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise Damaged("truncated file")


def decode_png(data: bytes) -> np.ndarray:
    """Rows x columns x channels of 8-bit samples; interlaced files and other depths are refused."""
    head, packed, palette = None, [], None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise Damaged("no header")
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    if not channels or depth != 8 or interlace or w * h * channels > MOST_PIXELS:
        raise NotImplementedError("PNG variant")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise Damaged("broken pixel data") from e
    stride = w * channels
    if len(raw) < h * (stride + 1):
        raise Damaged("truncated pixel data")
    rows = np.frombuffer(raw[: h * (stride + 1)], np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 0:
            now = line
        elif kind == 1:
            now = (np.cumsum(line.reshape(-1, channels), axis=0) & 255).reshape(-1)
        elif kind == 2:
            now = (line + above) & 255
        elif kind in (3, 4):
            now = line.copy()
            for x in range(stride):
                a = now[x - channels] if x >= channels else 0
                b, c = above[x], above[x - channels] if x >= channels else 0
                if kind == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    da, db, dc = abs(e - a), abs(e - b), abs(e - c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                now[x] = (now[x] + p) & 255
        else:
            raise Damaged("unknown filter")
        out[y], above = now, now
    pixels = out.reshape(h, w, channels)
    if colour == 3:
        if palette is None:
            raise Damaged("no palette")
        pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    return pixels


def decode_bmp(data: bytes) -> np.ndarray:
    start, (w, h, _, depth) = struct.unpack("<I", data[10:14])[0], struct.unpack("<iiHH", data[18:30])
    if depth not in (24, 32):
        raise NotImplementedError("BMP variant")
    stride = (w * depth // 8 + 3) // 4 * 4
    if len(data) < start + stride * abs(h):
        raise Damaged("truncated pixel data")
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1]
    return rows[::-1] if h > 0 else rows


def check(data: bytes) -> str | None:
    """Why the file is no whole image; None if it is one, as far as it can be told here."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            try:
                decode_png(data)
            except NotImplementedError:
                pass
        elif data[:2] == b"BM":
            try:
                decode_bmp(data)
            except NotImplementedError:
                pass
        elif data[:2] == b"\xff\xd8":
            end = 0
            for marker, _, end in jpeg_segments(data):
                last = marker
            if not end or last != 0xDA:
                return "no scan data"
            if data.rfind(b"\xff\xd9", end) < 0:
                return "scan data ends early"
        size(data)
    except (Damaged, struct.error) as e:
        return str(e) or "damaged"
    return None


def lanczos(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Antialiased Lanczos-3 reduction of a grey image, columns first, rounded to bytes after each pass."""

    def weights(n: int, to: int) -> np.ndarray:
        scale = n / to
        reach = 3 * max(scale, 1.0)
        centre = (np.arange(to) + 0.5) * scale
        x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / max(scale, 1.0)
        k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        k[np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) > reach] = 0
        return k / k.sum(1, keepdims=True)

    rounded = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    across = rounded(pixels.astype(np.float64) @ weights(pixels.shape[1], width).T)
    return rounded(weights(pixels.shape[0], height) @ across).astype(np.uint8)


def grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    r, g, b = (pixels[:, :, i].astype(np.int64) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    try:
        import io

        from PIL import Image
    except ImportError as e:
        raise NotImplementedError("no decoder for this format") from e
    with Image.open(io.BytesIO(data)) as im:
        return np.asarray(im.convert("RGB"))


def dhash(data: bytes) -> int | None:
    """64-bit difference hash, as a signed long: is each cell of an 8 x 9 reduction darker than its right neighbour?"""
    try:
        small = lanczos(grey(decode(data)), 9, 8)
    except (Damaged, NotImplementedError, struct.error, ValueError, IndexError):
        return None
    bits = (small[:, 1:] > small[:, :-1]).reshape(-1)
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value
