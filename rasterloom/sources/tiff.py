"""TIFF: uncompressed or deflated strips of greys, colours and palettes, 8 or 16 bits, all pages."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from rasterloom.sources.codecs import ImageError, Limits, Picture, _need

WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    """A directory's entries and where the next one stands."""
    (count,) = struct.unpack_from(order + "H", _need(data, at, 2))
    out: dict[int, list] = {}
    for k in range(count):
        tag, kind, n, _ = struct.unpack_from(order + "HHII", _need(data, at + 2 + 12 * k, 12))
        size = WIDTHS.get(kind, 0) * n
        if not size:
            continue
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        raw = _need(data, place, size)
        if kind in (2, 7):
            out[tag] = [raw]
        elif kind in (5, 10):
            v = struct.unpack(order + f"{2 * n}{'I' if kind == 5 else 'i'}", raw)
            out[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
        else:
            out[tag] = list(struct.unpack(order + f"{n}{LETTERS[kind]}", raw))
    return out, struct.unpack_from(order + "I", _need(data, at + 2 + 12 * count, 4))[0]


def byte_order(data: bytes) -> str:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ImageError("not a TIFF file")
    return order


def read_tiff(data: bytes, limits: Limits = Limits()) -> list[Picture]:
    order = byte_order(_need(data, 0, 8))
    at, out, seen = struct.unpack_from(order + "I", data, 4)[0], [], set()
    while at and at not in seen:
        seen.add(at)
        d, at = directory(data, at, order)
        try:
            w, h, photo = d[256][0], d[257][0], d[262][0]
            starts, sizes = d[273], d[279]
        except KeyError as e:
            raise ImageError(f"missing tag {e}") from None
        bits, channels, packed = d.get(258, [1]), d.get(277, [1])[0], d.get(259, [1])[0]
        if len(set(bits)) != 1 or bits[0] not in (1, 8, 16) or packed not in (1, 8, 32946) or d.get(284, [1])[0] != 1 or not 1 <= channels <= 4 or photo > 3:
            raise ImageError("unsupported kind of TIFF image")
        limits.check(w, h, max(channels, 3 if photo == 3 else 1), 1 + (bits[0] == 16))
        parts = [_need(data, a, n) for a, n in zip(starts, sizes, strict=True)]
        try:
            raw = b"".join(zlib.decompress(p) if packed != 1 else p for p in parts)
        except zlib.error as e:
            raise ImageError(str(e)) from None
        if bits[0] == 1:
            row = (w * channels + 7) // 8
            s = np.unpackbits(np.frombuffer(_need(raw, 0, row * h), np.uint8).reshape(h, row), axis=1)[:, : w * channels].reshape(h, w, channels).astype(np.int64) * 255
        else:
            s = np.frombuffer(_need(raw, 0, w * h * channels * bits[0] // 8), np.uint8 if bits[0] == 8 else order + "u2").reshape(h, w, channels).astype(np.int64)
        deep = "16" if bits[0] == 16 else "8"
        if photo == 0:
            s[..., 0] = (65535 if deep == "16" else 255) - s[..., 0]
        if photo == 3:
            table = np.array(d[320]).reshape(3, -1).T // 257
            s = table[s[..., 0]]
        tags = {"i_format": "tiff"} | {f"i_{k}res": f"{d[t][0]:g}" for k, t in (("x", 282), ("y", 283)) if t in d}
        out.append(Picture(s, deep, tags))
    if not out:
        raise ImageError("no images in file")
    return out


def write_tiff(pictures: list[Picture], packed: bool = False) -> bytes:
    """Little-endian, one strip a page."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for p in pictures:
        h, w, c = p.samples.shape
        deep = p.bits == "16"
        raw = p.samples.astype("<u2" if deep else np.uint8).tobytes()
        raw = zlib.compress(raw) if packed else raw
        strip = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        depths = len(out)
        out += struct.pack(f"<{c}H", *[16 if deep else 8] * c) + b"\0" * (2 * c % 4)
        entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, c, depths if c > 2 else (16 if deep else 8) * (0x10001 if c == 2 else 1)), (259, 3, 1, 8 if packed else 1), (262, 3, 1, 2 if c >= 3 else 1), (273, 4, 1, strip), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(raw))]
        entries += [(338, 3, 1, 2)] if c in (2, 4) else []
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)
