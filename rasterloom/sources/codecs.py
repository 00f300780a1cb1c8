"""Image codecs on bytes and numpy arrays (rows x columns x channels): PNM, RAW, BMP, TGA, PNG, SGI, GIF (reading)."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np


class ImageError(ValueError):
    pass


@dataclass
class Picture:
    samples: np.ndarray
    bits: str = "8"
    tags: dict[str, str] = field(default_factory=dict)
    palette: list[tuple[int, ...]] | None = None


@dataclass(frozen=True)
class Limits:
    """Checked on headers, before anything is decoded; 0 is no limit."""

    width: int = 0
    height: int = 0
    bytes: int = 0x4000_0000

    def check(self, width: int, height: int, channels: int, sample_bytes: int = 1) -> None:
        if width < 1 or height < 1:
            raise ImageError("image width and height must be positive")
        if not 1 <= channels <= 4:
            raise ImageError("channels out of range")
        if self.width and width > self.width or self.height and height > self.height:
            raise ImageError("image is larger than the limit")
        if self.bytes and width * height * channels * sample_bytes > self.bytes:
            raise ImageError("image would take more bytes than the limit")


# First bytes of formats, in order of precedence.
MAGIC = [
    (b"\xff\xd8", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"MM\0*", "tiff"), (b"II*\0", "tiff"), (b"BM", "bmp"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\x01\xda", "sgi"), (b"P1", "pnm"), (b"P2", "pnm"), (b"P3", "pnm"), (b"P4", "pnm"), (b"P5", "pnm"), (b"P6", "pnm"),
    (b"RIFF", "webp"), (b"%PDF", "pdf"), (b"\0\0\x01\0", "ico"), (b"\0\0\x02\0", "cur"),
]


def probe(data: bytes, extra: list[tuple[bytes, str]] = ()) -> str | None:
    for magic, name in [*extra, *MAGIC]:
        if data.startswith(magic):
            return name
    if len(data) >= 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 15, 16, 24, 32):
        return "tga"
    return None


def _need(data: bytes, at: int, n: int) -> bytes:
    if len(data) < at + n:
        raise ImageError("premature end of file")
    return data[at : at + n]


PNM_WORD = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _read_pnm(data: bytes, at: int, limits: Limits, incomplete: bool) -> tuple[Picture, int]:
    kind = data[at : at + 2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ImageError("bad header magic, not a PNM file")
    at += 2

    def word() -> int:
        nonlocal at
        m = PNM_WORD.match(data, at)
        if not m or not m[1].isdigit() or len(m[1]) > 9:
            raise ImageError("invalid or missing number in header")
        at = m.end()
        return int(m[1])

    w, h = word(), word()
    top = 1 if kind in (b"P1", b"P4") else word()
    if not 0 < top <= 65535:
        raise ImageError("maxval of zero or over 65535")
    channels = 3 if kind in (b"P3", b"P6") else 1
    limits.check(w, h, channels, 1 + (top > 255))
    n, tags = w * h * channels, {}
    if kind in (b"P1", b"P2", b"P3"):
        values = []
        if kind == b"P1":
            while len(values) < n and at < len(data):
                m = re.compile(rb"(?:\s|#[^\n]*\n)*([01])").match(data, at)
                if not m:
                    break
                values.append(int(m[1]))
                at = m.end()
        else:
            while len(values) < n:
                m = PNM_WORD.match(data, at)
                if not m:
                    break
                if not m[1].isdigit():
                    raise ImageError("invalid data for pnm")
                values.append(min(int(m[1]), top))
                at = m.end()
        got = np.array(values, np.int64)
    else:
        at += 1
        if kind == b"P4":
            row = (w + 7) // 8
            raw = np.frombuffer(data[at : at + row * h], np.uint8)
            at += row * h
            full = np.zeros(row * h, np.uint8)
            full[: len(raw)] = raw
            got = np.unpackbits(full.reshape(h, row), axis=1)[:, :w].ravel().astype(np.int64)[: len(raw) // row * w if len(raw) < row * h else None]
        else:
            size = 1 + (top > 255)
            raw = data[at : at + n * size]
            at += n * size
            got = np.minimum(np.frombuffer(raw[: len(raw) // size * size], ">u2" if size == 2 else np.uint8).astype(np.int64), top)
    if len(got) < n:
        lines = len(got) // (w * channels)
        if not incomplete or not lines:
            raise ImageError("short read - file truncated?")
        tags = {"i_incomplete": "1", "i_lines_read": str(lines)}
        got = np.concatenate([got[: lines * w * channels], np.zeros(n - lines * w * channels, np.int64)])
    if kind in (b"P1", b"P4"):
        return Picture((1 - got).reshape(h, w, 1) * 255, "8", tags, [(255, 255, 255), (0, 0, 0)]), at
    whole = 65535 if top > 255 else 255
    return Picture(((got * whole + top // 2) // top).reshape(h, w, channels), "16" if top > 255 else "8", tags), at


def read_pnm(data: bytes, limits: Limits = Limits(), incomplete: bool = False) -> list[Picture]:
    """All images of a stream; after the first, a broken one ends it when incomplete files are allowed."""
    out, at = [], 0
    while True:
        try:
            picture, at = _read_pnm(data, at, limits, incomplete)
        except ImageError:
            if out and incomplete:
                return out
            raise
        out.append(picture)
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if at >= len(data):
            return out


def write_pnm(p: Picture, wide: bool = False) -> bytes:
    h, w, c = p.samples.shape
    s = p.samples
    if c in (2, 4):
        top = 65535 if p.bits == "16" else 255
        s = s[..., :-1] * s[..., -1:] // top
    two = p.bits == "16" and wide
    if p.bits == "16" and not wide:
        s = (s + 128) // 257
    head = f"P{6 if s.shape[2] == 3 else 5}\n# made by rasterloom\n{w} {h}\n{65535 if two else 255}\n"
    return head.encode() + s.astype(">u2" if two else np.uint8).tobytes()


def read_raw(data: bytes, width: int, height: int, data_channels: int = 3, store_channels: int = 3, interleave: int = 0) -> Picture:
    """Interleaved pixels (0), or each line's channels one after another (1); missing channels are zero."""
    raw = np.frombuffer(_need(data, 0, width * height * data_channels), np.uint8)
    s = raw.reshape(height, data_channels, width).transpose(0, 2, 1) if interleave else raw.reshape(height, width, data_channels)
    out = np.zeros((height, width, store_channels), np.int64)
    n = min(data_channels, store_channels)
    out[..., :n] = s[..., :n]
    return Picture(out)


def write_raw(p: Picture) -> bytes:
    return p.samples.astype(np.uint8).tobytes()


def _unpack_bits(raw: np.ndarray, bits: int, width: int) -> np.ndarray:
    if bits == 8:
        return raw[:, :width]
    per = 8 // bits
    return np.stack([raw >> (8 - bits * (k + 1)) & (1 << bits) - 1 for k in range(per)], 2).reshape(len(raw), -1)[:, :width]


def _bmp_rle(data: bytes, w: int, h: int, four: bool) -> np.ndarray:
    out, x, y, at = np.zeros((h, w), np.uint8), 0, 0, 0
    while y < h and at + 1 < len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            values = [v >> 4, v & 15] * ((n + 1) // 2) if four else [v] * n
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            step = _need(data, at, 2)
            x, y, at = x + step[0], y + step[1], at + 2
            continue
        else:
            n = v
            size = (n + 1) // 2 if four else n
            part = _need(data, at, size)
            values = [q for b in part for q in (b >> 4, b & 15)] if four else list(part)
            at += size + size % 2
        values = values[: max(0, min(n, w - x))]
        if y < h:
            out[y, x : x + len(values)] = values
        x += n
    return out


def read_bmp(data: bytes, limits: Limits = Limits()) -> Picture:
    if _need(data, 0, 54)[:2] != b"BM":
        raise ImageError("not a BMP file")
    offset, head, w, h, planes, bits, packed, _, xres, yres, used, _ = struct.unpack_from("<I I i i H H I I i i I I", data, 10)
    if head != 40 or planes != 1:
        raise ImageError("unknown file header size")
    down, h = h < 0, abs(h)
    limits.check(w, h, 3)
    tags = {"bmp_bit_count": str(bits), "bmp_compression": str(packed), "i_format": "bmp", "i_xres": f"{xres * 0.0254:g}", "i_yres": f"{yres * 0.0254:g}"}
    palette = None
    if bits in (1, 4, 8):
        count = used or 1 << bits
        raw = _need(data, 54, 4 * count)
        palette = [(raw[4 * k + 2], raw[4 * k + 1], raw[4 * k]) for k in range(count)]
        if packed in (1, 2):
            index = _bmp_rle(data[offset:], w, h, packed == 2)
        else:
            row = (w * bits + 31) // 32 * 4
            index = _unpack_bits(np.frombuffer(_need(data, offset, row * h), np.uint8).reshape(h, row), bits, w)
        if index.max(initial=0) >= count:
            raise ImageError("invalid pixel index")
        s = np.array(palette, np.int64)[index]
    elif bits in (16, 24, 32):
        row = (w * bits + 31) // 32 * 4
        raw = np.frombuffer(_need(data, offset, row * h), np.uint8).reshape(h, row)
        if bits == 24:
            s = raw[:, : 3 * w].reshape(h, w, 3)[..., ::-1].astype(np.int64)
        else:
            masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
            v = raw[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
            parts = []
            for m in masks:
                if not m:
                    raise ImageError("a colour mask is empty")
                shift = (m & -m).bit_length() - 1
                parts.append((v & m) >> shift if m >> shift == 255 else ((v & m) >> shift) * 255 // (m >> shift))
            s = np.stack(parts, 2)
    else:
        raise ImageError(f"unknown bit count for BMP file ({bits})")
    return Picture(s if down else s[::-1], "8", tags, palette)


def write_bmp(p: Picture) -> bytes:
    h, w, c = p.samples.shape
    s = p.samples[..., :-1] * p.samples[..., -1:] // 255 if c in (2, 4) else p.samples
    s = np.repeat(s, 3, 2) if s.shape[2] == 1 else s
    row = (w * 3 + 3) // 4 * 4
    raw = np.zeros((h, row), np.uint8)
    raw[:, : 3 * w] = s[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI IiiHHIIiiII", b"BM", 54 + row * h, 0, 0, 54, 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + raw.tobytes()


def read_tga(data: bytes, limits: Limits = Limits()) -> Picture:
    idlen, mapped, kind, mfirst, mlen, mbits, _, _, w, h, bits, desc = struct.unpack_from("<BBBHHBHHHHBB", _need(data, 0, 18))
    if kind not in (1, 2, 3, 9, 10, 11):
        raise ImageError("unsupported image type")
    if (kind & 3) in (1, 3) and bits != 8 or (kind & 3) == 2 and bits not in (15, 16, 24, 32):
        raise ImageError("unsupported pixel size")
    size, at = (bits + 7) // 8, 18 + idlen
    limits.check(w, h, 4 if bits == 32 else 3 if (kind & 3) != 3 else 1)
    tags = {"i_format": "tga", "tga_bitspp": str(bits)} | ({"tga_idstring": data[18:at].split(b"\0")[0].decode("latin-1")} if idlen else {})

    def colours(raw: np.ndarray, bits: int) -> np.ndarray:
        if bits in (15, 16):
            v = raw.reshape(-1, 2).astype(np.int64)
            v = v[:, 0] | v[:, 1] << 8
            return np.stack([(v >> k & 31) * 255 // 31 for k in (10, 5, 0)], 1)
        b = raw.reshape(-1, bits // 8).astype(np.int64)
        return b[:, [2, 1, 0, 3][: bits // 8]] if bits >= 24 else b

    palette = None
    if mapped:
        n = mlen * ((mbits + 7) // 8)
        palette = colours(np.frombuffer(_need(data, at, n), np.uint8), mbits)
        at += n
    if kind > 8:
        out = bytearray()
        while len(out) < w * h * size:
            lead = _need(data, at, 1)[0]
            n = (lead & 127) + 1
            out += _need(data, at + 1, size) * n if lead & 128 else _need(data, at + 1, size * n)
            at += 1 + (size if lead & 128 else size * n)
        raw = np.frombuffer(bytes(out[: w * h * size]), np.uint8)
    else:
        raw = np.frombuffer(_need(data, at, w * h * size), np.uint8)
    if (kind & 3) == 1:
        if palette is None:
            raise ImageError("mapped image without a map")
        index = raw.astype(np.int64) - mfirst
        if index.min(initial=0) < 0 or index.max(initial=0) >= len(palette):
            raise ImageError("invalid pixel index")
        s = palette[index]
    else:
        s = raw.astype(np.int64)[:, None] if (kind & 3) == 3 else colours(raw, bits)
    s = s.reshape(h, w, -1)
    return Picture(s if desc & 32 else s[::-1], "8", tags)


def write_tga(p: Picture, compress: bool = False, idstring: str = "") -> bytes:
    h, w, c = p.samples.shape
    if c == 2:
        raise ImageError("cannot store 2 channel image in targa format")
    ident = idstring.encode("latin-1")[:255]
    head = struct.pack("<BBBHHBHHHHBB", len(ident), 0, (3 if c == 1 else 2) + 8 * compress, 0, 0, 0, 0, 0, w, h, 8 * c, 32 | (8 if c == 4 else 0)) + ident
    s = (p.samples if c == 1 else p.samples[..., [2, 1, 0, 3][:c]]).astype(np.uint8).reshape(-1, c)
    if not compress:
        return head + s.tobytes()
    out, at, n = bytearray(), 0, len(s)
    same = np.r_[(s[1:] == s[:-1]).all(1), False]
    while at < n:
        run = 1
        while run < 128 and at + run < n and same[at + run - 1]:
            run += 1
        if run > 1:
            out.append(127 + run)
            out += s[at].tobytes()
        else:
            while run < 128 and at + run < n and not same[at + run]:
                run += 1
            out.append(run - 1)
            out += s[at : at + run].tobytes()
        at += run
    return head + bytes(out)


def read_png(data: bytes, limits: Limits = Limits()) -> Picture:
    if _need(data, 0, 8) != b"\x89PNG\r\n\x1a\n":
        raise ImageError("not a PNG file")
    at, body, palette, clear, tags = 8, bytearray(), None, b"", {"i_format": "png"}
    w = h = depth = kind = lace = 0
    while at < len(data):
        n, name = struct.unpack(">I4s", _need(data, at, 8))
        chunk = _need(data, at + 8, n)
        if zlib.crc32(name + chunk) != struct.unpack(">I", _need(data, at + 8 + n, 4))[0]:
            raise ImageError("CRC error")
        at += 12 + n
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", chunk)
            limits.check(w, h, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(kind, 0), 1 + (depth == 16))
        elif name == b"PLTE":
            palette = [tuple(chunk[k : k + 3]) for k in range(0, n, 3)]
        elif name == b"tRNS":
            clear = chunk
        elif name == b"IDAT":
            body += chunk
        elif name == b"pHYs":
            x, y, unit = struct.unpack(">IIB", chunk)
            tags |= {"i_xres": f"{x * 0.0254:g}", "i_yres": f"{y * 0.0254:g}"} if unit else {"i_aspect_only": "1"}
        elif name == b"tEXt":
            key, _, text = chunk.partition(b"\0")
            tags[f"png_text_{key.decode('latin-1')}"] = text.decode("latin-1")
        elif name == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    try:
        raw = zlib.decompress(bytes(body))
    except zlib.error as e:
        raise ImageError(str(e)) from None
    out, place = np.zeros((h, w, channels), np.int64), 0
    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if lace else [(0, 0, 1, 1)]
    for x0, y0, dx, dy in passes:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        row, step = (pw * channels * depth + 7) // 8, max(1, channels * depth // 8)
        rows, before = [], np.zeros(row, np.int64)
        for _ in range(ph):
            if place + row >= len(raw) + 1 and place + row > len(raw) - 1 and len(raw) < place + row + 1:
                raise ImageError("premature end of image data")
            rule, line = raw[place], np.frombuffer(raw, np.uint8, row, place + 1).astype(np.int64)
            place += row + 1
            before = _unfilter(rule, line, before, step)
            rows.append(before)
        part = np.array(rows, np.int64)
        if depth == 16:
            values = part.reshape(ph, -1, 2)
            values = values[..., 0] << 8 | values[..., 1]
        elif depth == 8:
            values = part
        else:
            values = _unpack_bits(part.astype(np.uint8), depth, pw * channels).astype(np.int64)
        out[y0::dy, x0::dx] = values[:, : pw * channels].reshape(ph, pw, channels)
    if kind == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ImageError("invalid palette index")
        s = np.array(palette, np.int64)[out[..., 0]]
        if clear:
            alpha = np.full(len(palette), 255, np.int64)
            alpha[: len(clear)] = list(clear[: len(palette)])
            s = np.concatenate([s, alpha[out[..., 0]][..., None]], 2)
        return Picture(s, "8", tags, palette)
    top = (1 << depth) - 1
    s = out * 255 // top if depth < 8 else out
    if clear and kind in (0, 2):
        key = np.array(struct.unpack(f">{channels}H", clear))
        s = np.concatenate([s, np.where((out == key).all(2), 0, 65535 if depth == 16 else 255)[..., None]], 2)
    return Picture(s, "16" if depth == 16 else "8", tags)


def _unfilter(rule: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if rule == 0:
        return line
    if rule == 2:
        return line + up & 255
    out = line.copy()
    if rule == 1:
        for k in range(step):
            out[k::step] = np.cumsum(line[k::step]) & 255
        return out
    if rule not in (3, 4):
        raise ImageError("bad adaptive filter value")
    for i in range(len(line)):
        a, b = (int(out[i - step]) if i >= step else 0), int(up[i])
        if rule == 3:
            guess = (a + b) // 2
        else:
            c = int(up[i - step]) if i >= step else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = int(line[i]) + guess & 255
    return out


def write_png(p: Picture) -> bytes:
    h, w, c = p.samples.shape
    deep = p.bits == "16"
    raw = p.samples.astype(">u2" if deep else np.uint8)
    lines = b"".join(b"\0" + raw[y].tobytes() for y in range(h))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_sgi(data: bytes, limits: Limits = Limits()) -> Picture:
    magic, packed, size, dims, w, h, c, low, high, _, name, normal = struct.unpack_from(">HBBHHHHII4s80sI", _need(data, 0, 512))
    if magic != 474 or size not in (1, 2) or packed not in (0, 1) or dims not in (1, 2, 3) or normal:
        raise ImageError("not a supported SGI image")
    if low >= high:
        raise ImageError("SGI image: invalid pixmin and pixmax")
    h, c = (1, 1) if dims == 1 else (h, 1) if dims == 2 else (h, c)
    limits.check(w, h, c, size)
    planes = np.zeros((c, h, w), np.int64)
    if not packed:
        planes[:] = np.frombuffer(_need(data, 512, w * h * c * size), ">u2" if size == 2 else np.uint8).reshape(c, h, w)
    else:
        starts = np.frombuffer(_need(data, 512, 4 * h * c), ">u4")
        sizes = np.frombuffer(_need(data, 512 + 4 * h * c, 4 * h * c), ">u4")
        for k in range(h * c):
            part = np.frombuffer(_need(data, int(starts[k]), int(sizes[k]) // size * size), ">u2" if size == 2 else np.uint8).astype(np.int64)
            line, at = [], 0
            while at < len(part) and (n := int(part[at]) & 127):
                line += part[at + 1 : at + 1 + n].tolist() if part[at] & 128 else [int(part[at + 1])] * n
                at += 1 + (n if part[at] & 128 else 1)
            if len(line) != w:
                raise ImageError("SGI image: bad RLE data")
            planes[k // h, k % h] = line
    top = 255 if size == 1 else 65535
    s = planes.transpose(1, 2, 0)[::-1]
    if (low, high) != (0, top):
        s = np.clip((s - low) * top // (high - low), 0, top)
    tags = {"i_format": "sgi", "sgi_rle": str(packed), "sgi_pixmin": str(low), "sgi_pixmax": str(high)}
    label = name.split(b"\0")[0].decode("latin-1")
    return Picture(s, "16" if size == 2 else "8", tags | ({"i_comment": label} if label else {}))


def write_sgi(p: Picture) -> bytes:
    h, w, c = p.samples.shape
    size = 2 if p.bits == "16" else 1
    head = struct.pack(">HBBHHHHII4s80sI", 474, 0, size, 3 if c > 1 else 2, w, h, c, 0, 65535 if size == 2 else 255, b"", b"", 0).ljust(512, b"\0")
    return head + p.samples[::-1].transpose(2, 0, 1).astype(">u2" if size == 2 else np.uint8).tobytes()


def _lzw(data: bytes, least: int, count: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table: list[bytes] = []
    out, width, bits, held, last = bytearray(), least + 1, 0, 0, b""

    def fresh() -> None:
        nonlocal table, width, last
        table, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, b""

    fresh()
    for byte in data:
        bits |= byte << held
        held += 8
        while held >= width:
            code, bits, held = bits & (1 << width) - 1, bits >> width, held - width
            if code == clear:
                fresh()
                continue
            if code == end or len(out) >= count:
                return bytes(out[:count])
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                raise ImageError("bad LZW code")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return bytes(out[:count])


def read_gif(data: bytes, limits: Limits = Limits()) -> list[Picture]:
    """All frames, each of its own size, three channels or four where it has a transparent index."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ImageError("not a GIF file")
    sw, sh, flags = struct.unpack_from("<HHB", _need(data, 6, 7))
    at, shared = 13, None
    table = lambda at, flags: np.frombuffer(_need(data, at, 3 << (flags & 7) + 1), np.uint8).reshape(-1, 3).astype(np.int64)
    if flags & 128:
        shared = table(at, flags)
        at += 3 << (flags & 7) + 1
    out, control = [], {}
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label, at = _need(data, at, 2)[1], at + 2
            while n := _need(data, at, 1)[0]:
                if label == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", _need(data, at + 1, 4))
                    control = {"delay": delay, "index": index if packed & 1 else None, "disposal": packed >> 2 & 7}
                at += n + 1
            at += 1
            continue
        if data[at] != 0x2C:
            raise ImageError("unexpected block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", _need(data, at + 1, 9))
        at += 10
        if left + w > sw or top + h > sh:
            raise ImageError("image frame is outside the screen")
        colours = shared
        if local & 128:
            colours = table(at, local)
            at += 3 << (local & 7) + 1
        if colours is None:
            raise ImageError("image without a colour map")
        limits.check(w, h, 4)
        least, body, at = _need(data, at, 1)[0], bytearray(), at + 1
        while n := _need(data, at, 1)[0]:
            body += _need(data, at + 1, n)
            at += n + 1
        at += 1
        index = np.frombuffer(_lzw(bytes(body), least, w * h), np.uint8)
        if len(index) < w * h:
            raise ImageError("premature end of image data")
        index = index.reshape(h, w)
        if local & 64:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            index = index[np.argsort(order)]
        if index.max(initial=0) >= len(colours):
            raise ImageError("invalid pixel index")
        s = colours[index]
        if control.get("index") is not None:
            s = np.concatenate([s, np.where(index == control["index"], 0, 255)[..., None]], 2)
        out.append(Picture(s, "8", {"i_format": "gif", "gif_left": str(left), "gif_top": str(top), "gif_screen_width": str(sw), "gif_screen_height": str(sh)} | ({"gif_delay": str(control["delay"]), "gif_disposal": str(control["disposal"])} if control else {})))
        control = {}
    if not out:
        raise ImageError("no images in file")
    return out


def _packed_bits(codes: list[tuple[int, int]]) -> bytes:
    """Codes of given widths, lowest bits first."""
    out, held, n = bytearray(), 0, 0
    for code, width in codes:
        held |= code << n
        n += width
        while n >= 8:
            out.append(held & 255)
            held, n = held >> 8, n - 8
    return bytes(out) + (bytes([held]) if n else b"")


def write_gif(pictures: list[Picture], palette: list[tuple[int, int, int]], loop: int | None = None, delay: int = 0) -> bytes:
    """Frames of palette indexes (one channel) under a shared palette; an index after the last is transparent."""
    if not 1 <= len(palette) <= 255:
        raise ImageError("1 to 255 colours")
    bits = max(1, len(palette).bit_length())
    h, w = (max(p.samples.shape[k] for p in pictures) for k in (0, 1))
    table = b"".join(bytes(c) for c in palette).ljust(3 << bits, b"\0")
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | bits - 1, 0, 0) + table
    if loop is not None:
        out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0"
    least = max(2, bits)
    for p in pictures:
        fh, fw = p.samples.shape[:2]
        clear, codes, table_, width, prefix = 1 << least, [], {}, least + 1, b""
        index = p.samples[..., 0].astype(np.uint8).tobytes()
        codes.append((clear, width))
        for k in range(len(index)):
            longer = prefix + index[k : k + 1]
            if len(longer) == 1 or longer in table_:
                prefix = longer
                continue
            codes.append((table_.get(prefix, prefix[0]), width))
            table_[longer] = clear + 2 + len(table_)
            if clear + 2 + len(table_) > 1 << width and width < 12:
                width += 1
            if clear + 2 + len(table_) >= 4095:
                codes.append((clear, width))
                table_, width = {}, least + 1
            prefix = longer[-1:]
        if prefix:
            codes.append((table_.get(prefix, prefix[0]), width))
            if clear + 2 + len(table_) + 1 > 1 << width and width < 12:
                width += 1
        codes.append((clear + 1, width))
        body = _packed_bits(codes)
        out += b"\x21\xf9\x04" + struct.pack("<BHB", 1, delay, len(palette)) + b"\0\x2c" + struct.pack("<HHHHB", 0, 0, fw, fh, 0) + bytes([least])
        out += b"".join(bytes([len(body[k : k + 255])]) + body[k : k + 255] for k in range(0, len(body), 255)) + b"\0"
    return out + b";"


READERS = {"pnm": read_pnm, "bmp": read_bmp, "tga": read_tga, "png": read_png, "sgi": read_sgi, "gif": read_gif}
WRITERS = {"pnm": write_pnm, "bmp": write_bmp, "tga": write_tga, "png": write_png, "sgi": write_sgi, "raw": write_raw}


def decode(data: bytes, kind: str | None = None, limits: Limits = Limits(), incomplete: bool = False) -> list[Picture]:
    kind = kind or probe(data)
    if kind in ("ico", "cur", "tiff"):
        from rasterloom.sources import icons, tiff  # these build on this module

        try:
            return tiff.read_tiff(data, limits) if kind == "tiff" else icons.read_icons(data, limits)
        except (struct.error, IndexError) as e:
            raise ImageError(f"broken {kind} file: {e}") from None
    if kind not in READERS:
        raise ImageError(f"format '{kind}' not supported" if kind else "unable to determine the format")
    try:
        got = read_pnm(data, limits, incomplete) if kind == "pnm" else READERS[kind](data, limits)
    except (struct.error, IndexError) as e:
        raise ImageError(f"broken {kind} file: {e}") from None
    return got if isinstance(got, list) else [got]


def encode(p: Picture, kind: str, **options) -> bytes:
    if kind in ("ico", "cur", "tiff"):
        from rasterloom.sources import icons, tiff  # these build on this module

        return tiff.write_tiff([p], **options) if kind == "tiff" else icons.write_icons([p], kind == "cur")
    if kind not in WRITERS:
        raise ImageError(f"format '{kind}' not supported for writing")
    return WRITERS[kind](p, **options)
