"""Icons and cursors: BMP-like images of 1, 4, 8, 24 or 32 bits with a mask of transparent pixels."""

from __future__ import annotations

import struct

import numpy as np

from rasterloom.sources.codecs import ImageError, Limits, Picture, _need, _unpack_bits


def read_icons(data: bytes, limits: Limits = Limits()) -> list[Picture]:
    """All images. The mask makes alpha; with 32 bits the stored alpha counts instead."""
    zero, kind, count = struct.unpack_from("<HHH", _need(data, 0, 6))
    if zero or kind not in (1, 2) or not count:
        raise ImageError("not an icon file")
    out = []
    for k in range(count):
        w, h, _, _, hot_x, hot_y, size, offset = struct.unpack_from("<BBBBHHII", _need(data, 6 + 16 * k, 16))
        body = _need(data, offset, size)
        head, width, height, planes, bits = struct.unpack_from("<IiiHH", _need(body, 0, 40))
        height //= 2
        if head != 40 or planes != 1 or bits not in (1, 4, 8, 24, 32):
            raise ImageError("unsupported icon image")
        limits.check(width, height, 4)
        at, palette = 40, None
        if bits <= 8:
            raw = np.frombuffer(_need(body, at, 4 << bits), np.uint8).reshape(-1, 4)
            palette, at = raw[:, [2, 1, 0]].astype(np.int64), at + (4 << bits)
        row, mask_row = (width * bits + 31) // 32 * 4, (width + 31) // 32 * 4
        raw = np.frombuffer(_need(body, at, row * height), np.uint8).reshape(height, row)
        mask = np.frombuffer(_need(body, at + row * height, mask_row * height), np.uint8).reshape(height, mask_row)
        clear = np.unpackbits(mask, axis=1)[:, :width]
        if palette is not None:
            s = palette[_unpack_bits(raw, bits, width)]
        else:
            s = raw[:, : width * bits // 8].reshape(height, width, bits // 8)[..., [2, 1, 0, 3][: bits // 8]].astype(np.int64)
        if bits != 32:
            s = np.concatenate([s, np.where(clear, 0, 255)[..., None]], 2)
        tags = {"i_format": "ico" if kind == 1 else "cur"} | ({"cur_hotspotx": str(hot_x), "cur_hotspoty": str(hot_y)} if kind == 2 else {})
        out.append(Picture(s[::-1], "8", tags))
    return out


def write_icons(pictures: list[Picture], cursor: bool = False) -> bytes:
    """32-bit images; the mask is set where alpha is zero."""
    bodies, heads, at = [], [], 6 + 16 * len(pictures)
    for p in pictures:
        h, w, c = p.samples.shape
        if not (1 <= w <= 256 and 1 <= h <= 256):
            raise ImageError("icons are at most 256 x 256")
        s = p.samples if c in (2, 4) else np.concatenate([p.samples, np.full((h, w, 1), 255)], 2)
        s = np.concatenate([np.repeat(s[..., :1], 3, 2), s[..., 1:]], 2) if s.shape[2] == 2 else s
        bits = np.zeros((h, (w + 31) // 32 * 32), np.uint8)
        bits[:, :w] = s[::-1, :, 3] == 0
        body = struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 32, 0, 0, 0, 0, 0, 0) + s[::-1][..., [2, 1, 0, 3]].astype(np.uint8).tobytes() + np.packbits(bits, axis=1).tobytes()
        x, y = (int(p.tags.get(f"cur_hotspot{k}", 0)) for k in "xy") if cursor else (1, 32)
        heads.append(struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, x, y, len(body), at))
        bodies.append(body)
        at += len(body)
    return struct.pack("<HHH", 0, 2 if cursor else 1, len(pictures)) + b"".join(heads + bodies)
