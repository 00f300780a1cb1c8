"""What cameras and news desks write beside pixels: Exif directories and IPTC captions, as name -> text."""

from __future__ import annotations

import re
import struct

from rasterloom.sources.codecs import ImageError
from rasterloom.sources.tiff import byte_order, directory

# Tag numbers of the formats.
MAIN = {270: "image_description", 271: "make", 272: "model", 274: "orientation", 282: "x_resolution", 283: "y_resolution", 296: "resolution_unit", 305: "software", 306: "date_time", 315: "artist", 33432: "copyright"}
PHOTO = {33434: "exposure_time", 33437: "f_number", 34850: "exposure_program", 34855: "iso_speed_rating", 36867: "date_time_original", 36868: "date_time_digitized", 37377: "shutter_speed", 37378: "aperture", 37380: "exposure_bias", 37383: "metering_mode", 37385: "flash", 37386: "focal_length", 37510: "user_comment", 40961: "color_space"}
PLACE = {1: "gps_latitude_ref", 2: "gps_latitude", 3: "gps_longitude_ref", 4: "gps_longitude", 5: "gps_altitude_ref", 6: "gps_altitude", 15: "track"}
WORDS = {"orientation": {1: "top_left", 3: "bottom_right", 6: "right_top", 8: "left_bottom"}, "resolution_unit": {1: "none", 2: "inches", 3: "centimeters"}, "color_space": {1: "sRGB", 65535: "uncalibrated"}}
CAPTIONS = {120: "caption", 80: "photogr", 105: "headln", 110: "credit"}


def _text(name: str, value: list) -> str:
    first = value[0]
    if isinstance(first, bytes):
        if name == "user_comment":
            first = first[:8].replace(b"\0", b" ") + first[8:]
        return first.rstrip(b"\0").decode("latin-1")
    if name in WORDS:
        return WORDS[name].get(first, str(first))
    return " ".join(f"{v:g}" for v in value)


def exif(data: bytes) -> dict[str, str]:
    """Names and texts of an APP1 segment's body (with or without its "Exif" mark): main, photo and place directories."""
    data = data.removeprefix(b"Exif\0\0")
    order = byte_order(data)
    try:
        main, _ = directory(data, struct.unpack_from(order + "I", data, 4)[0], order)
        found = {f"exif_{n}": _text(n, main[t]) for t, n in MAIN.items() if t in main}
        for pointer, names in ((34665, PHOTO), (34853, PLACE)):
            if pointer in main:
                part, _ = directory(data, main[pointer][0], order)
                found |= {f"exif_{n}": _text(n, part[t]) for t, n in names.items() if t in part}
    except struct.error as e:
        raise ImageError(f"broken Exif data: {e}") from None
    return found


def iptc(data: bytes) -> dict[str, str]:
    """Caption, photographer, headline and credit of the 8BIM blocks of an APP13 segment."""
    found = {}
    for block in data.split(b"8BIM")[1:]:
        if block[:2] != b"\x04\x04":
            continue
        for m in re.finditer(rb"\x1c\x02(.)(..)", block, re.S):
            size = struct.unpack(">H", m[2])[0]
            name = CAPTIONS.get(m[1][0])
            if name and m.end() + size <= len(block):
                found[name] = block[m.end() : m.end() + size].decode("latin-1")
    return found
