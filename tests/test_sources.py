import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.model import blank
from rasterloom.sources import codecs, icons, images, metadata, tiff
from rasterloom.streaming import frames


@st.composite
def pictures(draw):
    w, h, c = draw(st.integers(1, 9)), draw(st.integers(1, 7)), draw(st.sampled_from([1, 2, 3, 4]))
    deep = draw(st.booleans())
    rng = np.random.default_rng(draw(st.integers(0, 9999)))
    return codecs.Picture(rng.integers(0, 65536 if deep else 256, (h, w, c)) // draw(st.sampled_from([1, 64])), "16" if deep else "8")


@settings(max_examples=60, deadline=None)
@given(pictures())
def test_round_trips(p):
    c = p.samples.shape[2]
    same = lambda got: np.array_equal(got.samples, p.samples) and got.bits == p.bits
    assert same(codecs.decode(codecs.write_png(p))[0]) and same(codecs.decode(codecs.write_sgi(p))[0])
    if c in (1, 3):
        assert same(codecs.decode(codecs.write_pnm(p, wide=True))[0])
    if p.bits == "8":
        if c == 3:
            assert same(codecs.decode(codecs.write_bmp(p))[0])
        if c != 2:
            for packed in (False, True):
                assert same(codecs.decode(codecs.write_tga(p, packed, "name"), "tga")[0])
        assert np.array_equal(codecs.read_raw(codecs.write_raw(p), p.samples.shape[1], p.samples.shape[0], c, c).samples, p.samples)


@settings(max_examples=40, deadline=None)
@given(pictures(), st.booleans())
def test_tiff_and_icons(p, packed):
    got = codecs.decode(tiff.write_tiff([p, p], packed))
    assert len(got) == 2 and all(np.array_equal(g.samples, p.samples) and g.bits == p.bits for g in got)
    if p.bits == "8" and p.samples.shape[2] == 4:
        for cursor in (False, True):
            assert np.array_equal(codecs.decode(icons.write_icons([p], cursor))[0].samples, p.samples)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.integers(1, 40), st.integers(1, 255), st.integers(0, 999))
def test_gif_frames(w, h, colours, seed):
    rng = np.random.default_rng(seed)
    palette = [tuple(map(int, c)) for c in rng.integers(0, 256, (colours, 3))]
    index = rng.integers(0, colours + 1, (h, w, 1)) // rng.integers(1, 4)
    p = codecs.decode(codecs.write_gif([codecs.Picture(index)] * 2, palette, loop=0, delay=7))
    table = np.array([(*c, 255) for c in palette] + [(0, 0, 0, 0)])
    shown = table[index[..., 0]]
    assert len(p) == 2 and np.array_equal(p[0].samples[..., 3], shown[..., 3]) and np.array_equal(p[0].samples[shown[..., 3] > 0], shown[shown[..., 3] > 0])


def test_metadata():
    import struct

    entries = struct.pack("<HHII", 271, 2, 4, 0x636261) + struct.pack("<HHII", 274, 3, 1, 6) + struct.pack("<HHII", 34665, 4, 1, 62)
    data = b"II*\0" + struct.pack("<IH", 8, 3) + entries + b"\0" * 4
    data = data.ljust(62, b"\0") + struct.pack("<HHHII", 1, 33437, 5, 1, 80) + b"\0" * 4 + struct.pack("<II", 28, 10)
    assert metadata.exif(b"Exif\0\0" + data) == {"exif_make": "abc", "exif_orientation": "right_top", "exif_f_number": "2.8"}
    with pytest.raises(codecs.ImageError):
        metadata.exif(b"junk")
    block = b"8BIM\x04\x04\0\0\0\0\0\x20" + b"\x1c\x02\x78\0\x05Hello" + b"\x1c\x02\x50\0\x02Me"
    assert metadata.iptc(b"Photoshop 3.0\0" + block) == {"caption": "Hello", "photogr": "Me"} and metadata.iptc(b"") == {}


def test_ascii_pnm():
    p = codecs.decode(b"P1\n# a remark\n2 2\n1 0\n0 1\n")[0]
    assert p.samples[..., 0].tolist() == [[0, 255], [255, 0]]
    p = codecs.decode(b"P3\n3 1\n63\n63 63 63\n32 32 32\n31 31 0\n")[0]
    assert p.samples[0].tolist() == [[255] * 3, [130] * 3, [125, 125, 0]]
    assert codecs.decode(b"P2\n1 1\n4095\n4095\n")[0].samples.tolist() == [[[65535]]]
    two = codecs.decode(b"P5 1 1 255\n\x05P5 1 1 255\n\x06")
    assert [x.samples[0, 0, 0] for x in two] == [5, 6]
    got = codecs.decode(b"P2\n2 2\n255\n1 2 3", incomplete=True)[0]
    assert got.tags["i_lines_read"] == "1" and got.samples[..., 0].tolist() == [[1, 2], [0, 0]]


@pytest.mark.parametrize("data", [b"", b"junk", b"P3\n1 1\n255\nx y z\n", b"P2\n2 2\n255\n1 2 3", b"P2\n99999999999 1\n255\n1", b"P2\n1 1\n0\n1", b"P6 5 5 255\n\0", b"BM" + b"\0" * 60, b"\x89PNG\r\n\x1a\n" + b"\0" * 30, b"GIF89a" + b"\0" * 12, b"\x01\xda" + b"\0" * 600])
def test_broken_files(data):
    with pytest.raises(codecs.ImageError):
        codecs.decode(data)


def test_limits():
    with pytest.raises(codecs.ImageError, match="larger than"):
        codecs.decode(b"P2\n20 20\n255\n", limits=codecs.Limits(width=10))
    codecs.Limits(10, 10, 300).check(10, 10, 3)
    with pytest.raises(codecs.ImageError, match="bytes"):
        codecs.Limits(10, 10, 300).check(10, 10, 3, 2)


def test_gif():
    # 2 x 2, four colours, one frame with a transparent index; codes: clear 0 1 2 3 end at 3 and 4 bits
    bits, out = "", bytearray()
    for code, n in ((4, 3), (0, 3), (1, 3), (2, 3), (3, 4), (5, 4)):
        bits = f"{code:0{n}b}" + bits
    while bits:
        out.append(int(bits[-8:], 2))
        bits = bits[:-8]
    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    data = b"GIF89a\2\0\2\0\x81\0\0" + table + b"\x21\xf9\4\1\5\0\1\0" + b"\x2c\0\0\0\0\2\0\2\0\0\2" + bytes([len(out)]) + bytes(out) + b"\0;"
    p = codecs.decode(data)[0]
    assert p.samples.tolist() == [[[0, 0, 0, 255], [255, 0, 0, 0]], [[0, 255, 0, 255], [0, 0, 255, 255]]] and p.tags["gif_delay"] == "5"


def test_files_through_spark(spark, tmp_path):
    for row in images.encoded(blank(spark, 4, 3, images=2, colour=(1, 2, 3)), "png").collect():
        (tmp_path / f"{row.image_id}.png").write_bytes(row.content)
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nshort")
    lines = images.read_files(spark, f"{tmp_path}/*.png")
    assert lines.where("error is not null").count() == 1 and lines.where("error is null").count() == 6
    px = images.pixels(lines, 0).collect()
    assert len(px) == 24 and {(p.c0, p.c1, p.c2, p.c3) for p in px} == {(1, 2, 3, None)}
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.png")
    assert {r.format for r in images.probe_format(files).collect()} == {"png"}
    frames.write(frames.line_means(frames.arriving(spark, str(tmp_path), "*.png")), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 6 and {r["mean"] for r in got} == {2.0}
