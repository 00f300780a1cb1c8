"""Stacks whose last images have fewer rows than the others, against SQL."""

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from rasterloom import queries
from rasterloom.model import HEIGHT, WIDTH, from_embeddings
from rasterloom.operators import quantize

SHORT = {1: 31, 2: 6}
FILES = ["file_pnm", "file_bmp", "file_tga", "file_png", "file_sgi", "file_tiff", "file_tga_alpha", "file_png_alpha", "file_sgi_alpha", "file_tiff_alpha", "file_ico_alpha", "file_cur_alpha", "probe_format"]
JOINS = ["box_fill", "channel_mask", "compose_mask", "masked_view_write", "opacity_fill", "transform2_getp3"]
STENCILS = ["bumpmap", "gaussian", "gaussian2", "gaussian2_both", "unsharpmask", "haar"]
SCALES = ["scale_lanczos", "scale_lanczos_alpha", "scale_mixing"]


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """A folder with short images, and one where the same images are whole."""
    ids = [50 * i + y for i in range(3) for y in range(HEIGHT)]
    vectors = [[((v * 37 + k * 11) % 200 - 100) / 150 for k in range(WIDTH)] for v in ids]
    whole = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())})
    kept = [v % HEIGHT < SHORT.get(v // HEIGHT, HEIGHT) for v in ids]
    out = []
    for name, table in (("short", whole.filter(pa.array(kept))), ("whole", whole)):
        out.append(str(tmp_path_factory.mktemp(name)))
        pq.write_table(table, f"{out[-1]}/embeddings.parquet")
    assert pc.sum(pa.array(kept)).as_py() == 87
    return out


@pytest.mark.parametrize("name", FILES + JOINS + STENCILS + SCALES)
def test_query(spark, folders, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{folders[0]}/embeddings.parquet')")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, folders[0]).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["quant_errdiff", "quant_transparent_errdiff"])
def test_error_diffusion(spark, folders, name):
    """Errors go downwards, so a short image is the top of the whole one."""
    short, whole = (set(map(tuple, queries.QUERIES[name](spark, f).collect())) for f in folders)
    assert short == {p for p in whole if p[1] < SHORT.get(p[0], HEIGHT)} and len(short) == 87 * WIDTH


def test_diffusion_passes_over_holes(spark, folders):
    """What falls on a place without a pixel is lost: of a row, each second pixel gets no share of the one before."""
    r = from_embeddings(spark, folders[0]).with_px(from_embeddings(spark, folders[0]).px.where("y = 0 and x % 2 = 0"))
    got = {p.x: p.c0 for p in quantize.error_diffusion(r, [(0, 0, 0), (255, 255, 255)]).px.where("image_id = 0").collect()}
    assert len(got) == WIDTH // 2
    for p in r.px.where("image_id = 0").collect():
        assert got[p.x] == (sum(c * c for c in p[3:6]) > sum((255 - c) ** 2 for c in p[3:6]))
