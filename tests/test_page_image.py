import numpy as np
import pytest

from gridloom.errors import RasterDataError
from gridloom.plans import rungs
from gridloom.plans.rungs import Overview, Rung
from gridloom.sources import page_image as pi
from gridloom.sources import raster_file as rf


def page(samples, **kw):
    src = rf.Bytes(rf.write_file([rf.Spec(np.asarray(samples), **kw)]))
    return rf.read_pages(src)[0], src


def rgba(samples, **kw):
    p, src = page(samples, **kw)
    return pi.to_rgba(p, p.decode(src))


def u8(*rows):
    return np.array(rows, np.uint8)


def test_colours():
    assert rgba(u8([[0], [255]]), photometric=0).tolist() == [[[255, 255, 255, 255], [0, 0, 0, 255]]]
    assert rgba(u8([[10, 20, 30, 128]]), photometric=2).tolist() == [[[10, 20, 30, 128]]]
    assert rgba(np.array([[[0], [65535], [32768]]], np.uint16), photometric=1, bits=16)[0, :, 0].tolist() == [0, 255, 128]
    assert rgba(u8([[0], [1]]), photometric=3, bits=1, color_map=[0, 65535, 65535, 0, 0, 0]).tolist() == [[[0, 255, 0, 255], [255, 0, 0, 255]]]
    assert rgba(u8([[255, 0, 0, 0]]), photometric=5).tolist() == [[[0, 255, 255, 255]]]
    p, src = page(u8([[128, 128, 128]]), photometric=6)
    with pytest.raises(RasterDataError):
        pi.to_rgba(p, p.decode(src))
    p.tags[pi.SUBSAMPLING] = (1, 1)
    assert pi.to_rgba(p, p.decode(src)).tolist() == [[[128, 128, 128, 255]]]
    for kw in ({"photometric": 4}, {"photometric": 2}, {"photometric": 3}):
        with pytest.raises(RasterDataError):
            rgba(u8([[1]]), **kw)


def test_box_reduce():
    assert pi.box_reduce(u8([[10], [20], [20], [40], [70]]), 2, 1).ravel().tolist() == [15, 43]
    a = np.random.default_rng(1).integers(0, 256, (21, 30, 4)).astype(np.uint8)
    got = pi.box_reduce(a, 7, 5)
    for y in range(5):
        for x in range(7):
            cell = a[y * 21 // 5 : (y + 1) * 21 // 5, x * 30 // 7 : (x + 1) * 30 // 7].reshape(-1, 4).astype(int)
            assert got[y, x].tolist() == [(2 * s + len(cell)) // (2 * len(cell)) for s in cell.sum(0).tolist()]
    assert pi.box_reduce(a, 30, 21) is a
    with pytest.raises(ValueError):
        pi.box_reduce(a, 31, 21)


def pattern(w, h):
    y, x = np.mgrid[:h, :w]
    return np.stack([3 * x % 256, 5 * y % 256, (x + y) % 256], 2).astype(np.uint8)


@pytest.mark.parametrize("w,h,to", [(32, 32, (16, 16)), (30, 21, (7, 5)), (40, 40, (9, 9))])
def test_bands_equal_whole(w, h, to):
    p, src = page(pattern(w, h), photometric=2, tile=(8, 8))
    whole = pi.box_reduce(pi.to_rgba(p, p.decode(src)), *to)
    for band in (160, 2000, 1 << 20):
        assert np.array_equal(pi.reduce_page(p, src, *to, band_bytes=band), whole)


def sizes(data):
    return [(p.width, p.height) for p in rf.read_pages(rf.Bytes(data))]


def test_pyramid_files():
    a = pattern(32, 32)
    p, src = page(a, photometric=2)
    make = lambda **kw: pi.pyramid_file(p, src, tile=16, least=8, **kw)
    full = make()
    assert sizes(full) == [(32, 32), (16, 16), (8, 8)]
    pages = rf.read_pages(rf.Bytes(full))
    assert np.array_equal(pages[0].decode(rf.Bytes(full)), a) and pages[0].tiled
    assert np.array_equal(pages[2].decode(rf.Bytes(full)), pi.box_reduce(pi.box_reduce(a, 16, 16), 8, 8))
    assert sizes(make(mode="tiled_only")) == [(32, 32)] and sizes(make(mode="levels_only")) == [(16, 16), (8, 8)]
    assert sizes(make(count=2)) == [(32, 32), (16, 16)] and sizes(make(mode="levels_only", count=1)) == [(16, 16)]
    assert sizes(make(mode="large_levels", direct_pixels=100)) == [(8, 8)] and make(mode="large_levels") == make(mode="levels_only")
    for bad in ({"mode": "levels_only", "least": 32}, {"count": 0}, {"band_bytes": 0}, {"mode": "x"}):
        with pytest.raises(ValueError):
            pi.pyramid_file(p, src, **{"tile": 16, "least": 8} | bad)


def test_many_files(spark, tmp_path):
    rows = []
    for k in range(3):
        (tmp_path / f"{k}.tif").write_bytes(rf.write_file([rf.Spec(pattern(20 + k, 9), photometric=2)]))
        rows.append((str(tmp_path / f"{k}.tif"), str(tmp_path / f"{k}.out"), 0))
    out = pi.build_pyramids(spark.createDataFrame(rows, "path string, target string, page int"), tile=16, least=10).orderBy("target").collect()
    assert [r.levels for r in out] == [2, 2, 3] and not list(tmp_path.glob("*.part"))
    assert [sizes((tmp_path / f"{k}.out").read_bytes())[1] for k in range(3)] == [(10, 4), (10, 4), (11, 4)]


def test_image_structs():
    a = np.random.default_rng(2).integers(0, 256, (3, 5, 4)).astype(np.uint8)
    p, src = page(a, photometric=2)
    image = pi.to_image(p, src, "x")
    assert image["mode"] == 24 and list(image["data"][:4]) == a[0, 0, [2, 1, 0, 3]].tolist()
    assert np.array_equal(pi.to_spec(image, keep_alpha=True).samples, a) and np.array_equal(pi.to_spec(image).samples, a[:, :, :3])
    grey = {"height": 1, "width": 2, "nChannels": 1, "mode": 0, "data": b"\x01\x02"}
    assert pi.to_spec(grey).samples.tolist() == [[[1, 1, 1], [2, 2, 2]]]
    with pytest.raises(RasterDataError):
        pi.to_spec(grey | {"mode": 5})


def test_rungs():
    base = Rung(1024, 784, (16, 16))
    down = lambda w, h: rungs.rung_downsample(Rung(w, h, (16, 16)), base)
    assert down(128, 112) == (8, 8) and down(64, 64) == (16, 16) and down(512, 392) == (2, 2) and down(99, 50) is None and down(1024, 784) is None
    assert rungs.rung_downsample(Rung(300, 240), base) == (1024 / 300, 784 / 240)
    pages = [Rung(800, 800), Rung(100, 100), Rung(200, 200), Rung(400, 400), Rung(400, 401)]
    assert [r.width for r in rungs.find_rungs(pages)] == [800, 400, 200, 100] and rungs.find_rungs(pages)[1] == pages[3]
    wide = [Rung(800, 400), Rung(400, 200), Rung(200, 100)]
    assert rungs.plan_overview(wide, 300) == Overview(1, 300, 150) and rungs.plan_overview(wide, 900) == Overview(0, 800, 400)
    assert rungs.plan_overview([Rung(20000, 10000, (512, 512))]).sparse and not rungs.plan_overview([Rung(20000, 10000)]).sparse


def test_describe():
    levels, plan, over = rungs.describe([Rung(8192, 4096, rows_per_strip=16)])
    assert [x.rung for x in levels] == [0, -1] and plan == Overview(0, 4096, 2048) and over.downsample_x == 2.0 and levels[0].tile_width == 4096 and levels[0].strips
    levels, plan, _ = rungs.describe([Rung(8192, 4096), Rung(2048, 1024)])
    assert len(levels) == 2 and plan == Overview(1, 1024, 512)
    assert len(rungs.describe([Rung(20000, 10000, (512, 512))])[0]) == 1
    assert rungs.native_jpeg(Rung(9, 9, (8, 8), compression=7)) and not rungs.native_jpeg(Rung(9, 9, compression=7)) and not rungs.native_jpeg(Rung(9, 9, (8, 8), compression=7, spp=1))
    assert rungs.band_rows(Rung(1000, 5000, rows_per_strip=100)) == 2300 and rungs.band_rows(Rung(10, 9000, rows_per_strip=9000)) == 4096 and rungs.band_rows(Rung(10**7, 50, rows_per_strip=50)) == 1
    p, _ = page(pattern(40, 30), photometric=2, tile=(16, 8))
    assert Rung.of(p) == Rung(40, 30, (16, 8), 30)
