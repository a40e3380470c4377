import numpy as np
import pytest

from gridloom.errors import RasterDataError
from gridloom.functions import codecs
from gridloom.operators import raster
from gridloom.plans import sizing
from gridloom.sources import raster_file as rf
from gridloom.sources import raster_source as rs
from gridloom.streaming.viewport import TileCache


def back(specs, **kw):
    src = rf.Bytes(rf.write_file(specs, **kw))
    return src, rf.read_pages(src)


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("big_endian", [False, True])
@pytest.mark.parametrize("bits,spp,comp,pred,tile,rps", [(8, 1, 1, 1, None, 2), (8, 3, 5, 1, None, None), (8, 2, 8, 2, None, 4), (8, 1, 32773, 1, (2, 2), None), (1, 1, 1, 1, None, None), (16, 3, 5, 2, (3, 2), None), (24, 1, 1, 1, None, 3), (12, 2, 8, 1, None, None), (32, 1, 32946, 1, (4, 4), None)])
def test_round_trip(big, big_endian, bits, spp, comp, pred, tile, rps):
    r = np.random.default_rng(1)
    a = r.integers(0, 2**bits, (5, 7, spp)).astype(codecs.dtype_for(bits))
    b = r.integers(0, 2**bits, (3, 4, spp)).astype(codecs.dtype_for(bits))
    src, pages = back([rf.Spec(x, bits=bits, compression=comp, predictor=pred, tile=tile, rows_per_strip=rps) for x in (a, b)], big=big, big_endian=big_endian)
    for p, x in zip(pages, (a, b), strict=True):
        assert np.array_equal(p.decode(src), x) and np.array_equal(p.decode(src), x)
        assert np.array_equal(p.decode(src, (1, 1, 2, 2)), x[1:3, 1:3])


def test_region_reads_only_its_chunks():
    a = np.arange(16, dtype=np.uint8).reshape(4, 4, 1) + 1
    src, (p,) = back([rf.Spec(a, rows_per_strip=1)])
    src.reads.clear()
    assert p.decode(src, (1, 1, 2, 2)).ravel().tolist() == [6, 7, 10, 11]
    assert src.reads == [(c[6], c[7]) for c in p.chunks()[1:3]]


def test_bad_files():
    good = rf.write_file([rf.Spec(np.ones((2, 2, 1), np.uint8))])
    for data in (b"", b"\0" * 8, good[:20], b"II*\0\x08\0\0\0\0\0\0\0\0\0", good[:4] + b"\xff\0\0\0" + good[8:]):
        with pytest.raises(RasterDataError):
            rf.read_pages(rf.Bytes(data))
    n = int.from_bytes(good[8:10], "little")
    loop = bytearray(good)
    loop[10 + 12 * n : 14 + 12 * n] = (8).to_bytes(4, "little")
    with pytest.raises(RasterDataError):
        rf.read_pages(rf.Bytes(bytes(loop)))
    with pytest.raises(ValueError):
        rf.Spec(np.ones((2, 2, 1), np.uint8), tile=(2, 2), rows_per_strip=1)
    with pytest.raises(RasterDataError):
        codecs.decode(6, b"")
    with pytest.raises(RasterDataError):
        codecs.encode(4, b"")


def test_codec_examples():
    assert codecs.packbits_decode(bytes.fromhex("02010203FDAA")) == bytes.fromhex("010203AAAAAAAA")
    assert codecs.packbits_decode(b"\x80") == b""
    assert codecs.packbits_encode(bytes([1, 2, 3, 4]) + b"\xaa" * 4) == bytes.fromhex("0301020304FDAA")
    assert codecs.difference(bytes([10, 5, 253, 28]), 4, 1, 8, undo=True) == bytes([10, 15, 12, 40])
    assert codecs.unpack_samples(b"\xb2", 8, 1).tolist() == [1, 0, 1, 1, 0, 0, 1, 0]
    r = np.random.default_rng(2)
    for n in (1, 2, 255, 2000, 70_000):
        for top in (2, 256):
            d = r.integers(0, top, n, dtype=np.uint8).tobytes()
            for code in (codecs.LZW, codecs.PACKBITS, codecs.DEFLATE):
                assert codecs.round_trip(d, code) == d


def test_geo_keys():
    p = rf.Page(0, {rf.GEO_SCALE: (2.0, 2.0, 0.0), rf.GEO_TIEPOINTS: (0, 0, 0, 5e5, 4e6, 0, 9), rf.GEO_KEYS: (1, 1, 0, 3, 1024, 0, 1, 1, 1026, rf.GEO_ASCII, 7, 0, 2057, rf.GEO_DOUBLES, 1, 0), rf.GEO_ASCII: "WGS 84|", rf.GEO_DOUBLES: (6378137.0,)})
    assert p.geo() == {"scale": [2.0, 2.0, 0.0], "tiepoints": [[0, 0, 0, 5e5, 4e6, 0]], "transform": [], "keys": {1024: 1, 1026: "WGS 84", 2057: 6378137.0}}
    assert rf.Page(0, {}).geo() is None and rf.rational((1, 0)) == 0.0


def test_planning_examples():
    assert sizing.chunk_plan(1000, 2048, 512, 3, 8, 10**9) == [(0, 512), (512, 512), (1024, 512), (1536, 512)]
    assert sizing.chunk_plan(100, 1000, 300, 1, 8, 10**9)[-1] == (900, 100)
    assert (sizing.workers(200, 50, 8), sizing.workers(200, 50, 3), sizing.workers(1, 50, 3)) == (4, 3, 1)
    assert raster.level_dims(32, 32, 8) == [(32, 32), (16, 16), (8, 8)] and raster.level_dims(32, 8, count=3) == [(32, 8), (16, 4), (8, 2)]
    assert sizing.decode_budget(None, None, 5)[0] == 512 << 20


def test_data_source_prunes(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (40, 30, 3)).astype(np.uint8)
    (tmp_path / "x.tif").write_bytes(rf.write_file([rf.Spec(a, photometric=2, compression=5, tile=(8, 8))]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(rs.TagRaster)
    load = lambda view: spark.read.format("tagraster").option("path", str(tmp_path / "x.tif")).option("view", view).load()
    assert load("pages").first().n_chunks == 20
    px = load("pixels").where("y >= 17 and y < 23 and x < 5")
    assert px.rdd.getNumPartitions() == 1
    got = {(r.x, r.y): r.samples for r in px.collect()}
    assert got == {(x, y): a[y, x].tolist() for y in range(17, 23) for x in range(5)}


def test_cache():
    c = TileCache(100)
    assert c.put("a", 60) == [] and c.put("b", 40) == [] and c.get("a")
    assert c.put("c", 30) == ["b"] and list(c.items) == ["a", "c"]
    assert c.put("big", 500) == ["a", "c"] and c.size == 500
    assert c.put("big", 10, reduction=1) == [] and c.size == 500


def load(spark, path, view):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(rs.TagRaster)
    return spark.read.format("tagraster").option("path", str(path)).option("view", view).load()


def test_views_of_many_files(spark, tmp_path):
    r = np.random.default_rng(4)
    pages = {}
    for k in range(3):
        a, b = r.integers(0, 256, (9 + k, 7, 3)).astype(np.uint8), r.integers(0, 60000, (4, 5, 1)).astype(np.uint16)
        geo = ((rf.GEO_SCALE, 12, [2.0, 2.0, 0.0]), (rf.GEO_KEYS, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 1026, rf.GEO_ASCII, 7, 0]), (rf.GEO_ASCII, 2, b"WGS 84|\0"))
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / f"f{k}.tif").write_bytes(rf.write_file([rf.Spec(a, photometric=2, tile=(4, 4), compression=8), rf.Spec(b, bits=16, rows_per_strip=2, extra=geo)], big=k == 1, big_endian=k == 2))
        pages[f"f{k}.tif", 0], pages[f"f{k}.tif", 1] = a, b
    frames = {v: (load(spark, tmp_path, v), rs.scan_rasters(spark, f"file://{tmp_path}", v)) for v in rs.VIEWS}
    for one, other in frames.values():
        assert one.schema.simpleString() == other.schema.simpleString()
        strip = lambda df: sorted(str([x if k else str(x).split("/")[-1] for k, x in enumerate(r)]) for r in df.collect())
        assert strip(one) == strip(other)
    one = {v: f[0] for v, f in frames.items()}
    assert {(r.path.split("/")[-1], r.page): (r.height, r.width, r.spp) for r in one["pages"].collect()} == {k: a.shape for k, a in pages.items()}
    assert {r.n_chunks for r in one["pages"].where("page = 1").collect()} == {2}
    tags = {(r.page, r.tag): (r.ints, r.text) for r in one["tags"].where("path like '%f0.tif'").collect()}
    assert tags[0, rf.WIDTH] == ([7], None) and tags[1, rf.GEO_ASCII] == (None, "WGS 84|")
    geo = one["geo"].collect()
    assert len(geo) == 3 and all(g.scale == [2.0, 2.0, 0.0] and g["keys"] == {1024: "1", 1026: "WGS 84"} and g.page == 1 for g in geo)
    built = {k: np.zeros_like(a) for k, a in pages.items()}
    for r in one["blocks"].collect():
        built[r.path.split("/")[-1], r.page][r.y : r.y + r.height, r.x : r.x + r.width] = np.frombuffer(r.samples, "<u2" if r.bits == 16 else np.uint8).reshape(r.height, r.width, r.spp)
    assert all(np.array_equal(built[k], pages[k]) for k in pages)
    chunk = one["chunks"].where("page = 0 and x = 4 and y = 8 and path like '%f1.tif'").first()
    assert chunk.n_bytes == len(chunk.data) and np.array_equal(np.frombuffer(codecs.decode(8, chunk.data), np.uint8).reshape(4, 4, 3)[:2, :3], pages["f1.tif", 0][8:, 4:])


def test_chunks_share_partitions(spark, tmp_path):
    a = np.zeros((2000, 40, 1), np.uint8)
    (tmp_path / "x.tif").write_bytes(rf.write_file([rf.Spec(a, rows_per_strip=1)]))
    assert load(spark, tmp_path / "x.tif", "blocks").rdd.getNumPartitions() == -(-2000 // rs.CHUNKS)
    assert load(spark, tmp_path / "x.tif", "blocks").where("y < 3").count() == 3


def test_sink_round_trip(spark, tmp_path):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for f in range(3):
        for page in range(2):
            a = r.integers(0, 2**16, (6 + f, 5, 1)).astype("<u2")
            want[f"n{f}.tif", page] = a
            rows.append((f"n{f}.tif", page, 5, 6 + f, 1, 16, bytearray(a.tobytes())))
    df = spark.createDataFrame(rows, "file string, page int, width int, height int, spp int, bits int, samples binary")
    spark.dataSource.register(rs.TagRaster)
    df.repartition("file").write.format("tagraster").options(path=str(tmp_path / "out"), compression="5", predictor="2", tile="4,4").mode("append").save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["n0.tif", "n1.tif", "n2.tif"]
    for (f, page), a in want.items():
        src = rf.Bytes(path=str(tmp_path / "out" / f))
        assert np.array_equal(rf.read_pages(src)[page].decode(src), a)
        src.close()
    with pytest.raises(Exception, match="several partitions"):
        df.repartition(6).write.format("tagraster").options(path=str(tmp_path / "bad")).mode("append").save()
    assert not list((tmp_path / "bad").iterdir())


def test_specs_are_checked():
    a = np.ones((2, 2, 1), np.uint8)
    for bad in ({"tile": (0, 4)}, {"bits": 4, "predictor": 2}, {"rows_per_strip": 0}):
        with pytest.raises(ValueError):
            rf.Spec(a, **bad)


def test_memory_probe():
    assert sizing.memory("MemTotal: 10 kB\nMemAvailable: 4 kB\n") == (10240, 4096) and sizing.memory("junk") == (None, None)
    assert sizing.memory()[0] is None or sizing.memory()[0] > 0
