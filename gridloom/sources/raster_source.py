"""Spark data source and sink "tagraster", and the same views over files of any store that Spark reads."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import RasterDataError
from ..functions import codecs, jpeg_parts
from . import raster_file as rf

VIEWS = {
    "pages": "path string, page int, width long, height long, spp int, bits int, compression int, photometric int, tiled boolean, n_chunks int, planar int, predictor int, rows_per_strip long, tile_width long, tile_height long, big_endian boolean",
    "tags": "path string, page int, directory string, tag int, count int, ints array<long>, floats array<double>, text string",
    "geo": "path string, page int, scale array<double>, tiepoints array<array<double>>, transform array<double>, keys map<int,string>",
    "chunks": "path string, page int, chunk int, x long, y long, width int, height int, valid_width int, valid_height int, offset long, n_bytes long, data binary",
    "blocks": "path string, page int, x long, y long, width int, height int, spp int, bits int, samples binary",
    "pixels": "page int, x long, y long, samples array<long>",
}
#: Chunks and samples of one input partition at most.
CHUNKS, SAMPLES = 256, 8 << 20
_HEAVY = (rf.STRIP_OFFSETS, rf.STRIP_COUNTS, rf.TILE_OFFSETS, rf.TILE_COUNTS)


@dataclass
class Part(InputPartition):
    """Files whose pages are listed, or chunks of a page (no, and Page.chunks()'s entry); stitched: the page is one stream."""

    paths: list[str]
    page: rf.Page | None = None
    chunks: list[tuple] = field(default_factory=list)
    stitched: bool = False


def find_files(path: str) -> list[str]:
    """A file, the raster files of a folder, or what a pattern matches; several by commas."""
    out = []
    for p in path.split(","):
        if "://" in p and not p.startswith("file://"):
            out.append(p)
            continue
        p = p.removeprefix("file://")
        if os.path.isdir(p):
            out += sorted(x for x in glob.glob(os.path.join(glob.escape(p), "**", "*"), recursive=True) if x.lower().endswith((".tif", ".tiff")))
        else:
            out += sorted(glob.glob(p)) or [p]
    return out


def _numbers(v) -> tuple[list | None, list | None, str | None]:
    """A tag's value as whole numbers, as floats, as text: what it is."""
    if isinstance(v, str):
        return None, None, v
    if v and isinstance(v[0], tuple):
        return None, [rf.rational(x) for x in v], None
    if v and isinstance(v[0], float):
        return None, list(v), None
    if v and isinstance(v[0], bytes):
        return list(b"".join(v)), None, None
    return [x - (1 << 64) if x >= 1 << 63 else x for x in v], None, None


def page_rows(view: str, path: str, p: rf.Page) -> Iterator[tuple]:
    """Rows of a page in the views pages, tags and geo."""
    if view == "pages":
        opt = lambda tag: None if p.one(tag) is None else int(p.one(tag))
        yield path, p.index, p.width, p.height, p.spp, p.bits, int(p.one(rf.COMPRESSION, 1)), int(p.one(rf.PHOTOMETRIC, 1)), p.tiled, len(p.tags.get(rf.TILE_OFFSETS if p.tiled else rf.STRIP_OFFSETS, ())), int(p.one(rf.PLANAR, 1)), int(p.one(rf.PREDICTOR, 1)), opt(rf.ROWS_PER_STRIP), opt(rf.TILE_WIDTH), opt(rf.TILE_HEIGHT), p.big_endian
    elif view == "tags":
        for kind, tags in (("main", p.tags), ("exif", p.exif), ("gps", p.gps)):
            for tag, v in sorted(tags.items()):
                yield path, p.index, kind, tag, len(v), *_numbers(v)
    elif (g := p.geo()) is not None:
        f = lambda x: [float(v) for v in x]
        yield path, p.index, f(g["scale"]), [f(t) for t in g["tiepoints"]], f(g["transform"]), {k: str(v) for k, v in g["keys"].items()}


def block_rows(view: str, path: str, p: rf.Page, box: tuple, px: np.ndarray) -> Iterator[tuple | pa.RecordBatch]:
    """Samples of the rectangle box (x, y) in the views blocks and pixels."""
    x, y = box
    h, w, spp = px.shape
    if view == "blocks":
        yield path, p.index, x, y, w, h, spp, p.bits, np.ascontiguousarray(px.astype(px.dtype.newbyteorder("<"))).tobytes()
        return
    ys, xs = np.mgrid[y : y + h, x : x + w]
    flat = px.reshape(-1).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, p.index, np.int32)), pa.array(xs.ravel()), pa.array(ys.ravel()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, spp, dtype=np.int32)), pa.array(flat))], names=["page", "x", "y", "samples"])


def is_stitched(p: rf.Page, chunks: list[tuple], src: rf.Bytes) -> bool:
    """Is a JPEG page one stream that is cut over its chunks? Its first one tells."""
    if int(p.one(rf.COMPRESSION, 1)) != codecs.JPEG:
        return False
    first = next((c for c in chunks if c[7]), None)
    return first is not None and not jpeg_parts.self_contained(src.read(first[6], first[7]))


class TagRaster(DataSource):
    """Options for reading: path (a file, a folder, a pattern, or several by commas), view (pages, tags, geo, chunks, blocks or
    pixels; see VIEWS). For writing: path (a folder), compression, predictor, photometric, tile ("width,height"), rows_per_strip.

    Rows to write are pages: file, page, width, height, spp, bits, samples (little endian, in the narrowest of 8, 16 and 32 bits). All
    pages of a file must be in one partition (repartition("file")).
    """

    @classmethod
    def name(cls) -> str:
        return "tagraster"

    def schema(self) -> str:
        view = self.options.get("view", "pages")
        if view not in VIEWS:
            raise ValueError(f"no view {view}; there are {', '.join(VIEWS)}")
        return VIEWS[view]

    def reader(self, schema):
        return RasterReader(self.options)

    def writer(self, schema, overwrite: bool):
        return RasterWriter(self.options, [f.name for f in schema.fields])


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.view, self.path, self.filters = options.get("view", "pages"), options["path"], []

    def pushFilters(self, filters: list[Filter]):
        """Comparisons with page, x and y choose chunks; all are given back, as a chunk holds more than asked for."""
        self.filters = [f for f in filters if isinstance(f, (EqualTo, LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and f.attribute[0] in ("page", "x", "y")]
        yield from filters

    def _may_hold(self, page: int, x: int, y: int, w: int, h: int) -> bool:
        # in the views of chunks and blocks a row's x and y are its corner's
        span = {"page": (page, page), "x": (x, x + w - 1), "y": (y, y + h - 1)} if self.view == "pixels" else {"page": (page, page), "x": (x, x), "y": (y, y)}
        for f in self.filters:
            lo, hi = span[f.attribute[0]]
            v = f.value
            if isinstance(f, EqualTo) and not lo <= v <= hi or isinstance(f, LessThan) and lo >= v or isinstance(f, LessThanOrEqual) and lo > v or isinstance(f, GreaterThan) and hi <= v or isinstance(f, GreaterThanOrEqual) and hi < v:
                return False
        return True

    def partitions(self):
        files = find_files(self.path)
        if self.view in ("pages", "tags", "geo"):
            return [Part(files[k : k + 32]) for k in range(0, len(files), 32)] or [Part([])]
        out = []
        for path in files:  # directories are read once, here; tasks get the chunks' places
            src = rf.Bytes(path=path)
            try:
                for p in rf.read_pages(src):
                    out += self._parts(path, p, src)
            finally:
                src.close()
        return out or [Part([])]

    def _parts(self, path: str, p: rf.Page, src: rf.Bytes) -> Iterator[Part]:
        chunks = p.chunks()
        some = [(k, c) for k, c in enumerate(chunks) if self._may_hold(p.index, c[0], c[1], c[4], c[5])]
        light = rf.Page(p.index, {k: v for k, v in p.tags.items() if k not in _HEAVY}, big_endian=p.big_endian)
        if self.view != "chunks" and some and is_stitched(p, chunks, src):
            yield Part([path], light, list(enumerate(chunks)), True)
            return
        held: list[tuple] = []
        size = 0
        for k, c in some:
            n = c[2] * c[3] * p.spp
            if held and (len(held) >= CHUNKS or size + n > SAMPLES):
                yield Part([path], light, held)
                held, size = [], 0
            held.append((k, c))
            size += n
        if held:
            yield Part([path], light, held)

    def read(self, part: Part) -> Iterator[tuple | pa.RecordBatch]:
        for path in part.paths:
            src = rf.Bytes(path=path)
            try:
                if part.page is None:
                    for p in rf.read_pages(src):
                        yield from page_rows(self.view, path, p)
                elif part.stitched:
                    px = part.page.stitched([src.read(c[6], c[7]) for _, c in part.chunks if c[7]])
                    for _, (x, y, _, _, w, h, _, _) in part.chunks:
                        yield from block_rows(self.view, path, part.page, (x, y), px[y : y + h, x : x + w])
                else:
                    for k, (x, y, w, h, vw, vh, at, n) in part.chunks:
                        data = src.read(at, n) if n else b""
                        if self.view == "chunks":
                            yield path, part.page.index, k, x, y, w, h, vw, vh, at, n, data
                        else:
                            yield from block_rows(self.view, path, part.page, (x, y), part.page.decode_chunk(data, w, h)[:vh, :vw])
            finally:
                src.close()


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def page_spec(row: dict, options: dict) -> rf.Spec:
    """A page to write from a row (width, height, spp, bits, samples) and the sink's options."""
    kind = np.dtype(codecs.dtype_for(row["bits"])).newbyteorder("<")
    a = np.frombuffer(row["samples"], kind)
    if a.size != row["width"] * row["height"] * row["spp"]:
        raise RasterDataError(f"{a.size} samples for a page of {row['width']}x{row['height']}x{row['spp']}")
    tile = options.get("tile")
    rows = options.get("rows_per_strip")
    return rf.Spec(
        a.astype(codecs.dtype_for(row["bits"])).reshape(row["height"], row["width"], row["spp"]), bits=row["bits"], photometric=int(options.get("photometric", 2 if row["spp"] >= 3 else 1)),
        compression=int(options.get("compression", 1)), predictor=int(options.get("predictor", 1)), tile=tuple(map(int, tile.split(","))) if tile else None, rows_per_strip=int(rows) if rows else None, extra=tuple(map(tuple, row.get("extra") or ())),
    )


class RasterWriter(DataSourceWriter):
    """Each task writes its files under names of their own; the driver gives them theirs when all tasks are done."""

    def __init__(self, options, names: list[str]):
        self.options, self.names = dict(options), names
        self.path = self.options["path"].removeprefix("file://")

    def write(self, iterator) -> Written:
        files: dict[str, list[dict]] = {}
        for r in iterator:
            row = dict(zip(self.names, r, strict=True))
            files.setdefault(row["file"], []).append(row)
        os.makedirs(self.path, exist_ok=True)
        done = []
        for name, rows in sorted(files.items()):
            if os.path.basename(name) != name or not name:
                raise RasterDataError(f"{name!r} is no file name")
            data = rf.write_file([page_spec(r, self.options) for r in sorted(rows, key=lambda r: r["page"])])
            with open(at := os.path.join(self.path, f".{name}.{uuid.uuid4().hex}"), "wb") as f:
                f.write(data)
            done.append((at, os.path.join(self.path, name)))
        return Written(done)

    def commit(self, messages) -> None:
        done = [f for m in messages if m for f in m.files]
        names = [n for _, n in done]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise RasterDataError("the pages of a file were in several partitions")
        for at, name in done:
            os.replace(at, name)

    def abort(self, messages) -> None:
        for at, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(at):
                os.remove(at)


# ---------------------------------------------------------------- files of any store


def _scan(batches: Iterator[pa.RecordBatch], view: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            src, rows = rf.Bytes(content), []
            for p in rf.read_pages(src):
                if view in ("pages", "tags", "geo"):
                    rows += page_rows(view, path, p)
                    continue
                chunks = p.chunks()
                if view == "chunks":
                    rows += [(path, p.index, k, *c[:8], src.read(c[6], c[7]) if c[7] else b"") for k, c in enumerate(chunks)]
                    continue
                whole = p.decode(src) if is_stitched(p, chunks, src) else None
                for x, y, w, h, vw, vh, at, n in chunks:
                    px = whole[y : y + vh, x : x + vw] if whole is not None else p.decode_chunk(src.read(at, n) if n else b"", w, h)[:vh, :vw]
                    for got in block_rows(view, path, p, (x, y), px):
                        if isinstance(got, pa.RecordBatch):
                            yield got
                        else:
                            rows.append(got)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def scan_rasters(spark: SparkSession, path: str, view: str = "pages", pattern: str = "*.tif*") -> DataFrame:
    """The views of TagRaster over all files that Spark finds under a path, in any store that it reads. A file is read whole by one
    task; for large local files the data source reads chunk by chunk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    fields = spark.createDataFrame([], VIEWS[view]).schema
    return files.mapInArrow(partial(_scan, view=view, schema=to_arrow_schema(fields)), fields)
