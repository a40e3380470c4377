"""Queries over rasters derived from the tables, each with its SQL equivalent.

orders -> pixels: x = key % 128, y = key div 128 (full rows only); r, g the low bytes of the price, b of the customer.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import color, raster
from ..streaming import viewport
from . import detail, rungs, sizing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_P = """p0 as (select o_orderkey as k, o_custkey as c, cast(floor(o_totalprice) as bigint) as t from orders),
p as (select cast(k % 128 as bigint) as x, cast(k // 128 as bigint) as y, t % 256 as r, (t // 256) % 256 as g, c % 256 as b, cast(255 as bigint) as a
      from p0 where k < (select count(*) // 128 * 128 from orders))"""


def orders_pixels(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("t"))
    full = spark.read.parquet(f"{d}/orders.parquet").count() // 128 * 128
    return o.where(F.col("o_orderkey") < full).selectExpr("o_orderkey % 128 as x", "o_orderkey div 128 as y", "t % 256 as r", "(t div 256) % 256 as g", "o_custkey % 256 as b", "255L as a")


def rows_of(spark: SparkSession, d: str) -> int:
    return spark.read.parquet(f"{d}/orders.parquet").count() // 128


def query(name: str, sql: str | None, over: Callable | None = orders_pixels):
    def put(f):
        QUERIES[name] = (lambda spark, d: f(over(spark, d))) if over else f
        if sql:
            ORACLES[name] = sql if over is None else f"with {_P} {sql}"
        return f

    return put


def _shown(px: DataFrame, rgba: tuple) -> DataFrame:
    return px.select("x", "y", *[c.alias(n) for c, n in zip(rgba, "rgba", strict=True)])


_box = "cast((2 * sum({0}) + count(*)) // (2 * count(*)) as bigint) as {0}"
_means = ", ".join(_box.format(c) for c in "rgba")
_byte = "cast(greatest(0, least(255, round({}))) as bigint)"

# ---------------------------------------------------------------- pixels

query("region_crop", "select x - 10 as x, y - 5 as y, r, g, b, a from p where x >= 10 and x < 74 and y >= 5 and y < 9")(lambda p: raster.crop(p, 10, 5, 64, 4))
query("sample_at", "select r, g from p where x = 17 and y = 3")(lambda p: raster.sample_at(p, 17, 3, ("r", "g")))
query("color_gray_invert", "select x, y, 255 - r as r, 255 - r as g, 255 - r as b, cast(255 as bigint) as a from p")(lambda p: _shown(p, color.gray(F.col("r"), invert=True)))
_g16 = _byte.format("(r * 256 + g) * 255e0 / 65535e0")
query("color_gray16", f"select x, y, {_g16} as r, {_g16} as g, {_g16} as b, cast(255 as bigint) as a from p")(lambda p: _shown(p, color.gray(F.col("r") * 256 + F.col("g"), 16)))
query("color_rgb_alpha", "select x, y, r, g, b, g as a from p")(lambda p: _shown(p, color.rgb(F.col("r"), F.col("g"), F.col("b"), F.col("g"))))
query("drop_alpha", "select x, y, r, g, b from p")(raster.drop_alpha)
query("color_palette", "select x, y, (r % 16) * 4369 // 256 as r, (15 - r % 16) * 4369 // 256 as g, (r % 16) * 17 // 256 as b, cast(255 as bigint) as a from p")(
    lambda p: _shown(p, color.palette(F.col("r") % 16, F.array(*[F.lit(v).cast("long") for v in [*(i * 4369 for i in range(16)), *((15 - i) * 4369 for i in range(16)), *(i * 17 for i in range(16))]]), 4))
)
_cmyk = ", ".join(_byte.format(f"255e0 * (1 - {c} / 255e0) * (1 - a2 / 255e0)") + f" as {n}" for c, n in zip("rgb", "rgb", strict=True))
query("color_cmyk", f"select x, y, {_cmyk}, cast(255 as bigint) as a from (select *, (r + g) % 256 as a2 from p)")(lambda p: _shown(p, color.cmyk(F.col("r"), F.col("g"), F.col("b"), (F.col("r") + F.col("g")) % 256)))
query("color_ycbcr", f"select x, y, {_byte.format('r + 1.402e0 * (b - 128)')} as r, {_byte.format('r - 0.344136e0 * (g - 128) - 0.714136e0 * (b - 128)')} as g, {_byte.format('r + 1.772e0 * (g - 128)')} as b, cast(255 as bigint) as a from p")(
    lambda p: _shown(p, color.ycbcr(F.col("r"), F.col("g"), F.col("b")))
)
_adj = "(pow({} / 255e0, 1e0 / 1.1e0) * 255e0 - 127.5e0) * 1.2e0 + 127.5e0 + 10e0"
query("adjust_bcg", "select x, y, " + ", ".join(_byte.format(_adj.format(c)) + f" as {c}" for c in "rgb") + ", a from p")(lambda p: p.select("x", "y", *[color.adjust(F.col(c), 10.0, 1.2, 1.1).alias(c) for c in "rgb"], "a"))
query("adjust_identity", "select x, y, r, g, b, a from p")(lambda p: p.select("x", "y", *[color.adjust(F.col(c)).alias(c) for c in "rgb"], "a"))


def _sparse(spark, d):
    p, h = orders_pixels(spark, d), rows_of(spark, d)
    grid = spark.range(h).select(F.col("id").alias("y")).select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(127).cast("long"))).alias("x"))
    out = raster.fill_sparse(p.where("(x div 16 + y div 16) % 3 <> 0"), grid, ("r",))
    return out.select("x", "y", (255 - F.col("r")).alias("v"))


query("sparse_fill", f"with {_P} select x, y, 255 - case when (x // 16 + y // 16) % 3 <> 0 then r else 0 end as v from p", None)(_sparse)
query("bit_unpack", "select x, y, cast(i as bigint) as i, (r >> (7 - i)) & 1 as bit from p, range(8) t(i)")(
    lambda p: raster.unpack_bits(p, "r")
)
query("bit_pack", "select y, x // 8 as byte, cast(sum((r & 1) << (7 - x % 8)) as bigint) as v from p group by all")(lambda p: raster.pack_bits(p, "r"))

# ---------------------------------------------------------------- resampling

query("pyramid_half", f"select y // 2 as y, x // 2 as x, {_means} from p group by 1, 2")(raster.halve)
query("resample_general", f"with {_P}, n as (select count(*) // 128 as h, greatest(1, count(*) // 128 // 3) as o from orders) select (y * o + o - 1) // h as y, (x * 50 + 49) // 128 as x, {_means} from p, n group by 1, 2", None)(
    lambda s, d: raster.box_resample(orders_pixels(s, d), 128, h := rows_of(s, d), 50, max(1, h // 3))
)


def _level(k: int, src: str) -> str:
    return f"l{k} as (select (y * h{k} + h{k} - 1) // h{k - 1} as y, (x * {128 >> k} + {(128 >> k) - 1}) // {256 >> k} as x, {_means} from {src}, dims group by 1, 2, h{k}, h{k - 1})"


_dims = "dims as (select h0, h1, h2, greatest(1, h2 // 2) as h3 from (select *, greatest(1, h1 // 2) as h2 from (select *, greatest(1, h0 // 2) as h1 from (select count(*) // 128 as h0 from orders))))"
_pyr = f"{_dims}, {_level(1, 'p')}, {_level(2, 'l1')}, {_level(3, 'l2')}"
_up = " union all ".join(f"select cast({k} as bigint) as level, x, y, r, g, b, a from l{k}" for k in (1, 2, 3))
query("pyramid_levels", f"with {_P}, {_pyr} select cast(0 as bigint) as level, x, y, r, g, b, a from p union all {_up}", None)(lambda s, d: raster.pyramid(orders_pixels(s, d), 128, rows_of(s, d), 4))
query("pyramid_levels_only", f"with {_P}, {_pyr} {_up}", None)(lambda s, d: raster.pyramid(orders_pixels(s, d), 128, rows_of(s, d), 4, base=False))
_asm = ", ".join(f"cast((sum({c}) + count(*) // 2) // count(*) as bigint) as {c}" for c in "rgba")
query("assemble_region", f"select y // 16 as y, x // 16 as x, {_asm} from (select x - 8 as x, y - 2 as y, r, g, b, a from p where x >= 8 and x < 104 and y >= 2 and y < 10) where x % 2 = 0 and y % 2 = 0 group by 1, 2")(lambda p: raster.assemble_region(p, 8, 2, 96, 8, 4))
query("sparse_overview", f"with {_P}, t as (select (count(*) // 128 + 7) // 8 as n from orders) select x, y, r, x // 8 as tile_x, y // 8 as tile_y from p, t where x // 8 in (0, 4, 8, 12) and y // 8 in (0, n // least(n, 4), 2 * n // least(n, 4), 3 * n // least(n, 4))", None)(
    lambda s, d: raster.sparse_overview(orders_pixels(s, d), 16, -(-rows_of(s, d) // 8), 8, 4).select("x", "y", "r", "tile_x", "tile_y")
)
query("tile_stats", "select y // 16 as ty, x // 16 as tx, count(*) as n, min(r) as lo, max(r) as hi, cast(sum(r) as bigint) as total from p group by 1, 2")(lambda p: raster.tile_stats(p, 16))
query("zonal_mean", "select l_partkey % 64 as x, l_suppkey % 64 as y, count(*) as n, cast((2 * sum(cast(l_quantity as bigint)) + count(*)) // (2 * count(*)) as bigint) as v from lineitem group by 1, 2", None)(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_partkey % 64 as x", "l_suppkey % 64 as y", "cast(l_quantity as bigint) as v").groupBy("x", "y").agg(F.count("*").alias("n"), raster._mean("v"))
)
query("progress_fraction", "select step, cast(sum(units) over (order by step) as double) / sum(units) over () as fraction from (select y as step, cast(sum(r) as bigint) as units from p group by y)")(
    lambda p: viewport.running_share(p.groupBy(F.col("y").alias("step")).agg(F.sum("r").alias("units")))
)

# ---------------------------------------------------------------- windows

query("predictor_apply", "select x, y, ((r - coalesce(lag(r) over (partition by y order by x), 0)) % 256 + 256) % 256 as r from p")(lambda p: raster.apply_predictor(p, ("r",)))
query("predictor_undo", "select x, y, cast(sum(r) over (partition by y order by x) as bigint) % 256 as r from p")(lambda p: raster.undo_predictor(p, ("r",)))
query("predictor_round_trip", "select x, y, r, g from p")(lambda p: raster.undo_predictor(raster.apply_predictor(p, ("r", "g")), ("r", "g")))
_runs = "select y, v as value, min(x) as first_x, count(*) as n from (select y, x, v, row_number() over (partition by y order by x) - row_number() over (partition by y, v order by x) as i from (select x, y, r // 64 as v from p)) group by y, v, i"
query("packbits_runs", _runs)(lambda p: raster.runs(p.selectExpr("x", "y", "r div 64 as v"), "v"))
query(
    "packbits_len",
    f"""select y, cast(sum(case when k = 1 then m + (m + 127) // 128 else 2 * m end) as bigint) as n_bytes from (
    select y, k, g, case when k = 1 then count(*) else sum(n // 128 + case when n % 128 >= 2 then 1 else 0 end) end as m from (
    select y, n, case when n = 1 then 1 else 2 end as k, sum(case when n = 1 then 0 else 1 end) over (partition by y order by first_x) as g from ({_runs})) group by y, k, g) group by y""",
)(lambda p: raster.packbits_length(raster.runs(p.selectExpr("x", "y", "r div 64 as v"), "v")))
query("chunk_offsets", "select part, strip, n, cast(sum(n) over (partition by part order by strip) - n + 8 as bigint) as \"offset\" from (select y // 4 as part, y as strip, cast(sum(r) as bigint) as n from p group by all)")(
    lambda p: raster.chunk_offsets(p.groupBy(F.expr("y div 4").alias("part"), F.col("y").alias("strip")).agg(F.sum("r").alias("n")), "n", "part", "strip", 8)
)
query("strip_rows", "select strip, cast(sum(n) over (order by strip) - n as bigint) as first_row, n from (select y // 3 as strip, count(distinct y) as n from p group by 1)")(
    lambda p: raster.strip_rows(p, 3)
)
_pages = "select p_partkey as src, p_size * 40 as w, p_size * 30 + p_partkey % 7 as h from part"
_parts = lambda s, d: s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as src", "p_size * 40 as w", "cast(p_size * 30 + p_partkey % 7 as bigint) as h")
query("max_by_width", f"select src, w, h from (select *, row_number() over (partition by w order by src) as k from ({_pages})) where k = 1", None)(lambda s, d: raster.one_per_width(_parts(s, d)))

# ---------------------------------------------------------------- planning and level of detail

query("chunk_plan", "select src, cast(y as bigint) as y, least(16, h - y) as height, least(16, h - y) * w * 7 as n_bytes from (" + _pages + "), range(0, 3000, 16) t(y) where y < h", None)(lambda s, d: sizing.chunk_bands(_parts(s, d), 16, 3, 8, 4 * sizing.MIB))
query("worker_count", f"select src, cast(greatest(1, least(200000000 // (w * h * 7), 8)) as bigint) as workers from ({_pages})", None)(lambda s, d: _parts(s, d).select("src", sizing.workers_column(200_000_000, F.col("w") * F.col("h") * sizing.bytes_per_pixel(3, 8), 8).alias("workers")))
query("level_dims", f"select src, cast(level as bigint) as level, cast(greatest(1, w // (1 << level)) as bigint) as width, cast(greatest(1, h // (1 << level)) as bigint) as height from ({_pages}), range(3) t(level)", None)(lambda s, d: raster.level_sizes(_parts(s, d), 3))
query("initial_view", f"""select src, cast((w - vw) // 2 as bigint) as vx, cast((h - vh) // 2 as bigint) as vy, vw, vh from (
    select *, cast(least(w, greatest(1, round(ww * f))) as bigint) as vw, cast(least(h, greatest(1, round(hh * f))) as bigint) as vh from (
    select *, case when ww * hh > 100000 then sqrt(100000e0 / (ww * hh)) else 1e0 end as f from (select *, least(600e0, w) as ww, least(400e0, h) as hh from ({_pages}))))""", None)(
    lambda s, d: _parts(s, d).select("src", *[c.alias(n) for n, c in sizing.initial_view(F.col("w"), F.col("h"), 600, 400, budget=100_000).items() if n != "zoom"])
)
_scales = "select event_id, value + 1 as scale from events"
_events = lambda s, d: s.read.parquet(f"{d}/events.parquet")
_scaled = lambda s, d: _events(s, d).selectExpr("event_id", "value + 1 as scale")
_span = "case " + " ".join(f"when scale * {1 << s} >= 64 then {s}" for s in range(10)) + " else 10 end"
query("select_span", f"select event_id, cast({_span} as bigint) as span from ({_scales})", None)(lambda s, d: _scaled(s, d).select("event_id", sizing.select_span(F.col("scale")).alias("span")))
query("select_reduction", f"select event_id, cast(case when scale / 50 * 8 <= 1.3e0 then 3 when scale / 50 * 4 <= 1.3e0 then 2 when scale / 50 * 2 <= 1.3e0 then 1 else 0 end as bigint) as reduction from ({_scales})", None)(
    lambda s, d: _scaled(s, d).select("event_id", sizing.select_reduction(F.col("scale") / 50).alias("reduction"))
)
query("target_level", f"select event_id, coalesce(max(case when scale / 100 * ds <= 1.3e0 then lvl end), 0) as level from ({_scales}), (select cast(i as bigint) as lvl, (1 << i) as ds from range(6) t(i)) group by 1", None)(
    lambda s, d: _scaled(s, d).select("event_id", detail.target_level(F.col("scale") / 100, [1 << k for k in range(6)]).alias("level"))
)
query("visible_tiles", f"select event_id, greatest(0, least(15, cast(floor(scale / 8) as bigint) - 1)) as t0, greatest(0, least(15, cast(floor((scale + 20) / 8) as bigint) + 1)) as t1 from ({_scales})", None)(
    lambda s, d: _scaled(s, d).select("event_id", *[c.alias(n) for c, n in zip(raster.visible_range(F.col("scale"), F.lit(20), 8, F.lit(16), 1), ("t0", "t1"), strict=True)])
)
query("reduced_extent", f"select src, cast((w + 7) // 8 as bigint) as w3, cast((h + 3) // 4 as bigint) as h2 from ({_pages})", None)(lambda s, d: _parts(s, d).select("src", sizing.reduced_extent(F.col("w"), 3).alias("w3"), sizing.reduced_extent(F.col("h"), 2).alias("h2")))
_tiles = "select i % 40 as tx, i // 40 as ty from range(1600) t(i)"
_near = "select tx, ty, ring, seg from (select *, case when ty - 11 = -ring then 0 when ty - 11 = ring then 1 when tx - 17 = -ring then 2 else 3 end as seg from (select cast(tx as bigint) as tx, cast(ty as bigint) as ty, cast(greatest(abs(tx - 17), abs(ty - 11)) as bigint) as ring from (" + _tiles + ")))"
_grid = lambda s, d: s.range(1600).selectExpr("id % 40 as tx", "id div 40 as ty")
query("nearest_tiles", f"select tx, ty, ring, cast(seg as bigint) as seg from ({_near}) order by ring, seg, case when seg < 2 then tx else ty end limit 77", None)(lambda s, d: raster.nearest_tiles(_grid(s, d), 17, 11, 77).select("tx", "ty", "ring", "seg"))
query("prefetch_ring", "select tx, ty, ring from (" + _near + ") where ring <= 6 and not (tx between 14 and 20 and ty between 9 and 13)", None)(
    lambda s, d: raster.nearest_tiles(_grid(s, d).where("greatest(abs(tx - 17), abs(ty - 11)) <= 6"), 17, 11, 10_000, exclude=_grid(s, d).where("tx between 14 and 20 and ty between 9 and 13")).select("tx", "ty", "ring")
)
query("region_tiles_join", "select e.id, t.ty, t.tx, t.total from (select o_orderkey as id, o_custkey % 100 as x, o_orderkey % 5 as y from orders where o_orderkey % 50 = 0) e join (select y // 16 as ty, x // 16 as tx, cast(sum(r) as bigint) as total from p group by 1, 2) t on tx * 16 < x + 40 and tx * 16 + 16 > x and ty * 16 < y + 9 and ty * 16 + 16 > y".join([f"with {_P} ", ""]), None)(
    lambda s, d: raster.tiles_of_regions(s.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 50 = 0").selectExpr("o_orderkey as id", "o_custkey % 100 as x", "o_orderkey % 5 as y", "40 as width", "9 as height"), 16).join(raster.tile_stats(orders_pixels(s, d), 16), ["tx", "ty"]).select("id", "ty", "tx", "total")
)
query("needs_fetch", "select distinct user_id, event_type from events e where not exists (select 1 from events c where c.user_id = e.user_id and c.event_type = e.event_type and c.event_id % 3 = 0)", None)(
    lambda s, d: raster.needs_fetch(_events(s, d).select("user_id", "event_type").distinct(), _events(s, d).where("event_id % 3 = 0"), on=["user_id", "event_type"])
)
query("zoom_label", "select src, case when z >= 10 then printf('%.0f%%', z) when z >= 1 then printf('%.1f%%', z) else printf('%.2f%%', z) end as label from (select p_partkey as src, (p_partkey % 997) / 7e0 as z from part)", None)(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as src", "(p_partkey % 997) / 7.0D as z").select("src", sizing.zoom_label(F.col("z") / 100).alias("label"))
)

# ---------------------------------------------------------------- events

query("debounce_last", "select user_id, event_id as last_event, ts as last_ts from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is null or nxt > ts + interval 8 hour", None)(lambda s, d: viewport.debounce(_events(s, d), "8 hours"))
query("throttle_window", "select time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as window_start, max(struct_pack(t := ts, e := event_id)).e as last_event from events group by 1", None)(lambda s, d: viewport.throttle(_events(s, d), "6 hours"))
query("latest_version", "select user_id, max(struct_pack(t := ts, e := event_id)).e as version from events group by 1", None)(lambda s, d: viewport.latest(_events(s, d), "user_id"))
query("lru_state", None, None)(lambda s, d: viewport.cache_batch(_events(s, d).selectExpr("user_id", "ts", "event_id", "event_type as tile", "cast(100 + value as bigint) as size"), 400))

# ---------------------------------------------------------------- bytes


_steps = f"select src, 0 as rung, w, h from ({_pages}) union all select src, 1, greatest(1, w // 2), greatest(1, h // 2) from ({_pages}) union all select src, 2, greatest(1, w // 4), greatest(1, h // 4) from ({_pages})"
query("plan_overview", f"""select src, cast(rung as bigint) as rung, cast(greatest(1, round(w * s)) as bigint) as width, cast(greatest(1, round(h * s)) as bigint) as height
from (select *, least(1::double, 300::double / greatest(w, h)) as s, row_number() over (partition by src order by case when greatest(w, h) >= 300 then 10 + rung else -rung end desc) as k from ({_steps})) where k = 1""", None)(
    lambda s, d: rungs.overview_plans(_parts(s, d).select("src", F.explode(F.expr("transform(sequence(0, 2), i -> struct(i as rung, greatest(1L, w div cast(pow(2, i) as int)) as w, greatest(1L, h div cast(pow(2, i) as int)) as h))")).alias("r")).select("src", "r.*"), 300)
)
def _digest(df: DataFrame, text: str, key: str, code: int) -> DataFrame:
    data = df.select(F.col(key).alias("id"), F.encode(text, "UTF-8").alias("data"))
    back = codecs.map_bytes(data, "data", partial(codecs.round_trip, code=code))
    return back.select("id", F.md5("data").alias("digest"), F.octet_length("data").cast("bigint").alias("n"))


for _name, _code in (("packbits", codecs.PACKBITS), ("lzw", codecs.LZW), ("deflate", codecs.DEFLATE)):
    query(f"{_name}_roundtrip", "select page_id as id, md5(html) as digest, cast(octet_length(encode(html)) as bigint) as n from pages", None)(lambda s, d, c=_code: _digest(s.read.parquet(f"{d}/pages.parquet"), "html", "page_id", c))


#: Rows of pixels of one file of the queries that write files.
BAND = 64


def _bands(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of orders as pages of BAND rows, to be written: file, page, width, height, spp, bits, samples."""
    px = orders_pixels(spark, d).selectExpr("y div %d as band" % BAND, "x", "y", "r", "g", "b")
    schema = "file string, page int, width int, height int, spp int, bits int, samples binary"

    def page(key, t):
        band, x, y = key[0].as_py(), t.column("x").to_numpy(), t.column("y").to_numpy()
        h = int(y.max()) % BAND + 1
        a = np.zeros((h, 128, 3), np.uint8)
        for k, c in enumerate("rgb"):
            a[y % BAND, x, k] = t.column(c).to_numpy()
        return pa.table({"file": [f"band-{band:09d}.tif"], "page": pa.array([0], pa.int32()), "width": pa.array([128], pa.int32()), "height": pa.array([h], pa.int32()), "spp": pa.array([3], pa.int32()), "bits": pa.array([8], pa.int32()), "samples": pa.array([a.tobytes()], pa.binary())})

    return px.groupBy("band").applyInArrow(page, schema)


def _written(spark: SparkSession, pages: DataFrame, **options: str) -> str:
    """Writes pages through the sink, a task per file, to a folder that driver and executors share; returns it."""
    from ..sources import raster_source

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared and "://" in shared and not shared.startswith("file://"):
        raise ValueError(f"files are written to a mounted folder, not to {shared}")
    folder = os.path.join(shared.removeprefix("file://") if shared else tempfile.mkdtemp(prefix="gridloom-"), f"rasters-{uuid.uuid4().hex}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(raster_source.TagRaster)
    pages.repartition("file").write.format("tagraster").options(path=folder, **options).mode("append").save()
    return folder


def _view(spark: SparkSession, folder: str, view: str) -> DataFrame:
    return spark.read.format("tagraster").option("path", folder).option("view", view).load()


def _file_scan(spark: SparkSession, d: str) -> DataFrame:
    """All pixels of orders, written as tiled files of BAND rows by the executors, and read back."""
    folder = _written(spark, _bands(spark, d), compression=str(codecs.LZW), predictor="2", tile="32,16")
    scan = spark.read.format("tagraster").option("view", "blocks")
    blocks = scan.option("path", folder).load().select(F.regexp_extract("path", r"band-(\d+)", 1).cast("long").alias("band"), "x", "y", "width", "height", "samples")
    at = F.explode(F.expr("sequence(0, width * height - 1)"))
    cell = blocks.select("band", "x", "y", "width", F.hex("samples").alias("s"), at.alias("i"))
    byte = lambda k: F.expr(f"cast(conv(substring(s, 6 * i + {2 * k + 1}, 2), 16, 10) as bigint)")
    return cell.select((F.col("x") + F.expr("i % width")).alias("x"), (F.col("band") * BAND + F.col("y") + F.expr("i div width")).cast("long").alias("y"), *[byte(k).alias(c) for k, c in enumerate("rgb")])


query("raster_file_scan", f"with {_P} select x, y, r, g, b from p", None)(_file_scan)
query("header_roundtrip", f"with n as (select count(*) // 128 as h from orders) select b as band, cast(128 as bigint) as width, least({BAND}, h - b * {BAND}) as height, cast(3 as int) as spp, cast(8 as int) as bits, cast({codecs.PACKBITS} as int) as compression, cast(2 as int) as photometric, cast(ceil(least({BAND}, h - b * {BAND}) / 8.0) as int) as n_chunks from n, range(0, 100000000) t(b) where b < ceil(h / {BAND}.0)", None)(
    lambda s, d: _view(s, _written(s, _bands(s, d), compression=str(codecs.PACKBITS), rows_per_strip="8"), "pages").select(F.regexp_extract("path", r"band-(\d+)", 1).cast("long").alias("band"), "width", "height", "spp", "bits", "compression", "photometric", "n_chunks")
)


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """The pixels of bands that are encoded as files in memory and decoded whole."""

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                from ..sources import raster_file, raster_source

                src = raster_file.Bytes(raster_file.write_file([raster_source.page_spec(r, {"compression": codecs.DEFLATE, "rows_per_strip": 16})]))
                px = raster_file.read_pages(src)[0].decode(src).reshape(-1, 3).astype(np.int64)
                x, y = np.tile(np.arange(r["width"]), r["height"]), int(r["file"][5:14]) * BAND + np.repeat(np.arange(r["height"]), r["width"])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x, y, *px.T, np.full(len(x), 255))], names=list("xyrgba"))

    return _bands(spark, d).mapInArrow(decode, "x long, y long, r long, g long, b long, a long")


query("full_decode", f"with {_P} select x, y, r, g, b, a from p", None)(_decoded)


def _geo_keys(spark: SparkSession, d: str) -> DataFrame:
    """Key directories of files whose geo tags come from part, written and parsed."""
    from ..sources import raster_file as rf

    def parse(batches):
        for b in batches:
            rows = []
            for i, w, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                extra = ((rf.GEO_SCALE, 12, [w / 4, h / 4, 0.0]), (rf.GEO_TIEPOINTS, 12, [0.0, 0.0, 0.0, float(i), float(w), 0.0]), (rf.GEO_KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, i % 3 + 1, 1026, rf.GEO_ASCII, 7, 0, 2057, rf.GEO_DOUBLES, 1, 1]), (rf.GEO_DOUBLES, 12, [1.0, 6378137.0 + i]), (rf.GEO_ASCII, 2, b"WGS 84|\0"))
                src = rf.Bytes(rf.write_file([rf.Spec(np.ones((1, 1, 1), np.uint8), extra=extra)]))
                g = rf.read_pages(src)[0].geo()
                rows.append((i, g["keys"][1024], g["keys"][1026], g["keys"][2057], g["scale"][0], g["tiepoints"][0][4]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["src", "model", "citation", "axis", "scale_x", "tie_y"])

    # few bytes, much work a row: a file of one row group would leave it all to one task
    dealt = _parts(spark, d).select("src", F.col("w").cast("long").alias("w"), "h").repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "src")
    return dealt.mapInArrow(parse, "src long, model long, citation string, axis double, scale_x double, tie_y double")


query("geo_keys", f"select src, src % 3 + 1 as model, 'WGS 84' as citation, 6378137e0 + src as axis, w / 4e0 as scale_x, cast(w as double) as tie_y from ({_pages})", None)(_geo_keys)


from . import catalog_detail  # noqa: E402, F401  (its queries join these)
