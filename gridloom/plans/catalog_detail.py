"""Queries over level-of-detail choices, metadata and files, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster
from . import detail, rungs, sizing
from .catalog import _events, _pages, _parts, query

_scales = "select event_id, value + 1 as scale from events"
_scaled = lambda s, d: _events(s, d).selectExpr("event_id", "value + 1 as scale")
_DOWN = [1.0, 2.0, 3.5, 8.0, 16.0, 40.0]
_level = "case " + " ".join(f"when scale / 100 * {d}e0 <= 1.3e0 then {k}" for k, d in reversed(list(enumerate(_DOWN)))) + " else 0 end"
_ds = "case level " + " ".join(f"when {k} then {d}e0" for k, d in enumerate(_DOWN)) + " end"

query("level_labels", f"""select event_id, cast(level as bigint) as level, 'L' || level || ' · ' || case when round(ds) <= 1 then '1:1' when ds < 10 then '1/' || regexp_replace(printf('%.1f', ds), '[.]0$', '') else '1/' || cast(cast(round(ds) as bigint) as varchar) end as label
from (select *, {_ds} as ds from (select event_id, {_level} as level from ({_scales})))""", None)(
    lambda s, d: _scaled(s, d).select("event_id", detail.level_at(F.col("scale") / 100, _DOWN).alias("at")).select("event_id", "at.level", detail.level_label(F.col("at.level"), F.col("at.downsample")).alias("label"))
)
_span = "case " + " ".join(f"when t * 256 * {1 << s} >= 64 then {s}" for s in range(10)) + " else 10 end"
_red = lambda most: "case " + " ".join(f"when t * 2 * {1 << s} <= 1.3e0 then {s}" for s in range(most, 0, -1)) + " else 0 end"
query("tile_plans", f"select event_id, cast(span as bigint) as span, cast(case when span = 0 then {_red(3)} else {_red(6)} end as bigint) as reduction from (select *, {_span} as span from (select event_id, 4 * (scale / 1000) as t from ({_scales})))", None)(
    lambda s, d: _scaled(s, d).select("event_id", *[c.alias(n) for n, c in detail.tile_plan(F.col("scale") / 1000, F.lit(4.0), 256, 2.0, native=True).items()])
)
_t = lambda a, b: f"greatest(0, least(15, cast(floor({a} / 8) as bigint) {b}))"
_x0, _x1, _y0, _y1 = _t("scale", "- 1"), _t("(scale + 20)", "+ 1"), _t("scale / 2", "+ 0"), _t("(scale / 2 + 30)", "+ 0")
query("visible_tiles_2d", f"select event_id, x0, x1, y0, y1, (x1 - x0 + 1) * (y1 - y0 + 1) as n, 5 between x0 and x1 and 3 between y0 and y1 as holds from (select event_id, {_x0} as x0, {_x1} as x1, {_y0} as y0, {_y1} as y1 from ({_scales}))", None)(
    lambda s, d: _ranges(_scaled(s, d))
)


def _ranges(events: DataFrame) -> DataFrame:
    x0, x1 = raster.visible_range(F.col("scale"), F.lit(20), 8, F.lit(16), 1)
    y0, y1 = raster.visible_range(F.col("scale") / 2, F.lit(30), 8, F.lit(16))
    out = events.select("event_id", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))
    own = [F.col(c) for c in ("x0", "x1", "y0", "y1")]
    return out.withColumns({"n": detail.tiles_in(*own), "holds": detail.in_range(F.lit(5), F.lit(3), *own)})


query("visible_rects", f"""select src, round(greatest(0e0, least(w, -vx / s)), 6) as x0, round(greatest(0e0, least(h, -vy / s)), 6) as y0, round(greatest(0e0, least(w, (600 - vx) / s)), 6) as x1, round(greatest(0e0, least(h, (400 - vy) / s)), 6) as y1
from (select *, (src % 17 - 8) * 30e0 as vx, (src % 11 - 5) * 40e0 as vy, (src % 5 + 1) / 4e0 as s from ({_pages}))""", None)(
    lambda s, d: _parts(s, d).selectExpr("*", "(src % 17 - 8) * 30D as vx", "(src % 11 - 5) * 40D as vy", "(src % 5 + 1) / 4D as s").select("src", *[F.round(c, 6).alias(n) for n, c in detail.visible_rect(F.col("s"), F.col("vx"), F.col("vy"), 600, 400, F.col("w"), F.col("h")).items()])
)
query("zoom_steps", f"""select src, round(ns, 6) as scale, round(fx + (src % 600) / s - (src % 600) / ns, 6) as x, round(fy + (src % 400) / s - (src % 400) / ns, 6) as y from (
select *, greatest(s / 2, least(greatest(s / 2, 8e0), s * exp(-(src % 401 - 200) / 200e0))) as ns, (w - 600 / s) / 2 as fx, (h - 400 / s) / 2 as fy from (select *, least(600e0 / w, 400e0 / h) as s from ({_pages})))""", None)(lambda s, d: _zoomed(_parts(s, d)))


def _zoomed(pages: DataFrame) -> DataFrame:
    fit = pages.select("src", *[c.alias(f"f_{n}") for n, c in detail.fit_view(F.col("w"), F.col("h"), 600.0, 400.0).items()])
    new = detail.zoom_about(F.col("f_scale"), F.col("f_x"), F.col("f_y"), F.expr("src % 600"), F.expr("src % 400"), detail.wheel_factor(F.expr("src % 401 - 200")), F.col("f_scale"), 8.0)
    return fit.select("src", *[F.round(c, 6).alias(n) for n, c in new.items()])


_shift = "case " + " ".join(f"when (greatest(w, h) + {(1 << k) - 1}) // {1 << k} <= 256 then {k}" for k in range(9)) + " end"
query("preview_shifts", f"select src, cast({_shift} as bigint) as shift from ({_pages})", None)(lambda s, d: _parts(s, d).select("src", detail.preview_shift(F.col("w"), F.col("h"), 256).alias("shift")))
_layers = "select user_id, cast(event_id % 5 as bigint) as level, cast(event_id % 3 as bigint) as span, pow(2, event_id % 5) as downsample from events"
query("fallback_layers", f"select user_id, level, span, row_number() over (partition by user_id order by downsample desc, span desc, level) as place from (select distinct * from ({_layers}))", None)(
    lambda s, d: detail.fallback_order(_events(s, d).selectExpr("user_id", "event_id % 5 as level", "event_id % 3 as span", "pow(2, event_id % 5) as downsample").distinct(), "user_id").drop("downsample")
)
query("minimap_tiles", "select user_id as cell, max(struct_pack(a := -pow(2, event_id % 5) * pow(2, event_id % 3), b := event_id)).b as event_id from events where value >= 2 group by 1", None)(
    lambda s, d: detail.sharpest(_events(s, d).selectExpr("user_id as cell", "event_id", "value", "pow(2, event_id % 5) as downsample", "event_id % 3 as reduction"), ["cell"], "event_id", extent=F.col("value"))
)
query("tiles_to_load", """select tx, ty, priority, ring from (select cast(i % 40 as bigint) as tx, cast(i // 40 as bigint) as ty, cast(greatest(abs(i % 40 - 17), abs(i // 40 - 11)) as bigint) as ring, cast(case when i % 40 between 14 and 20 and i // 40 between 9 and 13 then 0 else 1 end as bigint) as priority from range(1600) t(i))
where tx between 13 and 21 and ty between 8 and 14 order by priority, ring, ty, tx limit 60""", None)(lambda s, d: _wanted(s))


def _wanted(spark: SparkSession) -> DataFrame:
    grid = spark.range(1600).selectExpr("id % 40 as tx", "id div 40 as ty").selectExpr("*", "cast(greatest(abs(tx - 17), abs(ty - 11)) as bigint) as ring")
    inside = lambda m: grid.where(detail.in_range(F.col("tx"), F.col("ty"), F.lit(14 - m), F.lit(20 + m), F.lit(9 - m), F.lit(13 + m)))
    return detail.wanted_tiles(inside(0), inside(1), ["ring"], detail.tile_limit(60 * 5 * 64 * 64, 64, 64)).select("tx", "ty", "priority", "ring")


query("cache_admission", "select event_id, (event_id % 2 = 0 or 500 + value <= 550) and not (event_id % 3 = 0 and event_id % 4 < event_id % 5) as kept from events", None)(
    lambda s, d: _events(s, d).select("event_id", detail.may_store(F.expr("event_id % 2 = 0"), F.lit(500), F.col("value"), 550, F.expr("if(event_id % 3 = 0, 1, 0)"), F.expr("event_id % 4"), F.lit(1), F.expr("event_id % 5")).alias("kept"))
)
query("not_failed", "select event_id, user_id, event_type from events e where not exists (select 1 from events f where f.event_id % 7 = 0 and f.user_id = e.user_id and f.event_type = e.event_type)", None)(
    lambda s, d: detail.not_failed(_events(s, d).select("event_id", "user_id", "event_type"), _events(s, d).where("event_id % 7 = 0"), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")
)
query("model_points", f"select src, 300e0 + (w - 10e0) * 0.5e0 as mx, 4000e0 - (h - 20e0) * 0.25e0 as my from ({_pages})", None)(
    lambda s, d: _parts(s, d).select("src", *[c.alias(n) for n, c in detail.model_point(F.col("w"), F.col("h"), F.expr("array(10D, 20D, 0D, 300D, 4000D, 0D)"), F.expr("array(0.5D, 0.25D, 0D)")).items()])
)
_named = " ".join(f"when {k} then '{v}'" for k, v in detail.PHOTOMETRIC.items())
query("code_names", f"select src, case src % 10 {_named} end as name from ({_pages})", None)(lambda s, d: _parts(s, d).select("src", detail.code_name(F.expr("src % 10"), detail.PHOTOMETRIC).alias("name")))
_line = "(w * 7)"
_band = f"""least(h, case when b > 4096 then case when 4096 // strip * strip > 0 then 4096 // strip * strip else 4096 end else b end)"""
query("strip_band_rows", f"select src, cast({_band} as bigint) as rows from (select *, case when strip * (1048576 // (strip * {_line})) > 0 then strip * (1048576 // (strip * {_line})) else greatest(1, 1048576 // {_line}) end as b from (select *, least(greatest(src % 9, 1), h) as strip from ({_pages})))", None)(
    lambda s, d: _parts(s, d).select("src", rungs.band_rows_column(F.col("w"), F.col("h"), F.expr("src % 9"), 3, 8, 1 << 20).alias("rows"))
)
_two = f"select src, w, h, case when src % 3 = 0 then w // 2 when src % 3 = 1 then (w + 3) // 4 else w // 3 end as rw, case when src % 3 = 0 then h // 2 when src % 3 = 1 then h // 4 + src % 7 else h // 2 end as rh from ({_pages})"
_pow = "pow(2, floor(log2(w / rw::double) + 0.5))"
query("rung_downsample", f"""select src, case when fits then p when abs(w / rw::double - h / rh::double) <= 0.2 * (w / rw::double) then w / rw::double end as across, case when fits then p when abs(w / rw::double - h / rh::double) <= 0.2 * (w / rw::double) then h / rh::double end as down
from (select *, rw - w / p >= -1 and rw - w / p < 8 and rh - h / p >= -1 and rh - h / p < 8 as fits from (select *, {_pow} as p from ({_two}) where rw < w and rh <= h))""", None)(
    lambda s, d: rungs.downsample_columns(_parts(s, d).selectExpr("src", "w", "h", "case when src % 3 = 0 then w div 2 when src % 3 = 1 then (w + 3) div 4 else w div 3 end as rw", "case when src % 3 = 0 then h div 2 when src % 3 = 1 then h div 4 + src % 7 else h div 2 end as rh"), 8).select("src", "across", "down")
)
query("encode_units", f"select src, step, cast(sum(u) over (partition by src order by step) as double) / sum(u) over (partition by src) as fraction from (select src, k as step, greatest(1, w // (1 << k)) * greatest(1, h // (1 << k)) as u from ({_pages}), range(4) t(k))", None)(
    lambda s, d: sizing.progress(raster.level_sizes(_parts(s, d), 4).selectExpr("src", "level as step", "width * height as units"), "src")
)
