"""Viewport events: debounce, throttle, latest version and a byte-bounded tile cache; each on batches and on streams."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def debounce(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """The last event before each quiet gap of a key: key, last_event, last_ts. Batch or stream (with a watermark on ts)."""
    w = F.session_window(ts, gap)
    best = F.max(F.struct(ts, event))
    return events.groupBy(key, w).agg(best.alias("b")).select(key, F.col(f"b.{event}").alias("last_event"), F.col(f"b.{ts}").alias("last_ts"))


def throttle(events: DataFrame, interval: str, ts: str = "ts", event: str = "event_id") -> DataFrame:
    """The last event of each interval: window_start, last_event."""
    best = events.groupBy(F.window(ts, interval).alias("w")).agg(F.max(F.struct(ts, event)).alias("b"))
    return best.select(F.col("w.start").alias("window_start"), F.col(f"b.{event}").alias("last_event"))


def latest(events: DataFrame, key: str, ts: str = "ts", event: str = "event_id") -> DataFrame:
    """The current version of each key: its last event."""
    return events.groupBy(key).agg(F.max(F.struct(ts, event)).alias("b")).select(key, F.col(f"b.{event}").alias("version"))


class TileCache:
    """Least recently used by bytes. put() replaces, evicts the oldest until the new entry fits, and stores an entry larger
    than the whole budget all the same; a blurrier tile never replaces a sharper one of its version."""

    def __init__(self, budget: int):
        self.budget, self.size, self.items = budget, 0, OrderedDict()

    def get(self, key):
        if key in self.items:
            self.items.move_to_end(key)
            return self.items[key]
        return None

    def put(self, key, size: int, reduction: int = 0, version: int = 0) -> list:
        old = self.items.get(key)
        if old and old[2] == version and old[1] < reduction:
            return []
        if old:
            self.size -= old[0]
            del self.items[key]
        out = []
        while self.items and self.size + size > self.budget:
            k, v = self.items.popitem(last=False)
            self.size -= v[0]
            out.append(k)
        self.items[key] = (size, reduction, version)
        self.size += size
        return out

    def restore(self, keys: list, sizes: list, reductions: list, versions: list) -> None:
        """The entries of a cache that was kept, from the oldest to the latest."""
        self.items = OrderedDict(zip(keys, zip(sizes, reductions, versions, strict=True), strict=True))
        self.size = sum(sizes)

    def press(self) -> list:
        """Memory pressure: everything goes, and from now on the budget is half."""
        out = list(self.items)
        self.clear()
        self.budget //= 2
        return out

    def clear(self) -> None:
        self.items.clear()
        self.size = 0


def _play(cache: TileCache, pdf: pd.DataFrame) -> tuple[int, int]:
    """Hits and evictions of events in order; a tile that is there but blurrier or of another version than asked for is fetched again."""
    hits = evicted = 0
    for r in pdf.sort_values(["ts", "event_id"]).itertuples():
        reduction, version = int(getattr(r, "reduction", 0)), int(getattr(r, "version", 0))
        held = cache.get(r.tile)
        if held is not None and held[1] <= reduction and held[2] == version:
            hits += 1
        else:
            evicted += len(cache.put(r.tile, int(r.size), reduction, version))
    return hits, evicted


def _fold(key, frames: Iterator[pd.DataFrame], state, budget: int) -> Iterator[pd.DataFrame]:
    cache = TileCache(budget)
    if state.exists:
        cache.restore(*state.get)
    hits = evicted = n = 0
    for pdf in frames:
        n += len(pdf)
        h, e = _play(cache, pdf)
        hits, evicted = hits + h, evicted + e
    state.update(tuple(map(list, ([*cache.items], *zip(*cache.items.values(), strict=True)))) if cache.items else ([], [], [], []))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "hits": [hits], "evicted": [evicted], "cached_bytes": [cache.size]})


def cache_stream(events: DataFrame, budget: int) -> DataFrame:
    """A cache per user over a stream of (user_id, ts, event_id, tile, size, and reduction and version if there are any): hits and evictions of
    each micro-batch. The state keeps each tile's size, reduction and version in order of use."""
    from functools import partial

    return events.groupBy("user_id").applyInPandasWithState(partial(_fold, budget=budget), "user_id long, n long, hits long, evicted long, cached_bytes long", "tiles array<string>, sizes array<long>, reductions array<long>, versions array<long>", "update", "NoTimeout")


def _fold_batch(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    cache = TileCache(budget)
    hits, evicted = _play(cache, pdf)
    return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "n": [len(pdf)], "hits": [hits], "evicted": [evicted], "cached_bytes": [cache.size]})


def cache_batch(events: DataFrame, budget: int) -> DataFrame:
    from functools import partial

    return events.groupBy("user_id").applyInPandas(partial(_fold_batch, budget=budget), "user_id long, n long, hits long, evicted long, cached_bytes long")


def running_share(steps: DataFrame, units: str = "units", order: str = "step") -> DataFrame:
    """Progress: the part of all units done after each step, from 0 to 1."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = steps.agg(F.sum(units).alias("__t"))
    return steps.withColumn("__s", F.sum(units).over(w)).join(F.broadcast(total)).select(order, (F.col("__s") / F.col("__t")).alias("fraction"))
