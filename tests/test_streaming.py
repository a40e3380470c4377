import datetime
import random
from collections import defaultdict

from gridloom.streaming import viewport


def events(seed, n=400):
    r = random.Random(seed)
    t = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return [(r.randrange(4), t + datetime.timedelta(seconds=k * 7 + r.randrange(5)), k, f"t{r.randrange(12)}", r.randrange(20, 90), r.randrange(3), k // 150) for k in range(n)]


SCHEMA = "user_id long, ts timestamp, event_id long, tile string, size long, reduction long, version long"


def model(rows, budget):
    """The cache as a list from the oldest to the latest."""
    out, held = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for u, _, _, tile, size, red, ver in sorted(rows, key=lambda x: (x[1], x[2])):
        cache, stat = held[u], out[u]
        stat[0] += 1
        old = next((x for x in cache if x[0] == tile), None)
        if old:
            cache.remove(old)
            cache.append(old)
            if old[2] <= red and old[3] == ver:
                stat[1] += 1
                continue
            if old[3] == ver and old[2] < red:
                continue
            cache.remove(old)
        while cache and sum(x[1] for x in cache) + size > budget:
            cache.pop(0)
            stat[2] += 1
        cache.append((tile, size, red, ver))
    return {u: (*s, sum(x[1] for x in held[u])) for u, s in out.items()}


def test_cache_batch_against_a_model(spark):
    rows = events(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.user_id: (r.n, r.hits, r.evicted, r.cached_bytes) for r in viewport.cache_batch(df, 300).collect()}
    assert got == model(rows, 300)


def test_cache_stream_keeps_its_state(spark, tmp_path):
    rows = events(2)
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = viewport.cache_stream(src, 300).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    total = defaultdict(lambda: [0, 0, 0])
    for r in seen:
        for k, v in enumerate((r.n, r.hits, r.evicted)):
            total[r.user_id][k] += v
    want = model(rows, 300)
    assert {u: tuple(v) for u, v in total.items()} == {u: v[:3] for u, v in want.items()}


def test_debounce_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = events(3)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    q = viewport.debounce(src, "20 seconds").writeStream.format("memory").queryName("quiet").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("quiet").collect()))
    assert got == sorted(map(tuple, viewport.debounce(df, "20 seconds").collect())) and got


def test_pressure_empties_the_cache():
    c = viewport.TileCache(100)
    c.put("a", 40)
    assert c.press() == ["a"] and c.budget == 50 and c.size == 0
    c.put("b", 40)
    assert c.put("c", 20) == ["b"]
