"""Work and memory that must not grow with a file's layout or a batch's rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.functions import codecs


def test_geo_keys_are_dealt_out(spark, tmp_path):
    from gridloom.plans import catalog

    rows = spark.range(1, 3001).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = catalog.QUERIES["geo_keys"](spark, str(tmp_path))
    per_task = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in per_task) < 1500
    assert out.agg(F.sum("axis")).first()[0] == sum(6378137.0 + i for i in range(1, 3001))


def test_a_batch_is_worked_off_in_pieces():
    data = [None if i % 50 == 0 else bytes([i % 251]) * (3000 + i % 7) for i in range(5000)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(5000)), "data": pa.array(data, pa.binary())})
    seen, most, ids, back = 0, 0, [], []

    def f(x):
        nonlocal seen
        seen += len(x)
        return x

    for out in codecs._map(iter([batch]), f, 1):
        most, seen = max(most, seen), 0
        ids += out.column(0).to_pylist()
        back += out.column(1).to_pylist()
    assert ids == list(range(5000)) and back == data and most <= codecs.OUT_BYTES + 4000
    assert list(codecs._map(iter([batch.slice(0, 0)]), f, 1)) == []
