"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join. Native Spark only.

A listed entry is a host and a path, written host + path (``example.com/en/``); it fits the host and its subdomains where
the url's path starts with the entry's. A url is looked up under every suffix of its host at a label and every prefix of
its path of a length that the list has, so a lookup is an equality. Keys that miss the filter are gone before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The filter has a block (of HASHES words of 64 bits) for 16 entries, 2**BLOCK_BITS blocks of 72 bytes at most (19 MB); a longer list is
#: joined without a filter.
BLOCK_BITS, HASHES = 18, 6
#: Blocks of a filter whose size isn't given, as a power of two.
USUAL_BITS = 12

# fixed values: the rules of the query
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_sql(url)}, instr({_sql(url)}, '://') + 3)")).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _sql(name: str) -> str:
    return f"`{name}`"


def _blocks(key: str, bits: int) -> tuple:
    """Block number of a key, and its bit in each of HASHES words of the block."""
    h = F.xxhash64(F.col(key))
    g = F.xxhash64(F.col(key), F.lit("bits"))
    return F.shiftrightunsigned(h, 64 - bits).cast("int"), [(j, F.shiftrightunsigned(g, 6 * j).bitwiseAND(F.lit(63)).cast("int")) for j in range(HASHES)]


def filter_size(n: int) -> int | None:
    """Blocks of a filter of n keys as a power of two; None where they would be too many to broadcast."""
    bits = max(6, (n // 16).bit_length())
    return bits if bits <= BLOCK_BITS else None


def bloom_blocks(entries: DataFrame, key: str, bits: int = USUAL_BITS) -> DataFrame:
    """The filter: a row per block that has a bit (at most 2**bits), words w0, w1, ..."""
    block, at = _blocks(key, bits)
    words = [F.bit_or(F.expr("shiftleft(1L, b%d)" % j)).alias(f"w{j}") for j, _ in at]
    return entries.select(block.alias("block"), *[b.alias(f"b{j}") for j, b in at]).groupBy("block").agg(*words)


def passing(keys: DataFrame, key: str, blocks: DataFrame, bits: int = USUAL_BITS) -> DataFrame:
    """Rows whose key may be listed; their columns may have any names."""
    block, at = _blocks(key, bits)
    probe = keys.select(F.struct(*[F.col(f"`{c}`") for c in keys.columns]).alias("row"), block.alias("own"), *[b.alias(f"b{j}") for j, b in at])
    hit = F.lit(True)
    for j, _ in at:
        hit = hit & (F.expr(f"shiftrightunsigned(w{j}, b{j}) & 1") == 1)
    small = F.broadcast(blocks)  # at most 2**bits rows of 72 bytes
    return probe.join(small, probe.own == small.block).where(hit).select("row.*")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in keys (distinct), with a few others where a filter is enough to thin them out."""
    bits = filter_size(keys.count())
    return rows.join(keys, key, "left_semi") if bits is None else passing(rows, key, bloom_blocks(keys, key, bits), bits)


def url_verdicts(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (the longest listed entry that fits, else null) and verdict (its, else ``otherwise``).

    listed: host, path, verdict; entries that repeat are one (the least verdict, allow before block); null fields don't list.
    Pages: null or odd urls have an empty host and path and fit nothing; null ids and repeated rows stay rows of their
    own; other columns are ignored. A list without entries gives every page ``otherwise``.
    """
    rules = listed.where("host is not null and path is not null and verdict is not null").groupBy(F.lower("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.min("verdict").alias("r_verdict"))
    rules = rules.withColumn("rule", F.concat("r_host", "r_path")).withColumn("key", F.concat_ws("\x00", "r_host", "r_path"))
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())  # at most one per length of a url path
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    urls = src.withColumn("host", host_of("url")).withColumn("path", path_of("url")).select("page_id", "host", "path")
    # every distinct host and path is looked up once, however many pages a host has
    places = urls.where("host <> ''").select("host", "path", F.split("host", r"\.").alias("labels"))
    suffixes = F.explode(F.sequence(F.lit(1), F.size("labels")))
    keys = places.select("host", "path", "labels", suffixes.alias("from")).select("host", "path", F.expr("array_join(slice(labels, from, size(labels) - from + 1), '.')").alias("suffix"))
    keys = keys.select("host", "path", "suffix", F.explode(F.array(*[F.lit(x) for x in lengths]) if lengths else F.expr("cast(array() as array<int>)")).alias("k")).where("length(path) >= k")
    keys = keys.select("host", "path", F.expr("concat_ws('\\u0000', suffix, substring(path, 1, k))").alias("key"))
    hits = among(keys, rules.select("key"), "key").distinct()
    found = hits.join(rules.select("key", "rule", "r_verdict"), "key").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "r_verdict")).alias("best"))
    # urls without a host fit nothing: they would all meet under one key
    odd = urls.where("host = ''").withColumn("best", F.lit(None).cast(found.schema["best"].dataType))
    out = urls.where("host <> ''").join(found.withColumnsRenamed({"host": "f_host", "path": "f_path"}), (F.col("host") == F.col("f_host")) & (F.col("path") == F.col("f_path")), "left")
    return out.select("page_id", "host", "path", "best").unionByName(odd).select(F.col("page_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(otherwise)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP8_SQL = f"""
with r(r_host, r_path, r_verdict) as (values {_RULES_SQL}),
u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
best as (select host, path, r_host || r_path as rule, r_verdict,
                row_number() over (partition by host, path order by length(r_host || r_path) desc) as k
         from (select distinct host, path from p) d join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select cast(p.page_id as bigint) as page_id, p.host, p.path, rule, coalesce(r_verdict, 'allow') as verdict
from p left join (select * from best where k = 1) b on p.host = b.host and p.path = b.path
"""
