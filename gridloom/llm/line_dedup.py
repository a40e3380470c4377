"""Fuzzy line dedup by MinHash, in native Spark only.

A line's set holds its distinct SHINGLE-character shingles. Equal lines are one class. For each class minima of the shingle
hashes under fixed exclusive-or masks make bands of three; classes that agree in a band are candidates, verified by their
exact Jaccard similarity; distributed union-find makes components, and one line of each stays: the first in order of document
id and line number. Lines of under MIN_CHARS characters are duplicates only of lines equal to them.

All shingles are generated, hashed and reduced to the minima where the lines are read, grouped by the line's hash: one shuffle of
a few numbers a line finds equal lines and completes signatures. Texts of candidates are picked out by a blocked Bloom
filter whose size follows their number. A bucket is compared in full, in two rounds: all its lines with its least one, then, block by block, all pairs that these links have not joined yet. For the second round each line gets a bitmap of its shingles'
hashes, at least four bits a shingle: the bits in which two bitmaps differ are never more than the shingles in which the
sets differ, so most pairs that can't link are told without their texts, and none that does link is lost. A task that
compares two blocks emits only links that join parts not yet joined. Pairs of blocks are dealt out to turns, one after another: what
travels in a turn is bounded by the candidates' texts, however often blocks meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, join_weighted, shuffle_partitions
from .url_filter import among

SHINGLE, SIMILARITY_PCT = 8, 80
#: A signature has nine minima, three by three; the twelve lines of the affine plane of order 3 are its bands. Two sets whose minima
#: agree with probability 0.8 each agree in a band with probability 0.990.
ROWS = 3
PLANE = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6))
#: Lines shorter than this (in the compared form) have no near copies, only exact ones: they carry too little to tell.
MIN_CHARS = 24
#: Shingles that are hashed and reduced in one row.
STRIDE = 4
#: Buckets with more lines, or more characters, are cut into blocks of about so many, compared block by block.
BLOCK, BLOCK_CHARS = 512, 4 << 20
#: Bytes of lines that travel to their buckets in a turn: twice those of all candidates' texts, so many at least.
TURN = 64 << 20


def normal(line, fold: bool = False):
    """The compared form of a line: without spaces at its ends; with fold, lower case and white space as single spaces."""
    if not fold:
        return F.trim(line)
    line = F.col(line) if isinstance(line, str) else line
    low = F.lower(line)
    # most lines have nothing to fold: a scan for it, in the line as it is, costs less than the expression
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\f\v":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, line_no (from 0), line; empty texts have no line."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text <> ''")
    # posexplode() and explode() would bring a filter on what they take apart, which is then made twice
    return src.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))


def _masks(n: int) -> list[int]:
    return np.random.default_rng(31).integers(-(2**63), 2**63 - 1, n).tolist()


def shingle_hashes(classes: DataFrame, keep: list[str], min_chars: int = 0, k: int = SHINGLE) -> DataFrame:
    """A row per shingle: the kept columns, its place and its hash h; one row for lines of under min_chars. Characters are
    UTF-16 units of 2 bytes, so a shingle is a slice of the line's bytes."""
    wide = classes.select(*keep, F.encode("norm", "UTF-16BE").alias("wide"))
    size = (F.octet_length("wide") / 2).cast("int")
    at = F.explode_outer(F.sequence(F.lit(0), F.when(size < min_chars, 0).otherwise(F.greatest(F.lit(0), size - k))))
    return wide.select(*keep, "wide", at.alias("at")).select(*keep, "at", F.xxhash64(F.expr(f"substring(wide, 2 * at + 1, {2 * k})")).alias("h"))


def strided_hashes(classes: DataFrame, keep: list[str], min_chars: int = 0, k: int = SHINGLE) -> DataFrame:
    """The hashes of shingle_hashes(), STRIDE in a row: the kept columns, at (the row's number), g0, g1, ... The last row repeats the
    last shingle, which changes no minimum."""
    wide = classes.select(*keep, F.encode("norm", "UTF-16BE").alias("wide"))
    size = (F.octet_length("wide") / 2).cast("int")
    wide = wide.select(*keep, "wide", F.when(size < min_chars, 0).otherwise(F.greatest(F.lit(0), size - k)).alias("last"))
    rows = wide.select(*keep, "wide", "last", F.explode_outer(F.sequence(F.lit(0), F.expr(f"cast(last div {STRIDE} as int)"))).alias("at"))
    return rows.select(*keep, "at", *[F.expr(f"xxhash64(substring(wide, 2 * least({STRIDE} * at + {j}, last) + 1, {2 * k}))").alias(f"g{j}") for j in range(STRIDE)])


def _hashed(docs: DataFrame, id_col: str, text_col: str, fold: bool) -> DataFrame:
    # the filter is on the line as it is: one on its compared form would make that form twice; ltrim() stops at the first other character
    lines = split_lines(docs, id_col, text_col).where(F.ltrim("line", F.lit(" \t\r\f\v")) != "").select("doc_id", "line_no", normal("line", fold).alias("norm"))
    return lines.select("doc_id", "line_no", "norm", F.xxhash64("norm").alias("h1"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, similarity_pct: int = SIMILARITY_PCT, bands: int | None = None, rows: int = ROWS, fold: bool = False, block: int = BLOCK) -> DataFrame:
    """Lines that have a copy or a near copy: doc_id, line_no, keep_doc, keep_line (the first line that is reachable by links). A
    table in the shared folder. bands: instead of PLANE, so many bands of their own minima, ``rows`` each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    min_chars = max(min_chars, SHINGLE)
    keyed = _hashed(docs, id_col, text_col, fold)
    # the last bit of a class's number tells whether its lines may have near copies; a line has no fewer units than characters
    keyed = keyed.withColumn("h1", F.expr(f"(h1 & -2L) | if(length(norm) >= {min_chars} or octet_length(encode(norm, 'UTF-16BE')) >= {2 * min_chars}, 1L, 0L)"))
    scheme = PLANE if bands is None else tuple(tuple(range(b * rows, (b + 1) * rows)) for b in range(bands))
    masks = _masks(1 + max(map(max, scheme)))
    minima = [F.min(F.least(*[F.col(f"g{i}").bitwiseXOR(F.lit(m)) for i in range(STRIDE)])).alias(f"m{j}") for j, m in enumerate(masks)]
    signed = strided_hashes(keyed, ["h1"], min_chars).groupBy("h1").agg(F.sum(F.expr("if(at = 0, 1L, 0L)")).alias("n_lines"), *minima)
    signed = scratch.table(signed, "signed")
    scratch.release()

    band = [F.xxhash64(F.lit(b), *[F.col(f"m{x}") for x in at]) for b, at in enumerate(scheme)]
    keys = signed.where("h1 & 1 = 1").select("h1", F.explode_outer(F.array(*band)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("n > 1")
    shared = scratch.table(shared, "buckets")
    scratch.release()
    two = shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    large = shared.where("n > 2").select("key", "n", "lo")
    more = scratch.table(among(keys, large.select("key"), "key").join(large, "key"), "members")
    star = more.where("h1 <> lo").select(F.col("lo").alias("a"), F.col("h1").alias("b"))
    pairs = scratch.table(two.unionByName(star).distinct(), "pairs")
    wanted = scratch.table(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct(), "wanted")
    scratch.release()

    # the lines of candidates and of classes of several lines, with those that slip through the filter
    classes = signed.where("n_lines > 1").select("h1").union(wanted).distinct()
    picked = scratch.table(among(keyed.withColumn("h2", F.xxhash64("norm", F.lit(2))), classes, "h1"), "picked")
    scratch.drop(signed, shared)
    scratch.release()
    # one text for a hash: of lines that differ and share one, only those with the least second hash are its class
    one = picked.groupBy("h1").agg(F.min(F.struct("h2", "norm")).alias("x")).select("h1", "x.h2", "x.norm")
    texts = scratch.table(one.join(wanted, "h1", "left_semi"), "texts")
    scratch.release()

    first = _links(pairs, texts, similarity_pct, scratch)
    scratch.drop(pairs, wanted)
    scratch.release()
    rest = _apart(more, connected_components(first, scratch), texts, similarity_pct, block, scratch)
    links = scratch.table(reduce(DataFrame.unionByName, rest, first), "links")
    scratch.drop(more, texts, first, *rest)

    # the first line of each class, then of each component; then every other line of theirs goes
    comp = connected_components(links, scratch)
    scratch.release()
    least = picked.groupBy("h1", "h2").agg(F.count("*").alias("n_lines"), F.min(F.struct("doc_id", "line_no")).alias("own"))
    kept = one.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    least = least.join(kept, (least.h1 == kept.k1) & (least.h2 == kept.k2), "left_semi")
    least = least.join(comp, least.h1 == comp.node, "left").where("n_lines > 1 or component is not null").select("h1", "h2", "n_lines", "own", F.coalesce("component", "h1").alias("c"))
    first_of = least.groupBy("c").agg(F.min("own").alias("keep"))
    table = scratch.table(least.join(first_of, "c").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n_lines", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line")), "classes")
    scratch.release()
    found = join_weighted(picked.select("doc_id", "line_no", "h1", "h2"), table, [("h1", "k1"), ("h2", "k2")], "n_lines")
    out = scratch.table(found.select("doc_id", "line_no", "keep_doc", "keep_line"), "found")
    scratch.drop(picked, links, table)
    scratch.release()
    return out


def _sketches(texts: DataFrame) -> DataFrame:
    """h1, n (size of the set, repeats counted), lev and sk: a bit for each shingle's hash among 64 * 2**lev >= 4 n, and p, how many bits are
    set: the set has no fewer members. Texts are dealt by h1 once; no later step shuffles."""
    dealt = texts.repartition(shuffle_partitions(texts.sparkSession), "h1").withColumn("n", F.expr(f"cast(octet_length(encode(norm, 'UTF-16BE')) div 2 as int) - {SHINGLE - 1}"))
    sized = dealt.withColumn("lev", F.expr("cast(ceil(log2(greatest(n, 16) / 16.0D)) as int)"))
    bits = shingle_hashes(sized, ["h1", "n", "lev"])
    words = bits.groupBy("h1", "n", "lev", F.expr("cast(h & (shiftleft(1L, lev) - 1) as int)").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")).alias("w"))
    lists = words.groupBy("h1", "n", "lev").agg(F.sort_array(F.collect_list(F.struct("slot", "w"))).alias("l"))
    full = F.expr("if(size(l) = shiftleft(1, lev), transform(l, x -> x.w), transform(sequence(0, shiftleft(1, lev) - 1), i -> coalesce(try_element_at(map_from_entries(l), i), 0L)))")
    return lists.select("h1", "n", "lev", full.alias("sk"), F.expr("aggregate(l, 0, (s, x) -> s + bit_count(x.w))").alias("p"))


def _may_link(x: str, y: str, pct: int) -> str:
    """Whether two sketched sets can reach the similarity: SQL over fields n, lev and sk of x and y. n may be more than the set's size:
    sets that link differ in (100 - pct) / (100 + pct) of the sum of their sizes at most."""
    fold = lambda z: f"zip_with(slice({z}.sk, 1, size({z}.sk) div 2), slice({z}.sk, size({z}.sk) div 2 + 1, size({z}.sk) div 2), (u, v) -> u | v)"
    differ = lambda a, b: f"aggregate(zip_with({a}, {b}, (u, v) -> bit_count(u ^ v)), 0, (s, v) -> s + v)"
    bits = f"case when {x}.lev = {y}.lev then {differ(f'{x}.sk', f'{y}.sk')} when {x}.lev = {y}.lev + 1 then {differ(fold(x), f'{y}.sk')} when {y}.lev = {x}.lev + 1 then {differ(f'{x}.sk', fold(y))} else 0 end"
    return f"({100 + pct} * ({bits}) <= {100 - pct} * ({x}.n + {y}.n))"


def _like_size(x: str, y: str, pct: int) -> str:
    """Whether two sets' sizes, p at least and n at most, let them reach the similarity: neither has less than pct % of the other's."""
    return f"({pct} * {x}.p <= 100 * {y}.n and {pct} * {y}.p <= 100 * {x}.n)"


def _reach(u: str, made: str, pct: int) -> str:
    """Whether a set u reaches the similarity with one that is made here: an array of one binds it to a name."""
    return f"transform(array({made}), v -> {100 + pct} * size(array_intersect({u}, v)) >= {pct} * (size({u}) + size(v)))[0]"


def _alike(a: str, b: str, pct: int) -> str:
    """Whether two lines reach the similarity, within their row."""
    return f"transform(array({_set_sql(a)}), u -> {_reach('u', _set_sql(b), pct)})[0]"


def _apart(members: DataFrame, comp: DataFrame, texts: DataFrame, pct: int, block: int, scratch: Scratch) -> list[DataFrame]:
    """Links a, b between lines of a bucket in different components, a table for each turn; those of its least line are known before.
    members: key, h1 and the bucket's n and lo. Two lines are compared in the first bucket of members that they share."""
    inner = members.where("h1 <> lo")
    inner = scratch.table(inner.join(comp, inner.h1 == comp.node, "left").select("key", "h1", F.coalesce("component", "h1").alias("c")), "inner")
    split = inner.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    left = scratch.table(inner.join(split, "key"), "left")
    scratch.release()
    lines = left.select("h1").distinct()
    own = scratch.table(texts.join(lines, "h1", "left_semi"), "own")
    keys_of = members.join(lines, "h1", "left_semi").groupBy("h1").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    sketches = _sketches(own).join(own.select("h1", "norm"), "h1").join(keys_of, "h1")
    size = F.expr("octet_length(norm) + 8 * (size(sk) + size(keys)) + 64L").alias("size")
    sketches = scratch.table(sketches.select("*", F.length("norm").alias("chars"), size), "sketches")
    scratch.drop(inner, own)
    scratch.release()

    # a line travels once for each block that its block meets; the pairs of blocks of a bucket that is much of a turn go to several
    turn = max(TURN, 2 * (texts.agg(F.sum(F.octet_length("norm"))).first()[0] or 0))
    blocks = left.join(sketches.select("h1", "chars", "size"), "h1").groupBy("key").agg(F.expr(f"cast(greatest(ceil(count(*) / {block}), ceil(sum(chars) / {BLOCK_CHARS})) as int)").alias("nb"), F.sum("size").alias("size"))
    blocks = scratch.table(blocks.select("key", "nb", (F.col("size") * F.col("nb")).alias("cost")), "costs")
    turns = -(-int(blocks.agg(F.sum("cost")).first()[0] or 0) // turn)
    placed = scratch.table(left.join(blocks, "key").select("key", "h1", "c", "nb", F.expr("cast(pmod(xxhash64(h1, key), nb) as int)").alias("blk"), F.expr(f"8 * cost > {turn}").alias("large")), "placed")
    scratch.release()
    out = []
    for t in range(turns):
        out.append(_turn(placed, sketches, turns, t, pct, scratch))
        scratch.release()
    scratch.drop(left, sketches, blocks, placed)
    return out


def _turn(placed: DataFrame, sketches: DataFrame, turns: int, t: int, pct: int, scratch: Scratch) -> DataFrame:
    """The links of the pairs of blocks whose turn it is: each pair x <= y in a row, its lines l and r (x = y: l alone)."""
    met = placed.select("key", "h1", "c", "large", "blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    met = met.select("key", "h1", "c", "large", "blk", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"))
    met = met.where(F.expr(f"pmod(if(large, xxhash64(key, x, y), xxhash64(key)), {turns}) = {t}"))
    line = F.struct("h1", "c", "n", "p", "lev", "sk", "norm", F.expr("filter(keys, k -> k < key)").alias("before"))
    rows = met.join(sketches, "h1").select("key", "x", "y", (F.col("blk") == F.col("x")).alias("first"), line.alias("line"))
    rows = rows.repartition(4 * shuffle_partitions(placed.sparkSession), "key", "x", "y")
    both = rows.groupBy("key", "x", "y").agg(F.collect_list(F.expr("if(first, line, null)")).alias("l"), F.collect_list(F.expr("if(first, null, line)")).alias("r"))
    both = both.select("x", "y", "l", F.expr("if(x < y, r, l)").alias("r"))
    label = "if(acc.lab[t.j] = z, acc.lab[s.i], z)"
    # buckets shared before are looked up first: that costs less than a comparison of bitmaps
    may = f"p.c <> t.q.c and (x < y or p.h1 < t.q.h1) and {_like_size('p', 't.q', pct)} and not arrays_overlap(p.before, t.q.before) and {_may_link('p', 't.q', pct)}"
    placed_r = "transform(r, (q, j) -> named_struct('q', q, 'j', if(x < y, size(l), 0) + j))"
    some = f"transform(array({placed_r}), rs -> filter(transform(l, (p, i) -> named_struct('p', p, 'i', i, 'ts', filter(rs, t -> {may}))), s -> size(s.ts) > 0))[0]"
    lab = "concat(transform(l, p -> p.c), if(x < y, transform(r, q -> q.c), cast(array() as array<bigint>)))"
    # a line's set is made once for all that it is compared with in the row
    links = f"""aggregate({some}, named_struct('lab', {lab}, 'links', cast(array() as array<struct<a: bigint, b: bigint>>)),
        (acc, s) -> transform(array({_set_sql('s.p.norm')}), u -> aggregate(s.ts, acc,
            (acc, t) -> if(acc.lab[s.i] = acc.lab[t.j] or not {_reach('u', _set_sql('t.q.norm'), pct)}, acc,
                named_struct('lab', transform(acc.lab, z -> {label}), 'links', array_append(acc.links, named_struct('a', least(s.p.h1, t.q.h1), 'b', greatest(s.p.h1, t.q.h1)))))))[0],
        acc -> acc.links)"""
    return scratch.table(both.select(F.explode_outer(F.expr(links)).alias("e")).where("e is not null").select("e.a", "e.b").distinct(), "rest")


def _links(pairs: DataFrame, texts: DataFrame, pct: int, scratch: Scratch) -> DataFrame:
    """The pairs whose lines reach the similarity, by the hashes of all their shingles, within their rows."""
    both = pairs.join(texts.select(F.col("h1").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("h1").alias("b"), F.col("norm").alias("tb")), "b")
    return scratch.table(both.where(_alike("ta", "tb", pct)).select("a", "b"), "links")


def _set_sql(line: str, k: int = SHINGLE) -> str:
    """The hashes of the distinct shingles of a line, within its row."""
    last = f"greatest(1, octet_length(wide) - {2 * k - 1})"  # as few operations as can be in the inner lambda: it is interpreted
    return f"transform(array(encode({line}, 'UTF-16BE')), wide -> array_distinct(transform(sequence(1, {last}, 2), i -> xxhash64(substring(wide, i, {2 * k})))))[0]"


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """Lines that go: doc_id, line_no (from 0), keep_doc, keep_line (the line of its component that stays: the first by id and number).

    Null and empty texts have no lines, rows without an id take no part, lines without anything but spaces are never
    duplicates, lines of under min_chars characters only of equal ones; rows that repeat an id are one document's lines,
    numbered alike. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    found = line_classes(docs, id_col, text_col, min_chars, **options)
    return found.where("doc_id <> keep_doc or line_no <> keep_line").distinct().withColumnRenamed("doc_id", id_col)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_lines, removed (numbers of the lines that go, ascending), text (what stays; null where
    the text was null). Documents none of whose lines go keep their text as it is; rows without an id keep theirs too."""
    joined = _with_removed(docs, id_col, text_col, **options)
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return joined.select(F.col("id").alias(id_col), lines.alias("n_lines"), F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"), _without().alias("text"))


def _with_removed(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """id, text, row (the document's columns in one struct, so that their names can't clash) and removed (null: no line goes)."""
    gone = duplicate_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", **options)
    gone = gone.groupBy(F.col("id").alias("g")).agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]).alias("row"))
    return src.join(gone, src.id == gone.g, "left")


def _without() -> Column:
    """The text without the lines in removed."""
    # the array of one binds the lines to a name: they are split once; numbers are looked up by hash, so many lines may go from a long text
    kept = F.expr("transform(array(split(text, '\\n')), lines -> array_join(transform(array_except(sequence(0, size(lines) - 1), removed), i -> lines[i]), '\\n'))[0]")
    return F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = True, **options) -> DataFrame:
    """docs with the duplicate lines taken out of their texts; documents of which nothing but white space is left go
    (drop_empty), others and texts without duplicates stay as they are, all columns kept. Rows that repeat an id lose the same
    line numbers; null texts, empty texts and rows without an id stay as they are."""
    joined = _with_removed(docs, id_col, text_col, **options).withColumn("left", _without())
    if drop_empty:
        joined = joined.where("removed is null or text is null or trim(regexp_replace(left, '\\\\s+', ' ')) <> ''")
    return joined.select(*[F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its number of lines, those that go, and the characters that stay."""
    out = line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold=True)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.length("text").cast("long").alias("kept_chars"))
