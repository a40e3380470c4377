"""Token ids in Parquet list columns.

Documents are dealt by ranges of ids and sorted, so files, row groups and pages follow the id order and the page index
prunes both id ranges and columns. Token lists are dictionary encoded (one dictionary of at most the vocabulary per row
group), counts and starts delta encoded (format version 2).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SIGNS, Scratch, shuffle_partitions, slices, text_buffers, words

END_ID = 2
MARK = "<|startoftext|>"  # a special token of the vocabulary: it separates the pieces that are encoded together
#: Distinct pieces that a task remembers at most before it starts anew.
CACHE = 1_500_000
FORMAT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.block.size": str(32 << 20)}
SCHEMA = "doc_id long, part int, local_start long, n_tokens int, tokens array<int>"


class Encoder:
    """Encodes texts as the tokenizer does, each distinct piece once.

    Pieces end at white space, and between an ASCII letter and an ASCII digit or sign (not the apostrophe). The
    pre-tokenizer joins nothing across those places and drops the white space, so a text's ids are those of its pieces in order. Texts that may hold a special token's string go through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark = self.tok.token_to_id(MARK)
        self.forget()

    def forget(self) -> None:
        self.h, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, h: np.ndarray, raw: bytes, first: np.ndarray, end: np.ndarray) -> None:
        if len(self.h) + len(h) > CACHE:
            self.forget()
        ids, lens = [self.ids], []
        for lo in range(0, len(h), 4096):
            pieces = [raw[a:b] for a, b in zip(first[lo : lo + 4096].tolist(), end[lo : lo + 4096].tolist(), strict=True)]
            got = np.array(self.tok.encode((MARK.encode().join(pieces)).decode(), add_special_tokens=False).ids, np.int32)
            cut = np.flatnonzero(got == self.mark)
            lens.append(np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1)
            ids.append(got[got != self.mark])
        n = np.concatenate(lens)
        at = len(self.ids) + np.concatenate([[0], np.cumsum(n)[:-1]])
        self.ids = np.concatenate(ids)
        to = np.searchsorted(self.h, h)
        self.h, self.at, self.n = np.insert(self.h, to, h), np.insert(self.at, to, at), np.insert(self.n, to, n)

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each row's followed by end_id, and the n+1 offsets of the rows."""
        h, first, end, rows = words(raw, off, ASCII_SIGNS)
        data = raw.tobytes()
        if len(h):
            o = np.argsort(h)
            new = np.append(True, h[o[1:]] != h[o[:-1]])
            u, where, inv = h[o[new]], o[new], np.empty(len(h), np.int64)
            inv[o] = np.cumsum(new) - 1
            for again in (False, True):
                at = np.searchsorted(self.h, u)
                known = (at < len(self.h)) & (self.h[np.minimum(at, len(self.h) - 1)] == u) if len(self.h) else np.zeros(len(u), bool)
                if known.all():
                    break
                if again or len(self.h) + (~known).sum() > CACHE:
                    self.forget()
                    known[:] = False
                self._learn(u[~known], data, first[where[~known]], end[where[~known]])
            at = np.searchsorted(self.h, u)
            n, start = self.n[at][inv], self.at[at][inv]
            out_end = np.cumsum(n)
            flat = self.ids[np.repeat(start - (out_end - n), n) + np.arange(out_end[-1])]
            per_row = np.concatenate([[0], out_end])[rows]
        else:
            flat, per_row = np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        out = np.full(len(flat) + len(off) - 1, end_id, np.int32)
        row_off = per_row + np.arange(len(off))
        keep = np.ones(len(out), bool)
        keep[row_off[1:] - 1] = False
        out[keep] = flat
        if b"<|" in data:  # may be special tokens: these rows are encoded whole
            parts = [out[row_off[i] : row_off[i + 1]] for i in range(len(off) - 1)]
            for i in range(len(parts)):
                text = data[off[i] : off[i + 1]]
                if b"<|" in text:
                    parts[i] = np.append(self.whole(text.decode()), np.int32(end_id))
            out, row_off = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return out, row_off


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that what it has learnt serves the tasks that follow."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, part, start = encoder(path), TaskContext.get().partitionId(), 0
    for b in batches:
        raw, off = text_buffers(b.column(1))
        for i, j in slices(off):
            ids, row_off = enc.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i], end_id)
            n = np.diff(row_off)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(start + row_off[:-1]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(row_off.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
            )
            start += int(row_off[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes one row per document in ascending id order: doc_id, part (file number in id order), local_start (ids before it
    in its part), n_tokens and tokens (with the end id). Null texts are empty (the end id alone); rows without an id are
    not written; rows that repeat an id follow one another in any order; other columns are ignored."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    ordered = src.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(partial(_encode, path=tokenizer, end_id=end_id), SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows with start, the ids of all documents before; only pages that can hold ids in [first, last] are read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sizes = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("size"))
    before = sizes.selectExpr("part as p", "sum(size) over (order by part rows between unbounded preceding and current row) - size as base")  # a row per file
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.join(F.broadcast(before), rows.part == before.p).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = b.column(3)
        off, flat = t.offsets.to_numpy(), t.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "tokens").path("ids")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).mapInArrow(_crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")
