"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length.

Folding: lower case, homoglyphs and accents to plain letters, digits and signs that stand for letters to those, invisible
characters away, everything else to spaces. Lexicon entries are word beginnings; a hit starts at a word's start, and
only the longest entry at a place counts. Hits inside an exception phrase don't count. The score is a logistic function of
the weighted hits, as they are and per 100 words.

Entries, weights and the logistic function are learnt from at most TRAIN_ROWS labelled documents (equal texts count once).
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample (by a hash of the id), of the lexicon, and lengths of word beginnings.
TRAIN_ROWS, LEXICON, STEMS = 20_000, 400, (4, 5, 6, 7, 8, 9, 10, 12)

# fixed values: letters of other scripts that look like Latin ones, and digits and signs that stand for letters
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ɴ": "n", "ʟ": "l", "ᴀ": "a", "ᴇ": "e", "ᴏ": "o", "ᴛ": "t", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a lexicon word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "circus clown", "pond scum", "stupid question", "graceful loser", "weight loser")


def _folds() -> dict[int, str]:
    """What each character is folded to; built by rule for Latin, full-width and mathematical letters."""
    out: dict[int, str] = {}
    for c in (*range(0x20, 0x250), *range(0x1E00, 0x1F00), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x370, 0x530)):
        ch = chr(c)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(x)).lower()
        plain = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in plain)
        out[c] = plain if plain.isalnum() and plain else " "
    for c in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)):
        out[c] = ""
    for c in (*range(0, 0x20), *range(0x7F, 0xA0), *range(0x2000, 0x200B), *range(0x2010, 0x2060), 0x3000):
        out[c] = " "
    return out


_TABLE = _folds()


def fold(text: str | None) -> str:
    """The folded text, with a space before it."""
    return " " + (text or "").translate(_TABLE)


def words_of(text: str | None) -> list[str]:
    return fold(text).split()


def crc_fold(x: int | None) -> int:
    """crc32 of the id as text, mod 5: 0 is held out."""
    return zlib.crc32(str(x).encode()) % 5


class Model:
    """Lexicon (word beginning -> weight), exceptions and the logistic function; small and picklable."""

    def __init__(self, lexicon: dict[str, float], coef: tuple = (-4.0, 6.0, 0.0), exceptions: tuple = EXCEPTIONS):
        self.lexicon, self.coef, self.exceptions = dict(lexicon), tuple(coef), tuple(exceptions)
        self._ac = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "coef": self.coef, "exceptions": self.exceptions, "_ac": None}

    def automaton(self):
        if self._ac is None:
            import ahocorasick

            ac = ahocorasick.Automaton()
            for w, v in self.lexicon.items():
                ac.add_word(" " + w, (len(w), v, ()))
            for p in self.exceptions:
                p = " " + " ".join(words_of(p))
                ends = tuple(k for k in range(len(p)) if p[k] == " ")
                old = ac.get(p, None)
                ac.add_word(p, (len(p) - 1, old[1] if old else None, ends))
            ac.add_word("\x00", (0, None, ()))
            ac.make_automaton()
            self._ac = ac
        return self._ac

    def hits(self, folded: str) -> tuple[float, int]:
        """Sum of weights and number of hits."""
        best: dict[int, tuple[int, float]] = {}
        spared: set[int] = set()
        for end, (n, v, ends) in self.automaton().iter(folded):
            at = end - n
            if v is not None and best.get(at, (0, 0.0))[0] < n:
                best[at] = (n, v)
            if ends and (end + 1 == len(folded) or folded[end + 1] == " "):
                spared.update(at + k for k in ends)
        if spared:
            best = {k: v for k, v in best.items() if k not in spared}
        return sum(v for _, v in best.values()), len(best)

    def features(self, text: str | None) -> tuple[float, float, float]:
        folded = fold(text)
        raw, _ = self.hits(folded)
        if not raw:
            return 0.0, 0.0, 0.0
        n = max(1, len(folded.split()))
        return math.log1p(raw), math.log1p(100 * raw / n), math.log(n)

    def score(self, text: str | None) -> float:
        x = self.features(text)
        z = self.coef[0] + sum(a * b for a, b in zip(self.coef[1:], x, strict=False))
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, z))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a word or word beginning."""
    seen: dict[str, list[int]] = {}

    def batch():
        return pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.string()), "pos": pa.array([v[1] for v in seen.values()], pa.int64()), "neg": pa.array([v[0] for v in seen.values()], pa.int64())})

    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ws = {w for w in words_of(t) if len(w) > 2}
            for w in ws | {w[:k] for w in ws for k in STEMS if len(w) > k}:
                seen.setdefault(w, [0, 0])[y] += 1
        if len(seen) > 500_000:
            yield batch()
            seen.clear()
    if seen:
        yield batch()


def _phrases(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a pair of neighbouring words one of which begins with an entry."""
    seen: dict[str, list[int]] = {}
    entries = frozenset(lexicon.value)
    sizes = sorted({len(w) for w in entries})
    for b in batches:
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ws = words_of(t)
            hit = [any(w[:k] in entries for k in sizes) for w in ws]
            for p in {f"{a} {c}" for a, c, x, z in zip(ws, ws[1:], hit, hit[1:], strict=False) if x or z}:
                seen.setdefault(p, [0, 0])[y] += 1
    if seen:
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.string()), "pos": pa.array([v[1] for v in seen.values()], pa.int64()), "neg": pa.array([v[0] for v in seen.values()], pa.int64())})


def choose(counts: list[tuple[str, int, int]], pos: int, neg: int, most: int = LEXICON) -> dict[str, float]:
    """Entries by the significance of their log odds; of entries that begin with one another the more significant one."""
    scored = []
    for w, p, n in counts:
        odds = math.log((p + 0.1) / (pos + 0.2)) - math.log((n + 0.1) / (neg + 0.2))
        a, b = p / max(1, pos), n / max(1, neg)
        both = (p + n) / (pos + neg)
        z = (a - b) / math.sqrt(max(1e-12, both * (1 - both) * (1 / max(1, pos) + 1 / max(1, neg))))
        if p >= 3 and odds > 1.5 and z > 5:
            scored.append((-z, len(w), w, odds))
    out: dict[str, float] = {}
    for _, _, w, odds in sorted(scored):
        if len(out) >= most:
            break
        if not any(w.startswith(x) or x.startswith(w) for x in out):
            out[w] = odds
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Coefficients (the constant first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        g = x.T @ (p - y) + ridge * c
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), g)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c


def _features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        f = [m.features(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([v[j] for v in f], pa.float64()) for j in range(3)] + [b.column(1)], names=["x0", "x1", "x2", "y"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, exceptions: tuple = EXCEPTIONS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from labelled rows that are not held out: at most about ``most_rows``, chosen by a hash of the id, equal texts once.
    Without a row of either label the model has an empty lexicon. To the given exceptions come phrases of two words, one of which begins with
    an entry, that three or more harmless rows have and that are not a sign of the others (LEXICON at most)."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("y")).where("l_id is not null and y in (0, 1)").where("crc32(cast(cast(l_id as string) as binary)) % 5 <> 0")
    known = known.groupBy("l_id").agg(F.max("y").alias("y"))
    share = min(1.0, most_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("l_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    src = docs.select(F.col(id_col).cast("long").alias("l_id"), F.col(text_col).alias("text"))
    rows = src.join(F.broadcast(known), "l_id")  # at most about most_rows rows of 12 bytes
    rows = rows.where("text is not null").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y").persist()
    try:
        size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        pos, neg = size.get(1, 0), size.get(0, 0)
        if not pos or not neg:
            return Model({}, (-4.0, 0.0, 0.0, 0.0))
        counted = rows.mapInArrow(_counts, "w string, pos long, neg long").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        counted = counted.where(f"pos >= 3 and pos / {pos} > 4 * neg / {neg}")
        # the most significant ones only come to the driver
        top = counted.orderBy((F.col("pos") / pos - F.col("neg") / neg).desc(), "w").limit(20 * LEXICON).collect()
        lexicon = choose([(r.w, r.pos, r.neg) for r in top], pos, neg)
        pairs = rows.mapInArrow(partial(_phrases, lexicon=spark.sparkContext.broadcast(list(lexicon))), "w string, pos long, neg long").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        harmless = pairs.where(f"neg >= 3 and neg / {neg} > 2 * pos / {pos}").orderBy(F.desc("neg"), "w").limit(LEXICON).collect()
        model = Model(lexicon, exceptions=(*exceptions, *(r.w for r in harmless)))
        f = np.array([tuple(r) for r in rows.mapInArrow(partial(_features, model=spark.sparkContext.broadcast(model)), "x0 double, x1 double, x2 double, y int").collect()])
        f = f[np.lexsort(f.T)]
        model.coef = tuple(logistic(f[:, :3], f[:, 3]).tolist())
        return model
    finally:
        rows.unpersist()


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        s = [m.score(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id as text mod 5 is 0; null for a null id), score (0 to 1) and predicted (score >= 0.5).
    Null texts are empty and score like a text without hits; repeated rows score alike; other columns are ignored. No shuffle."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(partial(_scores, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.select(F.col("doc_id").alias(id_col), F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(batches: Iterator[pa.RecordBatch], model, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        yield b.filter(pa.array([m.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the documents that score at or above the threshold; all columns stay as they are. Null and empty texts score like
    texts without hits; rows that repeat go or stay together."""
    return docs.mapInArrow(partial(_keep, model=docs.sparkSession.sparkContext.broadcast(model), at=docs.columns.index(text_col), threshold=threshold), docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


