import random

import corpus_pipeline
import public_tokenizers

from gridloom.llm import token_files, toxicity

from .test_decontamination import words_of
from .test_line_dedup import brute as brute_lines
from .test_ngram_join import brute as brute_docs


def tables(spark, folder):
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(20, 50)) + ". " + text(4) + ".") for i in range(12)]
    shared = [text(12) for _ in range(5)]
    docs = []
    for i in range(260):
        lines = [text(r.randint(8, 40)) for _ in range(r.randint(1, 5))]
        if i % 7 == 0:
            lines.insert(r.randint(0, len(lines)), r.choice(shared))
        if i % 9 == 0:
            w = lines[0].split()
            w[len(w) // 2 : len(w) // 2] = ["vileword", "grossword"][: r.randint(1, 2)]
            lines[0] = " ".join(w)
        if i % 31 == 0:
            lines.append("")
            lines[-1] = "lead " + r.choice(items)[1] + " tail"
        if i % 13 == 0 and docs:
            w = r.choice(docs)[1].replace("\n", " ").split()
            lines = [" ".join(w[:-1] + ["end"])]
        docs.append((i, "\n".join(lines), r.choice(["en", "de"]), r.choice(["s1", "s2", None]), 0))
    docs += [(900, None, "en", "s1", 0), (901, "", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, int("vileword" in (t or "") or "grossword" in (t or ""))) for i, t, *_ in docs[:250]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items, dict((i, t) for i, _, t in labels)


def test_stages_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    docs, items, _ = tables(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {i: t for i, t, *_ in docs if model.score(t) < 0.5}
    assert sum("vileword" in (t or "") or "grossword" in (t or "") for t in kept.values()) <= 2 and len(kept) > 200

    gone = brute_lines(list(kept.items()))
    after = {}
    for i, t in kept.items():
        left = [x for j, x in enumerate((t or "").split("\n")) if (i, j) not in gone]
        if not any((i, j) in gone for j in range(len((t or "").split("\n")))):
            after[i] = t
        elif "\n".join(left).strip():
            after[i] = "\n".join(left)
    third = {i: after[i] for i, (_, c) in brute_docs(list(after.items())).items() if c == i}
    fourth = {i for i, t in third.items() if not any(" ".join(words_of(x)) in " ".join(words_of(t or "")) for _, x in items)}

    expected = [set(kept), set(after), set(third), fourth]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected, strict=False):
        stage(spark, frame, folder).write.parquet(p := f"file://{tmp_path}/{name}")
        frame = spark.read.parquet(p)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r.text for r in frame.collect()}
        if name == "line_dedup":  # MinHash may miss a pair
            assert sum(got.get(i, "-") != after[i] for i in after) <= 2 and len(set(got) ^ want) <= 1
        else:
            assert len(set(got) ^ want) <= 1, name
    out = corpus_pipeline.STAGES[-1][1](spark, frame, folder).collect()
    enc = token_files.Encoder(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {i: [*ids, 2] for i, t in got.items() if (ids := enc.whole(t or "").tolist())}
    tokens = {}
    for b in out:
        assert b.n_tokens <= 2048
        for d, s, e in zip(b.doc_ids, b.starts, [*b.starts[1:], b.n_tokens], strict=True):
            tokens.setdefault(d, []).extend(b.tokens[s:e])
    assert tokens == want
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, out))


def test_empty_tables_and_clashing_names(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    tables(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        frame.write.parquet(p := f"file://{tmp_path}/empty-{_}")
        frame = spark.read.parquet(p)
    assert frame.count() == 0
    names = ["id", "row", "removed", "own", "__gone", "__bad", "h1", "rep"]
    frame = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"doc_id as `{n}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns and out.count() > 100, name
