import random
import zlib

from gridloom.llm import toxicity as tx

MODEL = tx.Model({"idiot": 3.0, "trash": 2.0, "scum": 2.0}, (-3.0, 2.0, 1.0, 0.0))


def brute_hits(folded, model):
    """Word by word: the longest entry that each word begins with, outside exception phrases."""
    w = folded.split()
    spared = set()
    for p in model.exceptions:
        p = tx.words_of(p)
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                spared |= set(range(i, i + len(p)))
    out = [max((k for k in model.lexicon if x.startswith(k)), key=len) for i, x in enumerate(w) if i not in spared and any(x.startswith(k) for k in model.lexicon)]
    return sum(model.lexicon[k] for k in out), len(out)


def test_folding():
    for t in ("idiot", "IDIOT", "1d10t", "іdіоt", "ｉｄｉｏｔ", "i​diot", "ídïòt", "𝐢𝐝𝐢𝐨𝐭", "idíot"):
        assert tx.fold(t) == " idiot", t
    assert tx.words_of("A%%% b### ß\tç…d") == ["a", "b", "ss", "c", "d"]
    assert tx.fold(None) == " "


def test_hits_against_brute_force():
    r = random.Random(1)
    words = ["idiot", "idiots", "trash", "can", "clown", "scum", "pond", "xidiot", "the", "tr", "1d1ot", "fish", ","]
    for _ in range(500):
        f = tx.fold(r.choice([" ", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 12))))
        assert MODEL.hits(f) == brute_hits(" ".join(f.split()), MODEL) or "  " in f.strip()


def test_exceptions_and_length():
    assert MODEL.hits(tx.fold("the trash can is full")) == (0, 0)
    assert MODEL.hits(tx.fold("trash cans")) == (2.0, 1)
    assert MODEL.score("idiot") > MODEL.score("idiot " + "fine words " * 400) > MODEL.score("fine words") == MODEL.score("") == MODEL.score(None)


def test_learns_and_holds_out(spark):
    r = random.Random(2)
    vocab = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("amel", "iron", "osta", "ulem", "erin")]
    bad = ["vilest", "grotty", "nastoid"]
    rows, labels = [], []
    for i in range(1500):
        toxic = int(r.random() < 0.15)
        w = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(bad).upper() if r.random() < 0.3 else r.choice(bad).replace("o", "0"))
        rows.append((i, " ".join(w), "en", 0.5))
        if i % 2:
            labels.append((i, toxic))
    truth = dict(labels)
    df = spark.createDataFrame(rows + [(9001, None, "en", 0.1), (9002, "", "en", 0.1), (None, "vilest", "en", 0.1)], "doc_id long, text string, lang string, score double").repartition(3)
    lab = spark.createDataFrame([(i, t) for i, t in labels] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = tx.train(df, lab)
    out = {x.doc_id: x for x in tx.score_toxicity(df, model).collect()}
    assert len(out) == 1503 and out[None].held_out is None and out[9001].predicted == 0
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1500))
    assert all(x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1 for x in out.values())
    held = [i for i in truth if out[i].held_out]
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    kept = {x.doc_id for x in tx.drop_toxic(df, model).collect()}
    assert kept == {i for i, x in out.items() if not x.predicted}
    assert tx.train(df, lab.limit(0)).score("vilest") < 0.5
    assert tx.score_toxicity(df.limit(0), model).count() == 0


def test_exceptions_are_learnt_and_taken(spark):
    """A pair of words that harmless rows have spares its hits; the same word elsewhere doesn't."""
    r = random.Random(5)
    vocab = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("amel", "iron", "osta", "ulem", "erin")]
    rows, labels = [], []
    for i in range(1200):
        w, toxic = [r.choice(vocab) for _ in range(r.randint(10, 40))], int(i % 6 == 0)
        if toxic:
            w[r.randrange(len(w))] = "grotty"
        elif i % 40 == 1:
            w[2:4] = ["grotty", "lantern"]
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.train(df, lab, exceptions=("grotty plaice",))
    assert "grotty lantern" in model.exceptions and "grotty plaice" in model.exceptions
    assert model.score("bamel grotty ciron") > 0.5 > max(model.score("bamel grotty lantern ciron"), model.score("a grotty plaice"))


def test_long_and_odd_texts(spark):
    model = tx.Model({"grotty": 3.0}, (-4.0, 6.0, 0.0, 0.0))
    long = "fine words " * 30_000
    df = spark.createDataFrame([(1, long, 5.0), (2, long + "grotty", 5.0), (3, None, 5.0), (3, "\ud83d\ude00 gr0tty", 5.0)], "doc_id long, text string, predicted double")
    got = sorted((x.doc_id, x.score) for x in tx.score_toxicity(df, model).collect())
    assert got[0][1] < 0.5 and len(got) == 4 and tx.drop_toxic(df, model).columns == df.columns
