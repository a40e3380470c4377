import random
import zlib

import numpy as np
import pytest

from gridloom.llm import html_text, token_files, url_filter

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>'</script></head><body>{body}</body></html>"


def test_main_text_leaves_boilerplate():
    body = """<header><p>Site, name, and a long tag line, with commas, everywhere</p></header><nav><ul><li><a href=/a>One</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies, lots, of, them, all, the, time.</p></div><div class=ad>Buy, buy, buy, now.</div>
    <div id=main><article><h1>Title &amp; more</h1><p>First  one,\n with <b>bold<br><p>Second, &eacute;t&#233; &lt;x&gt;, text that goes on, and on.</p><form><p>Mail, us, here</p></form>
    <div class="comments"><p>Reader, says, hello, and, more</p></div><p>Third.</p></article></div><aside><p>Related, things, a, b</p></aside><footer>&copy; x</footer>"""
    assert html_text.main_text(page(body)) == "Title & more\n\nFirst one, with bold\n\nSecond, été <x>, text that goes on, and on.\n\nThird."


def test_main_text_without_article():
    long = "A sentence with words, and commas, that runs on for a while so that it scores. " * 3
    body = f"<div class=menu><p>{long}</p></div><div><div class=sidebar>{long}</div><div class=story><p>{long}</p><p>{long}</p></div><p>{'<a href=x>link, link, link</a> ' * 9}</p></div>"
    assert html_text.main_text(page(body)) == (long.strip() + "\n\n") * 1 + long.strip()


def test_main_text_odd_input(spark):
    for x in (None, "", "   ", "<p", "<!-- x", "<script>a", "<div><span></div></p></p>"):
        assert html_text.main_text(x) == ""
    assert html_text.main_text("plain, text &am") == "plain, text &am"
    assert html_text.main_text("<p>a<p>b" + "<div>" * 3000 + "c")
    df = spark.createDataFrame([(1, "u", "<p>a é</p>", "t"), (None, None, None, "t"), (1, "u", "<p>a é</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.extract_main_text(df).collect()), key=str) == [(1, "u", "a é", 3), (1, "u", "a é", 3), (None, None, "", 0)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0


TEXTS = [None, "", " \n", "a.b,c1d2 x.'s he'll... 3's '.a é.b.é a≠b ≠c .̀a", "a <|endoftext|> B", "<|ENDOFTEXT|>x", "tab\tnl\x0b\x85z q w", "ÀÉ é İ ſ", "日本語 text's IT'S", "x" * 300 + " " + "y" * 70, "\x1c a\x1cb", "don't we'LL", "a" * 5000, "% %% a%b%"]


def test_encoder_equals_tokenizer(monkeypatch):
    from gridloom.llm.common import text_buffers
    import pyarrow as pa

    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("ab é'.,1 \n\tST<|>́") for _ in range(r.randint(0, 60))) for _ in range(400)]
    monkeypatch.setattr(token_files, "CACHE", 300)
    enc = token_files.Encoder(public.path("word_bpe_49k.json"))
    for lo in range(0, len(texts), 90):
        some = texts[lo : lo + 90]
        ids, off = enc.encode(*text_buffers(pa.array(some, pa.string())), 2)
        for k, t in enumerate(some):
            assert ids[off[k] : off[k + 1]].tolist() == [*enc.whole(t or "").tolist(), 2], t


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 101, t, i) for i, t in enumerate(TEXTS * 4)] + [(None, "gone", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    p = f"file://{tmp_path}/ids"
    token_files.write_tokens(df, p, public.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in token_files.read_tokens(spark, p).collect()}
    enc, start = token_files.Encoder(public.path("word_bpe_49k.json")), 0
    want = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    assert len(got) == len(want)
    for i, t, _ in want:
        ids = [*enc.whole(t or "").tolist(), 2]
        assert (got[i].start, got[i].n_tokens, got[i].tokens) == (start, len(ids), ids)
        start += len(ids)
    assert [r.doc_id for r in token_files.read_tokens(spark, p, 10, 20).select("doc_id").orderBy("doc_id").collect()] == [i for i, _, _ in want if 10 <= i <= 20]
    crc = {r.doc_id: r.ids_crc32 for r in token_files.read_tokens(spark, p).mapInArrow(token_files._crcs, "doc_id long, start long, n_tokens long, ids_crc32 long").collect()}
    assert all(crc[i] == zlib.crc32(np.array(got[i].tokens, "<u4").tobytes()) for i in crc)
    token_files.write_tokens(df.limit(0), p + "2", public.path("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, p + "2").count() == 0


def test_token_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(0, 5000).selectExpr("id as doc_id", "repeat('word other ', 20) as text")
    token_files.write_tokens(df, f"file://{tmp_path}/ids", public.path("word_bpe_49k.json"))
    part = sorted((tmp_path / "ids").glob("*.parquet"))[0]
    col = pq.ParquetFile(part).metadata.row_group(0)
    named = {col.column(i).path_in_schema: col.column(i) for i in range(col.num_columns)}
    assert "RLE_DICTIONARY" in str(named["tokens.list.element"].encodings)
    assert named["doc_id"].has_offset_index and named["doc_id"].has_column_index


URLS = ["https://Example.com/en/1", "http://www.example.com/en/x?q#f", "http://www.example.com/de/", "https://a.b.net/es/9", "net://net/fr/", "http://x.net?/es/", "ftp://com", "http://notexample.com/en/", "no scheme/en/", "", None, "http:///en/", "a://b://c.com/en", "http://EXAMPLE.COM/EN/", "http://com/", "http://.com/x", "http://example.org/"]


def test_url_verdicts_against_sql(spark):
    import duckdb

    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[0], "y"), (0, URLS[0], "y")], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.url_verdicts(df, rules).collect()), key=str)
    pages = df.toPandas().astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", pages)
    assert got == sorted(con.execute(url_filter.OP8_SQL).fetchall(), key=str)
    assert {r.verdict for r in url_filter.url_verdicts(df, rules.limit(0), otherwise="block").collect()} == {"block"}
    assert url_filter.url_verdicts(df.limit(0), rules).count() == 0


def test_bloom_filter_has_no_misses_and_prunes(spark):
    listed = spark.range(2000).selectExpr("concat('k', id) as key")
    blocks = url_filter.bloom_blocks(listed, "key")
    assert url_filter.passing(listed, "key", blocks).count() == 2000
    assert url_filter.passing(spark.range(20000).selectExpr("concat('z', id) as key"), "key", blocks).count() < 400


def test_large_list_of_urls(spark):
    r = random.Random(3)
    rules = [(f"h{r.randrange(40)}.com", "/" + "/".join(str(r.randrange(3)) for _ in range(r.randrange(3))), r.choice(["allow", "block"])) for _ in range(200)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{r.choice(['', 'www.', 'a.b.'])}h{r.randrange(50)}.com/" + "/".join(str(r.randrange(3)) for _ in range(4)) for _ in range(400)]
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == (max(fit)[1:] if fit else (None, "allow"))


def test_url_filter_is_exact_at_any_size(spark, monkeypatch):
    """A long list through a filter, and through a join where the filter would be too large."""
    r = random.Random(12)
    rules = [(f"h{r.randrange(300)}.example", f"/p{k}/", r.choice(["allow", "block"])) for k in range(600)]
    pages = [(i, f"https://www.{h}{p}x?y" if i % 3 else f"http://{h}/other", None) for i, (h, p, _) in enumerate(rules)] + [(9000, None, 1), (9001, "no scheme", 1), (9002, "https://", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, row long")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = {}
    for i, (h, p, v) in enumerate(rules):
        want[i] = (h + p if i % 3 else None)
    for bits in (url_filter.BLOCK_BITS, 5):
        monkeypatch.setattr(url_filter, "BLOCK_BITS", bits)
        got = {x.page_id: x.rule for x in url_filter.url_verdicts(df, listed).collect()}
        assert all(got[i] == w for i, w in want.items()) and len(got) == len(pages) and got[9000] is None and got[9001] is None
