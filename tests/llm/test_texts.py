"""Line dedup, mixing, piece encoding, HTML text and WARC against brute force, and odd inputs."""

import hashlib
import base64
import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cvengine.llm import html_text, line_dedup, sentence_pieces, source_mix, warc
from cvengine.session import new_path


def words(line):
    return len(line.encode().split())


def plain_dedup(texts, least):
    """Deletes the lines of every later copy of a run of ``least`` words, over all runs of worded lines."""
    tokens = [[(i, x) for i, x in enumerate((t or "").split("\n")) if t is not None and words(x)] for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, own in enumerate(tokens):
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(x for _, x in own[a:b])
                if sum(map(words, run)) >= least:
                    if run in first:
                        gone[d] |= {i for i, _ in own[a:b]}
                    else:
                        first[run] = (d, a)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_equals_brute_force(spark):
    order = random.Random(3)
    lines = ["", " ", "a b", "c d e", "f", "g h i j", "k l", "m n o p q r s", "a b "]
    texts = ["\n".join(order.choice(lines) for _ in range(order.randint(0, 14))) for _ in range(60)]
    texts += [None, "", "\n\n", texts[5], texts[5], "x y z\n" * 12, "m n o p q r s"]
    rows = [(i, t, "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, line string")
    for least in (1, 4, 9):
        got = line_dedup.dedup_lines(table, least)
        assert got.columns == table.columns
        found = {r.doc_id: r for r in got.collect()}
        want = plain_dedup(texts, least)
        assert [found[i].text for i in range(len(texts))] == want
        assert all(found[i].n_chars == len(want[i] or "") for i in range(len(texts)))


def test_line_dedup_odd_inputs(spark):
    line = "one two three four five six"
    rows = [(None, line), (4, line), (4, line), (2, f"head\n{line}"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(table, 5, counts=True).collect()
    assert len(got) == 5
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(2, f"head\n{line}"): 1, (4, ""): 2, (None, ""): 1, (None, None): 1})
    assert line_dedup.dedup_lines(table.limit(0), 5).count() == 0
    long_text = "\n".join(f"{i} {line}" for i in range(20_000))
    twice = line_dedup.dedup_lines(spark.createDataFrame([(1, long_text), (2, long_text)], table.schema), 50)
    assert {r.doc_id: r.text for r in twice.collect()} == {1: long_text, 2: ""}


def test_line_dedup_runs_no_python(spark, sf):
    plan = line_dedup.op10_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def poisson_count(rate, u):
    term = total = math.exp(-rate)
    k = 0
    while total <= u:
        k += 1
        term *= rate / k
        total += term
    return k


def test_mix_equals_inverse_poisson(spark):
    sizes = {"a": 400, "b": 40, None: 10, "c": 1}
    rows = [(f"{s}{i}", s, f"t{i}", 1) for s, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id string, source string, text string, part int")
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), (None, 1.0), ("absent", 5.0)], "source string, weight double")
    total = 800
    got = source_mix.replicate(table, weights, total, seed=5)
    assert got.columns == table.columns
    counts = Counter(r.doc_id for r in got.collect())
    for doc, source, _, _ in rows:
        rate = total / 4 / sizes[source]
        parts = max(1, math.ceil(rate / 16))
        drawn = 0
        for part in range(1, parts + 1):
            u = (int(hashlib.md5(f"5|count|{doc}|{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            drawn += poisson_count(rate / parts, u)
        assert counts[doc] == drawn
    by_source = Counter()
    for doc, source, _, _ in rows:
        by_source[source] += counts[doc]
    assert all(abs(n - 200) < 60 for n in by_source.values())


def test_mix_odd_inputs(spark):
    schema = "doc_id long, source string, text string"
    rows = [(None, None, None), (None, "a", "x"), (1, "a", ""), (1, "a", ""), (2, "b", "long " * 50_000)]
    table = spark.createDataFrame(rows, schema)
    once = sorted(map(repr, source_mix.replicate(table, total=50).collect()))
    assert once == sorted(map(repr, source_mix.replicate(table.repartition(3), total=50).collect()))
    assert source_mix.replicate(table.limit(0)).count() == 0
    none = spark.createDataFrame([("a", None), ("b", 0.0)], "source string, weight double")
    assert source_mix.replicate(table, none).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.load_pieces(sentence_pieces.MODEL)


def test_pieces_equal_the_library(spark, sf, pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    order = random.Random(1)
    texts = [None, "", " ", "   ", " a", "\n\n x\n", "Hello  world  ", "▁▁a▁b", "\0a\0", "日本語テキスト 한국어", "😀😀 ok", "x" * 3000, " " * 37 + "end" + " " * 9]
    texts += ["".join(order.choice("ab  th einougzß\n▁,.'éà0123X-_/\\😀語") for _ in range(order.randint(1, 60))) for _ in range(2000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    table = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    encoded = sentence_pieces.encode(table, pieces)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else model.encode(t) for t in texts]
    back = {r.doc_id: r.out for r in sentence_pieces.decode(encoded, pieces, text="out").collect()}
    assert [back[i] for i in range(len(texts))] == [None if t is None else t.replace("▁", " ") for t in texts]
    assert sentence_pieces.encode(table.limit(0), pieces).count() == 0


def test_pieces_of_long_words(pieces):
    """Words without a blank are cut where no piece reaches across; ids stay the library's, and a page of them takes seconds."""
    model = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    order = random.Random(5)
    alphabets = ["".join(map(chr, range(0x4E00, 0x4E00 + 3000))), "abcdefgh", "the of and ing".replace(" ", ""), "日本語のテキスト漢字", "\U0001f600é語a", "a"]
    words = ["".join(order.choice(a) for _ in range(n)) for a in alphabets for n in (49, 120, 700)]
    words += [w for a in alphabets for w in ("".join(order.choice(a) for _ in range(n)) for n in (1, 5, 48))]
    ids, starts, sizes = sentence_pieces.encode_words(pieces, [sentence_pieces.SPACE + w for w in words])
    for word, start, size in zip(words, starts, sizes):
        assert ids[start : start + size].tolist() == model.encode(word)
    began = time.time()
    sentence_pieces.encode_words(pieces, ["".join(order.choice(alphabets[0]) for _ in range(200_000))])
    assert time.time() - began < 20


def test_pieces_decode_whole_lists(pieces):
    """Lists of a slice, NULL and empty ones; millions of ids are decoded in a second or two, which took twenty one by one."""
    rows = [[5], None, [], *([int(i) for i in pieces.key_ids[k : k + 40]] for k in range(0, 4000, 40)), [pieces.bytes_first + 0xE2], [pieces.bytes_first + 10, 300]]
    table = pa.array(pieces.text, pa.large_binary())
    want = [None if r is None else b"".join(pieces.text[i] for i in r).decode("utf-8", "replace").replace(sentence_pieces.SPACE, " ") for r in rows]
    want = [w[1:] if w and pieces.dummy_prefix and w[0] == " " else w for w in want]
    ids = pa.array(rows, pa.list_(pa.int32()))
    assert sentence_pieces.decode_lists(pieces, table, ids).to_pylist() == want
    assert sentence_pieces.decode_lists(pieces, table, ids.slice(1, 50)).to_pylist() == want[1:51]
    assert sentence_pieces.decode_lists(pieces, table, ids.slice(1, 2)).to_pylist() == [None, ""]
    assert sentence_pieces.decode_lists(pieces, table, ids.slice(0, 0)).to_pylist() == []
    many = pa.ListArray.from_arrays(pa.array(np.arange(0, 8_000_001, 2000), pa.int32()), pa.array(np.resize(pieces.key_ids, 8_000_000)))
    began = time.process_time()
    sentence_pieces.decode_lists(pieces, table, many)
    assert time.process_time() - began < 8


def test_pieces_query(spark, sf):
    assert sentence_pieces.op7_sentence_pieces(spark, sf).where(~F.col("round_trip")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>
<nav><ul><li>Home<li>More</ul></nav><div class="box">Same on all pages &amp; hosts</div>
<article><h1>Head&nbsp;line {n}</h1><p><b>First   para<br>of {n}<p>Second &lt;{n}&gt;</p><div class="ad">buy</div>
<p>shared passage</p><section id="comments"><p>reader {n}</p></section></article>
<footer>about<p>contact</p></footer></body></html>"""


def test_html_text(spark):
    rows = [(n, f"http://Site.example:80/{n}", PAGE.format(n=n)) for n in range(6)]
    bare = "<div>menu a</div><div>menu b</div><p>own text {n}</p><p>more<p>"
    rows += [(100 + n, "http://bare.example/x", bare.format(n=n)) for n in range(6)]
    rows += [(200, None, None), (201, "not a url [", ""), (202, "http://one.example/", bare.format(n=1)), (203, "http://bare.example/y", "<p"), (204, "", "a < b &am <i>c</i>d")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert got[3] == "Head line 3\nFirst para of 3\nSecond <3>\nshared passage"
    assert got[102] == "own text 2"  # the rest recurs on the host
    assert got[202] == "menu a\nmenu b\nown text 1\nmore"
    assert (got[200], got[201], got[203], got[204]) == ("", "", "", "a < b &am cd")
    assert html_text.extract(table.limit(0)).count() == 0


def test_html_near_copies_keep_their_article(spark):
    """Pages of a host that differ in title and menu only, with an article in containers; link lists in it recur and go."""
    bodies = {
        "div": "<div class=body>Text of the <b>body</b> in a div, long enough to be more than its links.</div>",
        "list": "<section><h2>Part</h2><ul><li>first of many items</li><li>second</li></ul></section>",
        "table": "<table><tr><td>cell one</td><td>cell two</td></tr></table><figure>a figure of it</figure>",
    }
    page = "<title>t {n}</title><div>menu {n}</div><div class=wrap><article>{head}{body}<ul><li><a href=x>Share</a></ul></article></div>"
    rows = [(n, f"http://{kind}{head}.example/", page.format(n=n, body=body, head=f"<h1>h {n}</h1>" * head)) for kind, body in bodies.items() for n in range(8) for head in (0, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {(r.url, r.page_id): r.text for r in html_text.extract(table).collect()}
    wanted = {"div": "Text of the body in a div, long enough to be more than its links.", "list": "Part\nfirst of many items\nsecond", "table": "cell one\ncell two\na figure of it"}
    for kind, text in wanted.items():
        assert [texts[f"http://{kind}1.example/", n] for n in range(8)] == [f"h {n}\n{text}" for n in range(8)]
        assert all(text in texts[f"http://{kind}0.example/", n] for n in range(8))


def test_html_side_names():
    """Classes and ids that only contain the word for a side part, and side parts' names on wrappers, keep their text."""

    def text(source):
        return html_text.Page(source, "h").main_text(lambda key: False)

    for name in ("layout has-sidebar", "content-sidebar-wrap", "no-sidebar", "with-ads", "sidebar", "sidebar-left", "ads"):
        for body in ("<article><p>text</article>", "<section><main><p>text</main></section>"):
            assert text(f'<div class="{name}">{body}</div>') == "text", name
    for part in ('<section id="related-work">', '<div class="social-science">', '<section id="social-media">', '<section id="notice-period">', '<div class="comment-on-law">'):
        assert text(f"<article><p>a</p>{part}<p>b</p></article>") == "a\nb", part
    for name in ("ad", "x ad-slot-2", "sidebar-left", "related_posts", "cookie-banner", "social-share-buttons", "ad-300x250"):
        assert text(f'<article><p>a</p><div class="{name}"><p>b</p></div></article>') == "a", name
        assert text(f"<p>a</p><section id={name.split()[-1]}><p>b</p></section>") == "a", name
    assert text('<div class=x><article class="comment"><p>b</article></div><article><p>a</article>') == "a"


PARTS = [
    ('<form id="aspnetForm"><article>text here</article></form>', "text here"),
    ('<div aria-hidden="true"><article>text</article></div>', "text"),
    ('<div role="dialog"><main>text</main></div><div role="dialog">more</div>', "text"),
    ('<article>Story</article><section class="comments"><article class="c">first!</article></section>', "Story"),
    ('<div class="content">story text</div><section class="comments"><article class="c">first!</article></section>', "story text"),
    ('<article>Story</article><section class="related-posts"><article>Teaser</article></section>', "Story"),
    ('<article>Story</article><div class="sidebar"><article class="card">x</article></div>', "Story"),
    ('<article>Story<p class="ad">buy</p><p class="notice">read this</p></article>', "Story\nread this"),
    ('<div class="content">long story</div><article class="teaser">Read next</article>', "long story"),
    ('<section class="comments"><article>nothing else</article></section>', "nothing else"),
    ('<article>one</article><article>two</article>', "one\ntwo"),
    ("<div>" + "a long text. " * 60 + "</div><article>short</article>", " ".join(["a long text."] * 60) + "\nshort"),
    ('<article>a<b>b<b>c</b>d</b>e</article>', "abcde"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ('<article>x<script>var a="</article>";</script>y</article>z', "xy"),
]


@pytest.mark.parametrize("source, text", PARTS)
def test_html_main_article(source, text):
    assert html_text.Page(source, "h").main_text(lambda key: False) == text


def test_html_nesting_takes_linear_time():
    began = time.time()
    for tag in ("div", "b", "p", "li", "td", "article"):
        html_text.Page(f"<{tag}>" * 20_000 + "x" + f"</{tag}>" * 20_000, "h").main_text(lambda key: False)
    assert time.time() - began < 6


def test_html_template_share(spark):
    rows = [(n, "http://large.example/", f"<p>own {n}</p><div>every page</div>" + "<div>on six pages</div>" * (n < 6)) for n in range(700)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert got[3] == "own 3\non six pages" and got[9] == "own 9"


def test_html_joined_templates_agree(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted(map(tuple, html_text.extract(pages, 2).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_SUBTREES", 0)
    assert sorted(map(tuple, html_text.extract(pages, 2).collect())) == want


def test_html_deep_nesting():
    page = html_text.Page("<div>" * 20_000 + "x" + "<b" * 5000, "h")
    assert page.main_text(lambda key: False) == "x"


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def test_warc_round_trip(spark):
    order = random.Random(2)
    long_page = "".join(order.choice("ab\r\n0ü語 😀") for _ in range(90_000))
    payloads = {1: "<p>a</p>", 2: None, 3: "<p>a</p>", 4: "", 5: long_page, 6: long_page, 7: "WARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n", 9: "x" * warc.SEGMENT}
    rows = [(i, f"http://h/{i}\r\nX: y" if i != 3 else None, p) for i, p in payloads.items()] + [(None, "u", "<p>a</p>"), (5, "http://h/5\r\nX: y", long_page)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("segment", F.lit(1))
    got = {r.page_id: r for r in warc.round_trip(table, new_path(spark, "warc")).collect()}
    assert got.keys() == {*payloads, None} and all(r.intact for r in got.values())
    for i, p in payloads.items():
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((p or "").encode()), digest(p or ""))
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 1, 4: 2, 6: 5, None: 1}
    assert got[1].url == "http://h/1X: y" and got[3].url is None


def test_warc_repeated_rows(spark, tmp_path):
    """A record and a result for each of several equal rows, as in the check SQL."""
    long_page = "é" * 60_000
    rows = [(1, "u", "a")] * 3 + [(2, "v", "a")] * 2 + [(3, "w", long_page)] * 2 + [(4, "w", long_page), (5, None, None), (5, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"]
    found = warc.round_trip(table, new_path(spark, "warc")).select(columns)
    table.write.parquet(str(tmp_path / "pages"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert Counter(map(tuple, found.collect())) == Counter(connection.execute(warc.CHECK_SQL).fetchall())


def test_warc_repeated_ids_and_no_ids(spark, tmp_path):
    rows = [(1, "a", "same"), (1, "b", "same"), (2, "c", "same"), (None, "d", "same"), (None, "e", "lone"), (None, "f", "two"), (None, None, "two"), (3, None, "x" * 50_000), (3, "g", "x" * 50_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"]
    found = warc.round_trip(table, new_path(spark, "warc")).select(columns).collect()
    table.write.parquet(str(tmp_path / "pages"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    assert Counter(map(tuple, found)) == Counter(connection.execute(warc.CHECK_SQL).fetchall())
    assert {(r.page_id, r.url): r.record_type for r in found if r.page_id == 1 or r.url == "e"} == {(1, "a"): "response", (1, "b"): "revisit", (None, "e"): "response"}


def test_clashing_columns(spark):
    """Columns named like those that an operator adds are replaced where it adds them, and pass through elsewhere."""
    text = "\n".join(f"line {i} of many words in a long text" for i in range(20))
    rows = [(1, text, "s"), (2, text, "s"), (3, "own", "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("part", "copy", "shuffle_key", "n_lines", "n_removed", "__row", "line", "pos", "n_chars"):
        table = table.withColumn(name, F.lit(7))
    marked = source_mix.replicate(table, marks=True)
    assert sorted(marked.columns) == sorted(table.columns)
    assert marked.where("part = 7 or shuffle_key = '7'").count() == 0 and source_mix.replicate(table).where("part = 7").count() > 0
    deduped = line_dedup.dedup_lines(table, counts=True)
    assert sorted(deduped.columns) == sorted(table.columns)
    assert sorted((r.doc_id, r.n_removed, r["__row"], r.line) for r in deduped.collect()) == [(1, 0, 7, 7), (2, 20, 7, 7), (3, 0, 7, 7)]
    assert line_dedup.dedup_lines(table).columns == table.columns


def test_weights_of_a_source_add_up(spark):
    table = spark.createDataFrame([(i, "x", "a" if i % 2 else "b") for i in range(200)], "doc_id long, text string, source string")
    twice = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "source string, weight double")
    once = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    assert sorted(source_mix.replicate(table, twice).collect()) == sorted(source_mix.replicate(table, once).collect())


def test_warc_limits(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.round_trip(table, new_path(spark, "warc"), least_bytes=3).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.round_trip(table.limit(0), new_path(spark, "warc")).count() == 0


def test_warc_notices_lost_segments(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "é" * 60_000)], "page_id long, url string, html string")
    records = warc.warc_records(table)
    assert records.count() > 2
    broken = records.where(~F.col("value").contains("WARC-Segment-Number: 2\r\n"))
    path = new_path(spark, "warc")
    broken.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    (row,) = warc.read_archives(spark, path).collect()
    assert row.whole is False and row.payload is None


def test_chunk_framing():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    assert warc.http_payload(head + b"3;x=1\r\nabc\r\n1\r\nd\r\n0\r\n\r\n") == b"abcd"
    assert warc.http_payload(head + b"9\r\nabc\r\n0\r\n\r\n") is None
    assert warc.http_payload(head + b"abc") is None
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nabc") == b"abc"
