"""Extraction and archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellmosaic.llm import html_text, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no, no, no";</script></head>
<body class="page has-sidebar"><header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more cookies, and we ask you to agree, please.</p></div>
<div id="content"><article><h1>The  title</h1><p>First &lt;para&gt;, with <b>bold</b>,
 and a line<br>break that goes on for some time, so that it counts.</p><!-- <p>hidden, hidden</p> --><div class="ad"><p>Buy, buy, buy now, really, it is cheap and good.</p></div>
<ul><li>item one</li><li>item two</li></ul><form><p>Your name, your mail, your all.</p><input></form><p>Short.<p>Last &#233;t&eacute; paragraph, unclosed</article></div>
<div id="comments"><article class="comment"><p>I think, therefore, that this is, all in all, a long comment, with commas, many.</p></article></div>
<aside><p>Related, things, to, read, and, so, on, and, on, for, long.</p></aside><footer><p>(c) 2020, all rights, reserved, by us, here.</p></footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "The title\nFirst <para>, with bold, and a line break that goes on for some time, so that it counts.\nitem one\nitem two\nShort.\nLast été paragraph, unclosed"


def test_main_text_without_article():
    page = "<body><div class=menu><a href=x>a</a> <a href=y>b</a></div><div><div class=story><p>" + "Some words, and more. " * 12 + "</p><p>" + "Second part, too. " * 9 + "</p></div><div class=sidebar><p>Other, text, here, long enough to count as one.</p></div></div></body>"
    got = html_text.main_text(page).split("\n")
    assert len(got) == 2 and got[0].startswith("Some words") and got[1].startswith("Second part")


def plain_score(nodes):
    """Scores by the definition: every paragraph's points to each element around it, less by a share at each step."""
    found = {}
    for node in (n for n in nodes if not n.dropped):
        at, points = node, html_text.paragraph_points(node)
        if html_text._own(node):
            found[id(node)] = found.get(id(node), 0.0) + points * (html_text.BESIDE if node.beside else 1)
        elif node.beside:
            points *= html_text.BESIDE
        share = points
        first = not html_text._own(node)
        while at.parent is not None:
            if not first:
                share *= html_text.PASSED * (html_text.BESIDE if at.beside else 1)
            first, at = False, at.parent
            found[id(at)] = found.get(id(at), 0.0) + share * (html_text.BESIDE if at.beside else 1)
    return found


def test_points_against_the_definition():
    import random

    rng = random.Random(6)
    for _ in range(60):
        depth, page = 0, "<body>"
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            if kind < 0.35:
                page += rng.choice(["<div>", "<section>", "<div class=comments>", "<article>", "<div class=story>", "<ul><li>"])
                depth += 1
            elif kind < 0.5:
                page += "</div>"
            else:
                page += f"<p>{', '.join(['words and more'] * rng.randint(0, 9))} {'<a href=x>a link</a>' if rng.random() < 0.3 else ''}</p>"
        nodes = html_text.parse(page)
        html_text._drop(nodes)
        html_text._measure(nodes)
        want = plain_score(nodes)
        for node in nodes:
            if not node.dropped:
                assert node.points == pytest.approx(want.get(id(node), 0.0)), page


SENTENCE = "Some words follow here, and then there are more of them, so that it reads like prose. "


@pytest.mark.parametrize("box", ["div", "section", "td"])
def test_points_choose_without_names(box):
    """Pages without tags or names that tell the article: it is found by its points alone."""
    wrap = (lambda x: f"<table><tr><td>{x}</td></tr></table>") if box == "td" else (lambda x: f"<{box}>{x}</{box}>")
    links = "".join(f"<li><a href=/{k}>link number {k}</a></li>" for k in range(30))
    story = "".join(f"<p>{SENTENCE * 3}part {k}.</p>" for k in range(6))
    page = f"<body>{wrap(f'<ul>{links}</ul>')}{wrap(story)}{wrap('<p>Short note.</p>')}</body>"
    assert html_text.main_text(page).split("\n") == [f"{SENTENCE * 3}part {k}." for k in range(6)]


def test_a_name_is_a_discount_and_no_veto():
    story = "".join(f"<p>{SENTENCE * 4}part {k}.</p>" for k in range(6))
    note = f"<div class=box><p>{SENTENCE}</p></div>"
    assert "part 5." in html_text.main_text(f"<body><div class='social-widget'>{story}</div>{note}</body>")
    # the same name beside a longer text is left out, as are comments inside the article
    page = f"<body><div class=box>{story}{story}</div><div class='social-widget'><p>{SENTENCE}</p></div></body>"
    assert "part 5." in html_text.main_text(page) and html_text.main_text(page).count("part 5.") == 2
    inside = f"<body><div class=post>{story}<div class=comments><p>{SENTENCE}I think.</p></div></div></body>"
    assert "I think" not in html_text.main_text(inside) and "part 5." in html_text.main_text(inside)


def test_points_choose_between_articles():
    """A teaser in an article of its own doesn't win over the text, wherever it stands."""
    story = "".join(f"<p>{SENTENCE * 3}part {k}.</p>" for k in range(6))
    page = f"<body><article><p>Teaser, read on.</p></article><div><div class=x>{story}</div></div></body>"
    assert html_text.main_text(page).startswith(SENTENCE) and "Teaser" not in html_text.main_text(page)


def test_deep_pages_take_linear_time():
    import time

    def took(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    deep = lambda n: "<div>" * n + f"<p>{SENTENCE}</p>" * n + "</div>" * n
    assert took(deep(20_000)) < 5 and took("<b>" * 20_000 + "<div>x</div></zz></p>" * 20_000) < 5


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text, here" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav><a href=x>only menu</a></nav>"), (None, "u", "just text & more"), (4, "u", deep), (5, "u", "<p>" + "long, " * 100_000), (5, "u", "<p>x<"), (6, "u", "<script>never closed")]
    got = html_text.extract_text(pages(spark, rows)).collect()
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {(r["page_id"], r["n_chars"]): r["text"] for r in got}
    assert text[(1, 0)] == text[(2, 0)] == text[(3, 0)] == text[(6, 0)] == "" and text[(None, 16)] == "just text & more" and text[(4, 15)] == "deep text, here"
    assert (5, 599_999) in text
    assert html_text.extract_text(pages(spark, [])).count() == 0


ROWS = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/3", "<p>öther</p>"), (9, "http://a/9", "<p>same</p>"), (4, None, None), (5, "u\r\nv", ""), (6, "http://a/6", "long " * 50_000), (None, "http://a/n", "<p>null id</p>")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    warc.register(spark)
    path = str(tmp_path_factory.mktemp("warc") / "x")
    warc.archive_pages(pages(spark, ROWS), path)
    return path


def test_round_trip(spark, archive):
    got = {r["page_id"]: r for r in warc.read_pages(spark, archive, payload=True).collect()}
    by_payload = defaultdict(list)
    for i, _, h in ROWS:
        by_payload[h or ""].append(i)
    for i, url, h in ROWS:
        r, data = got[i], (h or "").encode()
        whole = max(by_payload[h or ""], key=lambda x: -1 if x is None else x)
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == whole else ("revisit", whole))
        assert r["payload"] == (data if i == whole else None) and r["url"] == (url or "").replace("\r\n", "")


def test_lengths_without_decoding(spark, archive):
    one, two = ({(r["page_id"], r["payload_bytes"], r["record_type"]) for r in warc.read_pages(spark, archive, payload=p).collect()} for p in (False, True))
    assert one == two


def test_pushdown(spark, archive):
    rows = spark.read.format("warc").load(archive).filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://a/3"))
    assert [r["payload"] for r in rows.collect()] == ["<p>öther</p>".encode()]
    reader = warc.WarcReader(archive, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)])) == [GreaterThan(("payload_bytes",), 3)]
    kinds = {b.column(1)[k].as_py() for p in reader.partitions() for b in reader.read(p) for k in range(b.num_rows)}
    assert kinds == {"response"}


def test_foreign_archives(spark, tmp_path):
    """Plain files, and gzip members without a length in their header."""
    made = [warc.page_record(f"urn:page:{k}", f"http://x/{k}", b"payload %d" % k * 9000, None) for k in range(3)]
    plain = b"".join(gzip.decompress(x) for x in made)
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(gzip.decompress(x)) for x in made))
    warc.register(spark)
    for name in ("a.warc", "b.warc.gz"):
        got = {r["page_id"]: r for r in warc.read_pages(spark, str(tmp_path / name), payload=True).collect()}
        assert {k: r["payload"] for k, r in got.items()} == {k: b"payload %d" % k * 9000 for k in range(3)}


def test_least_bytes_and_empty(spark, tmp_path):
    warc.register(spark)
    warc.archive_pages(pages(spark, ROWS), str(tmp_path / "y"), least_bytes=1000)
    assert {r["record_type"] for r in warc.read_pages(spark, str(tmp_path / "y")).collect()} == {"response"}
    warc.archive_pages(pages(spark, []), str(tmp_path / "z"))
    assert warc.read_pages(spark, str(tmp_path / "z")).count() == 0


def read_bytes(data: bytes, payloads: bool = True, wanted=lambda h: True):
    import pyarrow as pa

    source = warc._Bytes(pa.BufferReader(data))
    return list(warc.records(source, wanted, payloads)), source.fetched


@pytest.mark.parametrize("kind", ["plain", "gzip", "sized"])
def test_files_cut_anywhere(kind):
    made = [warc.page_record(f"urn:page:{k}", f"http://x/{k}", bytes((k * j * 7919) % 251 for j in range(900 * k)), None) for k in range(4)]
    if kind == "plain":
        made = [gzip.decompress(x) for x in made]
    elif kind == "gzip":
        made = [gzip.compress(gzip.decompress(x)) for x in made]
    whole, _ = read_bytes(b"".join(made))
    assert len(whole) == 4 and not any(cut for _, _, cut in whole)
    ends = [sum(map(len, made[: k + 1])) for k in range(4)]
    for at in range(0, ends[-1], 100):
        for payloads in (True, False):
            got, _ = read_bytes(b"".join(made)[:at], payloads)
            done = sum(e <= at for e in ends)
            assert [h for h, _, _ in got[:done]] == [h for h, _, _ in whole[:done]] and not any(cut for _, _, cut in got[:done])
            begun = at > (ends[done - 1] if done else 0)
            # of a plain record only the line breaks behind its block may be lacking
            assert len(got) == done + begun and (not begun or got[-1][2] or (kind == "plain" and at >= ends[done] - 4))
            if payloads and begun and got[-1][0]:
                assert whole[done][1].startswith(got[-1][1])


def test_unwanted_bytes_are_not_read():
    import random

    noise = random.Random(3).randbytes(400_000)
    made = [warc.page_record(f"urn:page:{k}", f"http://x/{k}", noise, None) for k in range(6)]
    for data in (b"".join(made), b"".join(gzip.decompress(x) for x in made)):
        got, fetched = read_bytes(data, wanted=lambda h: h["warc-target-uri"].endswith("/5"))
        assert [b.endswith(noise) for _, b, _ in got] == [True] and fetched < 0.3 * len(data)
        got, fetched = read_bytes(data, payloads=False)
        assert len(got) == 6 and fetched < 0.1 * len(data)


def test_damaged_members_are_errors():
    one = bytearray(warc.page_record("urn:page:1", "http://x", b"payload " * 5000, None))
    one[len(one) // 2] ^= 0xFF
    with pytest.raises(ValueError, match="damaged"):
        read_bytes(bytes(one))
    with pytest.raises(ValueError, match="damaged"):
        read_bytes(b"\x1f\x8b\x08\x04" + bytes(6) + b"\x0c\0sl\x08\0" + b"\x01\0\0\0" + bytes(40))


def test_truncated_rows(spark, tmp_path):
    made = [warc.page_record(f"urn:page:{k}", f"http://x/{k}", b"payload %d" % k * 9000, None) for k in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made)[:-50])
    warc.register(spark)
    for payload in (True, False):
        got = warc.read_pages(spark, str(tmp_path / "a.warc.gz"), payload).collect()
        assert [(r["page_id"], r["truncated"]) for r in got] == [(0, False), (1, False), (2, True)]


def test_repeated_page_ids(spark, tmp_path):
    rows = [(7, "a", "<p>x</p>"), (7, "a", "<p>x</p>"), (7, "b", "<p>y</p>"), (3, "c", "<p>x</p>"), (None, "d", "<p>x</p>")]
    warc.register(spark)
    warc.archive_pages(pages(spark, rows), str(tmp_path / "r"))
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, str(tmp_path / "r")).collect())
    assert got == [("3", "revisit", 7), ("7", "response", None), ("7", "response", None), ("7", "response", None), ("None", "revisit", 7)]


def test_dense_and_sparse_members_follow_one_another():
    """Records that inflate much or little, of sizes about the reader's blocks, with and without lengths in the header: all are found whole."""
    import random

    rng = random.Random(11)
    for _ in range(60):
        payloads = []
        for _ in range(rng.randint(1, 8)):
            size = max(0, rng.choice((0, 10, 8 << 10, 64 << 10, 65 << 10, 200_000)) + rng.randint(-40, 40))
            dense = rng.random()
            payloads.append(rng.randbytes(size) if dense < 0.3 else b"<td>%d</td>" % rng.randint(0, 9) * (size // 9) if dense < 0.8 else rng.randbytes(size // 3) + b"a" * size)
        made = [warc.page_record(f"urn:page:{k}", f"http://x/{k}", p, None) for k, p in enumerate(payloads)]
        foreign = [m if rng.random() < 0.3 else gzip.compress(gzip.decompress(m), rng.choice((1, 6, 9))) for m in made]
        for whole in (True, False):
            got, _ = read_bytes(b"".join(foreign), whole)
            assert [h["warc-target-uri"] for h, _, _ in got] == [f"http://x/{k}" for k in range(len(made))] and not any(cut for _, _, cut in got)
            assert not whole or [b.partition(b"\r\n\r\n")[2] for _, b, _ in got] == payloads


@pytest.mark.parametrize("part", ["<a ", '<a href="', "<a x='", "<a", "<a/", "<!", '<a "<a ', "<a '\"<b ", "<title>", "<script", "<textarea", "</a ", '<p class="x" <'])
@pytest.mark.parametrize("end", ["", '"', "'", ">", '">', "'\"", "' \" '"])
def test_unclosed_tags_take_linear_time(part, end):
    page = "<p>" + "begin of a text, with words. " * 4 + "</p>" + part * (1_000_000 // len(part)) + end
    began = time.time()
    html_text.parse(page)
    assert time.time() - began < 4


def test_tokens_of_broken_tags():
    """What is behind a tag that isn't closed is found as in a page without it, and the tag itself is text."""
    tags = lambda page: [(n.tag, [p for p in n.parts if isinstance(p, str)]) for n in html_text.parse(page)]
    assert tags("a <b x=\"1>2\" y='>'>c</b> < d <3 <p")[1:] == [("b", ["c"])]
    assert tags("a <b x=\"1 <i>c</i>") == [("html", ["a <b x=\"1 "]), ("i", ["c"])]
    assert tags('<b x="<i>c</i> <s>d</s>') == [("html", ['<b x="', " "]), ("i", ["c"]), ("s", ["d"])]
