"""Operators on ``pages``: rules and lists, archives, main text."""

import base64
import hashlib
import html
import re
from pathlib import Path

import pytest

from spindlescope.llm import page_text, url_filter, warc
from spindlescope.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")
SCHEMA = "page_id long, url string, html string, host string, rule string, digest string, text string, first long"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA)


EDGES = [(1, None, None), (2, "", ""), (3, "no scheme", "<p>x"), (4, "http://A.Example.com/en/x?y#z", "same"), (5, "https://www.example.com/en/", "same"), (5, "https://www.example.com/en/", "same"),
         (6, "http://x.net/es/a", "é\r\n\r\nWARC/1.0\r\n\r\n"), (7, "ftp://net/fr/", "w" * 200_000), (8, "http://com", "<b>"), (9, "http://q.org/a/", "1"), (10, "https://www.q.org:443/a?b=1", "2"), (11, "http://q.org/b", "3"), (None, "http://q.org/b", "4")]


def test_rules_and_list(spark):
    pages = pages_of(spark, EDGES)
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.repeated_urls(pages)).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.example.com", "/en/x", "example.com/en/", "block"),
                   (5, "www.example.com", "/en/", "www.example.com/en/", "allow"), (6, "x.net", "/es/a", "net/es/", "block"), (7, "net", "/fr/", "net/fr/", "block"),
                   (8, "com", "", None, "allow"), (9, "q.org", "/a/", None, "block"), (10, "www.q.org:443", "/a", None, "block"), (11, "q.org", "/b", None, "block"), (None, "q.org", "/b", None, "block")}
    assert url_filter.judge_urls(pages_of(spark, []), url_filter.repeated_urls(pages_of(spark, []))).count() == 0


def test_filter_lets_every_listed_url_through_and_few_others(spark):
    listed = spark.range(3000).selectExpr("concat('h.org/', id) AS canonical")
    asked = spark.range(12_000).selectExpr("concat('h.org/', id) AS canonical")
    for urls in (3000, 40):  # the second: a filter far too small for its list is slower, not wrong
        hits = {r[0] for r in url_filter.possible_hits(asked, "canonical", listed, "canonical", urls).collect()}
        assert {f"h.org/{i}" for i in range(3000)} <= hits
        assert urls == 40 or len(hits) < 3400


def test_archives_round_trip(spark, tmp_path):
    folder = str(tmp_path / "warc")
    warc.write_warc(pages_of(spark, EDGES), folder)
    got = warc.captures(warc.read_warc(spark, folder)).collect()
    rows = [r for r in EDGES if r[0] is not None]
    assert len(got) == len(rows)
    payload = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body, main = payload[r["page_id"]], r["response"]
        assert main["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and main["payload_bytes"] == len(body)
        same = min(i for i, b in payload.items() if b == body)
        assert main["kind"] == ("response" if same == r["page_id"] else "revisit")
        assert main["refers_to"] == (None if same == r["page_id"] else f"urn:capture:response:{same}")
        assert bytes(main["body"]) == (body if main["kind"] == "response" else b"")
        assert r["request"]["kind"] == "request" and r["metadata"]["kind"] == "metadata"
    warc.write_warc(pages_of(spark, []), str(tmp_path / "none"))


def test_lonely_records_still_make_a_capture(spark):
    rows = [("a", "response", None, "u", None, None, "d", 1, None, b"x"), ("q", "request", "zz", "u", None, None, None, None, None, b"")]
    got = warc.captures(spark.createDataFrame(rows, warc.RECORD)).collect()
    assert len(got) == 1 and got[0]["request"] is None and got[0]["response"]["record_id"] == "a"


def plain(page):
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?p>|</?h1>", m[1]) if m else []
    found = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[bi]>", "", x.replace("<br>", " ")))).strip() for x in parts]
    return "\n".join(x for x in found if x)


@tables
def test_articles_come_out_whole(spark):
    want = {r["page_id"]: plain(r["html"]) for r in table(spark, SF_DIR, "pages").collect()}
    got = {r["page_id"]: r["text"] for r in page_text.main_text(table(spark, SF_DIR, "pages")).collect()}
    assert got == want


def test_repeated_runs_go_on_pages_without_an_article(spark):
    page = ("<html><body class='no-sidebar'><div>Home About Contact Us Today Now</div><p>Unique text number {0} is here and goes on with word{0} x{0} y{0}.</p>"
            "<aside>aside {0}</aside><form>form</form><div class='ad'>buy {0}</div><div>Copyright all rights reserved by the company ok</div>")
    pages = pages_of(spark, [(i, f"http://a.b/{i}", page.format(i)) for i in range(12)] + [(i + 50, *r[1:]) for i, r in enumerate(EDGES)])
    got = {r["page_id"]: r["text"] for r in page_text.main_text(pages).collect()}
    for i in range(12):
        assert got[i] == f"Unique text number {i} is here and goes on with word{i} x{i} y{i}."
    assert got[50] == got[51] == "" and got[52] == "x" and got[57] == "w" * 200_000
    sharded = page_text.boilerplate_runs(page_text.stage(page_text.block_table(pages).withColumn("page_key", page_text.F.monotonically_increasing_id())
                                         .select(url_filter.host_of(page_text.F.col("url")).alias("host"), "page_key", "opens")), shard_pages=6)
    assert sharded.where("host = 'a.b'").count() > 0
    assert page_text.main_text(pages_of(spark, [])).count() == 0


def test_counts_of_shards_are_added_up(spark):
    notice = "This notice about cookies stands on three pages of the host alone"
    unique = "<p>" + " ".join("w{0}x%d" % k for k in range(12)) + "</p>"
    pages = pages_of(spark, [(i, f"http://a.b/{i}", f"<html><body>{unique.format(i)}" + (f"<div>{notice}</div>" if i % 20 == 0 else "")
                              + ("<div>Share this</div>" if i % 20 == 1 else "") + f"<p>one of the most common {i} ends here {i} today {i}</p>") for i in range(60)])
    opened = page_text.stage(page_text.block_table(pages).withColumn("page_key", page_text.F.monotonically_increasing_id())
                             .select(url_filter.host_of(page_text.F.col("url")).alias("host"), "page_key", "opens"))
    found = [{r["run_hash"] for r in page_text.boilerplate_runs(opened, shard_pages=n).collect()} for n in (512, 6, 1)]
    assert found[0] and found[0] == found[1] == found[2]
    got = {r["page_id"]: r["text"] for r in page_text.main_text(pages).collect()}
    for i in range(60):
        assert notice not in got[i] and "Share this" not in got[i] and f"w{i}x3" in got[i] and f"common {i} ends" in got[i]


def test_blocks_of_articles_go_through_the_runs(spark):
    notice = "Sign up here to get all of our stories by mail each day"
    quoted = "An article may quote this whole sentence of another article of this host now"
    unique = "<p>" + " ".join("w{0}x%d" % k for k in range(12)) + "</p>"
    rows = [(i, f"http://a.b/{i}", f"<article>{unique.format(i)}<p>{notice}</p><p>Share</p>" + (f"<p>{quoted}</p>" if i < 9 else "") + "</article>") for i in range(30)]
    rows += [(100 + i, f"http://copies.net/{i}", f"<article><p>{quoted}</p></article>") for i in range(30)]
    rows += [(200, "http://c.d/", "<main>card</main>" + unique.format(200)), (201, "http://c.d/", f"<main>{unique.format(201)}</main><p>see more")]
    got = {r["page_id"]: r["text"].split("\n") for r in page_text.main_text(pages_of(spark, rows)).collect()}
    plain = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    for i in range(30):
        assert got[i] == [plain(i)] + ([quoted] if i < 9 else [])
        assert got[100 + i] == [quoted]  # one text, however often it is there
    assert got[200] == ["card", plain(200)] and got[201] == [plain(201)]


def test_a_shard_counts_as_sets_do():
    pages = [("a", ["x y z x y", "p q"], [False, True]), ("a", ["y z x y", "p q", "p q"], [True, True, False]), ("b", ["x y z"], [False])]
    hosts, runs = page_text._shard_runs(pages, 3, page_text.WordHashes())
    part = page_text._packed(hosts, runs, 1)
    got = page_text._unpacked(sum(part.column("sizes")[0].as_py()), part.column("data")[0].as_py())
    assert sorted(zip(got["pages"].tolist(), got["open"].tolist())) == [(1, True), (1, True), (2, True), (2, True), (2, True)]
    assert sorted(runs["key"].tolist()) == sorted(got["key"].tolist())


def test_runs_of_a_suffix_array():
    streams = [[1, 2, 3, 4, 5, 9], [7, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [3, 4, 5, 1], []]
    assert page_text.repeated_runs(streams, 5, 3) == {(1, 2, 3, 4, 5)}
    for run in (1, 2, 3, 4, 5, 6):
        for least in (1, 2, 3):
            seen = {}
            for i, s in enumerate(streams):
                for a in range(len(s) - run + 1):
                    seen.setdefault(tuple(s[a:a + run]), set()).add(i)
            assert page_text.repeated_runs(streams, run, least) == {w for w, p in seen.items() if len(p) >= least}


def test_blocks_of_odd_markup():
    text = lambda page: "\n".join(t for s, t in page_text.blocks(page) if s != "marked")
    assert text("<p>a<p>b<br>c &amp;&lt;d&gt; &eacute;&#233;&#xe9;") == "a\nb c &<d> ééé"
    assert text("<article><h1>T &am</h1><p>x <b>y</b>z<nav>menu</nav>w</article><p>out") == "T &am\nx yz\nw\nout"
    assert text("<script>if (a < b) {x('</p>')}</script>t<!-- c <p> -->u<style>s") == "tu"
    assert text("<div title='a > b'>k</div><textarea>no</textarea> 5 < 6") == "k\n5 < 6"
    assert text("<article>one<div class=comments><article>reader</article></div>two") == "one\ntwo"
