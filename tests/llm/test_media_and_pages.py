"""Audio columns, HTML extraction, fixity audit and language ID."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from changefold.llm import html as pages_of
from changefold.llm import language, telephony, warc
from changefold.llm.html import Page, extract_pages, host_of, templates

# --- telephony -------------------------------------------------------------------------


def test_companding_tables():
    # known values of both laws, and monotone halves
    assert telephony.MU[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A[[0, 0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-5504, -8, 8, -32256, 32256]
    assert sorted(set(telephony.MU.tolist())) == sorted({-v for v in telephony.MU.tolist()}) and len(set(telephony.A.tolist())) == 256


def decode_slowly(block):
    """One ADPCM block, sample by sample."""
    value, index = struct.unpack("<hB", block[:3])
    index, out = min(index, 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                if code & bit:
                    diff += part
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(telephony.MOVES[code])))
            out.append(value)
    return out


def test_adpcm_against_plain_decoder():
    raw = np.random.default_rng(1).integers(0, 256, size=(37, telephony.BLOCK), dtype=np.uint8)
    assert telephony.decode_adpcm(raw).tolist() == [decode_slowly(b.tobytes()) for b in raw]


def test_resampling():
    pcm = np.array([0, 10, 20, -20], dtype=np.int16)
    assert telephony.resample(pcm, 8000, 16000).tolist() == [0, 5, 10, 15, 20, 0, -20, -20]
    assert telephony.resample(pcm, 8000, 8000) is pcm and len(telephony.resample(pcm, 8000, 12000)) == 6
    assert len(telephony.resample(pcm[:0], 8000, 16000)) == 0


@pytest.mark.parametrize("codec", [telephony.MULAW, telephony.ALAW, telephony.IMA])
def test_wave_round_trip(codec):
    for size in (576, 1152, 577):
        payload = random.Random(size).randbytes(size)
        assert telephony.parse_wave(telephony.wave(payload, codec)) == (codec, 8000, payload)
    with pytest.raises(ValueError):
        telephony.parse_wave(telephony.wave(payload, codec)[:-9])


def test_media_rows(spark):
    docs = [(1, "a" * 576), (2, None), (2, ""), (None, "é" * 400), (5, "x" * 300_000), (6, "a" * 576)] + [(i, f"text {i}") for i in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("media", F.lit(1))
    got = telephony.media_rows(df).collect()
    assert len(got) == len(docs)
    for (doc_id, text), r in zip(docs, sorted(got, key=lambda r: docs.index(next(d for d in docs if d[0] == r["doc_id"] and len((d[1] or "").encode()) == r["n_bytes"]))), strict=True):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        codec, _, back = telephony.parse_wave(bytes(r["media"]))
        assert back == payload and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        pcm = telephony.expand(payload, codec)
        assert f"codec={codec};" in r["feature"] and r["feature"].endswith(telephony.measures(pcm))
        assert np.frombuffer(r["pcm"], "<i2")[::2].tolist() == pcm.tolist()
    by_text = {}
    for r in got:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["pcm_sha256"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert telephony.media_rows(df.limit(0)).count() == 0


def test_stored_pcm(spark, tmp_path):
    df = spark.createDataFrame([(i, f"some text {i} " * i) for i in range(30)] + [(None, None)], "doc_id long, text string")
    kept = telephony.store_media(df, str(tmp_path / "media"), 8000).collect()
    assert len(kept) == 31
    for r in kept:
        codec, rate, payload = telephony.parse_wave(bytes(r["media"]))
        assert rate == 8000 and hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and hashlib.sha256(r["pcm"]).hexdigest() == r["pcm_sha256"]
        assert np.frombuffer(r["pcm"], "<i2").tolist() == telephony.expand(payload, codec).tolist()


# --- HTML ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; <b>bold</b> text", "plain & bold text"), ("<p>a<p>b<br>c", "a\n\nb c"),
        ("<nav>menu</nav><article><h1>T &lt;x&gt;</h1><p>One\n two</p></article><footer>f</footer>", "T <x>\n\nOne two"),
        ('<div class="cookie-notice">hi</div><main><p>m</p><aside>s</aside></main>', "m"),
        ('<header>site</header><article><header><h1>T</h1></header><p>x</p><form><p>mail</p></form><div class="ad">buy</div></article>', "T\n\nx"),
        ("<article><p>a</p></article><section id=comments><article><p>nice</p></article></section>", "a"),
        ("<article><script>if (a < b) x('</p>')</script><style>p{}</style><!-- no <p>x</p> --><p>y</p>", "y"),
        ("<div id=content><ul><li>1<li>2</ul></div><div class=sidebar>no</div>", "1\n\n2"),
        ("<article><p>cut <b", "cut"), ("<article><p hidden>no</p><p>yes</article>", "yes"),
        ('<article data-x="a>b"><p title=\'<p>\'>q</p></article>', "q"),
    ],
)
def test_main_text(html, want):
    assert Page(html).text() == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='layout with-sidebar'><article><p>a</p></article><div class='sidebar'>s</div></div>", "a"),
        ("<div class='layout with-sidebar'><p>a</p></div>", "a"), ("<div class='post comments-open'><p>a</p></div>", "a"),
        ("<div class='sidebar'><article><p>a</p></article></div>", "a"), ("<form id=f><nav>n</nav><div role=main><p>a</p></div></form>", "a"),
        ("<div class='banner-top related-layout'><main><p>a</p><div class='site-footer'>f</div></main></div>", "a"),
        ("<div class=sidebar><main><p>a</p></main><p>s</p></div>", "a"), ("<div class=with-header><p>a</p></div><div class=site-header>h</div>", "a"),
        ("<article><p>a</p></article><section class=related><article><p>r</p></article></section>", "a"),
        ("<p>a</p><div id=comments><article><p>c</p></article></div>", "a"), ("<p>a</p><div class='related-posts'>r</div><div class=post-comments>c</div>", "a"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>", "if x=2 then"), ("<object data=f><param name=a><p>fallback</p></object>", "fallback"),
        ("<div hidden><main><p>no</p></main></div><p>a</p>", "a"),
    ],
)
def test_wrappers_keep_the_article(html, want):
    assert Page(html).text() == want


def site(n, host="h.example.org"):
    """Pages that mark nothing by tag or name; their template shows by recurrence alone."""
    page = "<html><body><div><p>Site name</p><p>Menu of the site</p></div><div><h2>Title {i}</h2><p>Story {i} goes on.</p></div><div><p>All about us</p></div></body></html>"
    return [(i, f"http://{host}/{i}", page.format(i=i)) for i in range(n)]


def test_template_is_deduced_per_host(spark):
    data = site(12) + [(100, "http://other.org/1", site(1)[0][2]), (101, None, None), (102, "http://h.example.org/0", site(1)[0][2]), (None, "x", "<p>a</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "token", "template")})
    found = templates(df.select("page_id", "url", "html")).collect()
    assert [r["host"] for r in found] == ["h.example.org"] and len(found[0]["template"]) == 3
    got = extract_pages(df).collect()
    assert len(got) == len(data)
    text = {(r["page_id"], r["url"]): r["text"] for r in got}
    assert all(text[(i, u)] == f"Title {i}\n\nStory {i} goes on." for i, u, _ in site(12))
    assert text[(102, "http://h.example.org/0")] == "Title 0\n\nStory 0 goes on."
    assert "Menu of the site" in text[(100, "http://other.org/1")] and text[(101, None)] == "" and text[(None, "x")] == "a"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_pages(df.limit(0)).count() == 0


def test_copies_under_other_addresses_keep_their_article(spark):
    html = site(1)[0][2]
    same = [(i, f"http://one.org/a?session={i}", html) for i in range(10)]
    nearly = [(20 + i, f"http://two.org/{i}", f"<!-- {i} -->" + html) for i in range(10)]
    df = spark.createDataFrame(same + nearly, "page_id long, url string, html string")
    assert templates(df).count() == 0
    assert {r["text"] for r in extract_pages(df).collect()} == {Page(html).text()} and "Story 0 goes on." in Page(html).text()
    # copies don't stand in for other pages, and a template never takes a whole page
    more = [(40 + i, f"http://one.org/{i}", h) for i, _, h in site(12)] + [(60, "http://one.org/x", html.replace("<h2>Title 0</h2><p>Story 0 goes on.</p>", ""))]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(same + more, "page_id long, url string, html string")).collect()}
    assert got[3] == got[40] == "Title 0\n\nStory 0 goes on." and got[60] == "Site name\n\nMenu of the site\n\nAll about us"


def deduced_by_hand(htmls):
    """(content, template, menus) of one host's pages, with occurrence vectors kept whole."""
    seen = {}
    for html in htmls:
        seen.setdefault(Page(html).fingerprint(), Page(html).tokens())
    vectors, rows = defaultdict(dict), {}
    for page, tokens in seen.items():
        for token, (parent, kind, sign, times, chars, links, place) in tokens.items():
            vectors[token][page] = times
            old = rows.setdefault(token, {"token": token, "parent": parent, "kind": kind, "sign": sign, "chars": 0, "links": 0, "place": place})
            rows[token] = old | {"sign": max(sign, old["sign"]), "chars": old["chars"] + chars, "links": old["links"] + links, "place": min(place, old["place"])}
    kept = []
    for token, row in rows.items():
        n = len(vectors[token])
        if n >= pages_of.MIN_PAGES and n >= pages_of.PAGE_SHARE * len(seen):
            kept.append(row | {"support": n, "vector": frozenset(vectors[token].items()), "most": max(vectors[token].values())})
    return [frozenset(x) for x in pages_of.deduce(kept)]


def plain_article(html):
    """The article of a page of the test tables, by its tags."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1].replace("<br>", " ")
    blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(h1|p)>", "\x01", inner)).split("\x01")
    return "\n\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def test_templates_equal_brute_force_and_need_no_word_lists(spark, monkeypatch):
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", host_of(F.col("url")))
    found = {r["host"]: [frozenset(r[c]) for c in ("content", "template", "menus")] for r in templates(frame).collect()}
    by_host = defaultdict(list)
    for r in frame.collect():
        by_host[r["host"]].append(r["html"])
    assert len(found) > 30
    for host, htmls in by_host.items():
        got, by_hand = found.get(host), deduced_by_hand(htmls)
        assert (got is None and not by_hand[0]) or got == by_hand
    for name in ("OUTSIDE_TAGS", "OUTSIDE_ROLES", "OUTSIDE_NAMES", "OUTSIDE_WHOLE", "NEVER"):
        monkeypatch.setattr(pages_of, name, frozenset())
    large = [(h, htmls) for h, htmls in by_host.items() if len(htmls) >= 10]
    assert large
    for host, htmls in large:
        sets = deduced_by_hand(htmls)
        assert [Page(x).slots(*sets) for x in htmls] == [plain_article(x) for x in htmls], host


STORY = "Story {i} tells of {i} things, and of {i} more of them, at some length."


@pytest.mark.parametrize(
    ("form", "want"),
    [
        # nothing is marked by a telling name or tag; texts of the slots vary or recur
        ("<div class=q1><ul><li><a href=a{i}>Go {i}</a><li><a href=b{i}>Up {i}</a></ul></div><div class=q2><h1>T{i}</h1><p>{s}</p><p>{s}</p></div><div class=q3>x{i}</div>", "T{i}\n\n{s}\n\n{s}"),
        ("<div class=q1>All of us</div><div class=q2><div class=lead><p>{s}</p></div><div class=rest><p>{s}</p></div><div class=q4>Write to us</div></div>", "{s}\n\n{s}"),
        ("<div class='layout has-sidebar'><h1>T{i}</h1><p>{s}</p></div><div>Menu</div>", "T{i}\n\n{s}"),
        ("<div class=side><div class='post no-comments'><p>{s}</p></div></div>", "{s}"),
        ("<div class=x><h1>T{i}</h1><div class=y><p>{s}</p></div><div class=z>no{i}</div></div>", "T{i}\n\n{s}"),
        ("<table><tr><td>Menu<td><p>{s}</p><td>ad{i}</table>", "{s}"),
        ("<main><p>{s}</p><section class=comments><p>{s}</p></section><form>{s}</form><nav>n{i}</nav></main>", "{s}"),
        ("<article>tease {i}</article><div class=full><p>{s}</p><p>{s}</p><p>{s}</p></div>", "{s}\n\n{s}\n\n{s}"),
    ],
)
def test_article_slot(form, want):
    htmls = [form.format(i=i, s=STORY.format(i=i)) for i in range(4)]
    sets = deduced_by_hand(htmls)
    assert [Page(x).slots(*sets) for x in htmls] == [want.format(i=i, s=STORY.format(i=i)) for i in range(4)]


def test_each_layout_of_a_host_has_its_template(spark):
    one = "<div class=top>Menu of one</div><div class=story><p>{s}</p></div><div class=end>End of one</div>"
    two = "<div class=head>Menu of two</div><section><p>{s}</p></section><div class=foot>End of two</div>"
    data = [(i, f"http://h/{i}", (two if i % 5 < 2 else one).format(s=STORY.format(i=i))) for i in range(20)]
    # a third of the pages are near copies; their shared words are no template
    data += [(100 + i, f"http://h/c{i}", one.format(s="The same story all over again, word for word.</p><p>" + STORY.format(i=100 + i))) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[i] == STORY.format(i=i) for i in range(20))
    assert all(got[100 + i].startswith("The same story all over again") for i in range(6))


def test_near_copies_on_small_hosts_keep_their_article():
    page = "<div class=top>Menu {i}</div><div class=story><p>The same story, word for word.</p><p>And its end.</p></div>"
    other = "<div class=top>Menu x</div><div class=story><p>Another story altogether.</p></div>"
    for n, more in ((3, 0), (3, 1), (5, 2)):
        htmls = [page.format(i=i) for i in range(n)] + [other.replace("x", str(k)) for k in range(more)]
        sets = deduced_by_hand(htmls)
        got = [Page(x).slots(*sets) or Page(x).text() for x in htmls]
        assert all("The same story, word for word.\n\nAnd its end." in x for x in got[:n])


def extracted_by_hand(htmls):
    sets = deduced_by_hand(htmls)
    return [Page(x).slots(*sets) or Page(x).text() for x in htmls]


@pytest.mark.parametrize("n", [4, 5, 8])
@pytest.mark.parametrize("at", [0, 1, 2])
def test_hosts_of_near_copies_alone_keep_the_whole_article(n, at):
    """Two equal paragraphs and a line that differs, wherever it stands, on all pages of a host."""
    parts = ["The same story, word for word, and it is a long one that goes on.", "And its end, which is the same on every page as well."]
    htmls, want = [], []
    for i in range(n):
        story = [*parts[:at], f"Line {i} is the one that differs.", *parts[at:]]
        htmls.append("<div class=top><a href=/>Menu</a></div><div class=story>" + "".join(f"<p>{x}</p>" for x in story) + "</div><div class=end>Terms of use</div>")
        want.append("\n\n".join(story))
    assert extracted_by_hand(htmls) == want


def test_what_recurs_inside_an_article_stays():
    """Headings between its parts, and a list of sources that is all links."""
    page = (
        "<div class=top><a href=/>Menu</a></div><div class=text><h1>Dish {i}</h1><p>Some words on dish {i}, and why it is good.</p><h2>Ingredients</h2><ul><li>{i} eggs and {i} cups of flour</li></ul>"
        "<h2>Method</h2><p>Beat the eggs {i} times and bake them for {i} minutes.</p><ul class=refs><li><a href=/a>Source a{i}</a></li><li><a href=/b>Source b{i}</a></li></ul></div><div class=low>Imprint</div>"
    )
    for i, text in enumerate(extracted_by_hand([page.format(i=i) for i in range(12)])):
        assert text == (
            f"Dish {i}\n\nSome words on dish {i}, and why it is good.\n\nIngredients\n\n{i} eggs and {i} cups of flour\n\nMethod\n\n"
            f"Beat the eggs {i} times and bake them for {i} minutes.\n\nSource a{i}\n\nSource b{i}"
        )


def test_what_recurs_around_an_article_goes():
    page = "<div class=text><div class=x1>Share this page with friends</div><p>Story {i} has a first part.</p><p>And {i} has a second one.</p><div class=x2>Written by our staff</div></div>"
    for i, text in enumerate(extracted_by_hand([page.format(i=i) for i in range(6)])):
        assert text == f"Story {i} has a first part.\n\nAnd {i} has a second one."


def test_odd_markup():
    assert Page('<p><a title="x>link</a> and <b class="y">more</b></p>').text() == "link and more"
    assert Page("<article>tease</article><p>A story of many words, which is what the page is for.</p>").text().endswith("what the page is for.")
    began = time.time()
    for odd in ("<a title=\"" * 50_000, "<div>" * 20_000 + "deep", "<nav>" * 20_000 + "deep", "<nav><article>" * 10_000 + "deep", "<" * 200_000, "<p>word " * 50_000, "<a b='" + "x" * 500_000, "<!--" * 50_000, "<script>" * 20_000):
        assert "<div" not in Page(odd).text()
    deep = "".join(f"<div class=c>t{k}" for k in range(5_000))
    sets = deduced_by_hand([deep + f"<p>{STORY.format(i=i)}</p>" for i in range(4)])
    assert Page(deep + "<p>x</p>").slots(*sets).endswith("x")
    assert time.time() - began < 30


def test_host(spark):
    urls = ["http://A.example.org:80/x", "//u:p@b.org/y", "no host", None, "https://c.net?q=//d"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u"))).collect()]
    assert got == ["a.example.org", "b.org", "", "", "c.net"]


# --- fixity ----------------------------------------------------------------------------


def test_audit_finds_every_fault(spark):
    rng = random.Random(5)
    pages = [(i, f"http://h/{i}", "body " * rng.randrange(1, 40) + str(i)) for i in range(700)] + [(None, None, None), (3, "dup", "x"), (3, "dup", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    bad = {17, 18, 300, 699}
    copy = df.withColumn("name", warc.page_name(df)).withColumn("html", F.when(F.col("page_id").isin(*bad), F.concat("html", F.lit("!"))).otherwise(F.col("html"))).select("page_id", "url", "html", "name")
    got = warc.audit(df, copy, per_file=300).collect()
    assert len(got) == len(pages) and {r["page_id"] for r in got if not r["intact"]} == bad
    # offsets tile each file
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"], []).append((r["record_offset"], r["n_bytes"]))
    for spans in by_file.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
    assert all(r["intact"] for r in warc.audit(df, df.withColumn("name", warc.page_name(df)).select("page_id", "url", "html", "name")).collect())
    assert warc.audit(df.limit(0), copy.limit(0)).count() == 0


def test_lost_and_extra_records(spark):
    """One file; records lost, added, overwritten and repeated anywhere in it mark themselves alone."""
    pages = [(i, f"http://h/{i}", "body " * (i % 9 + 1)) for i in range(300)] + [(7, "same", "x")] * 5
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    named = df.withColumn("name", warc.page_name(df))
    whole = [tuple(r) for r in named.collect()]
    add = lambda *rows: spark.createDataFrame(rows, named.schema)

    def states(replica):
        got = warc.audit(df, replica, per_file=1000).collect()
        assert len({r["file_root"] for r in got}) == 1
        return Counter((r["page_id"], r["state"]) for r in got if not r["intact"])

    assert states(named) == {}
    assert states(named.filter("page_id <> 50")) == {(50, "lost"): 1}
    first, last = min(whole, key=lambda r: r[3][8:]), max(whole, key=lambda r: r[3][8:])
    assert states(named.filter(F.col("name") != first[3])) == {(first[0], "lost"): 1 if first[0] != 7 else 5}
    assert states(named.filter(F.col("name") != last[3])) == {(last[0], "lost"): 1 if last[0] != 7 else 5}
    assert states(named.unionByName(add((900, "new", "z" * 10_000, "0" * 32), (901, "new", None, "f" * 32)))) == {(900, "extra"): 1, (901, "extra"): 1}
    same = next(r for r in whole if r[1] == "same")
    assert states(named.filter("url <> 'same'").unionByName(add(same, same))) == {(7, "lost"): 3}
    assert states(named.unionByName(add(same))) == {(7, "extra"): 1}
    odd = (same[0], same[1], "broken", same[3])
    assert states(named.filter("url <> 'same'").unionByName(add(same, same, same, odd))) == {(7, "damaged"): 1, (7, "lost"): 1}
    assert states(named.unionByName(add(odd))) == {(7, "extra"): 1}
    assert sum(states(named.limit(0)).values()) == len(pages)


def test_only_differing_branches_are_read(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", "b") for i in range(2000)], "page_id long, url string, html string")
    named = df.withColumn("name", warc.page_name(df))
    trees = [warc.tree(warc.records(x, 8)) for x in (named, named.filter("page_id <> 77"))]
    assert len(warc.mismatches(*trees).collect()) == 1 and trees[0][0].count() == 8 * 16 and trees[0][1].count() == 8
    assert warc.mismatches(trees[0], trees[0]).count() == 0


# --- language --------------------------------------------------------------------------


def test_trigrams_stay_inside_texts():
    bucket, owner = language.trigrams([b"abcd", b"", b"ab", b"ABC"])
    assert owner.tolist() == [0, 0, 0, 1, 2, 3, 3][: len(owner)] or set(owner.tolist()) <= {0, 1, 2, 3}
    one, _ = language.trigrams([b"abcd"])
    again, who = language.trigrams([b"xyz", b"abcd"])
    assert again[who == 1].tolist() == one.tolist()


def test_language_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, "x" * 100_000), (-2, "en", None)], "doc_id long, lang string, text string"), allowMissingColumns=True)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(-1, None, None), (-2, "http://h/de/1", ""), (None, "http://h/fr/1", "<html lang=fr>")], "page_id long, url string, html string")
    got = language.identify_pages(pages.unionByName(odd).withColumn("lang", F.lit("clash")), docs).toPandas()
    assert len(got) == pages.count() + 3
    mine = got[got["page_id"] >= 0]
    code = mine["url"].str.extract(r"//[^/]*/([a-z]{2})/")[0]
    assert (mine["lang"] == code).mean() > 0.98 and got["posterior"].between(0, 1).all()
    assert got[got["url"] == "http://h/fr/1"]["lang"].tolist() == ["fr"] and got[got["url"] == "http://h/de/1"]["lang"].tolist() == ["de"]
    none = language.identify_pages(pages, docs.limit(0))
    assert none.count() == pages.count() and none.filter("lang is not null").count() == 0
    assert language.identify_pages(pages.limit(0), docs).count() == 0


def test_many_languages(spark, monkeypatch):
    """Work grows with the languages, not with their square or worse."""
    docs = spark.createDataFrame([(i, f"l{i:02d}", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in "xyzuvw") * 3) for i in range(60)], "doc_id long, lang string, text string")
    pages = [(r["doc_id"], f"http://h{r['doc_id'] % 7}.zz/{r['doc_id']}", f"<article><p>{r['text']}</p></article>") for r in docs.collect()]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = language.identify_pages(frame, docs)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    got = found.collect()
    assert sum(r["lang"] == f"l{r['page_id']:02d}" for r in got) >= 55 and all(0 < r["posterior"] <= 1 for r in got)
    monkeypatch.setattr(language, "MOST_LANGS", 59)
    with pytest.raises(ValueError, match="59 languages"):
        language.identify_pages(frame, docs)


def test_markup_decides_where_text_is_silent(spark):
    docs = spark.createDataFrame([(i, lang, text) for i in range(30) for lang, text in (("aa", "foo bar foo bar"), ("bb", "qux zip qux zip"))], "doc_id long, lang string, text string")
    pages = [(i, f"http://x.aa/{i}", "<html lang='aa'><p>foo bar foo bar foo</p>") for i in range(30)] + [(50, "http://x.aa/p", "<html lang='bb'><p>1</p>"), (51, "http://x.aa/q", "<p>2</p>"), (52, "http://x.aa/r", "<html lang='aa'><p>qux zip qux zip qux zip qux zip qux</p>")]
    got = {r["page_id"]: r["lang"] for r in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    # a silent page follows its host's prior
    assert got[51] == "aa" and got[0] == "aa"


def fused_by_hand(docs, pages):
    """(language, posterior) of each page by plain sums."""
    bucket = lambda text: language.trigrams([text.encode()])[0].tolist()
    counts = {}
    for lang, text in docs:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(bucket(text or ""))
    langs = sorted(counts)
    n, size = len(langs), 1 << language.BITS
    total = {x: sum(counts[x].values()) + 0.5 * size for x in langs}
    soft = lambda v: [math.exp(x - max(v)) / sum(math.exp(y - max(v)) for y in v) for x in v]
    seen = []
    for url, html in pages:
        host = (re.search(r"//([^/?#:]*)", url or "") or ["", ""])[1].lower()
        ll = [language.TEMPER * sum(math.log((counts[x][b] + 0.5) / total[x]) for b in bucket(Page(html).text())) for x in langs]
        declared = re.search(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", html or "", re.I)
        code = re.search(r"//[^/?#]*/([a-zA-Z]{2})(?:[-/?#]|$)", url or "")
        seen.append({"host": host, "suffix": host.rpartition(".")[2], "ll": ll, "vote": soft(ll), "declared": declared and declared[1].lower(), "code": code and code[1].lower()})
    sums = lambda rows: [sum(r["vote"][k] for r in rows) for k in range(n)]
    prior = [(v + 1) / (len(seen) + n) for v in sums(seen)]
    trust = {}
    for kind in ("declared", "code"):
        said = [r for r in seen if r[kind] in langs]
        right = (sum(r["vote"][langs.index(r[kind])] for r in said) + 1) / (len(said) + 2)
        trust[kind] = (math.log(right), math.log((1 - right) / max(1, n - 1)))
    out = []
    for r in seen:
        by = {c: [x for x in seen if x[c] == r[c]] for c in ("host", "suffix")}
        scores = []
        for k in range(n):
            suffix = (sums(by["suffix"])[k] - r["vote"][k] + language.LEAN * prior[k]) / (len(by["suffix"]) - 1 + language.LEAN)
            host = (sums(by["host"])[k] - r["vote"][k] + language.LEAN * suffix) / (len(by["host"]) - 1 + language.LEAN)
            said = sum(trust[c][0 if r[c] == langs[k] else 1] for c in trust if r[c] in langs)
            scores.append(r["ll"][k] + math.log(max(host, 1e-9)) + said)
        p = soft(scores)
        out.append((langs[p.index(max(p))], max(p)))
    return out


def test_fusion_against_plain_python(spark):
    """Texts of four languages, of which markup and address tell some falsely or not at all;
    the truth is the language that a text was made of."""
    rng = random.Random(8)
    forms = {"aa": "kabo lumi tero", "bb": "xisch verung dachte", "cc": "tion nement queux", "dd": "osas ciones larga"}
    say = lambda lang, words: " ".join(rng.choice(forms[lang].split()) + rng.choice(["", "s", "en"]) for _ in range(words))
    docs = [(lang, say(lang, rng.randrange(5, 60))) for lang in forms for _ in range(12)] + [(None, "x " * 50), ("aa", None), ("aa", "kabo"), ("aa", "kabo")]
    pages, truth = [], []
    for i in range(80):
        lang = rng.choice([*forms, "aa"])
        told = lang if rng.random() < 0.7 else rng.choice([*forms, "zz"])
        mark = f" lang='{told}'" if rng.random() < 0.6 else ""
        address = f"http://h{i % 5}.{rng.choice(['xx', 'yy'])}/{rng.choice([lang, 'dd', 'story'])}/{i}"
        pages.append((address, f"<html{mark}><p>{say(lang, rng.choice([0, 1, 2, 30]))}</p></html>"))
        truth.append(lang)
    pages += [(None, None), pages[0], pages[0]]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["lang"], r["posterior"], r["text_lang"]) for r in language.identify_pages(frame, spark.createDataFrame(docs, "lang string, text string")).collect()}
    for i, (lang, p) in enumerate(fused_by_hand(docs, pages)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(p, abs=1e-9)
    fused, alone = (sum(got[i][k] == t for i, t in enumerate(truth)) for k in (0, 2))
    assert fused > alone and fused > 0.8 * len(truth)
