"""Archives, page text and URL verdicts."""

import hashlib
import math
import re

import pytest
import regex

from quarry.llm import html_extract, url_filter, warc

PAGES = "page_id long, url string, html string, payload int, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "h") for r in rows], PAGES)


LONG = "<p>" + "é word " * 300 + "</p>"


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/1", LONG), (9, "http://a/9", LONG), (4, None, LONG), (2, "u", "short"), (3, "u", "short"),
            (5, "u\r\nX: y", None), (6, "", ""), (7, "u", "x" * 200_000), (None, "u", LONG), (8, "u", LONG + "!")]
    got = {r["page_id"]: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == LONG and i != 9
        assert tuple(got[i]) == (i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response",
                                 9 if again else None)
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_rows_that_repeat_the_largest_id_are_responses(spark):
    got = warc.round_trip(pages(spark, [(3, "u", LONG), (3, "u", LONG), (1, "u", LONG)])).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "revisit"), (3, "response"), (3, "response")]


def test_files_and_payloads(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * 40) for i in range(60)]
    archives = warc.write_archives(pages(spark, rows))
    assert warc.export_files(archives, str(tmp_path)).count() == archives.count()
    assert not list(tmp_path.glob(".*"))
    back = warc.read_archives(warc.read_files(spark, str(tmp_path)), payload=True).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back} == {i: h for i, _, h in rows}


def records(n):
    return [warc.record("response", i, "u", b"payload %d" % i * 20, len(b"payload %d" % i * 20),
                        hashlib.sha1(b"payload %d" % i * 20).hexdigest(), None) for i in range(n)]


def test_dictionary_frame_comes_first():
    content = warc.archive(records(100))
    assert content[:4] == bytes.fromhex("5d2a4d18") and len(list(warc.frames(content))) == 100
    assert list(warc.frames(b"")) == []


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1),
    lambda r: r[:-1], lambda r: r + b"x", lambda r: r.replace(b"payload 0", b"payload 1", 1),
    lambda r: r.replace(b"WARC-Date", b"WARC Date"), lambda r: r.replace(b"WARC-Record-ID", b"X-Record-ID"),
    lambda r: r.replace(b"HTTP/1.1", b"FTP")])
def test_broken_records_are_found(change):
    good = records(1)[0]
    assert warc.parse(good)["page_id"] == 0
    with pytest.raises(warc.WarcError):
        warc.parse(change(good))


@pytest.mark.parametrize("told", [b"sha1:x1", b"sha1:", b"sha1:\xc3\xa9"])
def test_foreign_digests_are_errors_of_the_record(told):
    good = records(1)[0]
    bad = regex.sub(rb"(?<=WARC-Payload-Digest: )\S+", lambda m: told, good)
    assert bad != good
    with pytest.raises(warc.WarcError):
        warc.parse(bad)


def test_folded_header_lines_go_on():
    good = records(1)[0]
    folded = good.replace(b"WARC-Date: ", b"WARC-Date:\r\n \t", 1)
    assert folded != good and warc.parse(folded) == warc.parse(good)


@pytest.mark.parametrize("share", [1000, 2, 0.5])
def test_hot_payloads_are_looked_up_in_place(spark, monkeypatch, share):
    monkeypatch.setattr(warc, "HOT_PAYLOADS", share)
    rows = [(i, "u", LONG) for i in range(30)] + [(100 + i, "u", LONG + str(i % 4)) for i in range(12)] + [(None, None, "x"), (None, None, None)]
    got = {(r["page_id"], r["revisit"], r["refers_to"]) for r in warc.with_roles(pages(spark, rows)).collect()}
    assert got == ({(i, i != 29, 29 if i != 29 else None) for i in range(30)} | {(None, False, None)}
                   | {(100 + i, i < 8, 108 + i % 4 if i < 8 else None) for i in range(12)})


def test_broken_frames_are_rows_if_not_strict(spark):
    content = warc.archive(records(30))
    bad = bytearray(content)
    bad[-10] ^= 255
    df = spark.createDataFrame([("good", content), ("cut", content[:-3]), ("bad", bytes(bad)), ("none", b"junk")],
                               "archive string, content binary")
    got = warc.read_archives(df, strict=False).groupBy("archive").agg({"error": "count", "*": "count"}).collect()
    assert {r["archive"]: (r["count(error)"], r["count(1)"]) for r in got} == {
        "good": (0, 30), "cut": (1, 30), "bad": (1, 30), "none": (1, 1)}


CASES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<body><header>H</header><nav>N</nav><article><header><h1>T</h1></header><p>a <b>b</b>c<p>d<aside>x</aside>"
     "<div class='comments'><p>c</div><footer>f</footer></article><footer>F</footer>", "T\na bc\nd"),
    ("<main><p>one\n two</p><form><p>no</form></main><p>out</p>", "one two"),
    ("<div class='cookie-notice'>c</div><div id=sideBar>s</div><p>x<script>if(a<b){'</p>'}</script>y</p>", "xy"),
    ("<ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", "1\n2\na b\nc"),
    ("<p>cut <a href='x", "cut"), ("<p>&eacute;&#233;&#xe9;&nbsp;z</p></b></p>q", "ééé z\nq"),
    ("<style>p{}</style><!-- <p>no</p> --><p title='>'>t</p><textarea><p>no</textarea>", "t"),
    ("<div hidden>h</div><div style='display: none'>n</div><p>a<br>b", "a b"),
    ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\ner"),
]


def test_article_text(spark):
    rows = [(i, "http://h/x", h) for i, (h, _) in enumerate(CASES)]
    got = {r["page_id"]: r for r in html_extract.extract(pages(spark, rows + rows[:1])).collect()}
    for i, (_, text) in enumerate(CASES):
        assert tuple(got[i]) == (i, "http://h/x", text, len(text))
    assert html_extract.extract(pages(spark, rows).limit(0)).count() == 0


WRAPPED = [
    # (a) words in the names of wrappers and articles that mark something else
    *((f'<body><div class="{c}"><h1>Title</h1><p>The story of the day.</p></div><div class="sidebar">x</div></body>', "Title\nThe story of the day.")
      for c in ("post has-sidebar", "no-sidebar", "comments-open", "layout-side-by-side", "social-science", "sidebar main")),
    *((f'<article class="{c}"><p>The story.</p></article>', "The story.") for c in ("post has-sidebar", "comments", "related")),
    # (b) optional tags
    ("<html><head><meta charset=utf-8><title>t</title><body><article><p>The story.</p></article>", "The story."),
    ("<head><title>t</title><p>The story.</p>", "The story."),
    # (c) a page in one form, with another form in it
    ("<body><form action=x><nav>n</nav><article><p>The story of the day.</p></article><form><p>Search</p></form></form></body>", "The story of the day."),
    ("<body><form><p>The story of the day.</p></form><div class=cookie-banner>ok</div></body>", "The story of the day."),
    # (d) inline elements and paragraphs with words of parts in their names
    ('<article><p>The <span class="search-term">key</span> of <b id="comment-1-link">it</b>.</p><p class="form-group">More.</p></article>', "The key of it.\nMore."),
    # (e) a teaser article beside the text
    ("<body><div><p>" + "The story of the day. " * 9 + "</p></div><article><h3>Read on</h3></article></body>", ("The story of the day. " * 9).strip() + "\nRead on"),
    # parts that are marked still go, whatever their size
    ('<body><article><h1>T</h1><p>Short.</p></article><div class="comments"><p>' + "I say. " * 50 + "</p></div></body>", "T\nShort."),
    ('<body><article><h1>T</h1><p>Short.</p><div id="comment-list"><p>' + "I say. " * 50 + "</p></div></article></body>", "T\nShort."),
    ('<body><h1>T</h1><p>Short.</p><div class="related-posts"><p>Other</p></div><div class="newsletter_box2">Join</div></body>', "T\nShort."),
]


@pytest.mark.parametrize("html,text", WRAPPED)
def test_no_article_is_lost(html, text):
    assert "\n".join(html_extract.parse(html)[0]) == text


def test_parsing_is_linear_in_unclosed_tags():
    import time

    def seconds(n):
        page = "<body>" + "<font>" * n + "<h2>a" * n
        best = 1e9
        for _ in range(3):
            t0 = time.perf_counter()
            html_extract.parse(page)
            best = min(best, time.perf_counter() - t0)
        return best

    seconds(500)
    assert seconds(8000) < 8 * seconds(2000) + 0.05


def test_templates_of_a_host_go_but_articles_stay(spark):
    def page(i, body):
        return f"<body><div><b>Site</b> motto of ours</div>{body}<div><p>Call us now</p></div></body>"

    rows = [(i, "http://a.com/x", page(i, f"<p>story {i} of the day</p>")) for i in range(30)]
    rows += [(100 + i, "http://b.com/x", page(i, f"<p>other {i}</p>")) for i in range(3)]
    # copies and quoted passages inside of articles are no template
    rows += [(200 + i, "http://a.com/y", f"<article><h1>t {i}</h1><p>quoted passage</p></article>") for i in range(30)]
    rows += [(300 + i, "http://c.com/y", "<article><div><p>copied</p></div></article>") for i in range(30)]
    rows += [(400, None, page(0, "<p>no host</p>"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"story {i} of the day" for i in range(30))
    assert got[100] == "Site motto of ours\nother 0\nCall us now" and got[400].count("\n") == 2
    assert all(got[200 + i] == f"t {i}\nquoted passage" and got[300 + i] == "copied" for i in range(30))


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_templates_of_layouts_and_of_large_hosts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_extract, "BROADCAST_MARKS", broadcast)
    # four layouts, each on a quarter of the host's pages, by section
    rows = [(i, f"http://d.com/part{i % 4}/{i}", f"<body><div><p>Layout {i % 4} offer</p></div><p>story {i}</p>"
             f"<div><p>part of {i}</p></div></body>") for i in range(80)]
    # a block on an eighth of a large host's pages, and a sentence that many of them quote
    rows += [(1000 + i, f"http://e.com/{i}", f"<body>{'<div><p>Sale ends soon</p></div>' if i % 8 == 0 else ''}"
              f"<p>tale {i}</p>{'<p>as they say</p>' if i % 8 == 1 else ''}</body>") for i in range(1000)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"story {i}\npart of {i}" for i in range(80))
    assert all(got[1000 + i] == f"tale {i}" + ("\nas they say" if i % 8 == 1 else "") for i in range(1000))


def url_brute(urls):
    """The documented rule, by plain Python."""
    rows = []
    for u in urls:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1:] if fit else (None, None)
        rows.append([host, path, *rule, re.sub(url_filter.NAMES, "*", path)])
    nodes = {}
    for host, _, _, _, lex in rows:
        parts = lex.split("/")
        segs = parts[1:6] + ["**"] if len(parts) > 7 else parts[1:7]
        nodes[host, lex] = [segs, "", ""]
    count = lambda pick: sum(1 for r in rows if pick(r))
    for k in range(max((len(s[0]) for s in nodes.values()), default=0)):
        kids = {}
        for (host, lex), (segs, t, _) in nodes.items():
            if len(segs) > k:
                kid = kids.setdefault((host, t), {})
                kid[segs[k]] = kid.get(segs[k], 0) + count(lambda r: (r[0], r[4]) == (host, lex))
        for (host, lex), node in nodes.items():
            segs, t, _ = node
            if len(segs) > k:
                kid = kids[host, t]
                rare = len(kid) > url_filter.MAX_KIDS and kid[segs[k]] * url_filter.MAX_KIDS < sum(kid.values())
                node[2], node[1] = t, t + "/" + ("*" if rare else segs[k])
    label = {}
    for host, _, _, verdict, lex in rows:
        _, t, parent = nodes[host, lex]
        c = label.setdefault((host, parent, t), [0, 0])
        c[0] += verdict == "block"
        c[1] += verdict is not None
    add = lambda pick: [sum(c[i] for k, c in label.items() if pick(k)) for i in (0, 1)]
    total = add(lambda k: True)
    overall = (total[0] + 1) / (total[1] + 2)
    w, out = url_filter.WEIGHT, []

    def same(key):
        b, n = label[key]
        pb, pn = add(lambda k: k[:2] == key[:2])
        p = pb / max(pn, 1)
        spread = math.sqrt(p * (1 - p) * (1 / max(n, 1) + 1 / max(pn, 1)))
        return n > 0 and abs(b / max(n, 1) - p) <= url_filter.Z_SAME * spread

    for host, path, rule, verdict, lex in rows:
        _, t, parent = nodes[host, lex]
        key = (host, parent, t)
        sb, sn = add(lambda k: k[1] == parent)
        tb, tn = add(lambda k: k[1:] == (parent, t))
        prior = (tb + w * (sb + w * overall) / (sn + w)) / (tn + w)
        b, n = add(lambda k: k[:2] == key[:2] and same(k)) if same(key) else label[key]
        rate = (b + w * prior) / (n + w)
        out.append((host, path, rule, verdict or ("block" if rate >= url_filter.REJECT else "allow")))
    return out


def test_urls_equal_brute_force(spark):
    urls = [f"http://www.Example.org/{lang}/{n}{end}" for lang in ("en", "es", "fr") for n in (1, 25, 199)
            for end in ("", "/", ".html?x=1", "#t")]
    urls += [f"https://m.site.com/{lang}/{n}" for lang in ("fr", "de", "en") for n in range(5)]
    urls += [f"http://x.net/{lang}/{n}" for lang in ("de", "es", "fr") for n in range(3)]
    urls += [f"http://x.net/tag/word{chr(97 + i)}/{chr(97 + i)}x" for i in range(25)] + ["http://x.net/tag/worda/q"] * 9
    urls += [None, "", "nothing", "://", "http://org", "http://org/", "a://B.ORG/x://y", "http://h.com/a/b/c/d/e/f/g/h",
             "http://notexample.org/es/", "http://x.com/de", "http://x.com/de/", "http://a.net/" + "z" * 9000]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge(df).collect()}
    want = url_brute(urls)
    assert [got[i] for i in range(len(urls))] == want
    assert {v for *_, v in want} == {"allow", "block"}
    assert url_filter.judge(df.limit(0)).count() == 0
