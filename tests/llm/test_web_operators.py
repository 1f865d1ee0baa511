"""Chat formatting, URL filters, HTML extraction, WARC and the pipeline."""

import base64
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightlens.llm import chat_format, html_extract, url_filter, warc
from llm_same import same

SF = "/root/testdata/sf0.001"
_BITS = st.lists(st.sampled_from(["#", "##", "\\", "</turn>", "<", "|", "<|", "\n", ": ", "a", "é", "### user: "]), max_size=9).map("".join)


@settings(max_examples=200, deadline=None)
@given(_BITS, _BITS)
def test_chat_round_trip(role, text):
    chunk = chat_format.OPEN + chat_format.escape_role(role) + chat_format.BETWEEN + chat_format.escape(text) + chat_format.CLOSE
    assert chat_format.parse_chunk(chunk) == (role, text)


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (None, None, None, None), (1, 2, None, ""), (2, 0, "assistant", "x"),
            (2, 0, "assistant", "x"), (3, None, "user", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.format_chat(df)).collect()
    expected = []
    for conv in (1, 2, 3, None):
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        lost = "".join(x for _, r, x in turns if r == "assistant")
        chars = sum(len(f"### {chat_format.escape_role(r)}: {chat_format.escape(x)}</turn>\n") for _, r, x in turns)
        expected.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(),
                         len(lost), hashlib.sha256(lost.encode()).hexdigest(), chars))
    same(got, expected)
    assert chat_format.read_back(chat_format.format_chat(df.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part("text", text="see <|image 1|> "), part("image", ref="s3://a.png", width=56, height=29), part("audio", ref="b", seconds=2.0),
             part("document", ref=None, pages=3), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                               chat_format.T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string")
                               .add("text", chat_format.T.ArrayType(chat_format.PART)))
    a, b = sorted(chat_format.format_chat(df).collect(), key=lambda r: r.turn)
    assert [(x.n, x.type, x.ref, x.tokens) for x in a.attachments] == [
        (1, "image", "s3://a.png", 4), (2, "audio", "b", 50), (3, "document", None, 768)]
    assert a.attachment_tokens == 822 and b.attachments == []
    assert all(a.chunk[x.at:].startswith(f"<|{x.type} {x.n}|>") for x in a.attachments)
    assert len(chat_format._PLACEHOLDER.findall(a.chunk)) == 3


def test_url_parts_and_rules(spark):
    rows = [(1, "http://A.Net/x"), (2, "https://b.example.net/en/?q"), (3, "http://example.com/de/"), (4, "x://www.org/fr/1#f"),
            (5, None), (6, "no scheme"), (7, "http://a.net"), (8, "http://notexample.com/de/"), (9, "a://b?c://d/e"), (1, "http://A.Net/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, pages.selectExpr("url", "false AS bad")).collect()}
    want = {1: ("a.net", "/x", "net/", "block"), 2: ("b.example.net", "/en/", "example.net/en/", "allow"),
            3: ("example.com", "/de/", "example.com/de/", "block"), 4: ("www.org", "/fr/1", "org/fr/", "allow"), 5: ("", "", None, "allow"),
            6: ("", "", None, "allow"), 7: ("a.net", "", None, "allow"), 8: ("notexample.com", "/de/", None, "allow"), 9: ("b", "", None, "allow")}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == want
    assert url_filter.judge(pages.limit(0), pages.limit(0).selectExpr("url", "true AS bad")).count() == 0


def test_url_trees_on_held_out_urls(spark):
    urls = spark.range(3000).selectExpr("id", """CASE WHEN id % 5 = 0 THEN concat('http://win-big-', id, '-now.example.biz/', id * 7919, '?a=1&b=2')
        ELSE concat('https://news.example.com/', CASE WHEN id % 2 = 0 THEN 'en' ELSE 'fr' END, '/story') END AS url""", "id % 5 = 0 AS bad")
    model = url_filter.UrlModel(urls.filter("id < 2000").select("url", "bad"), rows=500)
    held = urls.filter("id >= 2000").withColumns({"host": url_filter.host_of(urls["url"]), "path": url_filter.path_of(urls["url"])})
    scored = model.score(held)
    assert scored.filter("(bad_score >= 0.5) = bad").count() >= 0.98 * held.count()
    plan = scored._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header>Site</header><aside>Side</aside><div class="cookie-notice">We use</div><!-- ad -->
<article><h1>Head &amp; line</h1><p><b>One  two<br>three<p>Four &lt;x&gt;</p><form><input>Send</form><div class="ad">Buy</div>
<ul><li>i<li>j</ul><div class="comments"><p>I say</p></div></article><footer>&copy; F</footer></body></html>"""


def test_html_extract_edges(spark):
    rows = [(1, "http://a/1", PAGE), (1, "http://a/1", PAGE), (2, "http://a/2", PAGE[:PAGE.index("Four") + 4]), (3, None, None),
            (4, "http://b/", ""), (None, "http://b/", "plain &eacute; text"), (5, "http://c/", "<div>" * 3000 + "deep" + "</div>" * 3000),
            (6, "http://d/", "<body><div id=x><p>" + "long words " * 50 + "</p></div><div class=sidebar>no</div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract_text(pages).collect()
    full = "Head & line\n\nOne two three\n\nFour <x>\n\ni\n\nj"
    texts = {1: full, 2: "Head & line\n\nOne two three\n\nFour", 3: "", 4: "", None: "plain é text", 5: "deep", 6: ("long words " * 50).strip()}
    same(got, [(i, u, texts[i], len(texts[i])) for i, u, _ in rows])
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_change_no_text(spark):
    """1, 2, 5 and 6 equal pages of a host; the copies differ in a script and a menu."""
    words, tail = "real words of the story " * 9, "more at the end of it " * 5
    kinds = [f"<article><h1>Head</h1><div class=entry>{words}</div><ul><li>item</ul><table><tr><td>cell</table></article>",
             f"<body><div class=wrap><h1>Head</h1><div class=entry><div class=inner>{words}</div></div><section>{tail}</section></div></body>",
             f"<main><h1>Head</h1><div id=story-x>{words}</div></main>"]
    rows = [(i, f"http://h{k}-{n}/", f"<script>var nonce={i}</script><nav>menu {i}</nav>{html}")
            for k, html in enumerate(kinds) for n in (1, 2, 5, 6) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {}
    for r in html_extract.extract_text(pages).collect():
        got.setdefault(r.url[7:9], set()).add(r.text)
    tails = ["\n\nitem\n\ncell", f"\n\n{tail.strip()}", ""]
    assert got == {f"h{k}": {f"Head\n\n{words.strip()}{t}"} for k, t in enumerate(tails)}


def test_template_of_different_pages_goes_but_not_from_articles():
    import functools
    def read(page, pages):
        ws = [html_extract.infer(html_extract.parse(x)) for x in pages]
        return html_extract.extract(html_extract.parse(page), functools.reduce(lambda a, b: (html_extract._merge_into(a, b), a)[1], ws))
    for tag, left in (("div", "s0"), ("article", "s0\n\nsame box")):
        pages = [f"<body><{tag}><p>s{i}</p><div class=box>same box</div></{tag}></body>" for i in range(5)]
        assert read(pages[0], pages) == left
    once = "<body><div><p>" + "s" * 99 + "</p>" + "<div class=box>same box</div>" * 6 + "</div></body>"
    assert read(once, [once]) == "s" * 99 + "\n\nsame box" * 6


def test_names_leave_out_boxes_not_pages():
    def read(page):
        root = html_extract.parse(page)
        return html_extract.extract(root, html_extract.infer(root))
    kept = ["<body class='single no-sidebar'><p>text</p></body>", "<article class='post has-comments'><p>text</p></article>",
            "<div id='share-story'><p>text</p></div>", "<main class='with-sidebar'><p>text</p></main>",
            "<body class=sidebar><main id=menu><p>text</p></main></body>", "<div class='page sidebar'><article><p>text</p></article></div>",
            "<form id=widget><div class=social><article class=comments><p>text</p></article></div></form>"]
    assert [read(x) for x in kept] == ["text"] * len(kept)
    for name in ("comments", "comment-list", "Cookie-Notice", "x ad", "site_header", "main-menu"):
        assert read(f"<body><div id=d><p>{'text ' * 9}</p><div class='{name}'>box <article>{'other ' * 5}</article></div></div></body>") == ("text " * 9).strip()


_TREES = st.recursive(st.sampled_from(["<p>t</p>", "u"]), lambda inner: st.builds(
    lambda tag, kids: f"<{tag}>{''.join(kids)}</{tag.split()[0]}>", st.sampled_from(["div", "div class=a", "ul", "section", "b"]),
    st.lists(inner, max_size=5)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(_TREES, max_size=4).map("".join), min_size=1, max_size=6))
def test_pages_match_the_expressions_of_their_host(pages):
    whole = html_extract.infer(html_extract.parse(pages[0]))
    for page in pages[1:]:
        html_extract._merge_into(whole, html_extract.infer(html_extract.parse(page)))
    todo = [(html_extract.parse(page), whole) for page in pages]
    while todo:
        node, w = todo.pop()
        slots = html_extract._slots(node, w)
        assert slots is not None
        todo += [(k, slots[id(k)]) for k in node.items if not isinstance(k, str) and id(k) in slots]


def test_expressions_decide_the_text():
    wrapper = None
    for i in range(5):
        w = html_extract.infer(html_extract.parse(f"<main><h1>h{i}</h1><div class=box>same</div><p>s{i}</p></main>"))
        wrapper = html_extract._merge_into(wrapper, w) or wrapper if wrapper else w
    read = lambda page: html_extract.extract(html_extract.parse(page), wrapper)
    assert read("<main><h1>h</h1><div class=box>same</div><p>s</p></main>") == "h\n\ns"
    assert read("<main><h1>h</h1><p>s</p><div class=box>same</div></main>") == "h\n\ns\n\nsame"      # other order
    assert read("<main><div class=box>same</div><p>s</p></main>") == "same\n\ns"                       # no title
    many = "".join(f"<div class=x{chr(97 + i // 26)}{chr(97 + i % 26)}>x</div>" for i in range(90))
    trees = [html_extract.parse(f"<main>{a}<p>s</p>{b}</main>") for a, b in ((many, many), ("<div>x</div>", many), (many, ""))]
    whole = html_extract.infer(trees[0])
    for tree in trees[1:]:
        html_extract._merge_into(whole, html_extract.infer(tree))
    assert set(whole["kids"]["main"]["kids"]) == {"div", "p"}
    assert all(html_extract._slots(tree.items[0], whole["kids"]["main"]) for tree in trees)


def test_wrappers_are_union_free_and_order_free():
    import copy
    pages = ["<div><h1>a</h1><p>b</p></div>", "<div><p>b</p><p>c</p><ul><li>x</li></ul><p>d</p></div>", "<div><h1>z</h1></div>"]
    merged = []
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        w = [html_extract.infer(html_extract.parse(pages[i])) for i in order]
        out = copy.deepcopy(w[0])
        for x in w[1:]:
            html_extract._merge_into(out, x)
        merged.append(out)
        labels = [x for g in out["kids"]["div"]["groups"] for x in g[0]]
        assert len(labels) == len(set(labels)) and set(labels) == {"h1", "p", "ul"}
        assert all(o for g in out["kids"]["div"]["groups"] for x, o in g[0].items() if x != "p")
    assert len({str(sorted(m["kids"]["div"]["kids"])) for m in merged}) == 1


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b\r\n", "same"), (5, None, "same"), (5, None, "same"), (None, "u", "same"), (2, "u", None), (3, "u", ""),
            (None, None, "lone"), (4, "u", "é" * 200_000 + "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS refers_to")
    got = warc.digest(warc.round_trip(pages)).collect()
    largest = {"same": 5, "": 3, rows[-1][2]: 4}
    expected = []
    for i, _, h in rows:
        data, top = (h or "").encode(), largest.get(h or "")
        first = top is None or i == top
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top))
    same(got, expected)
    assert warc.round_trip(pages.limit(0)).count() == 0
    same(warc.digest(warc.round_trip(pages, least_bytes=1)).filter("payload_bytes = 0").select("record_type").collect(), [("response",)] * 2)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.booleans())
def test_rewrite_makes_one_member_a_record(payloads, one_stream):
    z = [zlib.compressobj(6, wbits=31)]
    data = b""
    for n, p in enumerate(payloads):
        head, body = warc.record(n, f"u{n}", p, None, False)
        data += z[0].compress(head + body + b"\r\n\r\n")
        if not one_stream:
            data += z[0].flush()
            z[0] = zlib.compressobj(6, wbits=31)
    if one_stream or not payloads:
        data += z[0].flush()
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.rewrite(io.BytesIO(data), out, index) == len(payloads)
    import json
    entries = [json.loads(x) for x in index.getvalue().splitlines()]
    for e, p in zip(entries, payloads):
        member = out.getvalue()[e["offset"]:e["offset"] + e["length"]]
        assert zlib.decompress(member, wbits=31).endswith(p + b"\r\n\r\n")


def test_damaged_archive_stops():
    z = zlib.compressobj(6, wbits=31)
    head, body = warc.record(1, "u", b"payload" * 50, None, False)
    with pytest.raises(ValueError):
        warc.rewrite(io.BytesIO(z.compress(head + body[:40]) + z.flush()), io.BytesIO(), io.BytesIO())


def test_pipeline_equals_its_operators_on_small_documents(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as P
    from flightlens.llm import decontamination, quality, simhash_dedup, substring_dedup
    from flightlens.llm.runtime import staged, table
    docs = table(spark, SF, "documents")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before, after = rows(docs), staged(P.STAGES[0][1](spark, docs, SF))
    judged = quality.brute_force([(r.doc_id, r.text, r.source) for r in before.values()])
    assert set(rows(after)) == {x[0] for x in judged if x[-1]} and after.columns == list(P.COLUMNS)
    near = staged(P.STAGES[1][1](spark, after, SF))
    same_ids = simhash_dedup.brute_force([(r.doc_id, r.text) for r in rows(after).values()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(x[0] for x in same_ids if x[0] == x[2])
    cut = staged(P.STAGES[2][1](spark, near, SF))
    expected = {x[0]: x for x in substring_dedup.brute_force([(r.doc_id, r.text) for r in rows(near).values()])}
    kept = rows(near)
    for i, r in rows(cut).items():
        assert hashlib.sha256(b" ".join(r.text.encode().split())).hexdigest() == expected[i][3]
        assert expected[i][2] or r.text == kept[i].text
    clean = staged(P.STAGES[3][1](spark, cut, SF))
    bench = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    found = decontamination.brute_force([(r.doc_id, r.text) for r in rows(cut).values()], bench)
    assert set(rows(clean)) == {x[0] for x in found if not x[-1]}
    pieces = P.STAGES[4][1](spark, clean, SF).collect()
    assert {p.doc_id for p in pieces} == set(rows(clean))
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
