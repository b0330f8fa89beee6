"""HTML and chat: exact results of small pages and round trips."""

from __future__ import annotations

import hashlib
import html
import itertools
import random
import re
import time

from conftest_path import table

from spanlock.llm import chat, html_wrappers

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home</li><li>About</li></ul></nav>
<div class="content"><h1>{title}</h1><p>First &amp; <b>bold</b>
 text {n}.</p><p>Second {n}.{more}</div><div class="sidebar">Most read</div><div id="comments"><p>nice {n}</p></div>
<footer>All rights</footer><script>var x = "<p>no</p>";</script></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, wrapper string")


def test_article_without_the_rest(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(title=f"Title {i}", n=i, more=f"<p>Third {i}</p>" if i % 2 else ""), "x", "x", "x") for i in range(8)]
    rows += [(100, None, None, "x", "x", "x"), (101, "odd", "", "x", "x", "x"), (102, "http://h.example/c", "no markup", "x", "x", "x")]
    df = pages(spark, rows)
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract(df, html_wrappers.infer_wrappers(df)).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} First & bold text {i}. Second {i}." + (f" Third {i}" if i % 2 else "")
    assert got[100] == "" and got[101] == "" and len(got) == 11
    none = df.limit(0)
    assert html_wrappers.extract(none, html_wrappers.infer_wrappers(none)).count() == 0


def naive_article(page: str) -> str:
    """The text between the article tags of the test pages, block by block, with plain expressions."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"</?(a|b|i|em|strong|span|code)\b[^>]*>", "", re.sub(r"<script.*?</script>", "", body, flags=re.S))
    blocks = (" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split(r"<(?!br)[^>]*>", body))
    return " ".join(x for x in blocks if x)


def test_article_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: (r["url"], naive_article(r["html"])) for r in table(spark, sf, "pages").collect()}
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_wrappers.op2_html_wrappers(spark, sf).collect()}
    assert got == {i: (url, text, len(text)) for i, (url, text) in want.items()}


def read(spark, rows, salts=32):
    df = pages(spark, [(*r, "x", "x", "x") for r in rows])
    return {r["page_id"]: r["text"] for r in html_wrappers.extract(df, html_wrappers.infer_wrappers(df, salts)).collect()}


def alone(page: str) -> str:
    """Read without a wrapper of other pages: with that of the page itself."""
    w = html_wrappers.wrapper_of(html_wrappers.tokens(page))
    return html_wrappers.article(page, frozenset(html_wrappers.menus(w)), frozenset())


NEUTRAL = """<div class=aa><p>Good day to you</p></div><div class=bb><h2>Head {n}</h2><p>Body {n}. <p>More {n} <a href=x>see</a></div>
<div class=cc>Call us at {phone}</div>{loose}<div class=dd>{long}</div>"""


def test_the_host_wrapper_decides(spark):
    """Names say nothing here: only the alignment with other pages tells template text from the article."""
    long = "All of this was written by the same hand. " * 30
    page = lambda n, loose="": NEUTRAL.format(n=n, phone=f"0{n}" if n == 3 else "123", loose=loose, long=long)
    rows = [(n, f"http://h.example/{n}", page(n, "Loose words." if n == 5 else "")) for n in range(20)]
    got = read(spark, rows)
    for n in range(20):
        assert got[n] == f"Head {n} Body {n}. More {n} see" + (" Call us at 03" if n == 3 else "") + (" Loose words." if n == 5 else "")
    assert alone(rows[1][2]) == f"Good day to you Head 1 Body 1. More 1 see Call us at 123 {long.strip()}"
    # pages that are copies of one page, or too few, are no template
    assert read(spark, [(n, "http://h.example/1", page(1)) for n in range(8)])[4] == alone(page(1))
    assert read(spark, rows[:4])[1] == alone(page(1))


def test_menus_are_repeated_links(spark):
    menu = "<ul class=x>" + "".join(f"<li><a href={i}>Go {i}</a></li>" for i in range(4)) + "</ul>"
    cards = "<div class=y><p>A {n}<p>B {n} <a href=z>z</a></div>"
    rows = [(n, f"http://h.example/{n}", menu.replace("Go", f"Go {n}") + cards.format(n=n)) for n in range(3)]
    assert read(spark, rows) == {n: f"A {n} B {n} z" for n in range(3)}


def test_inside_and_outside_are_decided_for_each_page(spark):
    rows = [(1, "http://h.example/1", "<article><p>in</p></article><p>out</p>"), (2, "http://h.example/2", "<div class=content><p>plain</p></div>"), (3, None, "<p>odd</p>")]
    assert read(spark, rows) == {1: "in", 2: "plain", 3: "odd"}


def test_the_order_of_pages_does_not_matter(spark):
    """Wrappers aligned in any order, and pages in any order and partitions, give the same texts."""
    a = "<div class=x><p>{t}</p></div><div class=p></div>"
    b = "<div class=p><div class=q><a href=1>Politics {n}</a></div></div><div class=p><div class=q><a href=2>Economy {n}</a></div></div><div class=x><p>{t}</p></div>"
    c = "<div class=p><div class=q><a href=1>Sports {n}</a></div></div><div class=z><p>Also {n}</p></div><div class=x><p>{t}</p></div>"
    shapes = [a.format(t="Article one"), b.format(t="Article two", n=1), c.format(t="Article three", n=2)]
    results = set()
    for order in itertools.permutations(shapes):
        w = html_wrappers.wrapper_of(html_wrappers.tokens(order[0]))
        for page in order[1:]:
            w = html_wrappers.align(w, html_wrappers.wrapper_of(html_wrappers.tokens(page)))
        links = frozenset(html_wrappers.menus(w))
        results.add(tuple(html_wrappers.article(page, links, frozenset()) for page in shapes))
    assert results == {("Article one", "Article two", "Also 2 Article three")}
    rows = [(n, "http://h.example/", [a, b, c][n % 3].format(t=f"Article {n}", n=n), "x", "x", "x") for n in range(90)]
    want = {n: (f"Also {n} " if n % 3 == 2 else "") + f"Article {n}" for n in range(90)}
    for seed, parts in ((1, 1), (2, 5), (3, 16)):
        mixed = random.Random(seed).sample(rows, len(rows))
        df = pages(spark, mixed).repartition(parts)
        assert {r["page_id"]: r["text"] for r in html_wrappers.extract(df, html_wrappers.infer_wrappers(df)).collect()} == want


def test_articles_outside_main_are_teasers():
    assert alone("<main><p>m</p></main><div class=more><article><p>teaser</p></article></div>") == "m"
    assert alone("<main><article><h1>t</h1><p>m</p></article></main><article><p>teaser</p></article>") == "t m"
    assert alone("<main><nav>n</nav></main><article><p>a</p></article>") == "a"
    assert alone("<label>name</label><p class=visually-hidden>b</p><div class=topnav>c</div><p>x</p>") == "x"


def test_names_of_what_is_not_the_article():
    drops = ["sidebar", "sidebar-left", "site-footer", "ad-728x90", "ad", "cookie-banner", "share_buttons", "a1 b1 c1 d1 e1 f1 g1 h1 i1 sidebar", "related-posts", "comments-area"]
    keeps = ["share-price", "header-image-story", "advice", "content", "has-sidebar", "news-alert-story", "adventure", "commentary"]
    for name in drops:
        assert alone(f"<div class='{name}'>no</div><p>yes</p>") == "yes", name
    for name in keeps:
        assert alone(f"<div class='{name}'>yes</div>") == "yes", name
    assert alone("<article><header><h1>T</h1></header><p>x<footer>f</footer><aside>s</aside></article><header>H</header>") == "T x"
    assert alone("<body class=has-sidebar><form><main><p>x</p><form><label>f</label></form></main></form>") == "x"
    assert alone('<div data-title="the hidden garden">a</div><p aria-hidden="true">b</p><div hidden>c</div><div style="display: none">d</div>') == "a b"


def test_broken_pages_are_read_in_linear_time():
    assert alone("<p>a</p><script>var x=1; y") == "a"
    assert alone("<p>a</p><!-- b") == "a"
    assert alone("<p>a</p><a href='b") == "a"
    assert alone("1 < 2 <3 &lt;b&gt;") == "1 < 2 <3 <b>"
    assert alone("<p>a<x-y>b</x-y>c<wbr>d<br>e<hr>f<font>g</font></p>") == "abcd e fg"
    began = time.perf_counter()
    assert alone("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert alone("".join(f"<div class=x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>" for i in range(5000)) + "x" + "</y></p>" * 5000) == "x"
    assert alone("<p>a</p>" + "<a " * 350_000) == "a"
    assert alone("<p>a</p>" + '<a x="' * 200_000) == "a"
    assert alone("<p>a " + "<a <b " * 100_000 + 'x=">"') == "a"
    assert time.perf_counter() - began < 10


def test_deep_pages_and_repeated_pages_go_through(spark):
    deep = "<div>" * 5000 + "<p>x</p>"
    assert read(spark, [(1, "u", deep), (1, "u", deep), (2, "u", "<p>y</p>")]) == {1: "x", 2: "y"}


def test_wrappers_generalise():
    one, two, three = (html_wrappers.wrapper_of(html_wrappers.tokens(f"<div><h1>{t}</h1>{x}</div>")) for t, x in (("a", "<p>b</p><p>c</p>"), ("c", "<table><tr><td>d</td></tr></table>"), ("e", "<dl><dt>f<dd>g<dt>h<dd>i</dl>")))
    w = html_wrappers.align(html_wrappers.align(one, two), three)
    assert html_wrappers.expression(w) == "<div> <h1> #text </h1> ((<p> #text </p>)? )+ (<table> <tr> <td> #text </td> </tr> </table>)? (<dl> (<dt> #text </dt> <dd> #text </dd> )+ </dl>)? </div>"


def test_chat_is_read_back(spark, sf_dir):
    rows = {}
    for r in table(spark, sf_dir, "conversations").collect():
        rows.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    says = "\\### Assistant: </turn> ok"
    rows[-7] = [(0, "user", says), (1, "assistant", says)]
    got = {r["conv_id"]: r for r in chat.op8_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in rows.items():
        turns = sorted(turns)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), sha(loss))


def test_chat_odd_and_empty(spark):
    says = ["<|end|>", "\\<|", "<\\|text|>", "", None, "\U0001f600 é\n", "x" * 50_000]
    rows = [(1, i, r, t, "x", "x") for i, t in enumerate(says) for r in ("user", "assistant")] + [(None, None, None, None, "x", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string, starts string")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    want = sorted((i, r, t or "") for _, i, r, t, _, _ in rows[:-1])
    assert chat.read_turns(got[1]["formatted"]) == [(r, t) for _, r, t in want]
    texts = chat.read_loss(got[1]["formatted"], got[1]["loss"], got[1]["starts"], got[1]["stops"])
    assert texts == [t for _, r, t in want if r == "assistant" and t]
    assert chat.read_turns(got[None]["formatted"]) == [("", "")]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_repeated_turns_and_the_two_ways_to_digest(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b\\<|end|>"), (1, 1, "assistant", ""), (2, 0, "assistant", "\u0301x" * 70_000), (3, None, None, None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, two = chat.digests(chat.format_conversations(df)), chat.format_digests(df)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    got = {r["conv_id"]: r for r in two.collect()}
    assert [got[i]["n_turns"] for i in (1, 2, 3)] == [8, 2, 2] and got[1]["loss_chars"] == 2 * len("b\\<|end|>") and got[2]["loss_chars"] == 280_000
