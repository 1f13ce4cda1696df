import html
import random
import re
import time

from strandlake.llm import html_extract as he

PAGE_SCHEMA = "page_id long, url string, html string, host string, digests string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGE_SCHEMA)


def one(page, template=frozenset()):
    return he.main_text(page, template)[0]


def test_furniture_goes_and_blocks_are_joined():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- a <p>no</p> --><div class="cookie-notice">We use</div>
    <div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>One  two<br>three<p>Four &#233;&lt;b&gt;</p><ul><li>a<li>b</ul><form><input value=1>Send</form>
    <aside>Side</aside><table><tr><td>c<td>d</table><div id="comments"><p>Reader says</p></div></article><footer>&copy; me</footer></body></html>"""
    assert one(page).split("\n") == ["Head & tail", "One two three", "Four é<b>", "a", "b", "c", "d"]


def test_awkward_pages():
    assert [one(x) for x in (None, "", "   ", "<", "<p", "plain &amp; text", "</p></div>", "<article>", "<script>x")] == ["", "", "", "<", "<p", "plain & text", "", "", ""]
    assert one("<main><p>a</p></main><p>b</p>") == "a" and one("<p>a</p><p>b</p><nav>c</nav>") == "a\nb"
    assert one("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert one("<article><p>" + "long " * 200_000 + "</p></article>") == ("long " * 200_000).strip()
    assert one("<article hidden>no</article><article>a</article><article>b</article>") == "a\nb"
    assert one("<div class='comment'><article>reply</article></div><article>a</article>") == "a"


def test_random_articles_match_brute_force():
    random.seed(2)
    for _ in range(100):
        tags = [random.choice(["<p>", "</p>", "<b>", "</b>", "<br>", "x &amp; y", " word ", "<li>", "<h2>t</h2>", "é", "\n"]) for _ in range(40)]
        body = "".join(tags)
        want = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|li|h2)>", body)]
        assert one(f"<nav>n</nav><article>{body}</article>") == "\n".join(b for b in want if b)


def test_recurring_subtrees_go_per_host(spark):
    frame = lambda i, host: f"<div><span>Welcome to {host}</span></div><div><p>text {i} of its own</p></div><div><i>all rights {host}</i></div>"
    rows = [(i, f"https://A.example/{i}", frame(i, "a")) for i in range(12)] + [(50, "http://b.example/x", frame(50, "a")), (51, None, None), (51, None, None), (None, "", "<p>x</p>")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in he.extract(pages(spark, rows)).collect())
    want = [(str(i), f"text {i} of its own", len(f"text {i} of its own")) for i in range(12)]
    full = "Welcome to a\ntext 50 of its own\nall rights a"
    assert got == sorted([*want, ("50", full, len(full)), ("51", "", 0), ("51", "", 0), ("None", "x", 1)])
    assert he.extract(pages(spark, [])).collect() == []


def test_shared_article_text_stays(spark):
    rows = [(i, "https://a.example/", "<div>top</div><article><p>The same text.</p><p><a href=y>More links</a></p></article>") for i in range(20)]
    assert {r.text for r in he.extract(pages(spark, rows)).collect()} == {"The same text."}


def test_copies_of_whole_pages_stay(spark):
    story = "<div><p>The first part of the story.</p><p>The second part, longer than the first one.</p></div>"
    page = lambda i: f"<html><head><title>{i}</title></head><body><div><a href=/>Home</a> <a href=/x>More</a></div>{story}<footer>Printed {i}</footer></body></html>"
    rows = [(i, f"https://a.example/{i}", page(0)) for i in range(3)] + [(10 + i, f"https://b.example/{i}", page(i)) for i in range(5)]
    rows += [(100 + i, f"https://{'ab'[i % 2]}.example/o/{i}", f"<p>Other text {i}.</p>") for i in range(20)]
    got = {r.page_id: r.text for r in he.extract(pages(spark, rows)).collect()}
    told = "The first part of the story.\nThe second part, longer than the first one."
    assert all(got[i].endswith(told) for i in (0, 1, 2, *range(10, 15)))
    assert {got[i] for i in range(10, 15)} == {told}


def test_section_templates_go_on_large_hosts(spark):
    part = lambda i: "<div><span>Section of gardens</span></div>" if i < 150 else ""
    rows = [(i, f"https://a.example/{i}", f"{part(i)}<p>text {i} of its own</p>") for i in range(2000)]
    assert {r.page_id: r.text for r in he.extract(pages(spark, rows)).collect()} == {i: f"text {i} of its own" for i in range(2000)}


def brute_templates(rows):
    """Per host the stored digests that recur, by plain counting over whole pages."""
    hosts, out, shapes = {}, {}, {}
    for _, url, page in rows:
        host = re.match(r"(?:https?:)?//([^/:?#]*)", url or "")
        text, own = he.subtree_digests(page)
        hosts.setdefault(name := host[1].lower() if host else "", []).append((text, own))
        for d in own:
            shapes.setdefault(d, set()).add((name, text))
    for host, own in hosts.items():
        texts, found = {t for t, _ in own}, set()
        for d in set().union(*(x for _, x in own)):
            pages, contents = sum(d in x for _, x in own), len({t for t, x in own if d in x})
            if d < 0:
                recurs = pages >= he.MIN_PAGES and pages >= min(he.MIN_SHARE * len(own), he.MANY_PAGES)
            elif d % 2:
                recurs = len(shapes[d]) >= he.SHAPE_PAGES and len(texts) >= he.MIN_PAGES
            else:
                recurs = contents >= he.MIN_PAGES and contents >= min(he.MIN_SHARE * len(texts), he.MANY_PAGES)
            if recurs:
                found.add(d)
        out[host] = (found, len(texts) >= he.MIN_PAGES)
    return out


def mixed_pages():
    random.seed(5)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(4))
    rows = []
    for i in range(140):
        nav = "".join(f"<li><a href=x>{random.choice(['home', 'news', word()])}</a>" for _ in range(random.randint(2, 5)))
        parts = [f"<nav><ul>{nav}</ul></nav>", f"<div class='ad'>{random.choice(['buy', word()])}</div>", f"<div><span>Welcome {i % 3}</span></div>", f"<footer>{word()}</footer>", "<aside>one</aside>"]
        story = f"<article><h1>{word()}</h1><p>{word()} {word()}</p></article>" if i % 4 else f"<p>{word()} {word()} {word()}</p>"
        rows.append((i, f"https://h{min(i % 12, 5)}.example/{i}", "".join(random.sample(parts, 3)) + story + random.choice(parts)))
    return rows + [(200, None, None), (201, "https://h0.example/c", rows[0][2]), (201, "https://h0.example/c", rows[0][2]), (None, "//H1.example:80/x", rows[1][2])]


def test_extraction_matches_brute_force_with_and_without_a_broadcast(spark, monkeypatch):
    rows = mixed_pages()
    known = brute_templates(rows)
    host = lambda u: (m[1].lower() if (m := re.match(r"(?:https?:)?//([^/:?#]*)", u or "")) else "")
    want = sorted((str(i), str(u), *he.main_text(p, *known[host(u)])) for i, u, p in rows)
    shown = lambda n: sorted((str(r.page_id), str(r.url), r.text, r.n_template) for r in he.extract(pages(spark, rows), broadcast_digests=n).collect())
    assert shown(10**6) == want
    monkeypatch.setattr(he, "PAGES_A_PART", 4)
    assert shown(-1) == want


def test_templates_decide_on_the_tables_pages(spark):
    """On hosts that are counted, what lies outside the article goes by counts alone: without templates those texts change."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    known = brute_templates(rows)
    host = lambda u: re.match(r"https?://([^/:?#]*)", u)[1].lower()
    changed = sum(he.main_text(p, *known[host(u)])[0] != he.main_text(p, set(), known[host(u)][1])[0] for _, u, p in rows)
    counted = sum(known[host(u)][1] for _, u, _ in rows)
    assert counted > len(rows) // 2 and changed == counted
    assert all(he.main_text(p, *known[host(u)])[0] == he.main_text(p, set())[0] for _, u, p in rows)


def test_hostile_pages_take_linear_time():
    for page in (
        "<div>" * 100_000 + "<article>deep</article>", "<div>" * 20_000 + "</q>" * 200_000 + "x", "<a " * 200_000, "<b>" * 50_000 + "<i>" * 50_000 + "<p>" + "</b>" * 50_000 + "x",
        "<a '" * 100_001, "<li>" * 100_000 + "x", "<!--" * 100_000,
    ):
        start = time.process_time()
        text, _ = he.main_text(page, set())
        he.subtree_digests(page)
        assert time.process_time() - start < 8, page[:20]


def test_open_elements_close_as_before():
    assert one("<b>x<p>y</b>z</p>w") == "x\nyz\nw" and one("<ul><li>a<ul><li>b</li></li>c</ul>d</ul>") == "a\nb\nc\nd"
    assert one("<table><tr><td>a<td>b<tr><td>c</table>d") == "a\nb\nc\nd" and one("<p>a<!-- open") == "a" and one("<p>a<b") == "a<b"
