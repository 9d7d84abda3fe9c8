import hashlib

import pytest

from claimforge.llm import html, urls, warc

PAGES = "page_id long, url string, html string, rule string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


def expected(rows):
    least = {}
    for i, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and i is not None:
            least[data] = min(i, least.get(data, i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = least.get(data)
        revisit = i is not None and first is not None and i > first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", ["128m", "600"])
def test_archive_round_trip(spark, split):
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 7\r\n\r\nabcdefg\r\n\r\nWARC/1.1\r\n"
    same = "größer " * 30
    rows = [(1, "http://a", "short"), (2, None, same), (3, "http://b\r\nX: y", same), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", fake), (8, "u", fake * 9), (9, "u", "WARC/1.1\r\n" * 40), (2, None, same), (None, "u", "n" * 200), (12, "u", "\r\n\r\n" * 50), (13, "u", "é" * 5000), (14, "u", "n" * 200)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.archived(pages(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_archives_of_driver_pages(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "url", "html").collect()]
    got = warc.archived(spark.read.parquet(f"{tables}/pages.parquet")).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    assert warc.archived(pages(spark, [])).collect() == []


def test_pointer_jumping_keeps_the_chain_only(spark):
    chain = [("f", i * 10, i * 10 + 10) for i in range(37)] + [("f", 5, 10), ("f", 13, 370), ("g", 3, 9)]
    got = warc.reachable(spark.createDataFrame(chain, "file string, off long, nxt long")).collect()
    assert sorted((r.file, r.off) for r in got if r.off < 370) == [("f", i * 10) for i in range(37)]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda r: len(r[0]), default=(None, None)))


def test_url_rules(spark):
    said = ["http://WWW.Example.COM/en/7x?q#f", "https://a.com/en/1", "http://x.net/de/8", "http://m.example.net/de/8/1", "ftp://com/en/", "http://xcom/en/", "no scheme", None, "", "a://b://c/d", "http://ÄB.org/es/", "http://h?x/y", "http://h#/en/", "://x.com/en/\n2", "x" * 5000]
    got = {r.page_id: r for r in urls.judge(pages(spark, [(i, u, "") for i, u in enumerate(said)])).collect()}
    for i, u in enumerate(said):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict or rule is None and got[i].verdict in ("allow", "block")
    assert urls.judge(pages(spark, [])).collect() == []


def test_url_model_learns(spark):
    """Without a rule, English-looking paths follow the blocked ones and German-looking the allowed ones."""
    rows = [(i, f"http://s{i % 7}.com/en/{i}/the-thing.html", "") for i in range(300)] + [(1000 + i, f"http://s{i % 7}.net/de/{i}/das-ding.html", "") for i in range(300)]
    rows += [(5000 + i, f"http://t{i % 5}.info/en/{i}/the-thing.html", "") for i in range(50)] + [(6000 + i, f"http://t{i % 5}.info/de/{i}/das-ding.html", "") for i in range(50)]
    got = urls.judge(pages(spark, rows)).filter("rule is null").collect()
    right = sum((r.verdict == "block") == (r.page_id < 6000) for r in got)
    assert right / len(got) > 0.95


def test_url_ratios_equal_exact_counts(spark):
    """Ratios from plain dictionaries of all ruled URLs, of more distinct grams than a hashed table would tell apart."""
    import math
    import random
    from collections import Counter

    rnd = random.Random(3)
    name = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789-é") for _ in range(n))
    rows = [(i, f"http://{name(9)}.{('com', 'net', 'info')[i % 3]}/{('en', 'de', 'en')[i % 3]}/{name(30)}", "") for i in range(1500)] + [(9000, "http://a.com/en/1", ""), (9001, "http://a.com/en/1", ""), (9002, None, "")]
    got = urls.judge(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    counts = {"block": Counter(), "allow": Counter()}

    def grams(r):
        data = bytes(4) + (r.host + r.path).encode() + b"\1"
        return [data[i - 4 : i + 1] for i in range(4, len(data))]

    for r in got:
        if r.rule is not None:
            for g in grams(r):
                for k in range(5):
                    counts[r.verdict]["own", g[4 - k :]] += 1
                    counts[r.verdict]["context", k, g[4 - k : 4]] += 1

    def log(g, c):
        p = 1 / 256
        for k in range(5):
            p = (c["own", g[4 - k :]] + urls.SMOOTH * p) / (c["context", k, g[4 - k : 4]] + urls.SMOOTH)
        return math.log(p)

    assert len({g for r in got for g in grams(r)}) > 2**15
    for r in got:
        own = grams(r)
        assert abs(sum(log(g, counts["allow"]) - log(g, counts["block"]) for g in own) / len(own) - r.ratio) < 1e-8


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Big &amp; small</h1><p><b>First</b>&nbsp;line<br>second  line.<p>Next&eacute; <i>pa</i>ra. <div class="ad">Buy!</div>
    <form><label>Name</label><input></form><ul><li>one<li>two</ul><blockquote>quote</blockquote><table><tr><td>c1<td>c2</table>
    <div id="comments"><p>Nice article!</p></div></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert html.main_text(page) == "Big & small\n\nFirst line second line.\n\nNexté para.\n\none\n\ntwo\n\nquote\n\nc1\n\nc2"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<article><p>Cut off te<di") == "Cut off te"
    plain = "<body><div class=menu><a>a</a><a>b</a></div><div id=main-text><h2>Head</h2><p>" + "A long paragraph of text. " * 9 + "</p><p>Short.</p></div><div class=sidebar>x</div></body>"
    assert html.main_text(plain).startswith("Head\n\nA long") and html.main_text(plain).endswith("\n\nShort.")


def test_ratio_alone_separates():
    """No element or class name tells the link lists from the text, outside an article and inside one."""
    links = "<ul>" + "".join(f'<li><a href="/{i}"><b>Item</b> <i>{i}</i></a></li>' for i in range(12)) + "</ul>"
    paragraphs = [f"Paragraph {i} " + "with many words of plain running text " * 6 for i in range(4)]
    inside = f"<div class=x1>{links}</div><div class=x2><h2>Head</h2>{''.join(f'<p>{p}</p>' for p in paragraphs)}<ol><li>one<li>two</ol><p>Short end.</p></div><div class=x3>{links}</div>"
    wanted = ["Head", *(p.strip() for p in paragraphs), "one", "two", "Short end."]
    assert html.main_text(f"<body>{inside}</body>").split("\n\n") == wanted
    assert html.main_text(f"<body><article><h1>Title</h1>{inside}</article></body>").split("\n\n") == ["Title", *wanted]
    flat = f"<article><p>{paragraphs[0]}</p>{links}<p>{paragraphs[1]}</p></article>"
    assert html.main_text(flat).split("\n\n") == [paragraphs[0].strip(), paragraphs[1].strip()]


def test_the_ratio_decides(monkeypatch):
    """With other values in place of the smoothed ratio, other containers are chosen."""
    import numpy as np

    page = "<body><div><p>" + "Running text of the story. " * 9 + "</p><p>More.</p></div><div><a>one</a> <a>two</a> <a>three</a></div></body>"
    assert html.main_text(page).endswith("More.") and "one" not in html.main_text(page)
    monkeypatch.setattr(html, "smoothed", lambda values, sigma: np.arange(len(values), dtype=float) == len(values) - 1)
    assert html.main_text(page) == "one two three"


def test_marks_in_and_around_articles():
    body = "<p>" + "Running text of the story goes on. " * 6 + "</p>"
    text = ("Running text of the story goes on. " * 6).strip()
    clutter = "".join(f'<div class="{c}"><p>{"Some words that stand here too. " * 5}</p></div>' for c in ("notice", "site-notice", "login", "cookie-banner", "ad-slot top", "related-posts", "comments-list"))
    assert html.main_text(f"<article>{body}{clutter}</article>") == text
    assert html.main_text(f'<article>{body}<div role="search">{body}</div><aside>{body}</aside></article>') == text
    # Words of a class on no list keep its text; so does an article in a marked element.
    price = "The share price rose by ten per cent in a day and fell again. " * 3
    assert html.main_text(f'<article>{body}<div class="share-price-report"><p>{price}</p></div></article>') == f"{text}\n\n{price.strip()}"
    assert html.main_text(f'<div class="widget"><main>{body}</main></div>') == text
    assert html.main_text(f"<footer>{body}</footer><p>Only line.</p>") == "Only line."


STORY = "Running text of the story goes on and on. " * 6


def test_furniture_inside_a_line():
    """What is pruned inside a paragraph goes from it; the paragraph stays, whole and one block."""
    page = lambda inner: html.main_text(f"<article><p>{STORY}</p><p>Before it {inner} and after it.</p></article>").split("\n\n")[1:]
    for inner in ("<select><option>one<option>two</select>", "<button>Buy now</button>", "<button><p>Buy</p> now</button>", "<svg><title>icon</title></svg>", "<noscript>on</noscript>", "<textarea>x</textarea>", '<span class="ad">Buy</span>', '<a class="share" href="/">Share</a>', "<span hidden>secret</span>", "<iframe>old</iframe>", "<label>Name</label>"):
        assert page(inner) == ["Before it and after it."], inner
    assert page("<b>bold</b>") == ["Before it bold and after it."]
    assert html.main_text(f"<article><p>{STORY}</p><p>Ends in <button>Subscr") == f"{STORY.strip()}\n\nEnds in"
    assert html.main_text(f"<article><p>{STORY}</p><p>Open <button>Buy</p><p>Next.</p></article>") == f"{STORY.strip()}\n\nOpen\n\nNext."


def test_forms_around_and_in_articles():
    form = '<form><label>Mail</label><input><p>Get our letter.</p><button>Send</button></form>'
    assert html.main_text(f"<body><form><article><p>{STORY}</p>{form}</article></form></body>") == STORY.strip()
    assert html.main_text(f'<body><form id="aspnetForm"><div><h2>Head</h2><p>{STORY}</p><label>Search</label><input></div></form></body>') == f"Head\n\n{STORY.strip()}"
    assert html.main_text(f"<body><div><p>{STORY}</p></div>{form}</body>") == STORY.strip()
    assert html.main_text(f"<body>{form}</body>") == ""


def test_articles_side_by_side():
    """All stay in page order, but teasers; an article in another is part of it."""
    short = "A second and shorter story of the day. " * 2
    teaser = '<article><h3><a href="/1">A linked headline of another story</a></h3><p>Read on in this one.</p></article>'
    assert html.main_text(f"<article><h1>One</h1><p>{STORY}</p></article><article><h1>Two</h1><p>{short}</p></article>{teaser}{teaser}") == f"One\n\n{STORY.strip()}\n\nTwo\n\n{short.strip()}"
    assert html.main_text(f"<article><p>{STORY}</p><article><p>{short}</p></article></article>") == f"{STORY.strip()}\n\n{short.strip()}"


def test_references_and_comments():
    references = "".join(f'<li><a href="/{i}">Author {i}, A long title of a cited work, Journal of Things {i}</a></li>' for i in range(5))
    text = html.main_text(f"<article><p>{STORY}</p><h2>References</h2><ol>{references}</ol></article>")
    assert text.count("cited work") == 5 and "References" in text
    for mark in ("user-comment", "wpcomments-area", "comment-list", "comments"):
        assert html.main_text(f'<article><p>{STORY}</p><div class="{mark}"><p>{STORY}</p></div></article>') == STORY.strip(), mark
    assert html.main_text(f'<article><p>{STORY}</p><div class="commentary"><p>{STORY}</p></div></article>').count(STORY.strip()) == 2


def test_deep_and_long_pages():
    """Linear in elements that are never closed, end tags without a start, and many lines."""
    deep = "<div>" * 20_000 + "<p>deep text</p>" + "</span>" * 20_000 + "<i>" * 5_000 + "</b>" * 20_000
    assert html.main_text(deep) == "deep text"
    long = "<main>" + "<p>a line of the long page with some words</p>" * 20_000 + "</main>"
    assert html.main_text(long).count("\n\n") == 19_999


def brute_article(page):
    """Of the driver's page form: blocks of the article, tags cut out."""
    import html as entities
    import re

    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:h1|p)>", found[1]) if found else []
    texts = [" ".join(entities.unescape(re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " ")).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_main_text_of_driver_pages(spark, tables):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}
    got = html.extract(spark.read.parquet(f"{tables}/pages.parquet")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == brute_article(rows[r.page_id]) and r.n_chars == len(r.text)
    assert html.extract(pages(spark, [])).collect() == []
    odd = html.extract(pages(spark, [(None, None, None), (1, "u", "<p>x</p>")])).collect()
    assert sorted((r.page_id is None, r.text, r.n_chars) for r in odd) == [(False, "x", 1), (True, "", 0)]
