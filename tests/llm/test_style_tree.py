import itertools
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dendrospark.llm import style_tree
from dendrospark.llm.entry import op5_style_tree

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div><article class="post"><h1>Head  %d</h1><p>One &eacute;
 two<br>three<p>Four <b>five</b></p><aside>side</aside><form><input value="q">Send</form><ul><li>a<li>b</ul>
<div class="comments"><p>reader says</p></div></article><footer>&copy; site</footer></body>"""


def test_article_text():
    assert style_tree.main_text(PAGE % 1) == "Head 1\nOne \u00e9 two three\nFour five\na\nb"


def test_pages_without_article_and_broken_markup():
    assert style_tree.main_text("<div><p>a<p>b</div><div id='sidebar'>c</div>") == "a\nb"
    assert style_tree.main_text("plain &lt;text&gt;") == "plain <text>"
    assert style_tree.main_text("<p>a < b and c</p>") == "a < b and c"
    assert style_tree.main_text("<script>never closed") == ""
    assert style_tree.main_text("<p>x<!-- <p>y</p> --> z</p><!-- open") == "x z"
    assert style_tree.main_text("") == ""


def test_open_brackets_take_linear_time():
    began = time.process_time()
    text = "a<b " * 50_000
    assert style_tree.main_text("<p>x</p>" + text) == "x\n" + text.strip()
    assert time.process_time() - began < 10


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string").repartition(2)


def test_templates_are_cut_by_entropy(spark):
    """A block that all pages of a host share goes; blocks that differ, and other hosts, stay."""
    body = "<html><body><div class='x'><p class='motto'>Same on every page</p><p class='say'>Text number %d</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", body % i) for i in range(20)] + [(99, "http://other.example/", body % 99)]
    out = {r.page_id: r.text for r in style_tree.extract(pages(spark, rows), "url", "html", ["page_id"]).collect()}
    assert out[3] == "Text number 3" and out[99] == "Same on every page\nText number 99"


def test_copies_are_no_template(spark):
    """Neither exact nor near copies of an article, on a host of their own, lose any of their text."""
    article = "<article><h1>Same head</h1><p>Same body</p><p>%s</p></article><footer>f</footer>"
    rows = [(i, f"http://c.example/{i}", article % "end") for i in range(30)] + [(50 + i, f"http://n.example/{i}", article % f"end {i}") for i in range(30)]
    rows += [(100 + i, f"http://p.example/{i}", "<div><p>One</p><p>Two</p></div>") for i in range(30)] + [(140, "http://p.example/x", "<div><p>Three</p></div>")]
    out = {r.page_id: r.text for r in style_tree.extract(pages(spark, rows), "url", "html", ["page_id"]).collect()}
    assert out[7] == "Same head\nSame body\nend" and out[57] == "Same head\nSame body\nend 7"
    assert out[105] == "One\nTwo" and out[140] == "Three"


def neutral(html):
    """The same page without a word that tells what its elements are for."""
    html = re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="x{zlib.crc32(m[2].encode()):x}"', html)
    return re.sub(r"(</?)(nav|article|footer|header|aside|main|form)\b", r"\1div", html)


def site(host, n, seed=0):
    """(page_id, url, html, the article's text): menus and adverts change their words but not their layout."""
    say = random.Random(seed)
    words = lambda k: " ".join(say.choice("alder birch cedar elm fir hazel larch maple oak pine rowan yew".split()) for _ in range(k)) + f" {say.random()}"
    out = []
    for i in range(n):
        title, parts = words(3), [words(say.randint(5, 20)) for _ in range(say.randint(1, 12))]
        menu = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(6))
        body = "".join(f"<p>{p}</p>" if k % 3 else f"<p><b>{p}</b></p>" for k, p in enumerate(parts))
        out.append((seed * 1000 + i, f"http://{host}/{i}", f'<html><body><nav><ul>{menu}</ul></nav><div class="motto">Ever the same</div><div class="ad">{words(4)}</div><article><h1>{title}</h1>{body}<div class="box">Read on</div></article><footer>{words(3)}</footer></body></html>', "\n".join([title, *parts])))
    return out


def test_the_tree_alone_finds_the_article(spark):
    """Without names to go by, all is kept where no statistics decide, and only the article where they do."""
    rows = [(i, u, neutral(h)) for i, u, h, _ in site("one.example", 40, 1) + site("two.example", 25, 2)]
    want = {i: t for i, _, _, t in site("one.example", 40, 1) + site("two.example", 25, 2)}
    df = pages(spark, rows)
    assert {r.page_id: r.text for r in style_tree.extract(df, "url", "html", ["page_id"]).collect()} == want
    off = {r.page_id: r.text for r in style_tree.extract(df, "url", "html", ["page_id"], by_tree=False).collect()}
    assert all(want[i] != off[i] and "Ever the same" in off[i] for i in want)


def test_the_tree_changes_pages_with_articles(spark, folder):
    """A container that is alike on all pages goes from inside a declared article as well."""
    rows = [r[:3] for r in site("one.example", 40, 3)]
    df = pages(spark, rows)
    want = {i: t for i, _, _, t in site("one.example", 40, 3)}
    assert {r.page_id: r.text for r in op5_style_tree(spark, folder(pages=df)).collect()} == want
    off = {r.page_id: r.text for r in style_tree.extract(df, "url", "html", ["page_id"], by_tree=False).collect()}
    assert off == {i: t + "\nRead on" for i, t in want.items()}


def differ(marks, prior):
    """The chance that two pages differ, all pairs compared one by one."""
    both = list(itertools.combinations(marks, 2))
    return (sum(a != b for a, b in both) + style_tree.PRIOR * prior) / (len(both) + style_tree.PRIOR)


def brute(rows):
    """page_id -> text of a whole table: every node's pairs of pages, importance by recursion."""
    hosts = {}
    for _, url, html in rows:
        marks, content = style_tree.features(html or "")
        hosts.setdefault(style_tree.host_of(url), {})[content] = marks
    decided = {}
    for host, seen in hosts.items():
        shows, kids = {}, {}
        for marks in seen.values():
            for key, up, depth, flags, kind, n, mark in marks:
                shows.setdefault(key, ([], [], [], flags))[kind].append(mark)
                if kind == style_tree.LAYOUT:
                    shows[key][2].append(n)
                    if depth:
                        kids.setdefault(up, set()).add(key)

        def weigh(key, shows=shows, kids=kids):
            layouts, texts, counts, flags = shows[key]
            looks = differ(layouts, 1 if flags & 1 else 0.5)
            reads = (looks + differ(texts, 1 if flags & 1 else 0.5)) / 2 if texts else None
            if key not in kids:
                return looks if reads is None else reads
            parts = [(len(shows[k][0]), weigh(k)) for k in kids[key]] + ([(len(texts), reads)] if texts else [])
            share = style_tree.DECAY ** (sum(counts) / len(counts) + bool(texts))
            return (1 - share) * looks + share * sum(n * w for n, w in parts) / sum(n for n, _ in parts)

        def most(key, kids=kids, weigh=weigh):
            return max([weigh(key), *(most(k) for k in kids.get(key, ()))])

        cuts = {k for k, v in shows.items() if v[3] < 2 and most(k) < style_tree.LOW}
        mains = {k for k in shows if weigh(k) >= style_tree.HIGH and all(weigh(c) <= weigh(k) + style_tree.PEAK for c in kids.get(k, ()) if c in kids)}
        decided[host] = frozenset(cuts), frozenset(mains)
    return {i: style_tree.main_text(html or "", decided[style_tree.host_of(url)]) for i, url, html in rows}


def test_query_against_brute_force(spark, folder):
    rows = [r[:3] for r in site("one.example", 30, 4)] + [(i, u, neutral(h)) for i, u, h, _ in site("two.example", 12, 5) + site("few.example", 3, 6)]
    rows += [(9000 + i, f"http://one.example/c{i}", rows[0][2]) for i in range(20)]
    rows += [(9100 + i, "http://odd.example/", f"<div><div>same</div><div>{i % 3}<p>x{i}</p></div><ul><li>a<li>b{i % 2}</ul></div>") for i in range(15)]
    rows += [(9200, None, None), (9201, "http://one.example/empty", "")]
    got = {r.page_id: r.text for r in op5_style_tree(spark, folder(pages=pages(spark, rows))).collect()}
    assert got == brute(rows)


def test_importance_is_the_chance_that_two_pages_differ(spark):
    rows = [("h", 5, 0, 1, 0, 0, 0, m, n) for m, n in ((1, 3), (2, 1), (3, 4))]
    got = style_tree.nodes_of(spark.createDataFrame(rows, "host string, node long, up long, depth int, flags int, kind int, kids int, mark long, pages long")).first()
    assert abs(got.presentation - differ([1, 1, 1, 2, 3, 3, 3, 3], 0.5)) < 1e-12 and got.content is None


def test_inline_elements_and_missing_ends():
    assert style_tree.main_text("<div>one <button>Share</button>two <span class='ad'>x<div>y</div></span>three</div>") == "one two three"
    assert style_tree.main_text("<html><head><title>t</title><body><p>x</p>") == "x"
    deep = "<div>" * 30_000 + "deep" + "</div>" * 30_000
    assert style_tree.main_text(deep) == "deep" and max(m[2] for m in style_tree.features(deep)[0]) == style_tree.DEEPEST


def test_own_names_cannot_be_kept(spark):
    df = pages(spark, [(1, "http://a.b/", "x")]).withColumn("text", F.lit("t"))
    with pytest.raises(ValueError, match="text"):
        style_tree.extract(df, "url", "html", ["page_id", "text"])


def test_query_edge_cases(spark, folder):
    rows = [(1, "http://a.b/c", PAGE % 1), (1, "http://a.b/c", PAGE % 1), (2, None, None), (3, "nonsense", ""), (None, "http://a.b/", PAGE % 7), (5, "http://a.b/d", "<article><p>" + "long word " * 50_000)]
    out = op5_style_tree(spark, folder(pages=pages(spark, rows))).collect()
    assert Counter(r.page_id for r in out) == Counter({1: 2, 2: 1, 3: 1, None: 1, 5: 1})
    by = {r.page_id: r for r in out}
    assert by[2].text == "" and by[3].n_chars == 0 and by[None].text.startswith("Head 7")
    assert by[5].n_chars == len(("long word " * 50_000).strip())
    assert op5_style_tree(spark, folder(pages=pages(spark, rows).limit(0))).count() == 0
