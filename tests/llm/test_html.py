import random

from conftest import SF

from plumbline.llm import html

PAGE = """<!DOCTYPE html><html><head><title>Not me</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="top">Site</header><nav><ul>{menu}</ul></nav><div class="cookie-notice">We use cookies</div><!-- ad -->
<article><h1>{title}</h1>{body}<div id="comments"><p>First!</p></div></article>
<aside>Also <b>read</b></aside><form>Mail <input name=x><button>Go</button></form><footer>&copy; us</footer></body>"""


def make(rng, i):
    words = lambda: " ".join(rng.choice(["fish", "a &lt; b", "caf&eacute;", "x&amp;y", "<b>bold</b>", "<a href='/q?a=\">\"'>link</a>"]) for _ in range(rng.randint(1, 9)))
    plain = lambda s: s.replace("<b>bold</b>", "bold").replace("<a href='/q?a=\">\"'>link</a>", "link").replace("&lt;", "<").replace("caf&eacute;", "café").replace("&amp;", "&")
    parts = [words() for _ in range(rng.randint(0, 5))]
    body = "".join(rng.choice(["<p>{}</p>", "<p>\n {}  <br>", "<div>{}</div>", "<ul><li>{}</ul>", "<p><i>{}</i>"]).format(p) for p in parts)
    menu = "".join(f"<li><a href=/{j}>item {j}</a></li>" for j in range(rng.randint(0, 4)))
    return (i, f"http://{'hot' if i % 3 else 'h' + str(i % 7)}.example.org/{i}", PAGE.format(menu=menu, title=f"T {i}", body=body)), "\n\n".join([f"T {i}", *map(plain, parts)])


def test_known_texts(spark):
    rng = random.Random(2)
    made = [make(rng, i) for i in range(200)]
    pages = spark.createDataFrame([m[0] for m in made], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got == {m[0][0]: m[1] for m in made}


def test_wrapper_is_union_free():
    one = html.pattern(html.parse("<ul><li>a</li><li>b</li></ul><p>x"))
    two = html.pattern(html.parse("<ul><li>a</li></ul><h2>t</h2><p>x<p>y"))
    assert html.align(one, two) == [["ul", "1", [["li", "+", [["#", "1", []]]]]], ["h2", "?", [["#", "1", []]]], ["p", "+", [["#", "1", []]]]]
    pairs = html.pattern(html.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl>"))
    assert pairs == [["dl", "1", [["dt", "+", [["#", "1", []]]], ["dd", "+", [["#", "1", []]]]]]]


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None, 0), (2, "", "", 0), (3, "x", "just text &am", 0), (4, "http://a/", "<p>a<p>b <", 0), (5, "http://a/", deep, 0), (5, "http://a/", deep, 0), (None, "http://b/", "<p hidden>x</p><p>y", 0), (7, "http://c/", "<p>" + "long " * 50_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = html.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "just text &am" and by[4] == "a\n\nb <" and by[5] == "deep" and by[None] == "y"
    assert by[7] == ("long " * 50_000).strip()
    assert html.extract(pages.limit(0)).count() == 0


def test_query_on_the_tables(spark):
    got = html.op6_html(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and "track(" not in r.text and "©" not in r.text for r in got)
    assert all(r.text for r in got)
