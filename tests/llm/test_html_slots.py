from plumbline.llm import html


def texts(spark, bodies, host="a"):
    rows = [(i, f"http://{host}.example.org/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_what_is_constant_over_a_host_is_template(spark):
    page = '<div class="topbar">Best shop in town</div><div><h2>About {0}</h2><p>Story {0} of many.</p></div><div>All rights reserved</div>'
    got = texts(spark, [page.format(i) for i in range(6)])
    assert got == [f"About {i}\n\nStory {i} of many." for i in range(6)]


def test_copies_of_a_page_are_no_evidence(spark):
    assert texts(spark, ["<div>the same</div><p>text</p>"] * 6) == ["the same\n\ntext"] * 6


def test_marks_do_not_remove_bodies_articles_or_headings(spark):
    page = '<article class="search comment"><h1 class="banner">Title {0}</h1><p>Words {0}.</p><div class="share">Share {0}</div></article>'
    assert texts(spark, [page.format(i) for i in range(2)]) == [f"Title {i}\n\nWords {i}." for i in range(2)]


def test_varied_text_in_marked_elements_counts_where_there_is_no_other(spark):
    page = '<div class="search"><p>Post {0}</p><p>Log in here</p></div>'
    assert texts(spark, [page.format(i) for i in range(4)]) == [f"Post {i}" for i in range(4)]


def test_depth_is_not_cut(spark):
    depth = 2000
    assert texts(spark, ["<div>" * depth + f'<p>deep {i}</p><nav>menu</nav>' + "</div>" * depth for i in range(2)]) == ["deep 0", "deep 1"]
