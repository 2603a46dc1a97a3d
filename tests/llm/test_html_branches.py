"""A repeated container keeps the unique text below it."""

from varloom.llm import html_extract


def test_unique_text_below_repeated_containers_stays(spark):
    rows = []
    for i in range(12):
        rows.append((i, "http://a.example.org/x", f"<article>Staff report<h2>Summary</h2><h1>Title {i}</h1><p>unique story {i}</p></article>"))
        rows.append((100 + i, "http://b.example.org/x", f"<div class=content>Published by X<p>unique story {i}</p></div><div class=strip>Slogan<p>All rights</p></div>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Staff report\nSummary\nTitle {i}\nunique story {i}"
        assert got[100 + i] == f"Published by X\nunique story {i}"
