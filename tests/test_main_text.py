"""Main text of a page: menus, link lists and comment lists leave, the article stays."""
from credence.operators import backfill as B

ARTICLE = ["The council voted on Tuesday to rebuild the old bridge over the river before winter comes.",
           "Engineers said the work would take about six months and cost less than the earlier plan.",
           "Residents who cross the river every day welcomed the decision at the crowded evening meeting."]
PAGE = ("<html><head><title>Bridge</title><style>p{x:1}</style><script>var a='<p>hidden words here</p>';</script></head><body>"
        "<nav><ul>" + "".join(f'<li><a href="/s{i}">Section {i}</a></li>' for i in range(8)) + "</ul></nav>"
        "<div class=ad>Buy now</div><article><h1>Bridge vote</h1>"
        + "".join(f"<p>{t}</p>" for t in ARTICLE[:2]) + "<p>Short aside.</p>" + f"<p>{ARTICLE[2]}</p>"
        + "</article><section class=comments><ul>"
        + "".join(f'<li><a href="/u{i}">reader{i}</a> <a href="/r{i}">reply</a> agreed</li>' for i in range(5))
        + "</ul></section><footer>&copy; News &amp; more</footer></body></html>")


def test_menus_and_comments_leave(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>" + "word " * 30 + "</p>"), (1, PAGE)],
                                  "page_id long, html string")
    got = {r.page_id: r for r in B.main_text(pages).collect()}
    body = got[1].main_text
    assert body == " ".join([ARTICLE[0], ARTICLE[1], "Short aside.", ARTICLE[2]])
    assert "Section" not in body and "reader" not in body and "hidden" not in body and "News" not in body
    assert got[2].main_text == "" and got[2].n_blocks == 0 and got[3].main_text == ""
    assert got[4].main_text == ("word " * 30).strip() and got[4].n_kept == 1
