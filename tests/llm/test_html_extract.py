from gridlake.llm import html_extract as he


def page(body, tail="</body></html>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}{tail}"


NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><header>Site</header>'
FOOT = '<div class="cookie-notice">We use cookies</div><form>Mail <input></form><footer>&copy; all</footer>'


def test_blocks_entities_and_boilerplate():
    html = page(
        NAV + '<article class="post-7"><h1>Big &amp; small</h1><p><b>One\n two<br>three<p>A &lt; B&nbsp;&#233;'
        '<ul><li>x<li>y</ul><div class="ad">Buy</div><aside>side</aside><pre>a\n  b</pre></article>'
        '<div id="comments"><p>I like it, really I do, a lot of text here</p></div>' + FOOT
    )
    text, path = he.Page(html).text(None)
    assert path == "/html/body/article.post-#"
    assert text == "Big & small\nOne two three\nA < B é\nx\ny\na b"


def test_odd_pages():
    assert he.Page("").text(None) == ("", None)
    assert he.Page("just text &amp; <i>more</i>").text(None)[0] == "just text & more"
    assert he.Page("<p>cut <a href='x").text(None)[0] == "cut"
    assert he.Page("<div>a<!-- c --><div>b<p>c</div>d").text(None)[0] == "a\nb\nc\nd"
    assert he.Page("<body><script>x").text(None)[0] == ""
    assert he.Page('<a href="x>y">q</a> 1 < 2').text(None)[0] == "q 1 < 2"
    deep = "<div>" * 3000 + "deep"
    assert he.Page(deep).text(None)[0] == "deep"


def test_hosts_vote(spark):
    body = "<p>Some words of the story, told at length in a paragraph.</p>" * 3
    rows = [(k, f"https://A.example.org:80/{k}", page(NAV + f'<div class="c{k}"><section class="story">{body}</section></div>' + FOOT)) for k in range(5)]
    # Here another container holds more text than the story, but the host's pages have voted.
    odd = page(NAV + f'<div class="c9"><section class="story"><p>Short story.</p></section></div><div class="more">{body}</div>' + FOOT)
    rows += [(5, "http://a.example.org/x", odd), (6, None, odd), (7, "nonsense", None), (8, "http://b.example.org", ""), (8, "http://b.example.org", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", he.F.lit(1)).withColumn("path", he.F.lit(1))
    found = {r.page_id: r for r in he.main_text(pages.repartition(3)).collect()}
    assert found[0].path == "/html/body/div.c#" and found[0].text.count("\n") == 2
    assert found[5].text == "Short story."
    assert found[6].text.startswith("Some words")
    assert found[7].text == "" and found[8].text == ""
    assert he.main_text(pages).count() == len(rows)
    assert he.main_text(pages.limit(0)).count() == 0


def test_synthetic_pages_keep_every_article_paragraph(spark):
    import html as escapes
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in he.main_text(pages).collect()}
    for r in pages.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(escapes.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert texts[r.page_id] == "\n".join(b for b in blocks if b)
