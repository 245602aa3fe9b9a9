"""The quick way through plain HTML against the standard library's parser."""

import random
from html.parser import HTMLParser

from deltascope.operators import markup, segment


class Log(markup.Reader):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append(("start", tag, attrs))

    def handle_endtag(self, tag):
        self.seen.append(("end", tag))

    def handle_data(self, data):
        self.seen.append(("data", data))


def test_same_calls_as_the_parser():
    parts = ["<p>", "</p>", "<P Class=a>", '<td colspan="2" x=\'&lt;y\'>', "<td nowrap>", "<br/>", "<br />", "<img src=a.png alt=''>", "a &amp b &#36;", "&nbsp;", "x", "\n ", "<style>td{} &amp;</style>", "<script>a < b</script>", "<title>t &lt;</title>",
             "<title>", "<textarea>x</textarea>", "<style>", "</style>", "<style/>", "<!-- c -->", "<!doctype html>", "a < b", "<", ">", "</p x>", "<a href=/x/>", "<a href=x&amp;y>", '<a title="a>b">', "<ix:header>", "</ix:header>", "<a b = c>", "<noscript>n</noscript>", "&", "<b", "<a_b>", "<?x?>", "<a  b c=\"\">", "</3>", "<xmp>"]
    rng, plain = random.Random(8), 0
    for k in range(6000):
        page = "".join(rng.choice(parts[:13] if k % 2 else parts) for _ in range(rng.randrange(0, 9)))
        own, want = Log(), Log()
        own.read(page)
        HTMLParser.feed(want, page)
        HTMLParser.close(want)
        assert own.seen == want.seen, page
        plain += markup.plain_pieces(page) is not None
    assert plain > 2500


def test_page_texts_are_made_in_small_lots(spark):
    pages = spark.createDataFrame([(i, None if i % 7 == 0 else f"<p>page {i}</p>") for i in range(450)], "page_id long, html string").coalesce(1)
    out = segment.page_texts(pages, "page_id", segment.html_to_text, lot=50)
    assert {r.page_id: r.text for r in out.collect()} == {i: "" if i % 7 == 0 else f"page {i}" for i in range(450)}
