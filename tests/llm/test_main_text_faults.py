"""Pages inside one form, headlines in an article's header, and tags that are never closed."""

import tracemalloc

from foliant.llm import htmlmain

BODY = "<nav>menu</nav><article><header><h1>Headline</h1></header><p>The text.</p><form><input>mail me</form></article><footer>end</footer>"


def test_page_in_a_form():
    want = "Headline The text."
    assert htmlmain.extract(f"<body>{BODY}</body>") == want
    assert htmlmain.extract(f"<body><form action='x'>{BODY.replace('<form><input>mail me</form>', '')}</form></body>") == want
    assert htmlmain.extract("<form><div>All of it, and much more of it than any field.</div></form>") == "All of it, and much more of it than any field."
    assert htmlmain.extract("<div>Words that are not in it at all, and there are some of them.</div><form>search</form>") == "Words that are not in it at all, and there are some of them."
    assert htmlmain.extract("<header>Site</header><p>Text</p>") == "Text"


def test_unclosed_tags():
    page = "<article>" + "<div>" * 8000 + "deep text"
    tracemalloc.start()
    assert htmlmain.extract(page) == "deep text"
    assert tracemalloc.get_traced_memory()[1] < 30 << 20
    tracemalloc.stop()
    assert htmlmain.tokens(page)[0]


def test_a_host_of_such_pages(spark):
    pages = [(k, f"http://h.example/{k}", f"<body><form>{'<div>' * 3000 if k % 2 else ''}<div class='c'><p>Own words {k} of this page.</p></div></form></body>") for k in range(6)]
    found = htmlmain.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {k: f"Own words {k} of this page." for k in range(6)}
