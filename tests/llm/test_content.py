"""Pages whose content lies in elements that are boilerplate elsewhere."""

from quillmart.llm import wrappers

TEXT = " ".join(f"word{i} of the story" for i in range(40))
PAGES = {
    "one form": (f"<body><form action=x><div><nav>menu</nav><article><h1>Title</h1><p>{TEXT}</p></article><input></div></form><footer>foot</footer></body>", f"Title\n\n{TEXT}"),
    "form without article": (f"<body><form><h1>Title</h1><p>{TEXT}</p></form></body>", f"Title\n\n{TEXT}"),
    "search form": (f"<body><form><p>find</p></form><article><p>{TEXT}</p><form>mail me</form></article></body>", TEXT),
    "unclosed nav": (f"<body><nav><a>menu</a><article><p>{TEXT}</p></article></body>", TEXT),
    "unclosed header": (f"<body><header><a>site</a><main><p>{TEXT}</p></main></body>", TEXT),
    "header of an article": (f"<body><header>site</header><article><header><h1>Title</h1></header><p>{TEXT}</p><footer>by</footer></article></body>", f"Title\n\n{TEXT}"),
    "header of main": (f"<body><header>site</header><main><header><h1>Title</h1></header><p>{TEXT}</p></main></body>", f"Title\n\n{TEXT}"),
    "aside with other articles": (f"<body><article><p>{TEXT}</p></article><aside><article><p>other</p></article></aside></body>", TEXT),
    "all in an aside": (f"<body><nav>menu</nav><aside><h1>Title</h1><p>{TEXT}</p></aside></body>", f"Title\n\n{TEXT}"),
}


def test_content_in_boilerplate_elements(spark):
    """Alone, and in a host of forty pages of the same build."""
    own = lambda text, i: text.replace("word", f"w{i}x").replace("Title", f"Title {i}")
    rows, want = [], {}
    for k, (html, text) in enumerate(PAGES.values()):
        for i in range(41):
            rows.append((100 * k + i, f"http://host{k}{'' if i else 'alone'}/{i}", own(html, i)))
            want[100 * k + i] = own(text, i)
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).select("row.page_id", "text").collect()}
    wrong = {list(PAGES)[i // 100]: (got[i], want[i]) for i in want if got[i] != want[i]}
    assert not wrong
