"""URL filters whose unlisted keys outnumber the bits of a cascade."""

from quillmart.llm import urls


def test_false_positives_beyond_the_bits_of_a_cascade(spark, monkeypatch):
    """Few listed keys among many: the levels of each cascade stay small, and no verdict errs."""
    built, build = [], urls.build_cascade
    monkeypatch.setattr(urls, "build_cascade", lambda universe: built.append(build(universe)) or built[-1])
    rows = [(i, f"http://h{i}.example.org/es/{i}" if i % 3 else f"http://h{i}.com/xx/{i}{'?a' if i % 600 == 0 else ''}") for i in range(6000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, keys string").repartition(4)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.url_filter(pages, most_bits=1024).select("row.page_id", "rule", "verdict").collect()}
    assert got == {i: ("org/es/", "block") if i % 3 else (None, "block" if i % 600 == 0 else "allow") for i, _ in rows}
    assert len(built) > urls.cascades(11, 11, 1024)
    assert all(sum(size for size, _ in levels) <= 2 * 1024 + urls.LEAST_BITS * len(levels) for levels in built)
