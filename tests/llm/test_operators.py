"""The training-data operators against their oracle SQL, brute force, exact round trips and edge cases."""

import base64
import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quillmart.llm import bpe, compact, decontaminate, jaccard, licenses, quality, suffixes, urls, warc, wrappers
from quillmart.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_words string, row string"


def plain(value):
    return f"{value:.8g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = con.sql(ORACLE_SQL[name])
    names = result.columns
    assert sorted(names) == columns
    assert found == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and repeated rows, with columns whose names clash with the operators' own."""
    long = prose(30_000, 1)
    rows = [(1, None, None, None, "x", "y"), (2, "", "en", "a", None, None), (3, " \n\t ", "en", None, "x", "y"), (None, "the mit license", "en", "a", "x", "y"), (5, long, None, "a", "x", "y"), (6, long, "en", "a", "x", "y"), (6, long, "en", "a", "x", "y")]
    return spark.createDataFrame(rows, KINDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KINDS)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, "the MIT license"), (2, "the MIT license"), (None, "mit license")], "item_id long, text string")
    found = decontaminate.report(decontaminate.decontaminate(odd, bench)).collect()
    assert len(found) == 7 and [r for r in found if r.contaminated][0][:4] == (None, 3, 3, 1)
    assert decontaminate.decontaminate(none, bench).count() == 0 and decontaminate.decontaminate(odd, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert quality.quality_rules(odd).count() == 7 and quality.quality_rules(none).count() == 0
    assert quality.quality_rules(odd).where("kept").count() == 3
    scans = licenses.license_scan(odd).collect()
    assert len(scans) == 7 and [r.labels for r in scans if r.n_base] == ["mit"] and licenses.license_scan(none).count() == 0
    near = {(r.doc_id, r.n_shingles > 0): r.component_id for r in jaccard.near_duplicates(odd).collect()}
    assert near == {(1, False): 1, (2, False): 2, (3, False): 3, (None, True): None, (5, True): 5, (6, True): 5} and jaccard.near_duplicates(none).count() == 0
    rep = {(r.doc_id, r.n_repeated, r.n_later) for r in suffixes.report(suffixes.repeated_passages(odd)).collect()}
    assert rep == {(5, 30_000, 0), (6, 30_000, 30_000)} and suffixes.repeated_passages(none).count() == 0
    assert compact.near_passages(odd).select("doc_id", "partner_doc_id").distinct().collect() == [(6, 5)] and compact.near_passages(none).count() == 0
    coded = bpe.round_trip(odd).select("row.doc_id", "n_tokens").collect()
    assert len(coded) == 7 and bpe.round_trip(none).count() == 0


def test_pages(spark):
    inner = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nxWARC/1.0\r\n"
    rows = [(1, "http://a/b\r\nc", inner, "u"), (2, None, inner, "u"), (3, "x", None, "u"), (None, "HTTP://A.com/en/1?q", "é<p>b<nav>n</nav><p>c &amp; d</p>", "u"), (5, "", "", "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(2)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = {r[0]: (len((r[2] or "").encode()), digest(r[2]), "response", None) for r in rows}
    want[2], want[5] = (*want[2][:2], "revisit", 1), (*want[5][:2], "revisit", 3)
    assert got == want
    texts = {r.page_id: r.text for r in wrappers.extract(pages).select("row.page_id", "text").collect()}
    assert texts[None] == "é\n\nb\n\nc & d" and texts[3] == texts[5] == ""
    judged = {r.page_id: (r.host, r.path, r.verdict) for r in urls.url_filter(pages).select("row.page_id", "host", "path", "verdict").collect()}
    assert judged[None] == ("a.com", "/en/1", "block") and judged[2] == ("", "", "allow")
    empty = pages.limit(0)
    assert wrappers.extract(empty).count() == urls.url_filter(empty).count() == 0


def test_split_archives(spark):
    """Records are found again when splits end inside records and payloads hold the magic."""
    rows = [(i, "u", f"{prose(40, i)} WARC/1.0\r\nContent-Length: 9\r\n\r\n{i}") for i in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.page_id, r.payload_bytes) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, len(t.encode())) for i, _, t in rows]


def test_bpe_is_the_library():
    path, pattern = bpe.vocabulary()
    ranks = bpe.read_ranks(path)
    codec, library = bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    for i in range(300):
        text = "".join(r.choice(["a", "Zü", " ", "  ", "\n", "'s", "12", "!?", "　", "日本", " ", "é"]) for _ in range(r.randint(0, 200)))
        for leaf in (1, 3, 16):
            ids = codec.encode(text, leaf)
            assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_jaccard_keys_meet():
    """Any two sets with 75 of 100 overlap share a key, whatever their sizes and the common shingles."""
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 64, 127, 128, 300, 1000]:
        for _ in range(6):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(r.integers(0, len(a) // 7 + 1))
            add = r.integers(0, 2**63, int(r.integers(0, len(a) // 7 + 1))).astype(np.uint64)
            b = np.unique(np.concatenate([r.permutation(a)[drop:], add]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                hot = np.sort(r.permutation(a)[: len(a) // 3])
                assert len(np.intersect1d(jaccard.keys(a, hot), jaccard.keys(b, hot)))


def test_compact_windows_cover_every_stretch():
    values = np.random.default_rng(7).permutation(60)
    windows = compact.compact_windows(values, 10)
    for low in range(60):
        for high in range(low + 9, 60):
            at = low + int(values[low : high + 1].argmin())
            assert sum(a <= low <= c and c <= high <= b and c == at for a, c, b in windows) == 1


def test_compact_windows_with_equal_values():
    r = np.random.default_rng(8)
    for top in (2, 5, 30):
        values = r.integers(1, top, 90).astype(np.uint64)
        least = {low + int(values[low:high].argmin()) for low in range(90) for high in range(low + 10, 91)}
        assert set(compact.tree_nodes(values, np.full(90, 90), 10).tolist()) == least
        parts = compact.tree_nodes(values, np.repeat([40, 90], [40, 50]), 10).tolist()
        one, two = (compact.tree_nodes(v, np.full(len(v), len(v)), 10).tolist() for v in (values[:40], values[40:]))
        assert parts == one + [40 + x for x in two]


def test_near_passages(spark):
    shared = prose(80, 11)
    edited = shared.split()
    edited[40] = "changed"
    rows = [(1, f"{prose(200, 12)} {shared} {prose(90, 13)}"), (2, f"{prose(50, 14)} {shared}"), (3, f"{prose(60, 15)} {' '.join(edited)} {prose(60, 16)}"), (4, prose(300, 17))]
    found = compact.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} | {r.partner_doc_id for r in found} == {1, 2, 3}


def test_dealt_out_suffixes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spans = lambda most: sorted(suffixes.repeats(docs, most).groupBy("doc_id", "later").count().select("doc_id", "later").collect())
    assert spans(2) == spans(50_000)


def test_pipeline(spark):
    """Each stage against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, SF).cache()
        after = {r.doc_id: r for r in now.collect()}
        assert now.columns == columns and set(after) <= set(before)
        if name == "quality rules":
            kept = {r.doc_id for r in QUERIES["op3_quality_rules"](spark, SF).collect() if r.kept}
            assert set(after) == kept
        elif name == "n-gram jaccard join":
            assert set(after) == _heads({d: r.text for d, r in before.items()})
        elif name == "suffix-array dedup":
            seen, cut = set(), set()
            for d in sorted(before):
                w = before[d].text.split()
                for i in range(len(w) - 49):
                    g = tuple(w[i : i + 50])
                    cut |= {(d, j) for j in range(i, i + 50)} if g in seen else set()
                    seen.add(g)
            left = {d: [x for j, x in enumerate(r.text.split()) if (d, j) not in cut] for d, r in before.items()}
            assert {d: r.text.split() for d, r in after.items()} == {d: w for d, w in left.items() if w}
        else:
            assert decontaminate.decontaminate(now, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == len(before)
            assert all(len(after[d].text) <= len(before[d].text) for d in after)
    tokens = corpus_pipeline.tokenise(spark, now, SF).collect()
    assert {r.decoded_sha256 for r in tokens} == {hashlib.sha256(r.text.encode()).hexdigest() for r in after.values()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(after)


def _heads(texts):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := t.lower().split())}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for a, b in {(x, y) for v in holders.values() for x in v for y in v if x < y}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d for d in texts if find(d) == d}


def test_compact_pairs_inside_a_large_key(spark):
    """Forty texts share one line; text i and text i + 20 share that line with what follows it, and nobody else does."""
    line = prose(25, 77)
    own = [prose(45, 100 + i) for i in range(20)]
    rows = [(i, f"{prose(60, 200 + i)} {line} {own[i % 20]} {prose(60, 300 + i)}") for i in range(40)]
    found = compact.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.partner_doc_id))) for r in found} == {(i, i + 20) for i in range(20)}


def test_compact_pairs_around_a_common_notice(spark):
    """Two hundred texts, all rows twice, share 49 words that are no passage; each ten times two of them also share the next five words or more."""
    notice = prose(49, 900)
    more = {i: prose(5 + i, 1000 + i) for i in range(10)}
    rows = [(i, f"{prose(30, 2000 + i)} {notice} {more.get(i % 100, '')} {prose(30, 3000 + i)}") for i in range(200)]
    found = compact.near_passages(spark.createDataFrame(rows + rows, "doc_id long, text string")).where("doc_id != partner_doc_id").collect()
    assert sorted(tuple(sorted((r.doc_id, r.partner_doc_id))) for r in found if r.similarity == 1) == [(i, i + 100) for i in range(10)]


def test_compact_links_every_holder(spark):
    """Thirty texts hold one passage of sixty words at different places and nothing else of each other."""
    passage = prose(60, 910)
    rows = [(i, f"{prose(20 + i, 4000 + i)} {passage} {prose(40, 5000 + i)}") for i in range(30)]
    found = compact.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = defaultdict(set)
    for r in found:
        linked[r.doc_id].add(r.partner_doc_id)
        linked[r.partner_doc_id].add(r.doc_id)
    assert max(map(len, linked.values())) == 29 and len(linked) == 30


def _similar(one, two, a, b, c, d):
    p, q = set(one[a:b].tolist()), set(two[c:d].tolist())
    return len(p & q) / max(1, len(p | q))


def test_passages_when_growth_runs_too_far():
    """One change inside a good stretch, then changes every 22 words: the whole span is not similar enough, a part of it is. Brute force: all spans on the diagonal."""
    words = prose(500, 920).split()
    edited = list(words)
    for at in [*range(0, 50), 100, *range(150, 450, 22)]:
        edited[at] = f"changed{at}"
    one, two = compact.tokens([" ".join(words).encode(), " ".join(edited).encode()])
    longest = max(b - a for a in range(0, 120) for b in range(a + compact.LEAST, len(one), 3) if _similar(one, two, a, b, a, b) >= compact.SIMILAR)
    for place in (60, 95, 105, 130):
        found = compact.passages(one, two, [(place, place)])
        assert found and all(b - a >= 90 and s >= compact.SIMILAR and s == _similar(one, two, a, b, c, d) for a, b, c, d, s in found)
        assert found[0][1] - found[0][0] >= longest - compact.LEAST


def test_passages_against_brute_force():
    """Random edits: wherever a span around the meeting qualifies by itself between two edits, some passage is found there."""
    r = random.Random(9)
    for seed in range(60):
        words = prose(260, 6000 + seed).split()
        edited = [f"new{k}" if r.random() < r.choice((0.01, 0.04, 0.08)) else w for k, w in enumerate(words)]
        one, two = compact.tokens([" ".join(words).encode(), " ".join(edited).encode()])
        same = np.flatnonzero(one == two)
        if len(same):
            place = int(same[len(same) // 2])
            found = compact.passages(one, two, [(place, place)])
            exact = [(a, b) for a in range(0, place + 1) for b in range(place + 1, len(one) + 1) if b - a >= compact.LEAST and one[a] == two[a] and one[b - 1] == two[b - 1]]
            runs = np.concatenate([[0], np.cumsum(one == two)])
            fits = [(a, b) for a, b in exact if (n := runs[b] - runs[a]) >= compact.SIMILAR * (2 * (b - a) - n)]
            low, high = (compact._grown(x, y)[-1][0] for x, y in ((one[:place][::-1], two[:place][::-1]), (one[place:], two[place:])))
            inside = [(a, b) for a, b in fits if a >= place - low and b <= place + high]
            assert found or not inside


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Repeated rows, equal ids with different texts, groups of null ids, and empty texts."""
    a, b, c, d = (prose(60, 7000 + i) for i in range(4))
    near = a.rsplit(" ", 1)[0]
    rows = [(1, a, "x"), (1, a, "y"), (1, near, "x"), (2, a, "x"), (None, b, "x"), (None, b, "x"), (None, f"{b} more", "x"), (3, c, "x"), (3, c, "x"), (None, c, "x"), (4, d, "x"), (5, "", "x"), (5, "", "x"), (None, None, "x"), (6, " ", "x")]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), SF).collect()
    full = [(r.doc_id, r.text) for r in kept if r.text and r.text.strip()]
    assert len(full) == 4 and {d for d, _ in full} == {1, None, 3, 4}
    assert [t for d, t in full if d == 1][0] in (a, near) and [t for d, t in full if d is None][0] in (b, f"{b} more")
    assert len(kept) - len(full) == 4


def test_layout_classes_keep_the_article():
    """Wrappers named after a layout hold the article; marked elements beside it stay out."""
    for name in ("content no-sidebar", "page has-sidebar", "site-content with-header", "wrapper header-fixed", "post comments-open", "sidebar", "header"):
        page = f'<body><div class="{name}"><article><h1>T</h1><p>a <span class="ad">x</span> b</p></article></div><div class="comments"><p>c</p></div>'
        assert wrappers.main_text(page, None) == "T\n\na b"
        assert wrappers.main_text(page.replace("article", "div"), None).startswith("T\n\na b")
    related = '<body><article><p>a</p></article><div class="related"><article><p>r</p></article></div><div class="cookie-banner"><p>k</p></div>'
    assert wrappers.main_text(related, None) == "a"


def test_copies_of_a_page_are_one_tree(spark, monkeypatch):
    """Two thirds of a host's pages, and all without html, are copies: equal trees enter once, no group is large, and rounds of merging reach one tree a host."""
    pages = [(f"http://h/{i}", f"<body><p>{prose(20, 1) if i % 3 else prose(20, i + 2)}</p><p>same</p>") for i in range(300)]
    pages += [(None, None)] * 300
    frame = spark.createDataFrame(pages, "url string, html string").select(wrappers.host_and_path(wrappers.F.col("url"))[0].alias("host"), "html")
    monkeypatch.setattr(wrappers, "GROUP_PAGES", 8)
    sizes = []
    applied = type(frame.groupBy("host")).applyInArrow

    def spy(grouped, function, schema):
        sizes.extend(r.n for r in applied(grouped, lambda key, rows: wrappers.pa.table({"n": [rows.num_rows]}), "n long").collect())
        return applied(grouped, function, schema)

    monkeypatch.setattr(type(frame.groupBy("host")), "applyInArrow", spy)
    found = {r.host: wrappers.Tree.loaded(r.wrapper) for r in wrappers.induce(frame).collect()}
    assert found["h"].pages == 101 and wrappers.container_of(found["h"]) is not None and max(sizes) < 4 * 8
    same = [t for t in found["h"].texts.values() if t[1] == t[2]]
    assert [t[0] for t in same] == [101]


def test_wrappers_of_many_groups(spark, monkeypatch):
    """The result does not depend on how a host's pages are dealt, also with one optional element before the content."""
    monkeypatch.setattr(wrappers, "GROUP_PAGES", 5)
    pages, want = [], {}
    for i in range(60):
        text, notice = prose(30, 400 + i), "<div class=x><p>only here</p></div>" if i % 2 else ""
        pages.append((f"http://w/{i}", f"<body>{notice}<div><p>Brand and motto</p></div><div><h2>{prose(3, 700 + i)}</h2><p>{text}</p><p>Read more below</p></div>"))
        want[pages[-1][0]] = f"{prose(3, 700 + i)}\n\n{text}"
    got = {r.url: r.text for r in wrappers.extract(spark.createDataFrame(pages, "url string, html string")).select("row.url", "text").collect()}
    assert got == want


def test_alignment_is_simple_tree_matching():
    """Against the textbook recursion, on random trees; deep and wide pages need neither recursion nor square memory."""
    def textbook(x, y):
        if x[0] != y[0]:
            return 0
        table = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, a in enumerate(x[1]):
            for j, b in enumerate(y[1]):
                table[i + 1][j + 1] = max(table[i + 1][j], table[i][j + 1], table[i][j] + textbook(a, b))
        return table[-1][-1] + 1

    def tree(x):
        out, open_ = wrappers.Tree(), [(x, -1)]
        while open_:
            node, parent = open_.pop()
            at = out.add(node[0], parent, 1)
            open_ += [(c, at) for c in reversed(node[1])]
        return out

    r = random.Random(1)
    grow = lambda depth: (r.choice("ab"), [grow(depth - 1) for _ in range(r.randint(0, 4))] if depth else [])
    for _ in range(150):
        x, y = ("", [grow(3)]), ("", [grow(3)])
        found = wrappers.align(tree(x), tree(y), wrappers.Shapes())
        assert len(found) == textbook(x, y) and len(set(found.values())) == len(found)
    for one, two in (("<div>" * 5000 + "x", "<div>" * 5001 + "y"), ("<b>" * 5000 + "x", "<p>" + "<b>" * 5001 + "y"), ("<p>x" * 5000, "<p>y" * 5001), ("".join(f"<p class=c{i % 7}>x" for i in range(5000)), "".join(f"<p class=c{i % 5}>y" for i in range(5000)))):
        whole = wrappers.skeleton(*wrappers.parse(one))[0]
        wrappers.merge(whole, wrappers.skeleton(*wrappers.parse(two))[0], wrappers.Shapes())
        assert whole.pages == 2 and wrappers.Tree.loaded(whole.dumped()).labels == whole.labels
        assert wrappers.main_text(one, wrappers.Wrapper(whole))


def test_induced_template_acts_on_every_page(spark):
    """Hosts of many pages, with and without article: constant nodes go, slots stay, also inside the article."""
    shell = "<body><div class=top><p>Brand</p></div>{}<div class=end><p>Imprint</p></div>"
    inner = "<h1>{0}</h1><p class=hint>Share this page</p><p>{1}</p><p class=hint2>All rights reserved</p>"
    pages, want = [], {}
    for i in range(150):
        title, text = prose(3, 8000 + i), prose(40, 9000 + i)
        for host, tag in (("a", "article"), ("d", "div")):
            pages.append((f"http://{host}/{i}", shell.format(f"<{tag}>{inner.format(title, text)}</{tag}>")))
            want[pages[-1][0]] = f"{title}\n\n{text}"
    pages += [("http://one/", shell.format(f"<article>{inner.format('t', 'x')}</article>"))]
    want["http://one/"] = "t\n\nShare this page\n\nx\n\nAll rights reserved"
    got = {r.url: r.text for r in wrappers.extract(spark.createDataFrame(pages, "url string, html string")).select("row.url", "text").collect()}
    assert got == want


def test_license_passages_with_changed_words(spark, monkeypatch):
    """A grant with two words inserted and three missing needs neighbouring diagonals; half a passage and shuffled words are no licence."""
    grant = next(p for p, k in licenses.TEMPLATES.items() if p.startswith("permission is hereby granted"))
    w = grant.split()
    changed = " ".join([*w[:15], "well", "and", *w[15:30], *w[33:]])
    rows = [(1, f"{prose(40, 1)} {changed} {prose(30, 2)}"), (2, " ".join(w[: len(w) // 2])), (3, " ".join(random.Random(1).sample(w, len(w)))), (4, grant.upper().replace(" ", ", ")), (None, grant), (5, None)]
    scan = lambda: {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert scan() == {1: "mit", 2: "", 3: "", 4: "mit", None: "mit", 5: ""}
    monkeypatch.setattr(licenses, "NEAR_DIAGONALS", 0)
    assert scan()[1] == ""


def test_warc_ids_and_hot_payloads(spark):
    """Negative and null ids, one payload shared by most rows, an empty table; all columns against a plain version."""
    rows = [(i - 40, f"u{i}", "same" if i % 3 else prose(5, i)) for i in range(120)] + [(None, "n", "same"), (None, "m", None), (500, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted((str(i), len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", str(None if first[h or ""] == i else first[h or ""])) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in warc.archive_pages(pages).collect()) == want
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_benchmark_in_blocks(spark):
    """Several blocks find what one block finds, spans that touch across blocks merge, and repeated benchmark rows change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.report(decontaminate.decontaminate(docs, bench)).collect()))
    assert sorted(map(tuple, decontaminate.report(decontaminate.decontaminate(docs, bench.union(bench), 1500)).collect())) == one
    assert any(r[-1] for r in one)


def test_several_cascades(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    verdicts = lambda most: sorted(map(tuple, urls.url_filter(pages, most_bits=most).select("row.page_id", "rule", "verdict").na.fill("").collect()))
    assert verdicts(40) == verdicts(1 << 20)


def test_extra_columns_of_any_name(spark):
    """Spaces, dots, the operators' own names and upper case; null and missing groups of the quality rules."""
    columns = ["doc_id", "text", "my col", "a.b", "row", "kept_row", "found", "spans", "Text2"]
    docs = spark.createDataFrame([(1, prose(80, 1), "a", "b", "c", "d", "e", "f", "g"), (2, None, None, None, None, None, None, None, None), (3, prose(80, 1), "a", "b", "c", "d", "e", "f", "g")], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in columns))
    bench = spark.createDataFrame([(1, prose(80, 1))], "item_id long, text string")
    assert quality.quality_rules(docs).select("row.*").columns == columns and quality.quality_rules(docs).where("kept").count() == 2
    assert decontaminate.removed(decontaminate.decontaminate(docs, bench)).where("text = ''").count() == 2
    assert bpe.encode(docs).select("row.*").columns == bpe.round_trip(docs).select("row.*").columns == columns
    assert suffixes.without_copies(docs).select("doc.*").columns == columns
    pages = docs.withColumnRenamed("text", "html").withColumn("url", wrappers.F.lit("http://h/p"))
    assert wrappers.extract(pages).select("row.*").columns == pages.columns and urls.url_filter(pages).select("row.*").columns == pages.columns


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, odd names and an empty table go through all stages."""
    good = {i: prose(120, 40 + i) for i in range(4)}
    rows = [(i, t, "x") for i, t in good.items()] + [(0, good[0], "x"), (9, good[0].rsplit(" ", 1)[0], "y"), (None, good[1], "z"), (7, None, "x"), (8, "", "x"), (10, " \n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `my col` string")
    for frame, ids in ((docs, [0, 1, 2, 3]), (docs.limit(0), [])):
        sf = str(tmp_path / str(len(ids)))
        frame.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, prose(12, 999)), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert sorted(r.doc_id for r in out) == ids
        assert {r.decoded_sha256 for r in out} == {hashlib.sha256(good[i].encode()).hexdigest() for i in ids}


def test_quality_groups(spark):
    """Small groups take their language's fences, missing columns form one group, and the fences follow the group's own texts."""
    noisy = lambda i: " ".join(f"{w}#" for w in prose(60, i).split())
    rows = [(i, noisy(i), "en", "hash") for i in range(40)] + [(100 + i, prose(60, 100 + i), "en", "plain") for i in range(40)] + [(500, noisy(500), "en", "plain"), (501, noisy(501), "en", "hash"), (502, noisy(502), "de", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).select("row.doc_id", "kept").collect()}
    assert not kept[500] and kept[501] and kept[502] and sum(kept.values()) == 82
    assert quality.quality_rules(docs.select("doc_id", "text")).count() == 83
