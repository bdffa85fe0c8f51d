"""Queries on odd rows against the words of their contracts, written here a second time."""

import random
import re

import duckdb

from quillmart.llm.queries import ORACLE_SQL, QUERIES

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def _as_table(spark, tmp_path, name, rows, kinds):
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    return con


def test_license_phrases_of_the_contract(spark, tmp_path):
    """The name of the licence alone is no base phrase; repeated, cut and overlapping phrases and odd separators."""
    r = random.Random(5)
    vocabulary = "under the mit license apache version 2 cc by nc is".split()
    rows = [(1, "the mit license"), (2, "Under THE mit\x00License"), (3, None), (4, ""), (5, "under the mit licenses; under the\u00a0mit license"), (6, "under under the mit license under_the_mit_license CC-BY-NC")]
    rows += [(100 + i, "".join(r.choice(vocabulary) + r.choice([" ", "  ", "-", "\n", "_", "."]) for _ in range(r.randrange(200)))) for i in range(80)]
    con = _as_table(spark, tmp_path, "documents", rows, "doc_id long, text string")
    want = {}
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = sorted((j, label) for p, label in PHRASES.items() for j in range(len(words)) if words[j : j + len(p.split())] == p.split())
        want[i] = (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at})))
    found = QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()
    assert {x.doc_id: (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in found} == want
    assert want[1][1] == 0 and want[2][1] == 1 and want[5][1] == 0 and want[6][1] == 3
    assert {x.doc_id: x.labels for x in found}[1] == "mit"  # a label of the method's own
    assert sorted(map(str, con.sql(ORACLE_SQL["op5_license_scan"]).fetchall())) == sorted(str(tuple(x)) for x in found)


def test_url_rules_of_the_contract(spark, tmp_path):
    """Every rule's own word where it fits, on its host and below it, whatever the method says of the host; hosts and paths that only look alike fit none."""
    rules = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    hosts = ["com", "example.com", "a.Example.COM", "myexample.com", "net", "example.net", "b.example.net", "x.net", "org", "a.org", "xorg", "com.de", ""]
    paths = ["/en/", "/en/7", "/en/78/x", "/en", "/de/", "/de/8", "/de/80?a", "/de/9#b", "/es/1", "/DE/8", "", "?/de/"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)] + [(1000, None), (1001, "x.net/de/1"), (1002, "//x.net/de/1")]
    rows += [(2000 + i, f"ftp://copies.net/de/{i}?s") for i in range(9)]
    con = _as_table(spark, tmp_path, "pages", rows, "page_id long, url string")
    want = {}
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        fit = [(h + p, v) for (h, p), v in rules.items() if ("." + host.lower()).endswith("." + h) and path.startswith(p)]
        want[i] = (host.lower(), path, *max(fit, key=lambda x: len(x[0]), default=(None, None)))
    found = QUERIES["op7_url_filter"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and all(x[1:4] == want[x.page_id][:3] and want[x.page_id][3] in (None, x.verdict) for x in found)
    assert {want[i][2:] for i in want} == {(h + p, v) for (h, p), v in rules.items()} | {(None, None)}
    assert sorted(map(str, con.sql(ORACLE_SQL["op7_url_filter"]).fetchall())) == sorted(str(tuple(x)) for x in found)
