"""Suffix-array dedup against all windows, with texts that repeat within themselves."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest

from quillmart.llm import suffixes


def plain_repeats(docs):
    """Per document the sets of repeated words and of those whose passage has an earlier place."""
    places = {}
    for doc, text in docs:
        w = (text or "").split(" ")
        for i in range(len(w) - suffixes.PASSAGE + 1):
            places.setdefault(tuple(w[i : i + suffixes.PASSAGE]), []).append((doc, i))
    all_, later = {}, {}
    for held in places.values():
        for doc, i in held if len(held) > 1 else ():
            words = set(range(i, i + suffixes.PASSAGE))
            all_.setdefault(doc, set()).update(words)
            if (doc, i) != min(held):
                later.setdefault(doc, set()).update(words)
    return {d: (w, later.get(d, set())) for d, w in all_.items()}


@pytest.mark.parametrize(("places", "frequent"), [(10_000, 50_000), (3, 5)])
def test_repeats_within_and_between_texts(spark, monkeypatch, places, frequent):
    """One word over and over, short periods, passages twice in one text and in others; places: how many one task takes."""
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    r = random.Random(4)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, other = fresh(70), fresh(55)
    texts = [["a"] * 300, ["a", "b"] * 120, ["a"] * 60 + fresh(20) + ["a"] * 80, passage + fresh(30) + passage[:60], fresh(5) + passage, other, fresh(3) + other + fresh(9) + other, fresh(200), ["a"] * 49, ["c", "a", "b"] * 40]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None), (51, "")]
    frame = spark.createDataFrame([*docs, docs[3]], "doc_id long, text string").repartition(3)
    words = lambda spans: {i for s in spans for i in range(s["start"], s["end"])}
    runs = suffixes.repeats(frame, places)
    got = {}
    for x in runs.collect():
        for kind in (0, *([1] if x.later else [])):
            got.setdefault(x.doc_id, (set(), set()))[kind].update(range(x.start, x.end))
    assert got == plain_repeats(docs)
    found = {x.doc_id: (words(x.spans), words(x.later_spans)) for x in suffixes.repeated_passages(frame).collect()}
    assert found == plain_repeats(docs)


def test_a_million_equal_words():
    """Takes one suffix and two runs, and less than a GB."""
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["word " * 1_000_000]), pa.array([3])], ["doc_id", "text", "row"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = pa.Table.from_batches(suffixes._anchors(iter([batch]))).to_pylist()
    assert [(x["at"], x["start"], x["end"], x["later"]) for x in out] == [(0, None, None, None), (None, 1, 1_000_000, True), (None, 0, 50, False)]
    hits = [{"at": x["at"], "prefix": x["prefix"], "salts": 1} for x in out if x["at"] is not None]
    wide = pa.RecordBatch.from_arrays([*batch.columns, pa.array([hits])], [*batch.schema.names, "hits"])
    found = pa.Table.from_batches(suffixes._extended(iter([wide])))
    assert found.num_rows == 1 and found.column("windows").to_pylist() == [1]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_own_copies():
    words = np.array([1, 2] * 60 + [3], np.uint64)
    again, firsts = suffixes._own_copies(words)
    assert np.flatnonzero(again).tolist() == list(range(2, 71)) and firsts.tolist() == [0, 1]
