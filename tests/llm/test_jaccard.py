"""The Jaccard join in large keys against all pairs."""

import random

from quillmart.llm import jaccard

from .test_operators import _heads, prose


def _components(spark, texts):
    rows = list(enumerate(texts))
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    return found, dict(rows)


def _check(spark, texts):
    found, docs = _components(spark, texts)
    heads = _heads(docs)
    assert {d for d, c in found.items() if d == c} == heads
    return found


def test_large_groups_whose_links_are_not_transitive(spark, monkeypatch):
    """Chains, stars and unlinked crowds around one text, all in keys of many sets and in several blocks."""
    monkeypatch.setattr(jaccard, "SMALL_KEY", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "PARTNERS", 7)
    r = random.Random(4)
    base = prose(120, 1).split()
    texts = []
    for i in range(60):  # a star: far from each other, near the text in the middle
        words = list(base)
        for k in range(r.randint(1, 5)):
            words[r.randrange(120)] = f"edit{i}x{k}"
        texts.append(" ".join(words))
    chain = prose(150, 2).split()
    for i in range(30):  # a chain: each text has moved on by a few words
        texts.append(" ".join(chain[:100] + [f"moved{j}" for j in range(i * 6)])[:4000])
    crowd = prose(90, 3).split()
    for i in range(50):  # a crowd that shares two thirds of its words and links nowhere
        texts.append(" ".join(crowd[:60] + prose(30, 100 + i).split()))
    texts += [" ".join(base), " ".join(crowd)]
    found = _check(spark, texts)
    assert len(set(found.values())) > 40


def test_leaders_do_for_copies(spark):
    """Two hundred near copies with the usual limits."""
    r = random.Random(5)
    base = prose(200, 7).split()
    texts = [" ".join([*base[: (k := r.randrange(200))], f"new{i}", *base[k + 1 :]]) for i in range(200)] + [prose(50, 50 + i) for i in range(20)]
    found = _check(spark, texts)
    assert sum(c == 0 for c in found.values()) == 200
