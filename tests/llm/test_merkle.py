"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from quillmart.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def sides(levels, i):
    for level in levels[:-1]:
        low = i // 16 * 16
        yield "".join(level[low:i]), "".join(level[i + 1 : low + 16])
        i //= 16


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    held = []
    for k in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        held.append((own, tree([leaf(r) for r in own])))
    top = tree([levels[-1][0] for _, levels in held])
    for j, (own, levels) in enumerate(held):
        for i, r in enumerate(own):
            way, at = [*sides(levels, i), *sides(top, j)], leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                at = leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])))
            for a, b in way:
                at = sha(a + at + b)
            yield (r[0], leaf(r), levels[-1][0], top[-1][0], sha("".join(a + b for a, b in way)), at, at == top[-1][0])


@pytest.mark.parametrize(("n", "sources", "few"), [(0, 1, 1024), (1, 1, 1024), (2, 2, 1024), (17, 1, 1024), (300, 20, 1024), (4500, 3, 16), (600, 400, 16)])
def test_manifest_is_the_plain_one(spark, monkeypatch, n, sources, few):
    """Nulls anywhere, ties, repeated rows, one and many sources, names that clash; few: how many nodes are broadcast."""
    monkeypatch.setattr(merkle, "FEW", few)
    r = random.Random(n)
    rows = [(r.choice([None, i // 3]) if r.random() < 0.1 else i, None if sources == 3 and i % 2 else f"é{r.randrange(sources)}", r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "AbÉ" * r.randrange(9)])) for i in range(n)]
    rows += rows[: n // 10]
    docs = spark.createDataFrame([(*x, "x", "y", "z") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, kids string, key string").repartition(3)
    assert sorted((tuple(x) for x in merkle.tampered_manifest(docs).collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_long_text(spark):
    rows = [(1, "a", None, None, "É x" * 700_000), (2, "a", None, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(x) for x in merkle.tampered_manifest(docs).collect()), key=str) == sorted(plain_manifest(rows), key=str)
