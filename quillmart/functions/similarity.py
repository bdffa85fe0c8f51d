"""Token-set similarity of two texts, as an Arrow-batched function."""

from __future__ import annotations

from bisect import insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import normalized


def _alike(a: str, b: str) -> float:
    """2 x longest common subsequence over the summed lengths; bit-parallel, a word of bits for all of a."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & masks.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & (1 << len(a)) - 1
    return 2 * (len(a) - open_.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best likeness of the sorted common words, alone and with either rest; one word set inside the other is 1."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, [common, " ".join(sorted(s))])) for s in (x - y, y - x))
    if common and (x <= y or y <= x):
        return 1.0
    alone = max(_alike(common, left), _alike(common, right)) if common else 0.0
    return max(_alike(left, right), alone)


class Names:
    """Names that texts are compared with: their words, and how often each has each character."""

    def __init__(self, names: list[str]):
        self.names, self.words = names, [set(n.split()) for n in names]
        plain = [" ".join(w) for w in self.words]
        self.sizes = np.array([len(p) for p in plain], float)
        self.place = {c: i for i, c in enumerate(sorted(set("".join(plain))))}
        self.counts = np.zeros((len(names), len(self.place)), np.int32)
        self.holders: dict[str, list[int]] = defaultdict(list)
        for i, (p, w) in enumerate(zip(plain, self.words, strict=True)):
            for c in p:
                self.counts[i, self.place[c]] += 1
            for word in w:
                self.holders[word].append(i)

    def bounds(self, text: str) -> np.ndarray:
        """At least the token-set ratio with every name. No common subsequence is longer than the characters that both have; the common words with either side are counted exactly."""
        mine = set(text.split())
        size, own = len(" ".join(mine)), np.zeros(len(self.place), np.int32)
        for c in " ".join(mine):
            if c in self.place:
                own[self.place[c]] += 1
        out = 2 * np.minimum(self.counts, own).sum(axis=1) / np.maximum(self.sizes + size, 1)
        for i in {i for w in mine for i in self.holders.get(w, ())}:
            common = mine & self.words[i]
            n = len(" ".join(common))
            out[i] = 1.0 if common in (mine, self.words[i]) else max(out[i], 2 * n / (n + min(size, self.sizes[i])))
        return out

    def best(self, text: str, k: int, least: float) -> list[tuple[str, float]]:
        """The k names of highest score (to four places), the least name first of equal ones, from a least score on. Names are tried by falling bounds until none can be among them."""
        if not self.names or not text.split():
            return []
        bounds, found = np.round(self.bounds(text), 4), []
        for i in np.argsort(-bounds, kind="stable"):
            if bounds[i] < least or len(found) >= k and bounds[i] < -found[k - 1][0]:
                break
            if (score := round(token_set_ratio(text, self.names[i]), 4)) >= least:
                insort(found, (-score, self.names[i]))
        return [(n, -s) for s, n in found[:k]]


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    return pd.Series([known.setdefault(p, token_set_ratio(*p)) if p not in known else known[p] for p in zip(a, b, strict=True)])


def similarity(a: str | Column, b: str | Column) -> Column:
    """0 to 1; empty texts are like nothing. The driver's caller brings only candidate pairs here."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return _ratio(normalized(a), normalized(b))
