"""Quality rules: cut-offs learnt from mergeable quantile sketches per language and source, then a join that filters.

Rows in: `text` with optional `lang` and `source` columns. Every row comes out once, in `row`, with its counts and verdict.
Null and empty texts have no words and fail the base rule. Null (or missing) languages and sources form groups of their own. Repeated
rows are judged alike. Quantiles of groups of more than SKETCH_K rows come from a randomised sketch: a text within about 1 / SKETCH_K of
a fence's rank may be judged differently on another run. Other columns, whatever their names, stay inside `row`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, on_texts, stored, struct_array

#: Items that a sketch keeps per level; quantiles of groups up to this size are exact, larger ones within about 1 / size.
SKETCH_K = 1024
#: A (language, source) group with fewer measured rows takes the merged sketch of its language.
LEAST_ROWS = 30
MIN_WORDS = 50
#: Ratio -> (interquartile ranges above the upper quartile, plain slack on top of that).
FENCES = {"word_length": (3.0, 1.0), "symbol_ratio": (3.0, 0.1), "dup_line_ratio": (3.0, 0.4), "repeat_ratio": (3.0, 0.45)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOLS = b"#*$%&|<>"


def _repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    names = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(names.__getitem__, words), np.int64, n)
    grams = ids[:-2] * len(names) + ids[1:-1]
    if len(names) ** 3 < 1 << 62:
        grams = grams * len(names) + ids[2:]
    else:
        grams = np.unique(grams, return_inverse=True)[1] * len(names) + ids[2:]
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    for shift in range(3):
        hit[order[1:][same] + shift] = True
        hit[order[:-1][same] + shift] = True
    return int(hit.sum())


def _counts(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(joined) - len(joined.translate(None, _SYMBOLS))
    repeats = sum(n - 1 for n in Counter(lines).values()) if len(lines) > 1 else 0
    return len(words), chars, symbols, repeats, _repeated_words(words), len(lines)


def _measure(texts: pa.Array) -> pa.Array:
    found = np.array([_counts(t) for t in as_bytes(texts)], np.int64).reshape(-1, len(COUNTS))
    return struct_array({c: pa.array(v) for c, v in zip(COUNTS, found.T, strict=True)})


def measure(docs: DataFrame) -> DataFrame:
    """`row` (all columns of docs), its lang and source (null if docs have no such column) and its counts; one pass, no shuffle."""
    counts = on_texts("struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">", _measure)
    group = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(F.struct("*").alias("row"), *group, counts(F.col("text").cast("string")).alias("counts")).select("row", "lang", "source", "counts.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {"word_length": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "repeat_ratio": per("n_repeat_words", "n_words")}


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): the upper fence of each ratio.

    Each group's sketches are built map-side and merged; sketches of the groups merge once more into their language's. Rows
    with words enter, all of them. Groups under LEAST_ROWS rows take their language's fences.
    """
    ratios = _ratios()
    groups = measured.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(k) for k, c in ratios.items()))
    langs = groups.groupBy("lang").agg(*(F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(f"all_{k}") for k in ratios))
    both = groups.alias("g").join(langs.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")))
    out = [F.col("g.lang").alias("lang"), F.col("g.source").alias("source")]
    for k, (ranges, slack) in FENCES.items():
        sketch = F.when(F.col("n") >= LEAST_ROWS, F.col(k)).otherwise(F.col(f"all_{k}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        out.append((high + ranges * (high - low) + slack).alias(f"most_{k}"))
    return both.select(*out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """`row`, counts, base_failed and kept for every row of docs.

    The texts are measured twice, once for the sketches and once for the verdicts, so that no text is shuffled or stored.
    """
    fit = stored(thresholds(measure(docs).drop("row")), "quality-thresholds")
    judged = measure(docs).alias("m").join(fit.alias("t"), F.col("m.lang").eqNullSafe(F.col("t.lang")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    inside = F.lit(True)
    for k, ratio in _ratios().items():
        inside = inside & F.coalesce(ratio <= F.col(f"t.most_{k}"), F.lit(True))
    return judged.select("row", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))
