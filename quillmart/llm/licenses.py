"""License scans by diagonal voting, in DataFrame expressions alone.

Every rolling three-word hash of every text is joined to the template positions with that hash (hashes that no template has are left
out before the join: a semi-join reduction by the fixed list). A hit votes for the diagonal
(text position minus template position); neighbouring diagonals of a template merge, so inserted or missing words do not split
a span; each hit is verified word by word and a merged span counts when it covers enough of the template. A base phrase counts
at each place where its whole diagonal stands.

Rows in: `doc_id`, `text`. Null and empty texts have no words. Every row comes out once, repeated rows too; other columns are
not carried. A null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

GRAM = 3
#: Diagonals of one template that differ by this many words or fewer are one span.
NEAR_DIAGONALS = 3
#: Share of a template's three-word windows that a span must cover.
LEAST_COVERED = 0.75
#: The query's phrases and their labels, matched as consecutive words.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Phrases of the operator when it is given none: names alone, whatever leads to them.
NAMES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Passages that name a licence, grant it, state its conditions or disclaim, as plain words.
TEMPLATES = {
    "the mit license": "mit",
    "this work is licensed under the gnu general public license": "gpl",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license version 2": "mpl-2",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "released into the public domain": "public-domain",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software": "public-domain",
    "attribution you must give appropriate credit provide a link to the license and indicate if changes were made": "cc-by",
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = "".join(chr(b) for b in range(128) if not chr(b).isalnum() and chr(b) != " ")


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _templates(base: dict[str, str]) -> list[tuple[int, str, str, bool]]:
    return [(i, p, k, b) for i, (p, k, b) in enumerate([*((p, k, True) for p, k in base.items()), *((p, k, False) for p, k in TEMPLATES.items())])]


def template_grams(spark, base: dict[str, str]) -> DataFrame:
    """One row per template position: its three words and their hash. The list is fixed, so its size is."""
    rows = []
    for i, phrase, label, base in _templates(base):
        w = phrase.split()
        rows += [(i, label, base, len(w) - GRAM + 1, at, w[at : at + GRAM]) for at in range(len(w) - GRAM + 1)]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, n_grams int, template_pos int, gram array<string>")
    return frame.withColumn("hash", F.xxhash64(*[F.col("gram")[j] for j in range(GRAM)]))


def license_scan(docs: DataFrame, base: dict[str, str] = NAMES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row; base: phrases of three words or more, and their labels."""
    spark = docs.sparkSession
    grams = template_grams(spark, base)
    wanted = [r.hash for r in grams.select("hash").distinct().collect()]
    rolling = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)]).alias("hash")))
    found = docs.select(F.col("doc_id"), words(F.col("text").cast("string")).alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.when(F.size("words") >= GRAM, F.filter(rolling(F.col("words")), lambda g: g["hash"].isin(wanted))).alias("hits")
    )
    hit_words = F.transform("hits", lambda g: F.struct(g["pos"].alias("pos"), g["hash"].alias("hash"), F.slice("words", g["pos"] + 1, GRAM).alias("gram")))
    rows = stored(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", hit_words.alias("hits")), "license-hits")

    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    votes = (
        hits.join(F.broadcast(grams.withColumnRenamed("gram", "template_gram")), "hash")
        .where("gram = template_gram")
        .groupBy("row", "template", "label", "base", "n_grams", (F.col("pos") - F.col("template_pos")).alias("diagonal"))
        .agg(F.collect_set("template_pos").alias("covered"))
    )
    places = votes.where(F.col("base") & (F.size("covered") == F.col("n_grams")))
    counted = places.groupBy("row").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set"))

    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > NEAR_DIAGONALS).cast("int"), F.lit(1))
    spans = votes.where("not base").withColumn("apart", apart).withColumn("span", F.sum("apart").over(along))
    covered = spans.groupBy("row", "template", "label", "n_grams", "span").agg((F.size(F.array_distinct(F.flatten(F.collect_list("covered")))) / F.col("n_grams")).alias("share"))
    method = covered.groupBy("row").agg(F.max("share").alias("share"), F.collect_set(F.when(F.col("share") >= LEAST_COVERED, F.col("label"))).alias("method_set"))

    none = F.array().cast("array<string>")
    listed = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    base_set, method_set = F.coalesce("base_set", none), F.coalesce("method_set", none)
    return rows.join(counted, "row", "left").join(method, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        listed(base_set).alias("base_labels"), listed(F.concat(base_set, method_set)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).cast("double").alias("score"),
    )
