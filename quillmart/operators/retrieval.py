"""Fuzzy linkage of names, search baselines, retrievability, resolution of parties, and routing of questions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart.functions.similarity import Names, similarity
from quillmart.functions.text import normalized, query_words, value_words
from quillmart.operators.linkage import link_products
from quillmart.plans.canonical import stored

#: Least scores of an accepted and of an ambiguous match, the lead over the second that acceptance needs, and the least score of a suggestion.
ACCEPT, AMBIGUOUS, LEAD, SUGGEST = 0.82, 0.65, 0.05, 0.35
#: Weights of a search score.
ATTRIBUTE_HIT, NAME_HIT, FUZZY, EXACT, BREADTH = 1.1, 1.4, 0.35, 1.0, 0.01
SEARCHED = ("product_type", "subtype", "accessory", "shape", "feature", "material", "color", "capacity_text", "mouth_size_text", "use_category", "material_family")


#: Texts and names that one row of the comparison holds, about.
BLOCK, CHUNK = 500, 5_000


def _in_rows(df: DataFrame, column: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Distinct texts of a column in rows (name, texts) of about `size`, and the number of rows."""
    texts = df.select(column).where(F.col(column) != "").distinct()
    n = max(1, -(-texts.count() // size))
    return texts.groupBy(F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(name)).agg(F.collect_list(column).alias(f"{name}_texts")), n


def best_names(asked: DataFrame, names: DataFrame, k: int, least: float) -> DataFrame:
    """asked, name, score, rank: of every normalised text (column asked) the k names (column name) most like it, from a least score on; equal scores by name.

    Texts are asked of all names, block by block: no pair that scores enough shares anything that could be joined on. Each block
    of texts meets each chunk of names in one row, which gives back k names a text at most; a bound on the score keeps most pairs from being compared.
    """
    blocks, _ = _in_rows(asked, "asked", BLOCK, "block")
    chunks, n = _in_rows(names, "name", CHUNK, "chunk")
    met = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(chunks, "chunk").select("block_texts", "chunk_texts").repartition("block_texts", "chunk_texts")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for texts, held in frame.itertuples(index=False):
                known = Names(sorted(held))
                yield pd.DataFrame([(t, name, score) for t in texts for name, score in known.best(t, k, least)], columns=["asked", "name", "score"])

    found = met.mapInPandas(compared, "asked string, name string, score double")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "name"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def link_fuzzy(lines: DataFrame, products: DataFrame, accept: float = ACCEPT, lead: float = LEAD) -> DataFrame:
    """source_id, source_name, product_id, confidence, method, status of every distinct id and name in lines.

    What link_products() does not match exactly is compared by name: the best name counts if it is alike enough and leads the second
    best; otherwise it is ambiguous from AMBIGUOUS on, and rejected below. Of products with one name the least id stands for it.
    """
    exact = link_products(lines, products)
    names = products.select("product_id", normalized(F.col("product_name")).alias("name")).where("name != ''").groupBy("name").agg(F.min("product_id").alias("m_id"))
    rest = exact.where("product_id is null").withColumn("asked", normalized(F.col("source_name")))
    pairs = best_names(rest, names, 2, 0.0001)
    second = F.coalesce(F.lead("score").over(Window.partitionBy("asked").orderBy("rank")), F.lit(0.0))
    best = pairs.withColumn("second", second).where("rank = 1").join(names, "name")
    status = F.when(F.col("score").isNull(), "rejected").when((F.col("score") >= accept) & (F.col("score") - F.col("second") >= lead), "accepted").when(F.col("score") >= AMBIGUOUS, "ambiguous").otherwise("rejected")
    found = rest.join(best, "asked", "left").withColumn("status", status)
    fuzzy = found.select("source_id", "source_name", F.when(F.col("status") != "rejected", F.col("m_id")).alias("product_id"), F.coalesce("score", F.lit(0.0)).alias("confidence"), F.when(F.col("score").isNotNull(), "fuzzy_name").otherwise("none").alias("method"), "status")
    return exact.where("product_id is not null").withColumn("status", F.lit("accepted")).unionByName(fuzzy)


def link_all(tables: dict[str, DataFrame], products: DataFrame) -> DataFrame:
    """link_fuzzy() of several tables of lines (source_id, source_name) under their names, in one pass."""
    lines = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("dataset"), "source_id", "source_name").distinct()
        lines = part if lines is None else lines.unionByName(part)
    a, b = lines.alias("a"), link_fuzzy(lines, products).alias("b")
    same = F.col("a.source_id").eqNullSafe(F.col("b.source_id")) & F.col("a.source_name").eqNullSafe(F.col("b.source_name"))
    return a.join(b, same).select("a.dataset", "b.*")


def suggestions(texts: DataFrame, names: DataFrame, k: int = 5, least: float = SUGGEST) -> DataFrame:
    """text, name, score, rank: the k most similar names of each text, from a least score on."""
    asked = texts.select("text").where("text is not null").distinct().withColumn("asked", normalized(F.col("text")))
    found = best_names(asked, names.select(normalized(F.col("name")).alias("name")), k, least)
    return asked.join(found, "asked").select("text", "name", "score", "rank")


def resolve_parties(texts: DataFrame, parties: DataFrame) -> DataFrame:
    """text, party of texts that name a customer or supplier (column party): its whole normalised name, else the least name that holds the text.

    Names give their parts of every length that is asked, so that a part is looked up by itself: no common start of texts joins all names.
    """
    asked = texts.select("text").where("text is not null").distinct().withColumn("plain", normalized(F.col("text"))).where("plain != ''")
    named = parties.select("party", normalized(F.col("party")).alias("name")).where("name != ''").distinct()
    whole = asked.join(named, F.col("plain") == F.col("name")).select("text", F.lit(1).alias("tier"), "party")
    lengths = F.broadcast(asked.agg(F.collect_set(F.length("plain")).alias("lengths")))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.col("name").substr(i, n))
    parts = F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length("name")), cut))
    least = named.crossJoin(lengths).select("party", F.explode(F.array_distinct(parts)).alias("run")).groupBy("run").agg(F.min("party").alias("party"))
    part = asked.join(least, F.col("plain") == F.col("run")).select("text", F.lit(2).alias("tier"), "party")
    return whole.unionByName(part).groupBy("text").agg(F.min(F.struct("tier", "party")).alias("best")).select("text", "best.party")


def word_search(query: str, products: DataFrame, k: int = 10) -> DataFrame:
    """product_id, product_name, n_common, is_part: products that share words with a query or hold it, whole parts first, then by common words."""
    q = normalized(F.lit(query))
    name = normalized(F.col("product_name"))
    found = products.select("product_id", "product_name", F.size(F.array_intersect(F.filter(F.split(q, " "), lambda t: t != ""), F.split(name, " "))).cast("long").alias("n_common"), (F.contains(name, q) & (q != "")).alias("is_part"))
    return found.where("n_common > 0 or is_part").orderBy(F.col("is_part").desc(), F.col("n_common").desc(), "product_id").limit(k)


def search_documents(attributes: DataFrame) -> DataFrame:
    """product_id, product_name, plain, name_words, attribute_words. attributes: as extraction.labelled() gives them."""
    words = F.array_distinct(F.flatten(F.array(*[value_words(F.col(c)) for c in SEARCHED])))
    return attributes.select("product_id", "product_name", normalized(F.col("product_name")).alias("plain"), query_words(F.col("product_name")).alias("name_words"), words.alias("attribute_words"))


def retrievability(documents: DataFrame) -> DataFrame:
    """product_id, retrievability, n_matched, n_words, rank, top1, top5, top10: how well each product's own name finds it.

    Names and attributes that are equal are one class: classes are scored against each other where they share a word, so the
    work grows with distinct descriptions, and a product's rank counts the members of better classes and those of its own with a lesser id.
    A class that is better than the own one must have almost all words of the name in its own: it is found by the rarest of them. No likeness
    is above 1, so only pairs that would be as good as the own class with 1 are compared by it.
    """
    key = ["plain", "name_words", "attribute_words"]
    # read four times below, each time with all rules of extraction if it were not stored
    sorted_words = stored(documents.select("product_id", "plain", *[F.array_sort(c).alias(c) for c in key[1:]]).withColumn("class", F.xxhash64(*key)), "retrieved")
    classes = stored(sorted_words.groupBy("class", *key).agg(F.count("*").alias("members")), "retrieved-classes")
    hits = lambda q, c: F.size(F.array_intersect(q, c))
    score = lambda q_plain, q, alike: F.round((hits(q, "attribute_words") * ATTRIBUTE_HIT + hits(q, "name_words") * NAME_HIT) / F.size(q) + alike * FUZZY + F.when(F.col(q_plain) == F.col("plain"), EXACT).otherwise(0.0) + F.log1p(F.size("attribute_words").cast("double")) * BREADTH, 9)
    own = score("plain", "name_words", F.lit(1.0))
    # what words and breadth can give at most leaves so many words of the own name that a better class must have in its name, too
    most = F.broadcast(classes.agg(F.coalesce(F.max(F.log1p(F.size("attribute_words").cast("double"))), F.lit(0.0)).alias("most")))
    need = F.greatest(F.lit(1), F.ceil(F.size("q_words") * (F.col("own") - FUZZY - F.col("most") * BREADTH - ATTRIBUTE_HIT) / NAME_HIT - 1e-6)).cast("int")
    asked = classes.where(F.size("name_words") > 0).crossJoin(most).select(F.col("class").alias("q"), F.col("plain").alias("q_plain"), F.col("name_words").alias("q_words"), own.alias("own"), "most").withColumn("tried", F.size("q_words") - need + 1).drop("most")
    named = classes.select("class", "plain", "members", "name_words", "attribute_words", F.explode("name_words").alias("word"))
    often = named.groupBy("word").agg(F.count("*").alias("n"))
    keyed = asked.select("q", "tried", F.explode("q_words").alias("word")).join(often, "word").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("n", "word"))).where("place <= tried").select("q", "word")
    met = keyed.join(named.select("word", "class"), "word").select("q", "class").union(asked.join(classes, F.col("q_plain") == F.col("plain")).select("q", "class")).distinct()
    pairs = met.join(asked, "q").join(classes, "class")
    scored = pairs.where(score("q_plain", "q_words", F.lit(1.0)) >= F.col("own")).withColumn("score", score("q_plain", "q_words", similarity("q_plain", "plain")))
    better = scored.where("score > own or (score = own and class < q)").groupBy("q").agg(F.sum("members").alias("before"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("product_id"))
    ranked = sorted_words.withColumn("place", place).join(better.withColumnRenamed("q", "class"), "class", "left")
    size, matched = F.size("name_words"), F.size(F.array_intersect("name_words", "attribute_words"))
    rank = F.when(size > 0, F.coalesce("before", F.lit(0)) + F.col("place"))
    found = lambda k: F.coalesce(rank <= k, F.lit(False)).alias(f"top{k}")
    return ranked.select("product_id", F.round(F.when(size > 0, matched / size).otherwise(0.0), 4).alias("retrievability"), matched.cast("long").alias("n_matched"), size.cast("long").alias("n_words"), rank.cast("long").alias("rank"), found(1), found(5), found(10))


def retrievability_summary(report: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return report.agg(F.count("*").alias("n_rows"), rate("retrievability").alias("mean_retrievability"), *[rate(f"top{k}").alias(f"top{k}_rate") for k in (1, 5, 10)])


#: Phrases that speak for an intent, and their weights.
INTENTS = {
    "conversacion": [("HOLA", 6), ("BUENAS", 6), ("BUENOS DIAS", 6), ("BUENAS TARDES", 6), ("BUENAS NOCHES", 6), ("AYUDA", 6), ("QUE PUEDES HACER", 7), ("COMO FUNCIONAS", 6), ("GRACIAS", 6)],
    "buscar_producto": [("BUSCA", 4), ("BUSCAR", 4), ("ENCUENTRA", 3), ("QUIERO COMPRAR", 3), ("ESTOY BUSCANDO", 4), ("QUE PRODUCTO", 3), ("PRODUCTO QUISO DECIR", 5), ("ALTERNATIVAS PARECIDAS", 3)],
    "perfil_cliente": [("CLIENTE", 1.5), ("COMPRA MAS", 5), ("COMPRA", 2), ("PIDE MAS", 5), ("PIDE", 2), ("QUE LE VENDO", 4), ("QUE ME PIDE", 4), ("PRODUCTOS FRECUENTES", 4), ("PERFIL", 3), ("CUANTO REPRESENTA", 4)],
    "cliente_abastecimiento": [("DE DONDE", 5), ("SUELO COMPRAR", 5), ("DONDE COMPRO", 5), ("QUE COMPRO PARA", 5), ("DE QUIEN COMPRO", 5), ("ABASTECE", 4), ("ABASTECIMIENTO", 4), ("PROVEEDORES NECESITO", 4), ("LO QUE PIDE", 3)],
    "proveedor_conveniente": [("PROVEEDOR CONVIENE", 6), ("QUE PROVEEDOR", 4), ("A QUIEN LE COMPRO", 5), ("A QUIEN COMPRO", 5), ("QUIEN ME VENDE", 5), ("ME VENDE MAS BARATO", 5), ("MAS BARATO", 4), ("BARATO", 2), ("MEJOR PROVEEDOR", 5), ("HISTORIAL PARA", 3)],
    "pedido_optimo": [("NECESITO", 3), ("ARMA UN PEDIDO", 6), ("ARMAR PEDIDO", 6), ("QUIERO PEDIR", 4), ("PEDIDO", 5), ("MULTI SKU", 5), ("SKU", 2), ("REPARTO", 4), ("OPTIMIZAR", 4), ("CUBRIR TODO", 4), ("MENOR COSTO", 4)],
    "presupuesto_mochila": [("PRESUPUESTO", 6), ("CUANTO PUEDO", 5), ("CUANTO ME ALCANZA", 6), ("ME ALCANZA", 5), ("TENGO S", 5), ("CON S", 5), ("SOLES", 4), ("PLATA", 3), ("DINERO", 3), ("MAXIMIZO", 4), ("SOBRANTE", 3)],
    "ofertas_descuentos": [("OFERTA", 5), ("OFERTAS", 5), ("DESCUENTO", 5), ("BONIFICACION", 5), ("AHORRO", 4), ("AHORROS", 4), ("COSTO REFERENCIA", 3)],
    "familias_sustitutos": [("FAMILIA", 5), ("FAMILIAS", 5), ("SUSTITUTO", 5), ("SUSTITUTOS", 5), ("REEMPLAZO", 4), ("REEMPLAZAR", 4), ("NO HAY", 3), ("SIMILAR", 4), ("PARECIDO", 4), ("PARECIDOS", 4), ("ALTERNATIVA", 3), ("NO TENGO STOCK", 4)],
    "venta_cruzada": [("JUNTO", 5), ("VENDEN JUNTOS", 6), ("SE VENDEN", 3), ("COMBO", 5), ("COMPLEMENTO", 4), ("COMPLEMENTOS", 4), ("OFREZCO", 4), ("OFRECER", 4), ("RECOMENDAR", 5), ("VENTA CRUZADA", 6), ("QUE MAS", 4)],
    "riesgo_dependencia": [("RIESGO", 5), ("DEPENDENCIA", 5), ("DEPENDO", 5), ("PIERDO", 6), ("NO ME ATIENDE", 5), ("FALLA", 4), ("PERDER", 5), ("CUELLO DE BOTELLA", 6), ("CRITICO", 4), ("PROVEEDOR CRITICO", 6)],
}
CHAT, UNKNOWN = "conversacion", "desconocido"
#: Intent, points, a word that must be there, and words of which one must be.
BONUSES = (
    ("cliente_abastecimiento", 5.0, "CLIENTE", ("DE DONDE", "PROVEEDOR", "ABASTEC")),
    ("riesgo_dependencia", 6.0, "PROVEEDOR", ("PIERDO", "PERDER", "RIESGO", "DEPEND")),
    ("proveedor_conveniente", 5.0, "PROVEEDOR", ("CONVIENE", "BARATO", "COMPRO", "MEJOR")),
    ("buscar_producto", -1.0, "", ("ESE PRODUCTO", "ESTE PRODUCTO", "LO MISMO", "EL ANTERIOR")),
)
_AMOUNT = r"(?i)S/\s*([0-9]+(?:[.,][0-9]+)?)|([0-9]+(?:[.,][0-9]+)?)\s*(?:SOLES|PEN)\b"
_ITEM = r"(?i)\b([0-9]+)\s+(?:UNIDADES\s+(?:DE\s+)?)?([A-Z][A-Z]+)"


def slots(text: Column) -> tuple[Column, Column]:
    """Amount of money in a question (null if none), and how many ordered items it names (a number and a word, money left out)."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, _AMOUNT, 1), F.lit("")), F.nullif(F.regexp_extract(text, _AMOUNT, 2), F.lit("")))
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double"), F.size(F.regexp_extract_all(F.regexp_replace(text, _AMOUNT, " "), F.lit(_ITEM), F.lit(0))).cast("long")


def route(texts: DataFrame) -> DataFrame:
    """text, intent, confidence, amount, n_items of every distinct question: the intent whose phrases weigh most, unknown below two points. One projection over a fixed list of rules."""
    plain = F.col("plain")
    amount, items = slots(F.col("text"))
    asked = texts.select("text").where("text is not null").distinct().withColumns({"plain": normalized(F.col("text")), "amount": amount, "n_items": items})
    points = {i: sum((F.when(F.contains(plain, F.lit(p)), float(w)).otherwise(0.0) for p, w in rules), F.lit(0.0)) for i, rules in INTENTS.items()}
    others = sum((p for i, p in points.items() if i != CHAT), F.lit(0.0))
    points[CHAT] = F.when(others >= 3, 0.0).otherwise(points[CHAT])
    points["presupuesto_mochila"] += F.when(F.col("amount").isNotNull(), 6.0).otherwise(0.0)
    points["pedido_optimo"] += F.when(F.col("n_items") >= 2, 7.0).when((F.col("n_items") == 1) & F.col("amount").isNull(), 2.0).otherwise(0.0)
    for intent, extra, must, some in BONUSES:
        points[intent] += F.when(F.contains(plain, F.lit(must)) & plain.rlike("|".join(some)), extra).otherwise(0.0)
    ranked = F.sort_array(F.array(*[F.struct(p.alias("points"), F.lit(-k).alias("place"), F.lit(i).alias("intent")) for k, (i, p) in enumerate(points.items())]), asc=False)
    best = asked.withColumn("r", ranked)
    sure = F.col("r")[0]["points"] >= 2
    confidence = F.least(F.round(F.col("r")[0]["points"] / (F.col("r")[0]["points"] + F.col("r")[1]["points"] + 1.0), 2), F.lit(0.99))
    return best.select("text", F.when(sure, F.col("r")[0]["intent"]).otherwise(UNKNOWN).alias("intent"), F.when(sure, confidence).otherwise(0.0).alias("confidence"), "amount", "n_items")


def named_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, kind, name, place: of each kind the name that a text holds as whole words, the longest one, of those the first, of names alike when normalised the least. names: kind, name.

    A name is looked up by its rarest word among all names, so common words such as a prefix of all customers join nothing; the words around it are then compared.
    """
    words = lambda c: F.filter(F.split(normalized(F.col(c)), " "), lambda w: w != "")
    held = names.where("name is not null").withColumn("words", words("name")).where(F.size("words") > 0).groupBy("kind", "words").agg(F.min("name").alias("name"))
    each = held.select("kind", "words", "name", F.posexplode("words").alias("offset", "word"))
    often = each.groupBy("word").agg(F.count("*").alias("n"))
    keyed = each.join(often, "word").groupBy("kind", "words", "name").agg(F.min(F.struct("n", "word", "offset")).alias("key"))
    asked = texts.select("text").where("text is not null").distinct().withColumn("said", words("text"))
    spots = asked.select("text", "said", F.posexplode("said").alias("at", "word"))
    size, place = F.size("words"), F.col("at") - F.col("key.offset")
    met = spots.join(keyed, F.col("word") == F.col("key.word")).where((place >= 0) & (F.slice("said", F.greatest(place, F.lit(0)) + 1, size) == F.col("words")))
    best = met.groupBy("text", "kind").agg(F.min(F.struct((-size).alias("size"), place.alias("place"), "name")).alias("least"))
    return best.select("text", "kind", "least.name", F.col("least.place").cast("long").alias("place"))


def route_with_names(texts: DataFrame, products: DataFrame, customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """route() with the product, customer and supplier that each question names (null for none). Each of the three has its names in a column `name`."""
    kinds = {"product": products, "customer": customers, "supplier": suppliers}
    names = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("kind"), "name")
        names = part if names is None else names.unionByName(part)
    found = named_in(texts, names).groupBy("text").agg(*[F.min(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in kinds])
    return route(texts).join(found, "text", "left")
