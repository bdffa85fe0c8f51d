"""Flows, linkage, routing, networks, retrievability and files against plain versions on small inputs."""

import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmart.functions.similarity import token_set_ratio
from quillmart.functions.text import day
from quillmart.operators import communities, extraction, flows, networks, normalize, retrieval
from quillmart.sources import files


def test_min_cost_flow_is_least(spark):
    """Against all ways to split small orders."""
    r = random.Random(1)
    orders, options = [], []
    for q in range(12):
        for p in range(2):
            orders.append((f"q{q}", f"p{q}-{p}", r.randint(1, 4)))
            options += [(f"p{q}-{p}", f"s{q}-{s}", r.randint(1, 9), r.randint(0, 3), cap) for s, cap in ((0, r.randint(1, 4)), (1, r.randint(1, 4)))]
    caps = {}
    options = [(p, s, c, n, caps.setdefault(s, cap)) for p, s, c, n, cap in options]
    requests = spark.createDataFrame([*orders, ("none", "unknown", 3)], "request string, product_id string, ordered long")
    offered = spark.createDataFrame(options, "product_id string, supplier string, unit_cost long, capacity_units long, supplier_capacity long")
    got = {r.request: (r.units, r.cost) for r in flows.plan_totals(requests, flows.min_cost_flow(requests, offered)).collect()}
    cut = {r.request: r.max_flow for r in flows.max_flow(requests, flows.min_cut(requests, offered)).collect()}
    for q in range(12):
        mine = [(q_, p, n) for q_, p, n in orders if q_ == f"q{q}"]
        arcs = [o for o in options if o[0] in {p for _, p, _ in mine}]
        best = None
        for units in itertools.product(*[range(o[3] + 1) for o in arcs]):
            if all(sum(u for u, o in zip(units, arcs, strict=True) if o[0] == p) <= n for _, p, n in mine) and all(sum(u for u, o in zip(units, arcs, strict=True) if o[1] == s) <= c for s, c in caps.items()):
                value = (-sum(units), sum(u * o[2] for u, o in zip(units, arcs, strict=True)))
                best = value if best is None else min(best, value)
        assert got[f"q{q}"] == (-best[0], best[1]) and cut[f"q{q}"] == -best[0]
    assert got["none"] == (0, 0) and cut["none"] == 0


def test_fuzzy_linkage(spark):
    products = spark.createDataFrame([("1", "Frasco Gotero 30ml"), ("2", "Frasco Gotero 50ml"), ("3", "Tapa Rosca"), ("4", "Pote")], "product_id string, product_name string")
    lines = spark.createDataFrame([("x", "tapa roscca"), ("x", "frasco gotero"), ("x", "zzz"), ("003", "any"), (None, None), ("x", "gotero 30ml frasco")], "source_id string, source_name string")
    got = {r.source_name: (r.product_id, r.status, r.method) for r in retrieval.link_fuzzy(lines, products).collect()}
    assert got["tapa roscca"] == ("3", "accepted", "fuzzy_name") and got["frasco gotero"][1] == "ambiguous" and got["zzz"] == (None, "rejected", "none")
    assert got["any"] == ("3", "accepted", "product_id_numeric_equivalent") and got[None][1] == "rejected" and got["gotero 30ml frasco"][:2] == ("1", "accepted")
    assert token_set_ratio("A B", "B A C") == 1.0 and token_set_ratio("", "A") == 0.0 and 0 < token_set_ratio("ABCD", "ABCE") < 1


@pytest.mark.parametrize(("k", "least"), [(1000, 0.35), (5, 0.35), (2, 0.0)])
def test_best_names_are_those_of_all_pairs(spark, monkeypatch, k, least):
    """No pair is lost, however little two names share, against all pairs; in several blocks and chunks."""
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "CHUNK", 50)
    r = random.Random(3)
    words = ["frasco", "gotero", "tapa", "rosca", "pote", "bolsa", "vidrio", "ambar"]
    names = sorted({" ".join(r.sample(words, r.randint(1, 3))).upper() for _ in range(60)} | {"".join(r.choice("ABCDE ") for _ in range(r.randint(1, 12))).strip() or "A" for _ in range(60)})
    asked = sorted({n.replace(r.choice(n), "", 1).strip() for n in names} - {""})
    found = {}
    for x in retrieval.best_names(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(n,) for n in names], "name string"), k, least).collect():
        found.setdefault(x.asked, []).append((x["rank"], x.name, x.score))
    for a in asked:
        want = sorted((-round(token_set_ratio(a, n), 4), n) for n in names)
        want = [(i + 1, n, -s) for i, (s, n) in enumerate(want[:k]) if -s >= least]
        assert sorted(found.get(a, [])) == want


def test_routing(spark):
    asked = ["¿Qué proveedor conviene para la tapa?", "Tengo S/ 1500.50 de presupuesto", "Necesito 20 frascos y 30 tapas", "hola", "xyz", None, "", "cliente: de donde suelo comprar"]
    got = {r.text: r for r in retrieval.route(spark.createDataFrame([(a,) for a in asked], "text string")).collect()}
    want = ["proveedor_conveniente", "presupuesto_mochila", "pedido_optimo", "conversacion", "desconocido"]
    assert [got[a].intent for a in asked[:5]] == want and got[asked[7]].intent == "cliente_abastecimiento"
    assert got[asked[1]].amount == 1500.5 and got[asked[2]].n_items == 2 and got[""].confidence == 0 and None not in got


def test_names_in_questions(spark):
    """The longest name of whole words, then the first; names of common words, prefixes of all names, and names that are parts of words."""
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    products, customers, suppliers = frame(["Tapa", "Tapa Rosca", "Pote", None, ""]), frame([f"Cliente {i}" for i in range(30)] + ["Tapa"]), frame(["Proveedor #7", "Proveedor #77"])
    asked = ["Necesito 20 tapa rosca y 30 pote para el cliente 12", "proveedor 77 me vende tapas", "¿el proveedor #7, o cliente 1?", "pote tapa", "cliente", None, ""]
    got = {r.text: (r.product, r.customer, r.supplier) for r in retrieval.route_with_names(spark.createDataFrame([(a,) for a in asked], "text string"), products, customers, suppliers).collect()}
    assert got == {asked[0]: ("Tapa Rosca", "Cliente 12", None), asked[1]: (None, None, "Proveedor #77"), asked[2]: (None, "Cliente 1", "Proveedor #7"), asked[3]: ("Pote", "Tapa", None), asked[4]: (None, None, None), "": (None, None, None)}


def test_ranks_and_communities(spark):
    import numpy as np

    pairs = [(a, b, 1.0 + (i % 3)) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("x", "y")])]
    edges = spark.createDataFrame(pairs, "source string, target string, weight double")
    names = sorted({n for a, b, _ in pairs for n in (a, b)})
    w = np.zeros((8, 8))
    for a, b, x in pairs:
        w[names.index(a), names.index(b)] += x
        w[names.index(b), names.index(a)] += x
    rank = np.full(8, 1 / 8)
    for _ in range(500):
        rank = 0.15 / 8 + 0.85 * (w / w.sum(axis=1, keepdims=True)).T @ rank
    got = {r.node: r["rank"] for r in networks.pagerank_converged(networks.both_ways(edges)).collect()}
    assert all(got[n] == pytest.approx(v, abs=1e-7) for n, v in zip(names, rank, strict=True))
    members = communities.communities(edges)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"], ["x", "y"]]
    found = networks.modularity(edges, members).first()
    m, value = w.sum(), 0.0
    for g in groups.values():
        at = [names.index(n) for n in g]
        value += w[np.ix_(at, at)].sum() / m - (w[at].sum() / m) ** 2
    assert found.n_communities == 3 and found.modularity == pytest.approx(value, abs=1e-6)


def test_betweenness(spark):
    """A path, a square (two shortest paths) and a lone pair."""
    both = lambda e: spark.createDataFrame([*e, *[(b, a) for a, b in e]], "u string, v string")
    got = {r.node: r.betweenness for r in networks.betweenness(both([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "p"), ("y", "z")])).collect()}
    assert got == {"a": 0, "b": 2, "c": 2, "d": 0, "p": 0.5, "q": 0.5, "r": 0.5, "s": 0.5, "y": 0, "z": 0}


def test_retrievability_against_all_pairs(spark):
    """Ranks by classes equal ranks over all products."""
    import math

    r = random.Random(2)
    words = ["frasco", "gotero", "tapa", "rosca", "pote", "vidrio", "rojo", "azul"]
    products = [(str(i), " ".join(r.sample(words, r.randint(1, 3)))) for i in range(40)] + [("40", "de la"), ("41", None)]
    rows = extraction.labelled(extraction.attribute_rows(spark.createDataFrame(products, "product_id string, product_name string")))
    docs = retrieval.search_documents(rows)
    held = [(d.product_id, d.plain, d.name_words, set(d.attribute_words)) for d in docs.collect()]
    got = {x.product_id: x for x in retrieval.retrievability(docs).collect()}
    for i, plain, q, mine in held:
        def score(other, q=q, plain=plain):
            return round((sum(t in other[3] for t in q) * 1.1 + sum(t in other[2] for t in q) * 1.4) / len(q) + 0.35 * token_set_ratio(plain, other[1]) + (plain == other[1]) + 0.01 * math.log1p(len(other[3])), 9)

        if q:
            own = score((i, plain, q, mine))
            better = sum(score(o) > own for o in held)
            tied = sum(score(o) == own for o in held)
            assert better < got[i].rank <= better + tied
            assert got[i].retrievability == pytest.approx(round(sum(t in mine for t in q) / len(q), 4))
        else:
            assert got[i]["rank"] is None and not got[i].top10


def test_retrievability_reads_documents_once_and_compares_few(spark, monkeypatch):
    """Rows of the documents are made once; only pairs that can be better than the own class are compared by likeness."""
    made, compared = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def noted(i):
        made.add(1)
        return i

    def alike(a, b):
        compared.add(1)
        return token_set_ratio(a, b)

    monkeypatch.setattr(retrieval, "similarity", F.udf(alike, "double"))
    rows = [(str(i), f"PLATE {i}", ["PLATE", f"N{i}"], ["TAPA"]) for i in range(60)]
    docs = spark.createDataFrame(rows, "id string, plain string, name_words array<string>, attribute_words array<string>")
    got = retrieval.retrievability(docs.select(F.udf(noted, "string")("id").alias("product_id"), "plain", "name_words", "attribute_words")).collect()
    assert len(got) == 60 and all(r["rank"] == 1 for r in got)
    assert made.value == 60 and compared.value <= 60


def test_parts_of_names_join_nothing_in_common(spark):
    """Texts with one same start are looked up by themselves, not among all names that hold the start."""
    names = [(f"Customer#{i:06d}",) for i in range(200)]
    texts = spark.createDataFrame([(n[0][9:],) for n in names] + [("cust",), ("0",), ("zz",)], "text string")
    found = retrieval.resolve_parties(texts, spark.createDataFrame(names, "party string"))
    got = {r.text: r.party for r in found.collect()}
    assert got == {n[0][9:]: n[0] for n in names} | {"cust": names[0][0], "0": names[0][0]}
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_default_rules_and_uncommon_products(spark):
    rows = {r.product_id: r for r in extraction.attribute_rows(spark.createDataFrame([("1", "Frasco gotero ámbar 30 ml PET"), ("2", None), ("3", "Bomba atomizador B24 no estéril")], "product_id string, product_name string")).collect()}
    a = rows["1"]
    assert (a.product_type, a.color, a.capacity_value, a.capacity_unit, a.material, a.material_family, a.use_category) == ("gotero", "AMBAR", 30.0, "ML", "PET", "POLIETILENO TEREFTALATO", "empaque_envase")
    assert (rows["2"].use_category, rows["2"].confidence) == ("general", 0.6)
    assert (rows["3"].subtype, rows["3"].closure_type, rows["3"].mouth_size_mm, rows["3"].feature) == ("atomizador", "atomizador", 24.0, "no_esteril")


def test_detects_a_mapping(spark):
    rows = [(f"{1 + i % 28:02d}/03/2024", f"SKU-{i}", "Pintura", str(i + 1), "10,5", str((i + 1) * 10.5), "Ana") for i in range(40)]
    raw = spark.createDataFrame(rows, "FecDoc string, CodItem string, NomItem string, Cant string, `Valor Unitario` string, Subtotal string, Cliente string")
    found = normalize.detect(raw, "sales")
    assert found == {"date": "FecDoc", "product_id": "CodItem", "product_name": "NomItem", "quantity": "Cant", "unit_price_net": "Valor Unitario", "subtotal_net": "Subtotal", "customer": "Cliente"} | {k: v for k, v in found.items() if k not in ("date", "product_id", "product_name", "quantity", "unit_price_net", "subtotal_net", "customer")}
    days = spark.createDataFrame([("05/03/2024",), ("2024-3-5",), ("5-3-24",), ("31/02/2024",), ("x",), (None,)], "t string").select(day(F.col("t")).cast("string")).collect()
    assert [r[0] for r in days] == ["2024-03-05", "2024-03-05", "2024-03-05", None, None, None]


def test_spreadsheet(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>two</t></r><r><t>parts</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c></row><row r="4"><c r="B4"><v>2.5</v></c></row></sheetData></worksheet>')
    frame = files.read_table(spark, str(path))
    assert frame.columns == ["name", "n"] and [tuple(r) for r in frame.collect()] == [("twoparts", None), (None, "2.5")]
    spark.dataSource.register(files.SpreadsheetSource)
    assert spark.read.format("spreadsheet").load(str(path)).count() == 2
    (tmp_path / "b.csv").write_text('"a,b";c\n1;2\n')
    assert files.read_table(spark, str(tmp_path / "b.csv")).columns == ["a,b", "c"]


def test_search_by_classes_of_equal_products(spark):
    """Equal products are searched as one class and spelled out in order; queries of the same words are answered alike."""
    from quillmart.operators import attributes

    kinds = [("RED", "BOLT"), ("RED", "GEAR"), ("BLUE", "BOLT")]
    rows = [(f"p{i:03d}", f"WORD:{w}", 90) for i in range(90) for w in kinds[i % 3]]
    index = attributes.search_index(spark.createDataFrame(rows, "product_id string, attribute string, weight int"), 10)
    assert sorted(r.product_id for r in index.edges.select("product_id").distinct().collect()) == ["p000", "p001", "p002"]
    asked = spark.createDataFrame([(1, "red bolts"), (2, "Bolts RED"), (3, "blue"), (4, None)], "query_id long, text string")
    found = {}
    for r in attributes.search_batch(index, asked, 10).orderBy("query_id", (-F.col("relevance")), "product_id").collect():
        found.setdefault(r.query_id, []).append(r.product_id)
    red = [f"p{i:03d}" for i in range(0, 30, 3)]
    assert found == {1: red, 2: red, 3: [f"p{i:03d}" for i in range(2, 32, 3)]}
    must = spark.createDataFrame([(2, "WORD:GEAR")], "query_id long, attribute string")
    both = attributes.search_batch(index, asked, 2, must).orderBy("query_id", "product_id").collect()
    assert [(r.query_id, r.product_id) for r in both] == [(1, "p000"), (1, "p003"), (2, "p001"), (2, "p004"), (3, "p002"), (3, "p005")]


def test_profiles_walk_over_reachable_lines_alone(spark, tmp_path, monkeypatch):
    """Lines that no walk of three rounds can come to are not laid out as edges."""
    from quillmart import analysis
    from quillmart.operators import paths

    put = lambda name, rows, columns: spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("part", [(i, f"part {i}", "t", "b", 1.0) for i in (1, 2, 9)], "p_partkey long, p_name string, p_type string, p_brand string, p_retailprice double")
    put("customer", [(1, "a"), (2, "b"), (3, "z")], "c_custkey long, c_name string")
    put("orders", [(i, i, "1996-01-01") for i in (1, 2, 3)], "o_orderkey long, o_custkey long, o_orderdate string")
    lines = [(1, 1, "N", 1.0, 90.0, 0.0), (2, 1, "N", 1.0, 5.0, 0.0), (2, 2, "N", 1.0, 5.0, 0.0), (3, 9, "N", 1.0, 5.0, 0.0)]
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double")
    walk, seen = paths.personalised_pagerank, []

    def noted(edges, *rest):
        seen.extend(edges.collect())
        return walk(edges, *rest)

    monkeypatch.setattr(paths, "personalised_pagerank", noted)
    got = analysis._profiles(spark, str(tmp_path), 1).collect()
    assert [(r.customer, r.product_id) for r in got] == [("a", "1")] and got[0].score > 0
    assert {r.u for r in seen} == {"C|a", "C|b", "1", "2"}
