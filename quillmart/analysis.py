"""Registry of further commerce queries: normalising, extraction, linkage, flows, networks and composed reports, with oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart import queries as base
from quillmart.functions.text import normalized
from quillmart.operators import answers, budget, communities, cuts, extraction, flows, graph, networks, normalize, paths, reports, retrieval, supply
from quillmart.operators.attributes import CONFIDENCE, search, search_batch, search_index
from quillmart.plans.canonical import products, purchases, sales, stored, table

#: Mapping of the raw sales table: canonical field to its header.
SALES_MAPPING = {"date": "Fecha", "product_id": "Codigo", "product_name": "Producto", "customer": "Cliente", "quantity": "Cantidad", "unit_price_net": "Valor Unitario", "subtotal_net": "Subtotal", "is_cancelled": "Anulado", "description": "Detalle"}
PRODUCT_MAPPING = {"product_id": "Codigo", "product_name": "Producto", "software_category": "Categoria", "brand": "Marca", "current_price": "Precio", "stock_available": "Stock"}


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as a shop's export would have them: Spanish headers, everything text."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    full = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    units, unit = F.col("l_quantity").cast("long"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5)
    text = lambda c: c.cast("string")
    return full.select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Fecha"), F.concat(F.lit(" "), text(F.col("l_partkey"))).alias("Codigo"), F.col("p_name").alias("Producto"), F.col("c_name").alias("Cliente"),
        F.concat(text(units), F.lit(" und")).alias("Cantidad"), F.concat(text(unit), F.lit(",5")).alias("Valor Unitario"), F.concat(F.lit("S/ "), text(units * unit)).alias("Subtotal"),
        F.when(F.col("l_returnflag") == "R", "Sí").otherwise("no").alias("Anulado"), F.when(F.col("l_linenumber") == 3, F.lit("ajuste de caja")).when(F.col("l_linestatus") == "O", F.lit("venta")).alias("Detalle"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("Codigo"), F.concat(F.col("p_name"), F.lit(" ")).alias("Producto"), F.when(F.col("p_partkey") % 7 == 0, "-").when(F.col("p_partkey") % 7 == 1, "Sin categoría").otherwise(F.col("p_type")).alias("Categoria"), F.col("p_brand").alias("Marca"),
        F.concat(F.lit("S/ "), F.floor("p_retailprice").cast("string")).alias("Precio"), (F.col("p_size") - 10).cast("string").alias("Stock"),
    )


def _normal_sales(spark, sf_dir):
    return normalize.normalize(raw_sales(spark, sf_dir), SALES_MAPPING, "sales")


_NORMAL = """normal as (select cast(o_orderdate as date) date, cast(l_partkey as varchar) product_id, p_name product_name, c_name customer, cast(cast(l_quantity as bigint) as double) quantity,
  cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) + 0.5::double unit_price_net, cast(cast(l_quantity as bigint) * cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) as double) subtotal_net,
  l_returnflag = 'R' is_cancelled, l_linenumber = 3 is_adjustment, not (l_returnflag = 'R' or l_linenumber = 3) is_active
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""

#: Rules of the registered extraction: what the test tables' names hold. A user's catalogue takes the defaults or its own.
RULES = [
    ("product_type", "keyword_first_match", "fastener", ["BOLT", "RING"], 0.92),
    ("product_type", "keyword_first_match", "tapa", ["PLATE"], 0.9),
    ("product_type", "keyword_first_match", "machine part", ["GEAR", "ROD"], 0.9),
    ("subtype", "keyword_first_match", "gatillo", ["GIZMO"], 0.94),
    ("accessory", "keyword_any", "cap", ["RING", "PLATE"], 0.88),
    ("accessory", "keyword_any", "brush", ["SMALL", "RING"], 0.92),
    ("shape", "keyword_first_match", "tubular", ["ROD"], 0.7),
    ("feature", "keyword_first_match", "cold plate", ["COLD PLATE"], 0.88),
    ("feature", "keyword_first_match", "heated", ["HOT"], 0.9),
    ("use_category", "keyword_first_match", "hardware", ["BOLT", "GEAR"], 0.84),
]
MATERIALS = (("PLATE", "STEEL", "METAL"), ("ROD", "IRON", "METAL"), ("WIDGET", "PE", "PLASTIC"))
COLORS = ("BLUE", "RED")
#: A second extraction that the first is compared with.
OTHER_RULES = [r for r in RULES if r[2] != "heated"] + [("feature", "keyword_first_match", "warm", ["HOT"], 0.9), ("shape", "keyword_first_match", "flat", ["PLATE"], 0.9)]


def named_products(spark, sf_dir):
    """Products whose names also carry a measure."""
    p = table(spark, sf_dir, "part")
    measure = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" ML"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("B "), F.col("p_size").cast("string"), F.lit("LT"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" x 20 cm")))
    return p.select(F.col("p_partkey").cast("string").alias("product_id"), F.concat_ws(" ", "p_name", measure).alias("product_name"))


def _rows(spark, sf_dir, rules=RULES):
    return extraction.attribute_rows(named_products(spark, sf_dir), rules, MATERIALS, COLORS)


def _flat_rows(spark, sf_dir):
    return _rows(spark, sf_dir).withColumn("attribute_confidence", F.array_join(F.transform(F.array_sort(F.map_entries("attribute_confidence")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


def _sql_rows(name: str, heated: str, shape: str) -> str:
    has = lambda *w: " or ".join(f"list_contains(w, '{x}')" for x in w)
    return f"""{name}_found as (select product_id, product_name,
    case when {has("BOLT", "RING")} then 'fastener' when {has("PLATE")} then 'tapa' when {has("GEAR", "ROD")} then 'machine part' end product_type, case when {has("BOLT", "RING")} then 0.92::double when {has("PLATE", "GEAR", "ROD")} then 0.9::double end c_product_type,
    case when {has("GIZMO")} then 'gatillo' end subtype, case when {has("GIZMO")} then 0.94::double end c_subtype,
    case when {has("PLATE")} then 'STEEL' when {has("ROD")} then 'IRON' when {has("WIDGET")} then 'PE' end material, case when {has("PLATE", "ROD")} then 'METAL' when {has("WIDGET")} then 'PLASTIC' end material_family, case when {has("PLATE", "ROD", "WIDGET")} then 0.94::double end c_material,
    case when {has("BLUE")} then 'BLUE' when {has("RED")} then 'RED' end color, case when {has("BLUE", "RED")} then 0.94::double end c_color,
    case when k < 2 then cast(p_size as double) end capacity_value, case when k = 0 then 'ML' when k = 1 then 'L' end capacity_unit, case when k < 2 then {CONFIDENCE["capacity"]}::double end c_capacity,
    cast(null as double) mouth_size_mm, cast(null as double) c_mouth_size, case when k = 2 then p_size || ' X 20 CM' end size_text, case when k = 2 then {CONFIDENCE["size"]}::double end c_size_text,
    nullif(concat_ws('|', case when {has("RING", "PLATE")} then 'cap' end, case when {has("SMALL", "RING")} then 'brush' end), '') accessory, case when {has("SMALL", "RING")} then 0.92::double when {has("PLATE")} then 0.88::double end c_accessory,
    {shape}, case when contains(n, 'COLD PLATE') then 'cold plate' when {has("HOT")} then '{heated}' end feature, case when contains(n, 'COLD PLATE') then 0.88::double when {has("HOT")} then 0.9::double end c_feature,
    case when {has("BOLT", "GEAR")} then 'hardware' else 'general' end use_category, case when {has("BOLT", "GEAR")} then 0.84::double else 0.6::double end c_use_category, w from named),
{name} as (select *, case when subtype = 'gatillo' then subtype end closure_type, list_filter([struct_pack(k := 'accessory', v := c_accessory), struct_pack(k := 'capacity', v := c_capacity), struct_pack(k := 'color', v := c_color), struct_pack(k := 'feature', v := c_feature), struct_pack(k := 'material', v := c_material),
    struct_pack(k := 'mouth_size', v := c_mouth_size), struct_pack(k := 'product_type', v := c_product_type), struct_pack(k := 'shape', v := c_shape), struct_pack(k := 'size_text', v := c_size_text), struct_pack(k := 'subtype', v := c_subtype), struct_pack(k := 'use_category', v := c_use_category)], lambda e: e.v is not null) e from {name}_found)"""


_NAMED = """pre as (select cast(p_partkey as varchar) product_id, p_size, p_partkey % 3 k, p_name || ' ' || case p_partkey % 3 when 0 then p_size || ' ML' when 1 then 'B ' || p_size || 'LT' else p_size || ' x 20 cm' end product_name from part),
named as (select *, upper(product_name) n, string_split(upper(product_name), ' ') w from pre)"""
_SHAPE = "case when list_contains(w, 'ROD') then 'tubular' end shape, case when list_contains(w, 'ROD') then 0.7::double end c_shape"
_SHAPE2 = "case when list_contains(w, 'ROD') then 'tubular' when list_contains(w, 'PLATE') then 'flat' end shape, case when list_contains(w, 'ROD') then 0.7::double when list_contains(w, 'PLATE') then 0.9::double end c_shape"
_ROWS = f"{_NAMED}, {_sql_rows('attrs', 'heated', _SHAPE)}, x as (select *, round(list_sum(list_transform(e, lambda i: i.v)) / len(e), 4) confidence from attrs)"
_GRAPH_EDGES = """options as (select product_id, unnest([struct_pack(kind := 'TYPE', rel := 'HAS_TYPE', val := product_type, wt := coalesce(c_product_type, confidence)), struct_pack(kind := 'SUBTYPE', rel := 'HAS_SUBTYPE', val := subtype, wt := coalesce(c_subtype, confidence)), struct_pack(kind := 'ACCESSORY', rel := 'HAS_ACCESSORY', val := accessory, wt := coalesce(c_accessory, confidence)),
  struct_pack(kind := 'SHAPE', rel := 'HAS_SHAPE', val := shape, wt := coalesce(c_shape, confidence)), struct_pack(kind := 'FEATURE', rel := 'HAS_FEATURE', val := feature, wt := coalesce(c_feature, confidence)), struct_pack(kind := 'MATERIAL', rel := 'HAS_MATERIAL', val := material, wt := coalesce(c_material, confidence)), struct_pack(kind := 'COLOR', rel := 'HAS_COLOR', val := color, wt := coalesce(c_color, confidence)),
  struct_pack(kind := 'CAPACITY', rel := 'HAS_CAPACITY', val := cast(cast(capacity_value as bigint) as varchar) || capacity_unit, wt := coalesce(c_capacity, confidence))]) o from x),
vals as (select product_id, o.kind kind, o.rel relation, o.wt weight, unnest(string_split(o.val, '|')) label from options where o.val is not null and o.wt >= 0.75),
edges as (select 'PRODUCT:' || product_id source, kind || ':' || replace(trim(regexp_replace(upper(label), '[^A-Z0-9]+', ' ', 'g')), ' ', '_') target, relation, round(weight, 4) weight, kind, label from vals),
nodes as (select 'PRODUCT:' || product_id node_id, 'PRODUCT' node_type, product_name as label from x union all select target, min(kind), min(label) from edges group by target)"""


def _edges(spark, sf_dir):
    return extraction.graph_edges(_rows(spark, sf_dir))


def _nodes(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return extraction.graph_nodes(rows, extraction.graph_edges(rows))


_LONG = ("product_type", "subtype", "material", "color", "accessory", "shape", "feature", "capacity_value", "mouth_size_mm", "size_text", "closure_type", "use_category", "material_family")
_COMPARED = ("product_type", "subtype", "accessory", "shape", "feature", "material", "color", "capacity_value", "capacity_unit", "mouth_size_mm", "use_category", "material_family")


def _long_sql(source: str, columns: tuple[str, ...]) -> str:
    text = lambda c: f"cast(cast({c} as bigint) as varchar)" if c in ("capacity_value", "mouth_size_mm") else f"cast({c} as varchar)"
    return " union all ".join(f"select product_id, '{c}' attribute, {text(c)} as value from {source}" for c in columns)


def _requests(spark, sf_dir, k=8):
    """Each nation's customers together ask for ten times what they bought of their k products with most units."""
    places = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("customer"), F.col("n_name").alias("request"))
    sold = sales(spark, sf_dir).where("is_active").join(places, "customer").groupBy("request", "product_id").agg(F.sum("quantity").alias("units"))
    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.col("units").desc(), "product_id"))
    return sold.withColumn("rank", rank).where(F.col("rank") <= k).select("request", "product_id", (F.col("units") * 10).cast("long").alias("ordered"))


_REQUESTS = """requests as (select n_name request, product_id, cast(10 * sum(quantity) as bigint) ordered from sales join customer on c_name = customer join nation on c_nationkey = n_nationkey where is_active group by n_name, product_id qualify row_number() over (partition by n_name order by sum(quantity) desc, product_id) <= 8)"""


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))


def _between(spark, sf_dir):
    return networks.betweenness(base._places(spark, sf_dir), _sources(spark, sf_dir))


def _supplier_between(spark, sf_dir):
    """Betweenness of suppliers in the graph of suppliers and products, over paths that start at a supplier."""
    e = purchases(spark, sf_dir).where("is_active").select("supplier", F.concat(F.lit("P|"), "product_id").alias("product")).distinct()
    around = graph.undirected(e, "supplier", "product")
    return networks.betweenness(around, e.select(F.col("supplier").alias("node")))


def _described(spark, sf_dir, found):
    return networks.describe_communities(found.select(F.col("product_id").alias("node"), "community"), products(spark, sf_dir).select(F.col("product_id").alias("node"), F.col("product_name").alias("label")))


def _community_terms(spark, sf_dir):
    return _described(spark, sf_dir, communities.product_communities(base._edges(spark, sf_dir)))


def _answer_families(spark, sf_dir):
    found = stored(communities.product_communities(base._edges(spark, sf_dir)), "families")
    return answers.families(found, _described(spark, sf_dir, found))


#: Classes of products with equal attributes and weights.
_CLASSES = "sets as (select product_id, list(attribute || '=' || w order by attribute) items from used group by all), classes as (select items, min(product_id) class from sets group by items)"


def _search_queries(spark, sf_dir):
    """Searches for names and brands, and the brand as an attribute that results may have to have."""
    brand = F.concat(F.lit("BRAND:"), normalized(F.col("p_brand")))
    return table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"), brand.alias("attribute"))


_SEARCHES = f"""with recursive {base._PRODUCTS}, {base._ATTRIBUTES}, e as (select product_id, attribute, max(weight) w from edges group by all), q as (select p_partkey query_id, concat_ws(' ', p_name, p_brand) t, 'BRAND:' || {base._norm('p_brand')} attribute from part where p_partkey % 50 = 0),
        word as (select query_id, unnest({base._tokens('t')}) x from q), wanted as (select query_id, x from word union select query_id, case when ends_with(x, 'ES') and length(x) > 4 then x[:-3] when ends_with(x, 'S') and length(x) > 3 then x[:-2] else x end from word),
        seeds as (select distinct query_id, attribute from wanted join (select distinct attribute, string_split(attribute, ':')[-1] x from e) using (x)),
        second as (select distinct query_id, y.attribute from seeds join e x using (attribute) join e y on y.product_id = x.product_id),
        reached(query_id, attribute) as (select query_id, attribute from seeds union select query_id, y.attribute from reached r join e x on x.attribute = r.attribute join e y on y.product_id = x.product_id),
        decay as (select r.query_id, r.attribute, case when s.attribute is not null then 5 when n.attribute is not null then 3 else 1 end d from reached r left join seeds s using (query_id, attribute) left join second n using (query_id, attribute)),
        scored as (select query_id, product_id, sum(d * w) base, count(*) filter (d = 5) seed_coverage from e join decay using (attribute) group by all), t as (select query_id, count(*) total_seeds from seeds group by all)
        select query_id, product_id, round(base * (power(seed_coverage / total_seeds, 2) * 20 + 1), 2) relevance, seed_coverage, total_seeds from scored join t using (query_id) where {{required}}
        qualify row_number() over (partition by query_id order by round(base * (power(seed_coverage / total_seeds, 2) * 20 + 1), 2) desc, product_id) <= 10"""


def _demand(spark, sf_dir):
    """Units sold of every product: what the whole network is asked for."""
    return sales(spark, sf_dir).where("is_active and quantity > 0").groupBy("product_id").agg(F.sum("quantity").alias("ordered"))


def _identities(spark, sf_dir):
    """Purchases by unit cost, sales by list price, and gross amounts with tax."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return reports.amount_identities(
        {
            "purchases": (l, F.col("l_quantity"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_extendedprice")),
            "sales": (l, F.col("l_quantity"), F.col("p_retailprice"), F.col("l_extendedprice")),
            "gross": (l, F.lit(1.0), net * (1 + F.col("l_tax")), F.col("l_extendedprice")),
        }
    )


_IDENTITIES = """with l as (select * from lineitem join part on p_partkey = l_partkey), a as (
  select 'purchases' dataset, l_quantity * (l_extendedprice / l_quantity) expected, l_extendedprice total from l union all select 'sales', l_quantity * p_retailprice, l_extendedprice from l union all
  select 'gross', l_extendedprice * (1 - l_discount) * (1 + l_tax), l_extendedprice from l),
v as (select dataset, count(*) valid_rows, count(*) filter (abs(expected - total) / abs(total) <= 0.03) n_match from a where total <> 0 and expected is not null group by dataset)
select dataset, valid_rows, round(n_match / valid_rows, 4) match_rate, n_match / valid_rows >= 0.85 passes from v"""


def _network_flow(spark, sf_dir):
    demand, options = stored(_demand(spark, sf_dir), "demand"), stored(base._options(spark, sf_dir), "options")
    return cuts.shared_flow(demand, options, cuts.shared_cut(demand, options))


#: Two products that share no supplier, or few, in the graph of suppliers and products.
_ENDS = ("P|1", "P|57")
_SHORTEST = f"""with recursive {base._PURCHASES}, trade as (select distinct 'S|' || supplier u, 'P|' || product_id v from purchases where is_active), both_ways as (select u, v from trade union select v, u from trade),
walk(node, distance) as (select '{_ENDS[0]}', 0 union select v, distance + 1 from walk join both_ways on u = node where distance < 6),
d as (select node, min(distance) distance from walk group by node), goal as (select * from d where node = '{_ENDS[1]}'),
parents as (select b.u node, min(b.v) parent from both_ways b join d x on b.u = x.node join d y on b.v = y.node where y.distance = x.distance - 1 group by b.u),
path(node, step) as (select node, distance from goal union all select parent, step - 1 from path join parents using (node)),
seen as (select count(*) n from d where distance < (select distance from goal))"""


def _sales_graph(spark, sf_dir):
    return graph.transaction_edges(sales(spark, sf_dir), "customer", "SOLD_TO")


#: Questions; {} stands for a product's name.
_FORMS = ["¿Qué proveedor conviene para {}?", "Tengo S/ 500 para comprar {}, ¿cuánto me alcanza?", "Necesito 20 {} y 30 tapas", "¿Con qué se vende junto {}?", "Busca {}", "¿De dónde suelo comprar lo que pide el cliente {}?", "Hola, gracias", "xyz {}"]
_QUESTIONS = "select case p_partkey % 8 " + " ".join(f"when {j} then '{f}'".replace("{}", "' || p_name || '") for j, f in enumerate(_FORMS)) + " end as text from part"


def _names(spark, sf_dir):
    one = lambda t, kind, c: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return one("part", "product", "p_name").unionByName(one("customer", "customer", "c_name")).unionByName(one("supplier", "supplier", "s_name"))


def _questions(spark, sf_dir):
    """Questions about products, customers and suppliers, in turn."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("n"), F.col("p_partkey").alias("i"))
    forms = _FORMS
    pick = F.pmod(F.col("i"), F.lit(len(forms)))
    text = F.coalesce(*[F.when(pick == j, F.concat(F.lit(f.partition("{}")[0]), F.when(F.lit("{}" in f), F.col("n")).otherwise(""), F.lit(f.partition("{}")[2]))) for j, f in enumerate(forms)])
    return p.select(text.alias("text"))


def _typed(spark, sf_dir):
    """Lines whose ids say nothing and whose names are misspelt, cut or turned round."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, F.regexp_replace("p_name", "t", "tt")).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit(" de acero"))).when(F.col("p_partkey") % 4 == 2, F.substring("p_name", 1, 4)).otherwise(F.lit("flete"))
    return p.select(F.lit("-").alias("source_id"), name.alias("source_name"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("party"))


_CUSTOMERS = "asked as (select distinct unnest([lower(c_name), substring(c_name, 12), substring(c_name, 1, 8)]) as text from customer)"
_WORD_SCORE = "len(list_filter(['SMALL', 'BOLT'], lambda t: list_contains(string_split(n, ' '), t)))"

_REGISTRY = {
    "normalized_sales": (
        lambda s, d: _normal_sales(s, d).select("date", "product_id", "product_name", "customer", "quantity", "unit_price_net", "subtotal_net", "is_cancelled", "is_adjustment", "is_active", "analysis_total", "product_name_norm"),
        f"with {_NORMAL} select *, subtotal_net analysis_total, upper(product_name) product_name_norm from normal",
    ),
    "normalized_products": (
        lambda s, d: normalize.normalize(raw_products(s, d), PRODUCT_MAPPING, "products"),
        """select cast(p_partkey as varchar) product_id, p_name product_name, case p_partkey % 7 when 0 then '-' when 1 then 'Sin categoría' else p_type end software_category, p_brand brand, floor(p_retailprice) current_price, cast(greatest(p_size - 10, 0) as double) stock_available, cast(p_size - 10 as double) stock_available_raw,
        case when p_size < 10 then 'negative_raw_clipped' when p_size = 10 then 'zero' else 'positive' end stock_status, case when p_partkey % 7 < 2 then 'low' else 'normal' end software_category_confidence, true is_commercial_product, upper(p_name) product_name_norm, 'products' source_dataset from part""",
    ),
    "transaction_flags": (lambda s, d: reports.transaction_flags({"sales": _normal_sales(s, d)}), f"with {_NORMAL} select 'sales' dataset, count(*) n_rows, count(*) filter (is_active) n_active, count(*) filter (is_cancelled) n_cancelled, count(*) filter (is_adjustment) n_adjustment, sum(subtotal_net) total from normal"),
    "schema_candidates": (lambda s, d: normalize.field_scores(normalize.profile(raw_sales(s, d)), "sales"), None),
    "quality_summary": (lambda s, d: normalize.stage_report({"sales": SALES_MAPPING}, retrieval.link_fuzzy(_typed(s, d), products(s, d)), {"products": products(s, d)}), None),
    "attribute_rows": (
        _flat_rows,
        f"""with {_ROWS} select product_id, product_name, product_type, subtype, material, color, capacity_value, capacity_unit, mouth_size_mm, size_text, closure_type, accessory, shape, feature, use_category, material_family,
        '[' || array_to_string(list_transform(list_filter(w, lambda t: t not in {base._STOP})[1:8], lambda t: '"' || t || '"'), ',') || ']' keywords, confidence, array_to_string(list_transform(e, lambda i: i.k || '=' || cast(i.v as varchar)), ',') attribute_confidence from x""",
    ),
    "attribute_graph_edges": (lambda s, d: _edges(s, d).select("source", "target", "relation", "weight"), f"with {_ROWS}, {_GRAPH_EDGES} select source, target, relation, weight from edges"),
    "attr_graph_nodes": (_nodes, f"with {_ROWS}, {_GRAPH_EDGES} select * from nodes"),
    "attribute_activity": (lambda s, d: extraction.with_activity(_rows(s, d), base._activity(s, d)).select("product_id", "confidence", "n_sales", "n_purchases", "sales_total", "purchases_total"), f"with {_ROWS}, {base._PRODUCTS}, {base._SALES}, {base._PURCHASES}, {base._ACTIVITY} select product_id, confidence, n_sales, n_purchases, sales_total, purchases_total from x left join activity using (product_id)"),
    "adjacency_sample": (lambda s, d: extraction.adjacency_sample(_nodes(s, d), _edges(s, d)), f"with {_ROWS}, {_GRAPH_EDGES}, few as (select * from edges order by source, target limit 80) select source, a.label source_label, relation, target, b.label target_label, weight from few join nodes a on a.node_id = source join nodes b on b.node_id = target"),
    "graph_metrics": (
        lambda s, d: networks.graph_metrics(_nodes(s, d), _edges(s, d)),
        f"""with recursive {_ROWS}, {_GRAPH_EDGES}, around as (select source u, target v from edges union select target, source from edges), hub as (select distinct v a from around where v not like 'PRODUCT:%'),
        linked as (select distinct x.v a, y.v b from around x join around y on x.u = y.u where x.u like 'PRODUCT:%'), reach(a, b) as (select a, a from hub union select reach.a, linked.b from reach join linked on linked.a = reach.b), heads as (select a, min(b) head from reach group by a),
        labelled as (select distinct u node, head from around join heads on a = v where u like 'PRODUCT:%' union select a, head from heads), degree as (select u, count(*) n from around group by u),
        sizes as (select count(*) n from labelled group by head union all select 1 from nodes where node_id not in (select node from labelled))
        select 'nodes:' || node_type metric, count(*) as value from nodes group by node_type union all select 'edges:' || relation, count(*) from edges group by relation union all select 'connected_components', count(*) from sizes union all select 'largest_component', max(n) from sizes
        union all select 'products_total', count(*) from nodes where node_type = 'PRODUCT' union all select 'products_with_edges', count(*) from nodes where node_id like 'PRODUCT:%' and node_id in (select u from degree) union all select 'products_without_edges', count(*) from nodes where node_type = 'PRODUCT' and node_id not in (select u from degree)
        union all (select 'degree:' || u, n from degree order by n desc, u limit 20)""",
    ),
    "threshold_components": (
        lambda s, d: networks.components_by_threshold(extraction.graph_edges(_rows(s, d), 0.0), (0.6, 0.75, 0.9)),
        f"""with recursive {_ROWS}, {_GRAPH_EDGES.replace("o.wt >= 0.75", "o.wt >= 0.0")}, t as (select unnest([0.6, 0.75, 0.9])::double threshold), b as (select threshold, source u, target v from edges, t where weight >= threshold union select threshold, target, source from edges, t where weight >= threshold),
        reach(threshold, root, node) as (select distinct threshold, u, u from b where u not like 'PRODUCT:%' union select r.threshold, r.root, b.v from reach r join b on b.threshold = r.threshold and b.u = r.node), parts as (select threshold, node, min(root) label from reach group by all),
        sizes as (select threshold, label, count(*) n from parts group by all) select threshold, cast(sum(n) as bigint) n_nodes, count(*) n_components, max(n) largest from sizes group by threshold""",
    ),
    "coverage_report": (
        lambda s, d: extraction.coverage_report(_rows(s, d)),
        f"""with {_ROWS}, l as ({_long_sql('x', _LONG)}), c as (select attribute, value, count(*) n from l group by all), r as (select *, row_number() over (partition by attribute order by value is null, n desc, value) i from c)
        select attribute, cast(coalesce(sum(n) filter (value is not null), 0) as bigint) filled, cast(sum(n) as bigint) total, count(value) unique_values, coalesce(string_agg(value || '=' || n, ',' order by i) filter (i <= 10 and value is not null), '') top_values, round(coalesce(sum(n) filter (value is not null), 0) / sum(n), 4) coverage from r group by attribute""",
    ),
    "gold_accuracy": (
        lambda s, d: extraction.gold_accuracy(_rows(s, d), _rows(s, d, OTHER_RULES).where("product_id % 4 != 0"), ("product_type", "feature", "shape", "material", "capacity_value")),
        f"""with {_ROWS}, {_sql_rows('gold', 'warm', _SHAPE2)}, a as ({_long_sql('x', ('product_type', 'feature', 'shape', 'material', 'capacity_value'))}), b as ({_long_sql('gold', ('product_type', 'feature', 'shape', 'material', 'capacity_value'))}), j as (select attribute, a.value p, b.value q from a join b using (product_id, attribute) where product_id::bigint % 4 <> 0)
        select attribute, count(*) overlap_rows, count(q) expected_filled, count(*) filter (p is not null and q is not null) predicted_filled_on_expected, round(avg(case when p is not null and q is not null then (p = q)::int end), 4) accuracy_on_both_filled, round(count(*) filter (p = q) / greatest(count(q), 1), 4) recall_against_expected from j group by attribute""",
    ),
    "attribute_delta": (
        lambda s, d: extraction.delta_report(_rows(s, d), _rows(s, d, OTHER_RULES)),
        f"""with {_ROWS}, {_sql_rows('gold', 'warm', _SHAPE2)}, a as ({_long_sql('x', _COMPARED)}), b as ({_long_sql('gold', _COMPARED)})
        select product_id, attribute, coalesce(a.value, '') baseline_value, coalesce(b.value, '') candidate_value, case when a.value is null then 'filled' when b.value is null then 'removed' else 'changed' end change_type from a join b using (product_id, attribute) where a.value is distinct from b.value""",
    ),
    "review_sample": (
        lambda s, d: extraction.review_sample(extraction.with_activity(_rows(s, d), base._activity(s, d))),
        f"""with {_ROWS}, {base._PRODUCTS}, {base._SALES}, {base._PURCHASES}, {base._ACTIVITY} select product_id, x.product_name, product_type, confidence, case when product_type is null then 'sin_tipo;' else '' end || case when confidence < 0.78 then 'baja_confianza;' else '' end || case when product_type = 'tapa' and capacity_value is not null then 'tapa_con_capacidad;' else '' end needs_review_reason,
        n_sales + n_purchases + abs(sales_total) / 100 activity_score from x join activity using (product_id) order by needs_review_reason desc, activity_score desc, confidence, product_id limit 40""",
    ),
    "unvalidated_sample": (
        lambda s, d: extraction.unvalidated_sample(extraction.with_activity(_rows(s, d), base._activity(s, d)), named_products(s, d).where("product_id % 2 = 0")),
        f"with {_ROWS}, {base._PRODUCTS}, {base._SALES}, {base._PURCHASES}, {base._ACTIVITY} select product_id, x.product_name, confidence, n_sales + n_purchases + abs(sales_total) / 100 + abs(purchases_total) / 100 activity_score from x join activity using (product_id) where product_id::bigint % 2 <> 0 order by activity_score desc, confidence, product_id limit 50",
    ),
    "description_sample": (lambda s, d: extraction.description_sample(_rows(s, d)), None),
    "uncovered_tokens": (
        lambda s, d: extraction.uncovered_tokens(base.QUERIES["token_profile"](s, d), RULES),
        f"with {base._PRODUCTS}, t as (select product_id, unnest({base._tokens('product_name')}) token from products) select token, count(*) n, count(distinct product_id) n_products from t where token not in ('BOLT', 'RING', 'PLATE', 'GEAR', 'ROD', 'GIZMO', 'SMALL', 'HOT') and length(token) > 2 group by token order by n desc, token limit 50",
    ),
    "retrievability": (lambda s, d: retrieval.retrievability(retrieval.search_documents(extraction.labelled(_rows(s, d)))), None),
    "retrievability_summary": (lambda s, d: retrieval.retrievability_summary(retrieval.retrievability(retrieval.search_documents(extraction.labelled(_rows(s, d))))), None),
    "word_search": (
        lambda s, d: retrieval.word_search("small bolt", products(s, d)),
        f"with {base._PRODUCTS}, n as (select *, upper(product_name) n from products) select product_id, product_name, cast({_WORD_SCORE} as bigint) n_common, contains(n, 'SMALL BOLT') is_part from n where {_WORD_SCORE} > 0 order by is_part desc, n_common desc, product_id limit 10",
    ),
    "product_linkage_fuzzy": (lambda s, d: retrieval.link_fuzzy(_typed(s, d), products(s, d)), None),
    "product_linkage_all": (lambda s, d: retrieval.link_all({"sales": _typed(s, d), "purchases": base._linked_lines(s, d)}, products(s, d)), None),
    "name_suggestions": (lambda s, d: retrieval.suggestions(_typed(s, d).select(F.col("source_name").alias("text")), products(s, d).select(F.col("product_name").alias("name"))), None),
    "customer_resolution": (
        lambda s, d: retrieval.resolve_parties(table(s, d, "customer").select(F.explode(F.array(F.lower("c_name"), F.expr("substring(c_name, 12)"), F.substring("c_name", 1, 8))).alias("text")), _customers(s, d)),
        f"with {_CUSTOMERS}, q as (select text, {base._norm('text')} t from asked), c as (select c_name party, {base._norm('c_name')} n from customer), h as (select text, 1 tier, party from q join c on t = n where t <> '' union all select text, 2, party from q join c on contains(n, t) where t <> '') select text, party from h qualify row_number() over (partition by text order by tier, party) = 1",
    ),
    "question_names": (
        lambda s, d: retrieval.named_in(_questions(s, d), _names(s, d)).select("text", "kind", "name"),
        f"""with asked as (select distinct text, ' ' || {base._norm('text')} || ' ' t from ({_QUESTIONS})), names as (select kind, {base._norm('name')} n, min(name) as name from (select 'product' kind, p_name as name from part union all select 'customer', c_name from customer union all select 'supplier', s_name from supplier) group by all)
        select text, kind, name from asked join names on n <> '' and contains(t, ' ' || n || ' ') qualify row_number() over (partition by text, kind order by length(n) - length(replace(n, ' ', '')) desc, instr(t, ' ' || n || ' '), name) = 1""",
    ),
    "intent_routing": (lambda s, d: retrieval.route(_questions(s, d)), None),
    "min_cost_flow": (lambda s, d: flows.min_cost_flow(_requests(s, d), base._options(s, d)), None),
    "flow_vs_baseline": (lambda s, d: answers.optimal_orders(_requests(s, d), base._options(s, d)), None),
    "contested_order": (
        lambda s, d: flows.contested_order(base._options(s, d)),
        f"""with {base._PURCHASES}, {base._OPTIONS}, held as (select supplier, sum(capacity_units) offered, max(supplier_capacity) capacity, count(distinct product_id) n from options group by supplier), chosen as (select supplier from held where offered > capacity and n >= 2 order by n desc, supplier limit 1)
        select 'contested' request, product_id, cast(capacity_units as bigint) ordered from options where supplier in (select supplier from chosen) order by capacity_units desc, product_id limit 4""",
    ),
    "max_flow": (
        lambda s, d: flows.max_flow(_requests(s, d), flows.min_cut(_requests(s, d), base._options(s, d))).drop("n_bottlenecks"),
        f"""with {base._SALES}, {base._PURCHASES}, {base._OPTIONS}, {_REQUESTS}, numbered as (select *, row_number() over (partition by request order by product_id) - 1 i from requests), masks as (select unnest(range(256)) mask), sides as (select request, mask, (mask >> i::int) & 1 = 1 inside, product_id, ordered from numbered, masks),
        outside as (select request, mask, coalesce(sum(ordered) filter (not inside), 0) units from sides group by all), held as (select request, mask, supplier, least(any_value(supplier_capacity), sum(capacity_units)) units from sides join options using (product_id) where inside group by all), cuts as (select request, mask, units from outside union all select request, mask, units from held),
        flow as (select request, min(units) max_flow from (select request, mask, sum(units) units from cuts group by all) group by request) select request, cast(sum(ordered) as bigint) demand, cast(any_value(max_flow) as bigint) max_flow, round(any_value(max_flow) / sum(ordered), 4) coverage from requests join flow using (request) group by request""",
    ),
    "min_cut_edges": (lambda s, d: flows.min_cut(_requests(s, d), base._options(s, d)), None),
    "semantic_search_batch": (lambda s, d: search_batch(search_index(base._edges(s, d)), _search_queries(s, d)), _SEARCHES.format(required="true")),
    "semantic_search_required": (
        lambda s, d: search_batch(search_index(base._edges(s, d)), _search_queries(s, d), required=_search_queries(s, d).select("query_id", "attribute")),
        _SEARCHES.format(required="product_id in (select product_id from e join q using (attribute) where q.query_id = scored.query_id)"),
    ),
    "projection_class_pairs": (
        lambda s, d: graph.class_pairs(graph.product_classes(base._edges(s, d))[0]),
        f"with {base._PRODUCTS}, {base._ATTRIBUTES}, {base._PROJECTION}, {_CLASSES} select product_a a, product_b b, n_shared, shared_weight, similarity from projection where product_a in (select class from classes) and product_b in (select class from classes)",
    ),
    "projection_members": (lambda s, d: graph.product_classes(base._edges(s, d))[1], f"with {base._PRODUCTS}, {base._ATTRIBUTES}, {base._PROJECTION}, {_CLASSES} select class, product_id from sets join classes using (items)"),
    "network_cut_edges": (lambda s, d: cuts.shared_cut(_demand(s, d), base._options(s, d)), None),
    "network_max_flow": (_network_flow, None),
    "top_tokens": (
        lambda s, d: extraction.top_tokens(products(s, d)),
        f"""with {base._PRODUCTS}, t as (select product_id, unnest({base._tokens('product_name')}) token from products) select token, count(*) token_count, count(distinct product_id) product_count, round(count(distinct product_id) / (select count(*) from products), 4) product_coverage
        from t group by token order by token_count desc, token limit 100""",
    ),
    "offer_savings": (
        lambda s, d: supply.savings(supply.offer_candidates(base._options(s, d))),
        f"""with {base._PURCHASES}, {base._OPTIONS}, {base._OFFERS} select product_id, supplier, unit_cost, reference_cost, edge_weight, saving, round(saving / reference_cost, 6) saving_pct, edge_weight < 0 is_negative_edge, case when edge_weight < 0 then 'historical_saving' else 'at_or_above_reference' end scenario_type from offers where reference_cost > 0""",
    ),
    "amount_identities": (_identities, _IDENTITIES),
    "shortest_path": (lambda s, d: paths.shortest_path(base._trade(s, d), *_ENDS), f"{_SHORTEST} select cast(step as bigint) step, node, n expanded from path, seen"),
    "bidirectional_path": (lambda s, d: paths.bidirectional_path(base._trade(s, d), *_ENDS), None),
    "path_comparison": (lambda s, d: paths.compare_searches(base._trade(s, d), *_ENDS), None),
    "saturated_suppliers": (lambda s, d: flows.saturated_suppliers(flows.min_cut(_requests(s, d), base._options(s, d))), None),
    "pagerank_converged": (lambda s, d: networks.pagerank_converged(base._trade(s, d)).select("node", F.round("rank", 7).alias("rank")), None),
    "top_ranked_products": (lambda s, d: _top_ranked(s, d), None),
    "cooccurrence_docs": (
        lambda s, d: networks.co_documents(_sales_graph(s, d), "PRODUCT|0"),
        f"with {base._SALES}, h as (select distinct customer, date, product_id from sales where is_active) select 'PRODUCT|' || y.product_id node_id, count(*) co_docs from h x join h y on x.customer = y.customer and x.date = y.date and x.product_id = '0' and y.product_id <> '0' group by y.product_id",
    ),
    "node_lookup": (
        lambda s, d: networks.find_nodes(table(s, d, "part").select(F.explode(F.array(F.concat(F.lit("PRODUCT:"), F.col("p_partkey").cast("string")), "p_name", F.substring("p_name", 2, 6))).alias("text")), _nodes(s, d)),
        f"""with {_ROWS}, {_GRAPH_EDGES}, asked as (select distinct unnest(['PRODUCT:' || p_partkey, p_name, substring(p_name, 2, 6)]) as text from part), q as (select text, {base._norm('text')} t from asked), m as (select node_id, {base._norm('label')} n from nodes),
        h as (select text, 1 tier, node_id from q join nodes on node_id = text union all select text, 2, node_id from q join m on n = t where t <> '' union all select text, 3, node_id from q join m on contains(n, t) where length(t) >= 3) select text, node_id from h qualify row_number() over (partition by text order by tier, node_id) = 1""",
    ),
    "family_neighbourhood": (
        lambda s, d: networks.neighbourhood(base._edges(s, d), base._edges(s, d).where("attribute in ('WORD:BOLT', 'WORD:ROD')").select("attribute")),
        f"""with {base._PRODUCTS}, {base._ATTRIBUTES}, e as (select distinct product_id, attribute from edges), g as (select product_id, count(*) n from e group by all), near as (select attribute centre, product_id from e join g using (product_id) where attribute in ('WORD:BOLT', 'WORD:ROD') qualify row_number() over (partition by attribute order by n desc, product_id) <= 35)
        select centre, product_id, attribute from near join e using (product_id)""",
    ),
    "txn_graph_nodes": (
        lambda s, d: networks.transaction_nodes(_sales_graph(s, d), products(s, d)),
        f"with {base._PRODUCTS}, {base._transactions('sales', 'customer', 'SOLD_TO').replace('named as', 'named as', 1)}, ends as (select source node_id from edges union select target from edges) select node_id, split_part(node_id, '|', 1) node_type, coalesce(product_name, substring(node_id, instr(node_id, '|') + 1)) as label from ends left join products on node_id = 'PRODUCT|' || product_id".replace("with ", f"with {base._SALES}, ", 1),
    ),
    "betweenness": (
        lambda s, d: _between(s, d).select("node", F.round("betweenness", 6).alias("betweenness")),
        f"""with recursive {base._PLACES}, walk(s, node, path) as (select 'S' || s_suppkey, 'S' || s_suppkey, ['S' || s_suppkey] from supplier union all select s, v, list_append(path, v) from walk join both_ways on u = node where not list_contains(path, v)),
        through as (select unnest(path[2:-2]) node from walk where len(path) > 2), counts as (select node, count(*) / 2 b from through group by node) select node, coalesce(b, 0) betweenness from (select distinct u node from both_ways) left join counts using (node)""",
    ),
    "communities": (lambda s, d: communities.product_communities(base._edges(s, d)), None),
    "community_quality": (lambda s, d: communities.community_quality(base._edges(s, d)), None),
    "community_terms": (_community_terms, None),
    "answer_families": (_answer_families, None),
    "answer_profile": (lambda s, d: _profiles(s, d), None),
    "answer_supplier": (lambda s, d: answers.convenient_suppliers(purchases(s, d), _supplier_between(s, d)), None),
    "answer_offers": (lambda s, d: answers.offer_summary(supply.offer_candidates(base._options(s, d))), f"with {base._PURCHASES}, {base._OPTIONS}, {base._OFFERS}, b as (select min(edge_weight) w from offers group by product_id) select case when w < 0 then 'OFFER' when w > 0 then 'EXPENSIVE' else 'REFERENCE' end scenario, count(*) n_products, cast(-sum(w) as double) saving from b group by all"),
    "answer_budget": (
        lambda s, d: answers.budget_answers(budget.greedy_budget(base._lots(s, d)), budget.knapsack(base._lots(s, d))),
        f"select a.customer, a.budget, a.units greedy_units, a.cost greedy_cost, b.units best_units, b.cost best_cost, b.units - a.units gain from ({base.ORACLE_SQL['greedy_budget']}) a join ({base.ORACLE_SQL['knapsack']}) b using (customer)",
    ),
    "personal_ranks": (lambda s, d: paths.personal_ranks(base._trade(s, d), table(s, d, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("S|"), F.col("s_name")).alias("node"))).select("seed", "node", F.round("rank", 6).alias("rank")), None),
    "answer_cross_sell": (
        lambda s, d: answers.cross_sell_answers(reports.association_rules(sales(s, d), 2, 0.0001, 0.01), reports.co_sales(sales(s, d)), products(s, d), reports.frequent_products(sales(s, d), 3)),
        f"""with {base._PRODUCTS}, {base._SALES}, {base._BASKETS}, asked as (select product_id from baskets group by product_id order by count(*) desc, product_id limit 3), big as (select customer, date from baskets group by all having count(*) > 1), every as (select * from baskets join big using (customer, date)), n as (select count(*) n from big),
        c as (select product_id, count(*) c from every group by all having count(*) >= 0.0001 * (select n from n)), items as (select * from every where product_id in (select product_id from c)),
        p as (select x.product_id antecedent, y.product_id consequent, count(*) n_pairs from items x join items y on x.customer = y.customer and x.date = y.date and x.product_id <> y.product_id where x.product_id in (select product_id from asked) group by all having count(*) >= 2),
        r as (select antecedent, consequent, n_pairs, n_pairs * n / (a.c * b.c) lift from p join c a on a.product_id = antecedent join c b on b.product_id = consequent, n where n_pairs >= 0.0001 * n and n_pairs >= 0.01 * a.c), best as (select * from r qualify row_number() over (partition by antecedent order by lift desc, consequent) <= 10),
        plain as (select x.product_id antecedent, y.product_id consequent, row_number() over (partition by x.product_id order by count(*) desc, y.product_id) co_rank from baskets x join baskets y on x.customer = y.customer and x.date = y.date and x.product_id <> y.product_id where x.product_id in (select product_id from asked) group by x.product_id, y.product_id qualify co_rank <= 10)
        select antecedent, consequent, product_name recommended, n_pairs, lift, co_rank from best left join products on product_id = consequent left join plain using (antecedent, consequent)""",
    ),
    "answer_risk": (lambda s, d: answers.risk_report(purchases(s, d), sales(s, d), flows.saturated_suppliers(flows.min_cut(_requests(s, d), base._options(s, d))), _supplier_between(s, d)), None),
    "answer_search": (lambda s, d: answers.product_search(retrieval.word_search("small bolts", products(s, d)), search(base._edges(s, d), "small bolts")), None),
}


def _top_ranked(spark, sf_dir):
    edges = _sales_graph(spark, sf_dir)
    return answers.top_product_nodes(networks.pagerank_converged(networks.both_ways(edges)), networks.transaction_nodes(edges, products(spark, sf_dir)))


def _profiles(spark, sf_dir, k=20):
    """Profiles of the k customers who spent most."""
    chosen = reports.client_top_products(sales(spark, sf_dir), 1).orderBy(F.col("value").desc(), "customer").limit(k).select("customer")
    chosen, lines = stored(chosen, "profile-chosen"), sales(spark, sf_dir).where("is_active")
    # three rounds leave only the chosen, what they bought, and the customers of that: all lines of these customers hold all steps of the walk
    bought = stored(lines.join(chosen, "customer", "left_semi").select("product_id").distinct(), "profile-bought")
    near = stored(lines.join(bought, "product_id", "left_semi").select("customer").distinct(), "profile-near")
    e = stored(lines.join(near, "customer", "left_semi").groupBy(F.concat(F.lit("C|"), "customer").alias("u"), F.col("product_id").alias("v")).agg(F.sum("total").alias("w")), "profile-edges")
    ranks = paths.personalised_pagerank(e.union(e.select("v", "u", "w")), chosen.select(F.concat(F.lit("C|"), "customer").alias("node")), 3)
    mine = sales(spark, sf_dir).join(F.broadcast(chosen), "customer", "left_semi")
    return answers.customer_profile(mine, ranks.select(F.expr("substr(seed, 3)").alias("seed"), "node", F.round("rank", 9).alias("rank")))


QUERIES = {k: v[0] for k, v in _REGISTRY.items()}
ORACLE_SQL = {k: v[1] for k, v in _REGISTRY.items() if v[1]}
