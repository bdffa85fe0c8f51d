"""Registry of the commerce queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.functions.text import STOP_WORDS, normalized, tokens
from quillmart.operators import attributes, budget, graph, linkage, normalize, paths, reports, supply
from quillmart.plans.canonical import products, purchases, sales, table

_PRODUCTS = "products as (select cast(p_partkey as varchar) product_id, p_name product_name, p_type category, p_brand brand from part)"
_SALES = """sales as (select cast(o_orderdate as date) date, c_name customer, cast(l_partkey as varchar) product_id, p_name product_name, cast(l_quantity as bigint) quantity,
  cast(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) as bigint) total, l_returnflag <> 'R' is_active
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""
_PURCHASES = """purchases as (select cast(l_shipdate as date) date, s_name supplier, n_regionkey + 1 delivery_days, cast(l_partkey as varchar) product_id, cast(l_quantity as bigint) quantity,
  cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) unit_cost, cast(floor(l_extendedprice * 100 + 0.5) as bigint) total, l_returnflag <> 'R' is_active
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""
_BASKETS = "baskets as (select distinct customer, date, product_id from sales where is_active)"
_OPTIONS = """capacity as (select supplier, max(units) supplier_capacity from (select supplier, date, sum(quantity) units from purchases where is_active group by all) group by supplier),
options as (select product_id, supplier, min(unit_cost) unit_cost, cast(sum(unit_cost) as bigint) cost_sum, max(quantity) capacity_units, count(*) n_lines, max(date) last_purchase, cast(min(delivery_days) as bigint) delivery_days, cast(any_value(supplier_capacity) as bigint) supplier_capacity
  from purchases left join capacity using (supplier) where is_active and quantity > 0 and unit_cost > 0 group by product_id, supplier)"""
_OFFERS = """offers as (select o.product_id, supplier, unit_cost, reference_cost, n_suppliers, reference_cost - unit_cost saving, unit_cost - reference_cost edge_weight,
  case when reference_cost > unit_cost then 'OFFER' when reference_cost < unit_cost then 'EXPENSIVE' else 'REFERENCE' end scenario
  from options o join (select product_id, median(unit_cost) reference_cost, count(distinct supplier) n_suppliers from options group by product_id having count(distinct supplier) > 1) r using (product_id))"""
_TOP_CLIENT = "client_top as (select * from (select *, row_number() over (partition by customer order by value desc, product_id) rank from (select customer, product_id, cast(sum(total) as bigint) value, cast(sum(quantity) as bigint) quantity, count(distinct date) n_dates, max(date) last_date from sales where is_active group by customer, product_id)))"
_TOP_SUPPLIER = "supplier_top as (select * from (select *, row_number() over (partition by product_id order by least_cost, n_lines desc, supplier) rank from (select product_id, supplier, min(unit_cost) least_cost, cast(sum(quantity) as bigint) quantity, count(*) n_lines, max(date) last_date from purchases where is_active group by product_id, supplier)))"
_ORDERED = "ordered as (select product_id, cast(greatest(1, sum(quantity) // 4) as bigint) ordered from sales where is_active group by product_id)"
_STOP = f"({', '.join(repr(w) for w in STOP_WORDS)})"


def _norm(column: str) -> str:
    return f"trim(regexp_replace(upper(strip_accents(replace(coalesce({column}, ''), 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g'))"


def _tokens(column: str) -> str:
    return f"list_filter(string_split({_norm(column)}, ' '), lambda t: t <> '' and t not in {_STOP})"


_ATTRIBUTES = f"""edges as (
  select product_id, 'WORD:' || unnest(list_distinct({_tokens("product_name")})) attribute, 'WORD' relation, 90 weight from products union all
  select product_id, 'CATEGORY:' || unnest(list_distinct({_tokens("category")})), 'CATEGORY', 75 from products union all
  select product_id, 'BRAND:' || {_norm("brand")}, 'BRAND', 80 from products)"""
_PROJECTION = """kept as (select attribute from edges group by attribute having count(distinct product_id) <= greatest(2, floor(0.35 * (select count(distinct product_id) from edges)))),
used as (select product_id, attribute, max(weight) w from edges where attribute in (select attribute from kept) group by all),
mass as (select product_id, sum(w) mass from used group by all),
projection as (select product_a, product_b, n_shared, cast(shared_weight as bigint) shared_weight, shared_weight / (a.mass + b.mass - shared_weight) similarity from
  (select x.product_id product_a, y.product_id product_b, sum(least(x.w, y.w)) shared_weight, count(*) n_shared from used x join used y on x.attribute = y.attribute and x.product_id < y.product_id group by all having count(*) >= 2)
  join mass a on a.product_id = product_a join mass b on b.product_id = product_b where shared_weight / (a.mass + b.mass - shared_weight) >= 0.3)"""


def _transactions(lines: str, party: str, relation: str) -> str:
    return f"""named as (select *, 'DOC|' || {party} || '|' || cast(date as varchar) doc from {lines} where is_active),
edges as (select doc source, 'PRODUCT|' || product_id target, 'CONTAINS' relation, total weight from named union all
  select distinct doc, 'PARTY|' || {party}, '{relation}', 1 from named union all select distinct doc, 'DATE|' || cast(date as varchar), 'ON_DATE', 1 from named)"""


#: Supplier and nation graph for paths and components: suppliers and customers hang on their nations, nations on their regions.
_PLACES = """places as (select 'S' || s_suppkey u, 'N' || s_nationkey v from supplier union all select 'C' || c_custkey, 'N' || c_nationkey from customer union all select 'N' || n_nationkey, 'R' || n_regionkey from nation),
both_ways as (select u, v from places union select v, u from places)"""


def _places(spark, sf_dir):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    s = table(spark, sf_dir, "supplier").select(text("S", "s_suppkey").alias("u"), text("N", "s_nationkey").alias("v"))
    c = table(spark, sf_dir, "customer").select(text("C", "c_custkey").alias("u"), text("N", "c_nationkey").alias("v"))
    n = table(spark, sf_dir, "nation").select(text("N", "n_nationkey").alias("u"), text("R", "n_regionkey").alias("v"))
    return graph.undirected(s.union(c).union(n), "u", "v")


def _trade(spark, sf_dir):
    """Suppliers and products, weighted by lines."""
    e = purchases(spark, sf_dir).where("is_active").groupBy(F.concat(F.lit("S|"), "supplier").alias("u"), F.concat(F.lit("P|"), "product_id").alias("v")).agg(F.count("*").alias("w"))
    return e.union(e.select("v", "u", "w"))


def _pagerank_sql(rounds: int) -> str:
    steps = "".join(f", r{i} as (select m.v node, 0.15 / (select count(*) from out_) + 0.85 * sum(rank * p) rank from m join r{i - 1} on r{i - 1}.node = m.u group by m.v)" for i in range(1, rounds + 1))
    return f"""with {_PURCHASES}, e as (select 'S|' || supplier u, 'P|' || product_id v, count(*) w from purchases where is_active group by all), both_ways as (select u, v, w from e union all select v, u, w from e),
out_ as (select u, sum(w) o from both_ways group by u), m as (select b.u, v, w / o p from both_ways b join out_ using (u)), r0 as (select u node, 1.0 / (select count(*) from out_) rank from out_){steps}
select node, round(rank, 9) rank from r{rounds}"""


def _ordered(spark, sf_dir):
    """An order of a quarter of what was sold."""
    return reports.demand(sales(spark, sf_dir)).select("product_id", F.greatest(F.lit(1), F.floor(F.col("units") / 4)).cast("long").alias("ordered"))


def _activity(spark, sf_dir):
    return reports.product_activity(products(spark, sf_dir), sales(spark, sf_dir), purchases(spark, sf_dir))


_ACTIVITY = """a as (select product_id, cast(sum(quantity) as bigint) sold, count(*) n_sales, cast(sum(total) as bigint) sales_total from sales where is_active group by all), b as (select product_id, cast(sum(quantity) as bigint) bought, count(*) n_purchases, cast(sum(total) as bigint) purchases_total from purchases where is_active group by all),
activity as (select product_id, product_name, coalesce(sold, 0) sold, coalesce(n_sales, 0) n_sales, coalesce(sales_total, 0) sales_total, coalesce(bought, 0) bought, coalesce(n_purchases, 0) n_purchases, coalesce(purchases_total, 0) purchases_total, sold is not null has_sales, bought is not null has_purchases from products left join a using (product_id) left join b using (product_id))"""


def _options(spark, sf_dir):
    return supply.supply_options(purchases(spark, sf_dir))


def _alloc(spark, sf_dir, *by):
    return supply.allocate(_options(spark, sf_dir), _ordered(spark, sf_dir), by)


def _alloc_sql(order: str) -> str:
    return f"""with {_SALES}, {_PURCHASES}, {_OPTIONS}, {_ORDERED},
split as (select product_id, supplier, unit_cost, delivery_days, supplier_capacity, cast(greatest(0, least(capacity_units, ordered - coalesce(sum(capacity_units) over (partition by product_id order by {order}, supplier rows between unbounded preceding and 1 preceding), 0))) as bigint) units from options join ordered using (product_id))"""


def _edges(spark, sf_dir):
    return graph.attribute_edges(products(spark, sf_dir))


def _linked_lines(spark, sf_dir):
    """Lines with the product's id as it is, as a number with leading zeros, or only the name."""
    key, kind = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 3
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.when(kind == 0, key).when(kind == 1, F.concat(F.lit("00"), key)).alias("source_id"), F.when(kind == 2, F.concat(F.lit(" "), F.upper("p_name"), F.lit("!"))).otherwise(F.col("p_name")).alias("source_name"))


def _asked(spark, sf_dir):
    """Texts that name products: ids, names, parts of names, and words turned round."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("i"), F.col("p_name").alias("n"))
    return p.select(F.explode(F.array("i", "n", F.substring("n", 2, 5), F.array_join(F.reverse(F.split("n", " ")), " "))).alias("text"))


def _lots(spark, sf_dir):
    return budget.requests(sales(spark, sf_dir), _options(spark, sf_dir))


def _rules(spark, sf_dir):
    return attributes.rule_attributes(products(spark, sf_dir), RULES)


def _walk_sql(seed: str, rounds: int) -> str:
    steps = "".join(f", r{i} as (select node, sum(rank) rank from (select m.v node, 0.85 * rank * p rank from m join r{i - 1} on r{i - 1}.node = m.u union all select '{seed}', 0.15) group by node)" for i in range(1, rounds + 1))
    return f"""with {_PURCHASES}, e as (select 'S|' || supplier u, 'P|' || product_id v, count(*) w from purchases where is_active group by all), both_ways as (select u, v, w from e union all select v, u, w from e),
out_ as (select u, sum(w) o from both_ways group by u), m as (select b.u, v, w / o p from both_ways b join out_ using (u)), r0 as (select '{seed}' node, 1.0::double rank){steps}
select '{seed}' seed, node, round(rank, 9) rank from r{rounds}"""


#: Keyword rules of the registered queries: attribute, method, value, keywords, confidence.
RULES = [
    ("finish", "keyword_first_match", "bright", ["BLUE", "RED"], 0.94),
    ("finish", "keyword_first_match", "matte", ["OLD", "COLD"], 0.85),
    ("size", "keyword_any", "small", ["SMALL", "ROD"], 0.9),
    ("size", "keyword_any", "large", ["LARGE", "SMALL"], 0.9),
    ("fastener", "contains_any", "yes", ["BOLT", "RING", "GEAR"], 0.8),
    ("set", "keyword_any", "cold widget", ["COLD WIDGET"], 0.7),
    ("plain", "not_contains_any", "yes", ["BOLT", "HOT"], 0.6),
]
_LOTS = """spent as (select customer, product_id, sum(total) v, sum(quantity) quantity from sales where is_active group by all),
top as (select * from spent qualify row_number() over (partition by customer order by v desc, product_id) <= 5),
cheapest as (select product_id, unit_cost, capacity_units from options qualify row_number() over (partition by product_id order by unit_cost, supplier, capacity_units) = 1),
priced as (select customer, product_id, unit_cost, cast(least(quantity, capacity_units) as bigint) units, cast(least(quantity, capacity_units) * unit_cost as bigint) cost from top join cheapest using (product_id)),
lots as (select *, cast(floor(sum(cost) over (partition by customer) / 2) as bigint) budget, row_number() over (partition by customer order by unit_cost, product_id) i from priced)"""
_RULES_SQL = """p as (select product_id, trim(regexp_replace(upper(product_name), '[^A-Z0-9]+', ' ', 'g')) n from products),
ruled as (select product_id, 'finish' attribute, case when list_has_any(string_split(n, ' '), ['BLUE', 'RED']) then 'bright' when list_has_any(string_split(n, ' '), ['OLD', 'COLD']) then 'matte' end as value, case when list_has_any(string_split(n, ' '), ['BLUE', 'RED']) then 0.94::double else 0.85::double end confidence from p
  union all select product_id, 'size', nullif(concat_ws('|', case when list_has_any(string_split(n, ' '), ['SMALL', 'ROD']) then 'small' end, case when list_has_any(string_split(n, ' '), ['LARGE', 'SMALL']) then 'large' end), ''), 0.9::double from p
  union all select product_id, 'fastener', case when contains(n, 'BOLT') or contains(n, 'RING') or contains(n, 'GEAR') then 'yes' end, 0.8::double from p
  union all select product_id, 'set', case when contains(n, 'COLD WIDGET') then 'cold widget' end, 0.7::double from p
  union all select product_id, 'plain', case when not (contains(n, 'BOLT') or contains(n, 'HOT')) then 'yes' end, 0.6::double from p),
attrs as (select * from ruled where value is not null)"""
_SEARCH = f"""with recursive {_PRODUCTS}, {_ATTRIBUTES}, e as (select product_id, attribute, max(weight) w from edges group by all),
seeds as (select distinct attribute from e where string_split(attribute, ':')[-1] in ('SMALL', 'BOLTS', 'BOLT')),
second as (select distinct attribute from e where product_id in (select product_id from e where attribute in (select attribute from seeds))),
reached(attribute) as (select attribute from seeds union select y.attribute from reached r join e x on x.attribute = r.attribute join e y on y.product_id = x.product_id),
decay as (select attribute, case when attribute in (select attribute from seeds) then 5 when attribute in (select attribute from second) then 3 else 1 end d from reached),
scored as (select product_id, sum(d * w) base, count(*) filter (d = 5) seed_coverage from e join decay using (attribute) group by product_id), t as (select count(*) total_seeds from seeds)
select product_id, round(base * (power(seed_coverage / total_seeds, 2) * 20 + 1), 2) relevance, seed_coverage, total_seeds from scored, t order by relevance desc, product_id limit 10"""
_UPPER = r"translate(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', ' ', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_MEASURES = f"""with t as (select doc_id, {_UPPER} u from documents), m as (select doc_id, try_cast(replace(nullif(regexp_extract(u, '{attributes.CAPACITY}', 1), ''), ',', '.') as double) capacity_value, nullif(regexp_extract(u, '{attributes.CAPACITY}', 2), '') unit,
  try_cast(coalesce(nullif(regexp_extract(u, '{attributes.MOUTH[0]}', 1), ''), nullif(regexp_extract(u, '{attributes.MOUTH[1]}', 1), '')) as double) mouth_size, nullif(regexp_extract(u, '{attributes.SIZE}', 0), '') size_text from t)
select doc_id, capacity_value, case when unit in ('LT', 'LTR') then 'L' when unit = 'G' then 'GR' else unit end capacity_unit, mouth_size, size_text,
  round((case when unit is null then 0 else 0.95::double end + case when mouth_size is null then 0 else 0.92::double end + case when size_text is null then 0 else 0.93::double end) / nullif((unit is not null)::int + (mouth_size is not null)::int + (size_text is not null)::int, 0), 6) confidence from m"""


def _profile_sql(columns: list[str], source: str) -> str:
    number = "try_cast(replace(regexp_replace(x, '[^0-9,.-]', '', 'g'), ',', '.') as double)"
    one = lambda c: f"""select '{c}' column_name, count(*) n_rows, count(*) filter (x is null) n_null, count(distinct x) n_distinct, count({number}) n_number, count(*) filter (regexp_matches(x, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) n_date, min({number}) least, max({number}) largest,
        array_to_string(list_sort(list(distinct x))[1:5], '|') samples from (select cast({c} as varchar) x from {source})"""  # noqa: E731
    return " union all ".join(map(one, columns))


_SPLIT = "select product_id, supplier, units, unit_cost, delivery_days, units * unit_cost cost from split where units > 0"
_REGISTRY = {
    "abc_classes": (lambda s, d: reports.abc_classes(sales(s, d)), f"""with {_SALES}, v as (select product_id, product_name, cast(sum(total) as bigint) value, cast(sum(quantity) as bigint) quantity from sales where is_active group by all),
        c as (select *, cast(sum(value) over (order by value desc, product_id, product_name rows unbounded preceding) as bigint) cumulative, sum(value) over () all_value from v)
        select product_id, product_name, value, quantity, cumulative, case when cumulative * 100 <= 80 * all_value then 'A' when cumulative * 100 <= 95 * all_value then 'B' else 'C' end class from c"""),
    "co_sales_pairs": (lambda s, d: reports.co_sales(sales(s, d)), f"with {_SALES}, {_BASKETS} select x.product_id product_a, y.product_id product_b, count(*) n_baskets from baskets x join baskets y on x.customer = y.customer and x.date = y.date and x.product_id < y.product_id group by all"),
    "association_rules": (lambda s, d: reports.association_rules(sales(s, d)), f"""with {_SALES}, {_BASKETS}, big as (select customer, date from baskets group by all having count(*) > 1), items as (select * from baskets join big using (customer, date)),
        c as (select product_id, count(*) c from items group by all), n as (select count(*) n from big), p as (select x.product_id antecedent, y.product_id consequent, count(*) n_pairs from items x join items y on x.customer = y.customer and x.date = y.date and x.product_id <> y.product_id group by all having count(*) >= 2)
        select antecedent, consequent, n_pairs, n_pairs / n support, n_pairs / a.c confidence, n_pairs * n / (a.c * b.c) lift from p join c a on a.product_id = antecedent join c b on b.product_id = consequent, n"""),
    "supplier_dependency": (lambda s, d: reports.supplier_dependency(purchases(s, d)), f"""with {_PURCHASES}, v as (select supplier, count(*) purchase_lines, cast(sum(total) as bigint) value, count(distinct product_id) n_products from purchases where is_active group by supplier), t as (select *, sum(value) over () a, sum(purchase_lines) over () l from v)
        select supplier, purchase_lines, value, n_products, purchase_lines / l line_share, value / a share, case when value * 100 > 30 * a then 'ALTA' when value * 100 > 15 * a then 'MEDIA' else 'ok' end alert from t"""),
    "client_top_products": (lambda s, d: reports.client_top_products(sales(s, d)), f"with {_SALES}, {_TOP_CLIENT} select * from client_top where rank <= 5"),
    "product_top_suppliers": (lambda s, d: reports.product_top_suppliers(purchases(s, d)), f"with {_PURCHASES}, {_TOP_SUPPLIER} select * from supplier_top where rank <= 3"),
    "customer_supply_join": (lambda s, d: reports.customer_supply(sales(s, d), purchases(s, d)), f"with {_SALES}, {_PURCHASES}, {_TOP_CLIENT}, {_TOP_SUPPLIER} select c.customer, c.product_id, c.value, s.supplier, s.least_cost from client_top c left join supplier_top s on s.product_id = c.product_id and s.rank = 1 where c.rank <= 3"),
    "product_activity": (_activity, f"with {_PRODUCTS}, {_SALES}, {_PURCHASES}, {_ACTIVITY} select * from activity"),
    "code_patterns": (lambda s, d: reports.code_patterns(_activity(s, d)), f"""with {_PRODUCTS}, {_SALES}, {_PURCHASES}, {_ACTIVITY}, c as (select case when length(product_id) > 1 and product_id like '0%' then 'LEADING_ZERO_NUM_' || length(product_id) else 'NUM_' || length(product_id) || '_DIGITS' end pattern, count(*) products, count(*) filter (has_sales) products_with_sales, count(*) filter (has_purchases) products_with_purchases, cast(sum(sales_total) as bigint) sales_total, cast(sum(purchases_total) as bigint) purchases_total from activity group by all),
        x as (select *, sales_total / greatest(sum(sales_total) over (), 1) sales_share, purchases_total / greatest(sum(purchases_total) over (), 1) purchases_share from c)
        select *, case when products_with_sales = 0 and products_with_purchases = 0 then 'inactive_pattern' when sales_share >= 0.95 then 'dominant_commercial_pattern' else 'review' end suggested_interpretation from x"""),
    "amount_identity": (lambda s, d: reports.amount_identity(purchases(s, d)), f"with {_PURCHASES}, t as (select abs(quantity * unit_cost - total) <= 0.03 * total h from purchases where total > 0) select count(*) n_rows, count(*) filter (h) n_hold, count(*) filter (h) / count(*) rate from t"),
    "demand": (lambda s, d: reports.demand(sales(s, d)), f"with {_SALES} select product_id, cast(sum(quantity) as bigint) units from sales where is_active group by product_id having sum(quantity) > 0"),
    "supplier_removal_impact": (lambda s, d: reports.supplier_removal(purchases(s, d), sales(s, d)), f"""with {_SALES}, {_PURCHASES}, a as (select distinct supplier, product_id from purchases where is_active), n as (select product_id, count(*) n from a group by all), u as (select product_id, sum(quantity) units from sales where is_active group by all having sum(quantity) > 0)
        select supplier, count(*) n_products, count(*) filter (n = 1) n_single_source, cast(coalesce(sum(units), 0) as bigint) units_at_risk from a join n using (product_id) left join u using (product_id) group by supplier"""),
    "supplier_daily_capacity": (lambda s, d: supply.daily_capacity(purchases(s, d)), f"with {_PURCHASES}, {_OPTIONS} select supplier, cast(supplier_capacity as bigint) capacity from capacity"),
    "supply_options": (_options, f"with {_PURCHASES}, {_OPTIONS} select * from options"),
    "offer_candidates": (lambda s, d: supply.offer_candidates(_options(s, d)), f"with {_PURCHASES}, {_OPTIONS}, {_OFFERS} select * from offers"),
    "offer_best_paths": (lambda s, d: supply.best_offers(supply.offer_candidates(_options(s, d))), f"with {_PURCHASES}, {_OPTIONS}, {_OFFERS} select product_id, supplier, edge_weight, unit_cost from offers qualify row_number() over (partition by product_id order by edge_weight, supplier) = 1"),
    "cheapest_split": (lambda s, d: _alloc(s, d, "unit_cost"), f"{_alloc_sql('unit_cost')} {_SPLIT}"),
    "fastest_split": (lambda s, d: _alloc(s, d, "delivery_days", "unit_cost"), f"{_alloc_sql('delivery_days, unit_cost')} {_SPLIT}"),
    "capacity_violations": (lambda s, d: supply.flow_capacity_violations(_alloc(s, d, "unit_cost"), _options(s, d)), f"{_alloc_sql('unit_cost')} select supplier, cast(sum(units) as bigint) assigned, cast(sum(units * unit_cost) as bigint) cost, any_value(supplier_capacity) supplier_capacity, sum(units) > any_value(supplier_capacity) violated from split where units > 0 group by supplier"),
    "normalized_names": (lambda s, d: table(s, d, "documents").select("doc_id", normalized(F.col("text")).alias("normalized")), f"select doc_id, {_norm('text')} normalized from documents"),
    "token_profile": (lambda s, d: products(s, d).select("product_id", F.explode(tokens(F.col("product_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("product_id").alias("n_products")), f"with {_PRODUCTS}, t as (select product_id, unnest({_tokens('product_name')}) token from products) select token, count(*) n, count(distinct product_id) n_products from t group by token"),
    "attr_graph_edges": (_edges, f"with {_PRODUCTS}, {_ATTRIBUTES} select * from edges"),
    "degree_top": (lambda s, d: graph.attribute_degrees(_edges(s, d)).orderBy(F.col("degree").desc(), "attribute").limit(20), f"with {_PRODUCTS}, {_ATTRIBUTES} select attribute, count(distinct product_id) degree from edges group by attribute order by degree desc, attribute limit 20"),
    "product_projection": (lambda s, d: graph.product_projection(_edges(s, d)), f"with {_PRODUCTS}, {_ATTRIBUTES}, {_PROJECTION} select * from projection"),
    "top_similar": (lambda s, d: graph.top_similar_products(_edges(s, d)), f"with {_PRODUCTS}, {_ATTRIBUTES}, {_PROJECTION}, b as (select product_a product_id, product_b other, similarity from projection union all select product_b, product_a, similarity from projection) select *, row_number() over (partition by product_id order by similarity desc, other) rank from b qualify rank <= 5"),
    "attribute_cooccurrence": (lambda s, d: graph.attribute_cooccurrence(_edges(s, d)), f"with {_PRODUCTS}, {_ATTRIBUTES}, e as (select distinct product_id, attribute from edges) select x.attribute attribute_a, y.attribute attribute_b, count(*) n_products from e x join e y on x.product_id = y.product_id and x.attribute < y.attribute group by all having count(*) >= 3"),
    "txn_graph_sales": (lambda s, d: graph.relation_counts(graph.transaction_edges(sales(s, d), "customer", "SOLD_TO")), f"with {_SALES}, {_transactions('sales', 'customer', 'SOLD_TO')} select relation, count(*) n_edges, count(distinct source) n_sources, count(distinct target) n_targets from edges group by relation"),
    "txn_graph_purchases": (lambda s, d: graph.relation_counts(graph.transaction_edges(purchases(s, d), "supplier", "ISSUED_BY")), f"with {_PURCHASES}, {_transactions('purchases', 'supplier', 'ISSUED_BY')} select relation, count(*) n_edges, count(distinct source) n_sources, count(distinct target) n_targets from edges group by relation"),
    "connected_components": (lambda s, d: graph.components(_places(s, d)), f"with recursive {_PLACES}, reach(node, other) as (select u, u from both_ways union select node, v from reach join both_ways on u = other) select node, min(other) label from reach group by node"),
    "bfs_distance": (lambda s, d: graph.hop_distances(_places(s, d), "S1"), f"with recursive {_PLACES}, walk(node, distance) as (select 'S1', 0 union select v, distance + 1 from walk join both_ways on u = node where distance < 6) select node, cast(min(distance) as bigint) distance from walk group by node"),
    "offer_edges": (lambda s, d: paths.offer_edges(supply.offer_candidates(_options(s, d))), f"""with {_PURCHASES}, {_OPTIONS}, {_OFFERS} select distinct 'SOURCE' source, 'PRODUCT:' || product_id target, 0::double weight, 'start_product' edge_type from offers
        union all select 'PRODUCT:' || product_id, 'OPTION:' || product_id || ':' || supplier, edge_weight::double, scenario from offers union all select 'OPTION:' || product_id || ':' || supplier, 'SINK:' || product_id, 0, 'finish_product' from offers"""),
    "bellman_ford_distances": (lambda s, d: paths.bellman_ford(paths.offer_edges(supply.offer_candidates(_options(s, d))), "SOURCE").select("node", "distance"), f"""with {_PURCHASES}, {_OPTIONS}, {_OFFERS} select 'SOURCE' node, 0::double distance union all select distinct 'PRODUCT:' || product_id, 0 from offers
        union all select 'OPTION:' || product_id || ':' || supplier, edge_weight from offers union all select 'SINK:' || product_id, min(edge_weight) from offers group by product_id"""),
    "bidirectional_path_length": (lambda s, d: paths.bidirectional_length(_places(s, d), "S1", "C7"), f"with recursive {_PLACES}, walk(node, distance) as (select 'S1', 0 union select v, distance + 1 from walk join both_ways on u = node where distance < 6) select 'S1' as start, 'C7' as goal, cast(min(distance) as bigint) length from walk where node = 'C7'"),
    "ppr_k": (lambda s, d: paths.personalised_pagerank(_trade(s, d), s.range(1).select(F.lit("S|Supplier#000000001").alias("node"))).select("seed", "node", F.round("rank", 9).alias("rank")), _walk_sql("S|Supplier#000000001", 5)),
    "greedy_budget": (lambda s, d: budget.greedy_budget(_lots(s, d)), f"""with recursive {_SALES}, {_PURCHASES}, {_OPTIONS}, {_LOTS}, fold(customer, budget, i, units, cost) as (select distinct customer, budget, 0::bigint, 0::bigint, 0::bigint from lots
        union all select f.customer, f.budget, f.i + 1, case when f.cost + l.cost <= f.budget then f.units + l.units else f.units end, case when f.cost + l.cost <= f.budget then f.cost + l.cost else f.cost end from fold f join lots l on l.customer = f.customer and l.i = f.i + 1)
        select customer, budget, units, cost from fold qualify row_number() over (partition by customer order by i desc) = 1"""),
    "knapsack": (lambda s, d: budget.knapsack(_lots(s, d)), f"""with {_SALES}, {_PURCHASES}, {_OPTIONS}, {_LOTS}, chosen as (select customer, any_value(budget) budget, mask, cast(coalesce(sum(units) filter ((mask >> (i - 1)::int) & 1 = 1), 0) as bigint) units, cast(coalesce(sum(cost) filter ((mask >> (i - 1)::int) & 1 = 1), 0) as bigint) cost from lots, (select unnest(range(32))::int mask) group by customer, mask)
        select customer, budget, units, cost from chosen where cost <= budget qualify row_number() over (partition by customer order by units desc, cost, mask) = 1"""),
    "per_sku_order": (lambda s, d: _alloc(s, d, "unit_cost").groupBy("product_id").agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"), F.count("*").alias("n_suppliers"), F.max("delivery_days").alias("delivery_days")), f"{_alloc_sql('unit_cost')} select product_id, cast(sum(units) as bigint) units, cast(sum(units * unit_cost) as bigint) cost, count(*) n_suppliers, max(delivery_days) delivery_days from split where units > 0 group by product_id"),
    "attribute_measures": (lambda s, d: attributes.measures(table(s, d, "documents"), "doc_id", "text"), _MEASURES),
    "attribute_extract": (_rules, f"with {_PRODUCTS}, {_RULES_SQL} select * from attrs"),
    "attribute_coverage": (lambda s, d: attributes.coverage(_rules(s, d), products(s, d)), f"with {_PRODUCTS}, {_RULES_SQL} select attribute, count(distinct product_id) n_products, count(distinct value) n_values, round(avg(confidence), 6) mean_confidence, count(distinct product_id) / (select count(*) from products) share from attrs group by attribute"),
    "threshold_sensitivity": (lambda s, d: attributes.threshold_sensitivity(_edges(s, d), products(s, d)), f"with {_PRODUCTS}, {_ATTRIBUTES} select threshold, count(*) n_edges, count(distinct product_id) n_products, count(distinct attribute) n_attributes, (select count(*) from products) - count(distinct product_id) n_orphans from edges, (select unnest(range(60, 95, 5))::int threshold) where weight >= threshold group by threshold"),
    "focus_subgraph": (lambda s, d: attributes.focus_subgraph(_edges(s, d)), f"with {_PRODUCTS}, {_ATTRIBUTES}, e as (select distinct product_id, attribute from edges), t as (select attribute from e group by attribute order by count(*) desc, attribute limit 16), near as (select * from e where attribute in (select attribute from t)), c as (select product_id from near group by product_id order by count(*) desc, product_id limit 120) select * from near where product_id in (select product_id from c)"),
    "semantic_search": (lambda s, d: attributes.search(_edges(s, d), "small bolts"), _SEARCH),
    "product_linkage_exact": (lambda s, d: linkage.link_products(_linked_lines(s, d), products(s, d)), f"""with {_PRODUCTS}, first_named as (select {_norm('product_name')} n, min(product_id) id from products group by n), lines as (select distinct case l_linenumber % 3 when 0 then l_partkey::varchar when 1 then '00' || l_partkey end source_id, case when l_linenumber % 3 = 2 then ' ' || upper(p_name) || '!' else p_name end source_name from lineitem join part on l_partkey = p_partkey)
        select source_id, source_name, coalesce(a.product_id, b.product_id, c.id) product_id, case when a.product_id is not null then 1.0::double when b.product_id is not null then 0.98::double when c.id is not null then 0.95::double else 0 end confidence,
        case when a.product_id is not null then 'product_id_exact' when b.product_id is not null then 'product_id_numeric_equivalent' when c.id is not null then 'product_name_exact_normalized' else 'none' end as method
        from lines left join products a on a.product_id = source_id left join products b on b.product_id = cast(try_cast(source_id as bigint) as varchar) left join first_named c on c.n = {_norm('source_name')}"""),
    "entity_resolution": (lambda s, d: linkage.resolve(_asked(s, d), products(s, d)), f"""with {_PRODUCTS}, names as (select {_norm('product_name')} n, min(product_id) id from products group by n), asked as (select distinct unnest([product_id, product_name, substring(product_name, 2, 5), array_to_string(list_reverse(string_split(product_name, ' ')), ' ')]) as text from products), q as (select text, {_norm('text')} t from asked),
        hits as (select text, 1 tier, 0 size, product_id from q join products on product_id = text union all select text, 2, 0, id from q join names on n = t union all select text, 3, 0, id from q join names on contains(n, t) where t <> '' union all select text, 4, length(n), id from q join names on list_has_all(string_split(n, ' '), string_split(t, ' ')) where t <> '')
        select text, product_id, cast(tier as bigint) tier from hits qualify row_number() over (partition by text order by tier, size, product_id) = 1"""),
    "column_profile": (lambda s, d: normalize.profile(table(s, d, "part")), _profile_sql(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "part")),
    "column_profile_dates": (lambda s, d: normalize.profile(table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority")), _profile_sql(["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"], "(select * replace (cast(o_orderdate as date) as o_orderdate) from orders)")),
    "cross_sell_for_product": (lambda s, d: reports.cross_sell(reports.association_rules(sales(s, d)), products(s, d), reports.frequent_products(sales(s, d), 3)), f"""with {_PRODUCTS}, {_SALES}, {_BASKETS}, asked as (select product_id from baskets group by product_id order by count(*) desc, product_id limit 3), big as (select customer, date from baskets group by all having count(*) > 1), items as (select * from baskets join big using (customer, date)),
        c as (select product_id, count(*) c from items group by all), n as (select count(*) n from big), p as (select x.product_id antecedent, y.product_id consequent, count(*) n_pairs from items x join items y on x.customer = y.customer and x.date = y.date and x.product_id <> y.product_id where x.product_id in (select product_id from asked) group by all having count(*) >= 2),
        r as (select antecedent, consequent, n_pairs, n_pairs * n / (a.c * b.c) lift from p join c a on a.product_id = antecedent join c b on b.product_id = consequent, n)
        select antecedent, row_number() over (partition by antecedent order by lift desc, consequent) rank, consequent, product_name recommended, n_pairs, lift from r left join products on product_id = consequent qualify rank <= 10"""),
    "business_graph_metrics": (lambda s, d: graph.relation_counts(graph.transaction_edges(sales(s, d), "customer", "SOLD_TO").unionByName(graph.transaction_edges(purchases(s, d), "supplier", "ISSUED_BY"))), f"""with {_SALES}, {_PURCHASES}, s as (select *, 'DOC|' || customer || '|' || cast(date as varchar) doc from sales where is_active), p as (select *, 'DOC|' || supplier || '|' || cast(date as varchar) doc from purchases where is_active),
        edges as (select doc source, 'PRODUCT|' || product_id target, 'CONTAINS' relation from s union all select distinct doc, 'PARTY|' || customer, 'SOLD_TO' from s union all select distinct doc, 'DATE|' || cast(date as varchar), 'ON_DATE' from s union all select doc, 'PRODUCT|' || product_id, 'CONTAINS' from p union all select distinct doc, 'PARTY|' || supplier, 'ISSUED_BY' from p union all select distinct doc, 'DATE|' || cast(date as varchar), 'ON_DATE' from p)
        select relation, count(*) n_edges, count(distinct source) n_sources, count(distinct target) n_targets from edges group by relation"""),
    "pagerank_k": (lambda s, d: graph.pagerank(_trade(s, d)).select("node", F.round("rank", 9).alias("rank")), _pagerank_sql(5)),
}
QUERIES = {k: v[0] for k, v in _REGISTRY.items()}
ORACLE_SQL = {k: v[1] for k, v in _REGISTRY.items()}
