"""Relational reports over canonical sales and purchases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmart.functions.text import code_pattern
from quillmart.plans.canonical import running_total


def abc_classes(sales: DataFrame) -> DataFrame:
    """Products by value: those that make up the first 80 % are A, up to 95 % B, the rest C."""
    value = sales.where("is_active").groupBy("product_id", "product_name").agg(F.sum("total").alias("value"), F.sum("quantity").alias("quantity"))
    total = value.agg(F.sum("value").alias("all_value"))
    ranked = running_total(value, "value", [F.col("value").desc(), F.col("product_id"), F.col("product_name")], "cumulative").crossJoin(F.broadcast(total))
    share = F.col("cumulative") * 100
    return ranked.select("product_id", "product_name", "value", "quantity", "cumulative", F.when(share <= 80 * F.col("all_value"), "A").when(share <= 95 * F.col("all_value"), "B").otherwise("C").alias("class"))


def baskets(sales: DataFrame) -> DataFrame:
    """Distinct products of a customer's day."""
    return sales.where("is_active").select("customer", "date", "product_id").distinct()


def co_sales(sales: DataFrame) -> DataFrame:
    """How often two products are in one customer's day."""
    b = baskets(sales)
    pairs = b.alias("x").join(b.alias("y"), (F.col("x.customer") == F.col("y.customer")) & (F.col("x.date") == F.col("y.date")) & (F.col("x.product_id") < F.col("y.product_id")))
    return pairs.groupBy(F.col("x.product_id").alias("product_a"), F.col("y.product_id").alias("product_b")).agg(F.count("*").alias("n_baskets"))


def association_rules(sales: DataFrame, least_pairs: int = 2, min_support: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """Rules a -> b with support, confidence and lift over baskets of two products or more.

    Products under the least support go before pairs are made; pairs need it too, and at least `least_pairs` baskets.
    """
    sized = baskets(sales).groupBy("customer", "date").agg(F.collect_set("product_id").alias("items")).where(F.size("items") > 1)
    n = F.broadcast(sized.agg(F.count("*").alias("n")))
    items = sized.select("customer", "date", F.explode("items").alias("product_id"))
    counts = items.groupBy("product_id").agg(F.count("*").alias("c"))
    if min_support:
        counts = counts.crossJoin(n).where(F.col("c") >= min_support * F.col("n")).drop("n")
        items = items.join(counts.select("product_id"), "product_id", "left_semi")
    both = items.alias("x").join(items.alias("y"), (F.col("x.customer") == F.col("y.customer")) & (F.col("x.date") == F.col("y.date")) & (F.col("x.product_id") != F.col("y.product_id")))
    pairs = both.groupBy(F.col("x.product_id").alias("antecedent"), F.col("y.product_id").alias("consequent")).agg(F.count("*").alias("n_pairs")).where(F.col("n_pairs") >= least_pairs)
    a, b = counts.select(F.col("product_id").alias("antecedent"), F.col("c").alias("ca")), counts.select(F.col("product_id").alias("consequent"), F.col("c").alias("cb"))
    full = pairs.join(a, "antecedent").join(b, "consequent").crossJoin(n).where((F.col("n_pairs") >= min_support * F.col("n")) & (F.col("n_pairs") >= min_confidence * F.col("ca")))
    return full.select("antecedent", "consequent", "n_pairs", (F.col("n_pairs") / F.col("n")).alias("support"), (F.col("n_pairs") / F.col("ca")).alias("confidence"), (F.col("n_pairs") * F.col("n") / (F.col("ca") * F.col("cb"))).alias("lift"))


def cross_sell(rules: DataFrame, products: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """The k rules of highest lift for each asked product (column product_id), with the recommended product's name."""
    rank = F.row_number().over(Window.partitionBy("antecedent").orderBy(F.col("lift").desc(), "consequent"))
    mine = rules.join(asked.select(F.col("product_id").alias("antecedent")).distinct(), "antecedent", "left_semi").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    return mine.join(products.select(F.col("product_id").alias("consequent"), F.col("product_name").alias("recommended")), "consequent", "left").select("antecedent", "rank", "consequent", "recommended", "n_pairs", "lift")


def frequent_products(sales: DataFrame, k: int = 1) -> DataFrame:
    """product_id of the k products in most baskets."""
    return baskets(sales).groupBy("product_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "product_id").limit(k).select("product_id")


def supplier_dependency(purchases: DataFrame) -> DataFrame:
    """Suppliers' shares of purchase lines and of what is bought, with an alert by value."""
    value = purchases.where("is_active").groupBy("supplier").agg(F.count("*").alias("purchase_lines"), F.sum("total").alias("value"), F.count_distinct("product_id").alias("n_products"))
    total = value.agg(F.sum("value").alias("all_value"), F.sum("purchase_lines").alias("all_lines"))
    alert = F.when(F.col("value") * 100 > 30 * F.col("all_value"), "ALTA").when(F.col("value") * 100 > 15 * F.col("all_value"), "MEDIA").otherwise("ok")
    return value.crossJoin(F.broadcast(total)).select("supplier", "purchase_lines", "value", "n_products", (F.col("purchase_lines") / F.col("all_lines")).alias("line_share"), (F.col("value") / F.col("all_value")).alias("share"), alert.alias("alert"))


def _top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def client_top_products(sales: DataFrame, k: int = 5) -> DataFrame:
    grouped = sales.where("is_active").groupBy("customer", "product_id").agg(F.sum("total").alias("value"), F.sum("quantity").alias("quantity"), F.count_distinct("date").alias("n_dates"), F.max("date").alias("last_date"))
    return _top(grouped, "customer", [F.col("value").desc(), F.col("product_id")], k)


def product_top_suppliers(purchases: DataFrame, k: int = 3) -> DataFrame:
    grouped = purchases.where("is_active").groupBy("product_id", "supplier").agg(F.min("unit_cost").alias("least_cost"), F.sum("quantity").alias("quantity"), F.count("*").alias("n_lines"), F.max("date").alias("last_date"))
    return _top(grouped, "product_id", [F.col("least_cost"), F.col("n_lines").desc(), F.col("supplier")], k)


def transaction_flags(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, active, cancelled and adjusted ones, and the total, of normalised tables by name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows"), F.count_if("is_active").alias("n_active"), F.count_if("is_cancelled").alias("n_cancelled"), F.count_if("is_adjustment").alias("n_adjustment"), F.coalesce(F.sum("analysis_total"), F.lit(0.0)).alias("total"))
        part = one.select(F.lit(name).alias("dataset"), *one.columns)
        out = part if out is None else out.unionByName(part)
    return out


def product_activity(products: DataFrame, sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """Every product with the lines, units and totals that were sold and bought, zero where there are none."""
    side = lambda df, units, lines, total: df.where("is_active").groupBy("product_id").agg(F.sum("quantity").alias(units), F.count("*").alias(lines), F.sum("total").alias(total))
    sold, bought = side(sales, "sold", "n_sales", "sales_total"), side(purchases, "bought", "n_purchases", "purchases_total")
    full = products.select("product_id", "product_name").join(sold, "product_id", "left").join(bought, "product_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select("product_id", "product_name", *map(zero, ("sold", "n_sales", "sales_total", "bought", "n_purchases", "purchases_total")), F.col("sold").isNotNull().alias("has_sales"), F.col("bought").isNotNull().alias("has_purchases"))


def code_patterns(activity: DataFrame) -> DataFrame:
    """Products by the shape of their codes, with activity, shares of all totals and what that suggests. activity: as product_activity() gives it."""
    counts = activity.groupBy(code_pattern(F.col("product_id")).alias("pattern")).agg(
        F.count("*").alias("products"), F.count_if("has_sales").alias("products_with_sales"), F.count_if("has_purchases").alias("products_with_purchases"), F.sum("sales_total").alias("sales_total"), F.sum("purchases_total").alias("purchases_total")
    )
    all_ = F.broadcast(counts.agg(F.sum("sales_total").alias("s"), F.sum("purchases_total").alias("p")))
    share = lambda c, a: F.col(c) / F.greatest(F.col(a).cast("double"), F.lit(1.0))
    shared = counts.crossJoin(all_).withColumns({"sales_share": share("sales_total", "s"), "purchases_share": share("purchases_total", "p")}).drop("s", "p")
    idle = (F.col("products_with_sales") == 0) & (F.col("products_with_purchases") == 0)
    suggests = F.when(F.col("pattern") == "HAS_CANCEL_KEYWORD", "cancel_or_adjustment_pattern").when(idle, "inactive_pattern").when(F.col("sales_share") >= 0.95, "dominant_commercial_pattern").otherwise("review")
    return shared.withColumn("suggested_interpretation", suggests)


def amount_identity(lines: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Share of purchase lines whose quantity times unit cost is their total."""
    holds = F.abs(F.col("quantity") * F.col("unit_cost") - F.col("total")) <= tolerance * F.col("total")
    return lines.where("total > 0").agg(F.count("*").alias("n_rows"), F.count_if(holds).alias("n_hold"), (F.count_if(holds) / F.count("*")).alias("rate"))


def amount_identities(checks: dict[str, tuple[DataFrame, Column, Column, Column]], tolerance: float = 0.03, passes: float = 0.85) -> DataFrame:
    """dataset, valid_rows, match_rate, passes: of each table (rows, quantity, unit price, total) the share of rows whose quantity times unit price is their total, up to a share of it.

    Rows with a null or a total of 0 are not valid; a table without valid rows has a rate of 0 and does not pass.
    """
    out = None
    for name, (rows, quantity, unit, total) in checks.items():
        off = F.abs(quantity * unit - total) / F.abs(total)
        valid = (total != 0) & quantity.isNotNull() & unit.isNotNull() & total.isNotNull()
        row = rows.agg(F.count_if(valid).alias("valid_rows"), F.count_if(valid & (off <= tolerance)).alias("n")).select(F.lit(name).alias("dataset"), "valid_rows", (F.col("n") / F.greatest("valid_rows", F.lit(1))).alias("rate"))
        out = row if out is None else out.unionByName(row)
    return out.select("dataset", "valid_rows", F.round("rate", 4).alias("match_rate"), (F.col("rate") >= passes).alias("passes"))


def demand(sales: DataFrame) -> DataFrame:
    return sales.where("is_active").groupBy("product_id").agg(F.sum("quantity").alias("units")).where("units > 0")


def supplier_removal(purchases: DataFrame, sales: DataFrame) -> DataFrame:
    """Per supplier: its products, those that nobody else supplies, and what was sold of all of them."""
    active = purchases.where("is_active").select("supplier", "product_id").distinct()
    sources = active.groupBy("product_id").agg(F.count("*").alias("n_suppliers"))
    sold = demand(sales)
    full = active.join(sources, "product_id").join(sold, "product_id", "left")
    return full.groupBy("supplier").agg(F.count("*").alias("n_products"), F.count_if(F.col("n_suppliers") == 1).alias("n_single_source"), F.coalesce(F.sum("units"), F.lit(0)).alias("units_at_risk"))


def customer_supply(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """For each customer's top products the cheapest supplier."""
    best = product_top_suppliers(purchases, 1).select("product_id", "supplier", "least_cost")
    return client_top_products(sales, 3).select("customer", "product_id", "value").join(best, "product_id", "left")
