"""The engine's queries over the star schema, each with SQL over the plain tables that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import WideLayer, wide_layer
from .functions.periods import day_key, month_key
from .graph import SchemaGraph
from .operators import probe
from .operators.equivalence import find_equivalents
from .operators.virtual import add_monthly_summaries, add_period_anchor, consolidate, key_overlap
from .plans.compose import ComposeOptions
from .plans.expand import ExpansionError
from .plans.fold import fold
from .plans.infer import by_key, by_name, by_tokens
from .plans.select import explicit, greedy, lattice, profiles
from .reports import grading, quality
from .reports.information import column_bits
from .reports.text import kind_of
from .sources.catalog import from_frames, star_schema
from .types import Catalog, Edge

Query = Callable[[SparkSession, str], DataFrame]


def orders_layer(spark: SparkSession, sf_dir: str, **options) -> WideLayer:
    return wide_layer(spark, star_schema(spark, sf_dir), ["orders", "customer", "nation", "part", "lineitem"], **{"prefix_joined_fields": False, "expose_child_filters": True, "field_budget": 1_000, **options})


def asked(sql: str, **options) -> Query:
    """A query over the wide models."""
    return lambda spark, sf_dir: orders_layer(spark, sf_dir, **options).query(sql)


#: name: (query over the wide models, query over the tables).
WIDE: dict[str, tuple[str, str]] = {
    "wide_base_projection": ("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders"),
    "wide_key_only_count": ("SELECT COUNT(*) AS n FROM orders", "SELECT COUNT(*) AS n FROM orders"),
    "wide_select_star": ("SELECT * FROM nation", "SELECT n_nationkey, n_name, r_name, cc AS customers_count, cb AS customers_c_acctbal_sum, sc AS suppliers_count, sb AS suppliers_s_acctbal_sum FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, COUNT(*) AS cc, SUM(c_acctbal) AS cb FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, COUNT(*) AS sc, SUM(s_acctbal) AS sb FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey"),
    "wide_one_hop": ("SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY c_mktsegment", "SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "wide_two_hop": ("SELECT n_name, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY n_name", "SELECT n_name, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "wide_three_hop": ("SELECT r_name, ROUND(AVG(o_totalprice), 2) AS mean FROM orders GROUP BY r_name", "SELECT r_name, ROUND(AVG(o_totalprice), 2) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "wide_child_count": ("SELECT o_orderkey, lineitems_count FROM orders", "SELECT o_orderkey, n AS lineitems_count FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
    "wide_child_sum": ("SELECT o_orderkey, ROUND(lineitems_l_extendedprice_sum, 2) AS price FROM orders", "SELECT o_orderkey, ROUND(s, 2) AS price FROM orders LEFT JOIN (SELECT l_orderkey, SUM(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
    "wide_reaggregate": ("SELECT c_mktsegment, ROUND(SUM(lineitems_l_quantity_sum), 2) AS qty, SUM(lineitems_count) AS n FROM orders GROUP BY c_mktsegment", "SELECT c_mktsegment, ROUND(SUM(l_quantity), 2) AS qty, COUNT(l_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"),
    "fanout_guard": ("SELECT ROUND(SUM(o_totalprice), 2) AS total, ROUND(SUM(lineitems_l_quantity_sum), 2) AS qty FROM orders", "SELECT ROUND((SELECT SUM(o_totalprice) FROM orders), 2) AS total, ROUND((SELECT SUM(l_quantity) FROM lineitem), 2) AS qty"),
    "childless_parent_kept": ("SELECT o_orderkey, lineitems_count FROM orders WHERE lineitems_count IS NULL", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS lineitems_count FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
    "push_filter_child": ("SELECT n_name, ROUND(SUM(o_totalprice), 2) AS revenue, ROUND(SUM(lineitems_l_quantity_sum), 2) AS qty FROM orders WHERE lineitems_l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY n_name", "SELECT n_name, ROUND(SUM(o_totalprice), 2) AS revenue, ROUND(SUM(q), 2) AS qty FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"),
    "push_filter_all_pass": ("SELECT COUNT(*) AS n FROM orders WHERE lineitems_l_shipdate >= TIMESTAMP '1995-01-01'", "SELECT COUNT(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01'"),
    "push_filter_and_paren": ("SELECT COUNT(*) AS n, ROUND(SUM(lineitems_l_quantity_sum), 2) AS qty FROM orders WHERE (lineitems_l_returnflag = 'R' AND (o_totalprice > 100000))", "SELECT COUNT(*) AS n, ROUND(SUM(q), 2) AS qty FROM orders JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > 100000"),
    "push_filter_two_children": ("SELECT n_name, customers_count, suppliers_count FROM nation WHERE customers_c_mktsegment = 'BUILDING' AND suppliers_s_name <> 'x'", "SELECT n_name, cc AS customers_count, sc AS suppliers_count FROM nation JOIN (SELECT c_nationkey, COUNT(*) AS cc FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, COUNT(*) AS sc FROM supplier WHERE s_name <> 'x' GROUP BY 1) ON s_nationkey = n_nationkey"),
    "push_filter_child_dimension": ("SELECT COUNT(*) AS n, ROUND(SUM(lineitems_l_quantity_sum), 2) AS qty FROM orders WHERE lineitems_p_size BETWEEN 10 AND 20 AND lineitems_l_discount > 0.05", "SELECT COUNT(*) AS n, ROUND(SUM(q), 2) AS qty FROM orders JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 10 AND 20 AND l_discount > 0.05 GROUP BY 1) ON l_orderkey = o_orderkey"),
    "outer_having": ("SELECT n_name, COUNT(*) AS n FROM orders GROUP BY n_name HAVING COUNT(*) > 590", "SELECT n_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING COUNT(*) > 590"),
    "outer_having_alias": ("SELECT c_mktsegment, COUNT(*) AS n FROM orders GROUP BY 1 HAVING n > 10 ORDER BY n DESC", "SELECT c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING COUNT(*) > 10"),
    "outer_orderby_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "outer_limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20"),
    "outer_case": ("SELECT r_name, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, COUNT(*) AS n FROM orders GROUP BY r_name", "SELECT r_name, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "outer_scalar_subquery": ("SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)"),
    "outer_subquery_pushed_alone": ("SELECT COUNT(*) AS n FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE lineitems_l_returnflag = 'R')", "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "outer_cte": ("WITH top AS (SELECT n_name, SUM(o_totalprice) AS t FROM orders GROUP BY n_name) SELECT COUNT(*) AS n, ROUND(MAX(t), 2) AS most FROM top", "WITH top AS (SELECT n_name, SUM(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT COUNT(*) AS n, ROUND(MAX(t), 2) AS most FROM top"),
    "outer_derived_table": ("SELECT COUNT(*) AS n FROM (SELECT c_name, SUM(o_totalprice) AS t FROM orders GROUP BY c_name) q WHERE t > 100000", "SELECT COUNT(*) AS n FROM (SELECT c_name, SUM(o_totalprice) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) q WHERE t > 100000"),
    "outer_union": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "outer_intersect_except": ("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT o_orderkey FROM orders WHERE r_name = 'ASIA' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000 AND r_name = 'ASIA' AND o_orderstatus <> 'F'"),
    "outer_window_rank": ("SELECT o_orderkey, r_name, RANK() OVER (PARTITION BY r_name ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders", "SELECT o_orderkey, r_name, CAST(RANK() OVER (PARTITION BY r_name ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "outer_window_frame": ("SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) AS before, COUNT(*) OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders", "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) AS before, COUNT(*) OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders JOIN customer ON o_custkey = c_custkey"),
    "outer_rollup": ("SELECT r_name, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ROLLUP (r_name, o_orderstatus)", "SELECT r_name, o_orderstatus, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, o_orderstatus)"),
    "outer_cube": ("SELECT r_name, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY CUBE (r_name, o_orderstatus)", "SELECT r_name, o_orderstatus, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, o_orderstatus)"),
    "outer_grouping_sets": ("SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((c_mktsegment), (o_orderpriority), ())", "SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment), (o_orderpriority), ())"),
    "outer_distinct": ("SELECT DISTINCT n_name, o_orderstatus FROM orders", "SELECT DISTINCT n_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "outer_predicates": ("SELECT COUNT(*) AS n FROM orders WHERE c_name LIKE '%1%' AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 300000 AND c_mktsegment IS NOT NULL", "SELECT COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name LIKE '%1%' AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 300000 AND c_mktsegment IS NOT NULL"),
    "outer_string_date_math": ("SELECT YEAR(o_orderdate) AS y, SUBSTRING(o_orderpriority, 1, 1) AS p, COUNT(*) AS n, ROUND(SUM(o_totalprice) / CASE WHEN COUNT(*) = 0 THEN NULL ELSE COUNT(*) END, 2) AS mean, ROUND(COALESCE(MAX(ABS(o_totalprice)), 0), 2) AS most FROM orders GROUP BY 1, 2", "SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS y, SUBSTRING(o_orderpriority, 1, 1) AS p, COUNT(*) AS n, ROUND(SUM(o_totalprice) / COUNT(*), 2) AS mean, ROUND(MAX(ABS(o_totalprice)), 2) AS most FROM orders GROUP BY 1, 2"),
    "part_child_filter": ("SELECT p_brand, SUM(lineitems_count) AS n FROM part WHERE lineitems_l_shipdate < TIMESTAMP '1996-01-01' GROUP BY p_brand", "SELECT p_brand, COUNT(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1"),
    "fact_anchor_dimensions": ("SELECT p_brand, r_name, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY p_brand, r_name", "SELECT p_brand, r_name, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
}
#: Of the two ways from lines to regions the supplier's is the shorter, so it has the plain name.
OPTIONS: dict[str, dict] = {"fact_anchor_dimensions": {"max_hops": 4}}


def _select_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders_layer(spark, sf_dir).query(WIDE["wide_select_star"][0])
    return df.withColumns({c: F.round(c, 2) for c, t in df.dtypes if t == "double"})


# --- shapes that the plain star schema lacks -------------------------------------


def _with(catalog: Catalog, frames: dict[str, DataFrame], keys=None, edges=()) -> Catalog:
    more = from_frames(frames, keys or {}, ())
    return Catalog((*catalog.tables, *more.tables), (*catalog.edges, *edges))


def min_max_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = orders_layer(spark, sf_dir, aggregates=("sum", "avg", "min", "max"))
    return wide.query("SELECT o_orderkey, ROUND(lineitems_l_quantity_avg, 4) AS mean, lineitems_l_quantity_min AS low, lineitems_l_quantity_max AS high FROM orders")


def role_playing_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = star_schema(spark, sf_dir)
    orders = base.table("orders").frame(spark)
    trips = orders.select("o_orderkey", F.col("o_custkey").alias("bill_to_id"), (F.col("o_custkey") % 100 + 1).alias("ship_to_id"))
    catalog = _with(base, {"trips": trips}, {"trips": ("o_orderkey",)}, (Edge("trips", ("bill_to_id",), "customer", ("c_custkey",)), Edge("trips", ("ship_to_id",), "customer", ("c_custkey",))))
    return wide_layer(spark, catalog, ["trips"], max_hops=1).query("SELECT bill_to_c_mktsegment AS bill, ship_to_c_mktsegment AS ship, COUNT(*) AS n FROM trips GROUP BY 1, 2")


def role_playing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = star_schema(spark, sf_dir)
    orders = base.table("orders").frame(spark)
    links = orders.select(F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("src_cust_id"), (F.col("o_custkey") % 50 + 1).alias("dst_cust_id"), F.col("o_totalprice").alias("qty"), F.col("o_orderstatus").alias("kind"))
    catalog = _with(base, {"moves": links}, {"moves": ("link_id",)}, (Edge("moves", ("src_cust_id",), "customer", ("c_custkey",)), Edge("moves", ("dst_cust_id",), "customer", ("c_custkey",))))
    return wide_layer(spark, catalog, ["customer"], field_budget=1_000).query("SELECT c_custkey, moves_count AS sent, dst_cust_moves_count AS got, ROUND(dst_cust_moves_qty_sum, 2) AS qty FROM customer")


def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = star_schema(spark, sf_dir)
    supply = base.table("lineitem").frame(spark).groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("sold"))
    catalog = _with(base, {"supply": supply}, {"supply": ("l_partkey", "l_suppkey")}, (Edge("lineitem", ("l_partkey", "l_suppkey"), "supply", ("l_partkey", "l_suppkey")),))
    return wide_layer(spark, catalog, ["lineitem"], prefix_joined_fields=False, field_budget=1_000).query("SELECT sold, COUNT(*) AS n FROM lineitem GROUP BY sold")


def _periods(spark: SparkSession, sf_dir: str) -> Catalog:
    base = star_schema(spark, sf_dir)
    orders = base.table("orders").frame(spark).select("o_orderkey", "o_custkey", "o_totalprice", month_key("o_orderdate").alias("YYYYMM"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", day_key("ts").alias("YYYYMMDD"))
    lines = base.table("lineitem").frame(spark).select("l_orderkey", "l_partkey", "l_quantity", day_key("l_shipdate").alias("YYYYMMDD"))
    catalog = _with(Catalog(tuple(t for t in base.tables if t.name in ("customer", "part")), ()), {"f_orders": orders, "f_events": events, "f_lines": lines}, {"f_orders": ("o_orderkey",), "f_events": ("event_id",)}, (Edge("f_orders", ("o_custkey",), "customer", ("c_custkey",)), Edge("f_lines", ("l_partkey",), "part", ("p_partkey",))))
    return add_monthly_summaries(add_period_anchor(catalog))


def period_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir).table("V_PERIOD").frame(spark)


def period_two_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_layer(spark, _periods(spark, sf_dir), ["V_PERIOD"], field_budget=1_000)
    return wide.query("SELECT YYYYMM, f_orders_count AS orders, ROUND(f_lines_l_quantity_sum, 2) AS qty, f_events_count AS events FROM V_PERIOD")


def derived_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_layer(spark, _periods(spark, sf_dir), ["f_lines"], prefix_joined_fields=False, field_budget=1_000)
    return wide.query("SELECT YYYY, COUNT(*) AS n FROM f_lines GROUP BY YYYY")


def monthly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(spark, sf_dir).table("V_f_lines_MON").frame(spark).select("YYYYMM", "l_partkey", F.round("l_quantity", 2).alias("qty"), "ROW_CNT")


def monthly_summary_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_layer(spark, _periods(spark, sf_dir), ["V_f_lines_MON"], prefix_joined_fields=False, field_budget=1_000)
    return wide.query("SELECT YYYYMM, p_brand, ROUND(SUM(l_quantity), 2) AS qty, SUM(ROW_CNT) AS n FROM V_f_lines_MON GROUP BY YYYYMM, p_brand")


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = star_schema(spark, sf_dir)
    customers = base.table("customer").frame(spark)
    spans = customers.select(F.col("c_custkey").alias("h_custkey"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half")).select("h_custkey", F.concat(F.lit("grade"), "half").alias("grade"), F.when(F.col("half") == 0, F.lit("1990-01-01")).otherwise(F.lit("1998-01-01")).cast("timestamp_ntz").alias("valid_from"), F.when(F.col("half") == 0, F.lit("1997-12-31 23:59:59")).otherwise(F.lit("2100-01-01")).cast("timestamp_ntz").alias("valid_to"))
    catalog = _with(base, {"grades": spans}, {"grades": ("h_custkey", "valid_from")}, (Edge("orders", ("o_custkey",), "grades", ("h_custkey",), condition="{L}.o_custkey = {R}.h_custkey AND {L}.o_orderdate BETWEEN {R}.valid_from AND {R}.valid_to"),))
    return wide_layer(spark, catalog, ["orders"], prefix_joined_fields=False, field_budget=1_000).query("SELECT grade, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY grade")


def _links(spark: SparkSession, sf_dir: str) -> WideLayer:
    return wide_layer(spark, star_schema(spark, sf_dir), ["orders"], expose_groupable_children=True, prefix_joined_fields=False, field_budget=1_000)


def link_axis_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).query("SELECT lineitems_p_name AS name, lineitems_o_orderkey_count AS orders FROM orders")


def link_axis_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).query("SELECT lineitems_p_brand AS brand, lineitems_s_name AS supplier, o_orderstatus AS status, lineitems_o_orderkey_count AS orders FROM orders WHERE lineitems_s_name < 'Supplier#000000020'")


def _slices(spark: SparkSession, sf_dir: str) -> Catalog:
    """The lines as one table for each month; the driver sees the first and the last date."""
    base = star_schema(spark, sf_dir)
    lines = base.table("lineitem").frame(spark).select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    kind = lines.schema["l_shipdate"].dataType
    low, high = lines.agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    months = [divmod(k, 12) for k in range(12 * low.year + low.month - 1, 12 * high.year + high.month + 1)]
    begins = [F.lit(f"{y}-{m + 1:02}-01").cast(kind) for y, m in months]
    frames = {f"F_LINES_{y}{m + 1:02}": lines.where((F.col("l_shipdate") >= a) & (F.col("l_shipdate") < b)).drop("l_shipdate") for (y, m), a, b in zip(months, begins, begins[1:], strict=False)}
    return _with(base, frames, {n: ("l_orderkey",) for n in frames}, tuple(Edge(n, ("l_partkey",), "part", ("p_partkey",)) for n in frames))


def snapshot_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, _ = consolidate(_slices(spark, sf_dir))
    wide = wide_layer(spark, catalog, ["F_LINES"], prefix_joined_fields=False, field_budget=1_000)
    return wide.query("SELECT SNAPSHOT_YYYYMM AS month, p_brand, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM F_LINES GROUP BY 1, 2")


def snapshot_period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog, _ = consolidate(_slices(spark, sf_dir))
    wide = wide_layer(spark, catalog, ["part"], field_budget=1_000, expose_child_filters=True)
    return wide.query("SELECT SUM(f_lines_count) AS n FROM part WHERE f_lines_SNAPSHOT_YYYYMM = '199602'")


def snapshot_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _slices(spark, sf_dir)
    return key_overlap(*(c.table(f"F_LINES_{m}").frame(spark).select("l_orderkey") for m in ("199601", "199602")))


# --- probes ------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fk_violation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.violations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), [F.col("doc_id")], ["doc_id"])


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.orphans(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), [("doc_id", "doc_id")]).select("doc_id")


def containment_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.containment(_read(spark, sf_dir, "events"), "user_id", _read(spark, sf_dir, "customer"), "c_custkey")


def distinct_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.distinct_widths(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"])


def pk_unique_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = from_frames({"nation": _read(spark, sf_dir, "nation"), "lineitem": _read(spark, sf_dir, "lineitem")}, {"nation": ("n_regionkey", "n_nationkey"), "lineitem": ("l_orderkey", "l_linenumber")})
    found = probe.unique_parts(spark, c)
    return spark.createDataFrame([(t, k[0]) for t, k in found.items()], "table_name string, column_name string")


def mutual_determination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.pair_width(_read(spark, sf_dir, "nation"), "n_nationkey", "n_name")


def equivalent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").withColumn("nation_cd", F.concat(F.lit("N"), "n_nationkey"))
    found = find_equivalents(spark, from_frames({"nation": nation}, {"nation": ("n_nationkey",)}))
    return spark.createDataFrame([(g.table, c) for g in found for c in g.columns], "table_name string, column_name string")


def information_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_bits(_read(spark, sf_dir, "customer")).select("column_name", "n_distinct", F.round("bits", 6).alias("bits"))


def _renamed(spark: SparkSession, sf_dir: str) -> Catalog:
    orders, customers, items = (_read(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    return from_frames(
        {
            "customers": customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
            "orders": orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), "o_totalprice"),
            "items": items.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("SA_PART_CD"), "l_quantity"),
            "d_sa_part": _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("PART_CD"), "p_name"),
            "labels": _read(spark, sf_dir, "labels"),
            "documents": _read(spark, sf_dir, "documents").select("doc_id", "lang"),
        },
        {"customers": ("id",), "orders": ("id",), "d_sa_part": ("PART_CD",), "documents": ("doc_id",)},
    )


def _edges(spark: SparkSession, edges) -> DataFrame:
    return spark.createDataFrame([(e.child, ",".join(e.child_cols), e.parent) for e in edges], "child string, child_columns string, parent string")


def infer_fk_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, by_name(_renamed(spark, sf_dir)))


def infer_fk_by_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, by_key(_renamed(spark, sf_dir)))


def infer_fk_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, by_tokens(_renamed(spark, sf_dir)))


def recover_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, probe.recover(spark, _renamed(spark, sf_dir)).edges)


# --- metadata of the fold -------------------------------------------------------------


def fact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p.name, p.role.value, p.score) for p in profiles(SchemaGraph.build(star_schema(spark, sf_dir)))], "table_name string, role string, score double")


def candidate_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c.name, len(c.reach), len(c.inlined)) for c in lattice(SchemaGraph.build(star_schema(spark, sf_dir)), ComposeOptions())], "table_name string, reach int, inlined int")


def greedy_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = greedy(lattice(SchemaGraph.build(star_schema(spark, sf_dir)), ComposeOptions()))
    return spark.createDataFrame([(k, a, s.stop) for k, a in enumerate(s.anchors)], "place int, anchor string, stop string")


def explicit_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lattice(SchemaGraph.build(star_schema(spark, sf_dir)), ComposeOptions())
    return spark.createDataFrame([(a,) for a in explicit(c, ["region", "nation", "customer", "orders", "lineitem"], drop_redundant=True).anchors], "anchor string")


def layer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = orders_layer(spark, sf_dir)
    return spark.createDataFrame([(f.name, kind_of(f)) for f in wide.layer.model("orders").fields], "field string, kind string")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = orders_layer(spark, sf_dir)
    return spark.createDataFrame([r for r in quality.lineage(wide.layer) if r[0] == "orders" and r[2] == "joined"], "model string, field string, kind string, source string, path string")


def fidelity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = orders_layer(spark, sf_dir)
    f = quality.fidelity(wide.layer, wide.graph)
    return spark.createDataFrame([(f.columns.of + f.noise, f.joins.have, f.joins.of, f.pairs.have, f.pairs.of)], "columns_total int, edges_absorbed int, edges_total int, pairs_answered int, pairs_total int")


def compression_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([r for r in quality.compression(orders_layer(spark, sf_dir).layer) if r[0] == "nation"], "model string, table_name string, kind string, fields int")


#: Queries over the wide model, graded by the sums of all orders by nation.
GRADED = {
    "same": "SELECT n_name, SUM(o_totalprice) AS revenue FROM orders GROUP BY n_name",
    "most": "SELECT n_name, SUM(o_totalprice) AS revenue FROM orders WHERE o_totalprice >= 20000 GROUP BY n_name",
    "one_status": "SELECT n_name, SUM(o_totalprice) AS revenue FROM orders WHERE o_orderstatus = 'F' GROUP BY n_name",
    "nothing": "SELECT n_name, SUM(o_totalprice) AS revenue FROM orders WHERE o_totalprice < 0 GROUP BY n_name",
    "unreadable": "SELECT n_name, SUM(no_such_field) AS revenue FROM orders GROUP BY n_name",
}


def value_match_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, tables = orders_layer(spark, sf_dir), star_schema(spark, sf_dir)
    orders, customer, nation = (tables.table(n).frame(spark) for n in ("orders", "customer", "nation"))
    wanted = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("o_totalprice").alias("total"))
    out = []
    for name, sql in GRADED.items():
        g = grading.grade(wanted, lambda sql=sql: wide.query(sql))
        out.append((name, g.verdict, g.wanted_rows, g.got_rows, g.wanted_total, g.got_total, g.same_rows))
    return spark.createDataFrame(out, "name string, verdict string, wanted_rows long, got_rows long, wanted_total double, got_total double, same_rows boolean")


#: Only what a query that can't be read gives is stated; all other values are computed.
GRADED_SQL = """
WITH priced AS (SELECT n_name, o_totalprice AS x, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
sums AS (
  SELECT 'same' AS name, n_name, SUM(x) AS t FROM priced GROUP BY 2
  UNION ALL SELECT 'most', n_name, SUM(x) FROM priced WHERE x >= 20000 GROUP BY 2
  UNION ALL SELECT 'one_status', n_name, SUM(x) FROM priced WHERE s = 'F' GROUP BY 2
  UNION ALL SELECT 'nothing', n_name, SUM(x) FROM priced WHERE x < 0 GROUP BY 2),
figures AS (
  SELECT name, COUNT(n_name) AS n, ROUND(COALESCE(SUM(t), 0), 2) AS total, STRING_AGG(n_name || ROUND(t, 4), ',' ORDER BY n_name) AS all_rows
  FROM (VALUES ('same'), ('most'), ('one_status'), ('nothing')) AS v(name) LEFT JOIN sums USING (name) GROUP BY name)
SELECT g.name,
       CASE WHEN g.n = w.n AND (w.n = 0 OR ABS(w.total - g.total) < 0.1) THEN 'EXACT_VALUE_MATCH'
            WHEN w.total > 0 AND g.total > 0 AND ABS(w.total - g.total) / GREATEST(1, w.total) < 0.05 THEN 'CLOSE_VALUE_MATCH'
            WHEN g.n > 0 THEN 'PARTIAL_ROW_MATCH' ELSE 'EXEC_SUCCESS' END AS verdict,
       w.n AS wanted_rows, g.n AS got_rows, w.total AS wanted_total, g.total AS got_total, COALESCE(g.all_rows, '') = COALESCE(w.all_rows, '') AS same_rows
FROM figures g, figures w WHERE w.name = 'same'
UNION ALL SELECT 'unreadable', 'FAIL', n, 0, total, 0, FALSE FROM figures WHERE name = 'same'
"""


REJECTED = {
    "unparseable": "SELEC 1",
    "cte_shadows": "WITH orders AS (SELECT 1 AS x) SELECT x FROM orders",
    "self_join": "SELECT COUNT(*) FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey",
    "no_model": "SELECT 1 FROM nowhere",
    "two_models": "SELECT COUNT(*) FROM orders, nation",
    "unknown_field": "SELECT no_such_field FROM orders",
    "filter_selected": "SELECT lineitems_l_shipdate FROM orders",
    "filter_in_or": "SELECT COUNT(*) FROM orders WHERE lineitems_l_returnflag = 'R' OR o_totalprice > 1",
    "filter_grouped": "SELECT COUNT(*) FROM orders GROUP BY lineitems_l_returnflag",
    "two_filters_in_one": "SELECT COUNT(*) FROM orders WHERE lineitems_l_tax > lineitems_l_discount",
    "physical_table": "SELECT COUNT(*) FROM orders JOIN supplier ON o_orderkey = s_suppkey",
    "not_a_query": "DELETE FROM orders",
    "accepted": "SELECT COUNT(*) FROM orders",
}


def expand_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, out = orders_layer(spark, sf_dir), []
    for name, sql in REJECTED.items():
        try:
            wide.expand(sql)
            out.append((name, "accepted"))
        except ExpansionError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "rule string, outcome string")


def text_equals_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of the rendered SQL and of the DataFrame of a whole model differ: none."""
    wide = orders_layer(spark, sf_dir)
    for t in wide.graph.catalog.tables:
        t.frame(spark).createOrReplaceTempView(t.name)
    names = [f.name for f in wide.layer.model("orders").fields if not f.filter_only]
    sql = f"SELECT {', '.join(names)} FROM orders"
    text, frame = spark.sql(wide.expand(sql).sql), wide.query(sql)
    near = lambda df: df.select(*(F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    a, b = near(text), near(frame)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differing"))


def answerable_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources.goldset import Case

    wide = wide_layer(spark, star_schema(spark, sf_dir), ["orders"], prefix_joined_fields=False)
    cases = [Case("A_1", "A", "", "", frozenset({("orders", "o_totalprice"), ("nation", "n_name")})), Case("B_1", "B", "", "", frozenset({("supplier", "s_name")}))]
    return spark.createDataFrame([(v.case_id, v.answerable, v.model, ",".join(v.missing)) for v in quality.answerable(wide.layer, cases, wide.graph)], "case_id string, answerable boolean, model string, missing string")


def fold_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fold(star_schema(spark, sf_dir))
    return spark.createDataFrame([(m.name, m.base, len(m.absorbed)) for m in made.layer.models], "model string, base string, absorbed int")


def streamed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of the events as a stream that runs until it has caught up."""
    from .streaming.rollup import rollup

    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a stream reads a folder; a table that is one file is picked out of its own
    folder, _, file = table.inputFiles()[0].rpartition("/")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", file if file == "events.parquet" else "*.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="widegrain-")
    at = f"{shared}/rollup-{uuid.uuid4().hex}"
    # the result grows with the groups, so it stays distributed: each batch writes the whole of it
    made = rollup(stream, "ts", ["event_type"], ["value"]).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/stream")
    query = made.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/rows")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/rows").select(day_key("window_start").alias("day"), "event_type", F.round("value", 2).alias("value"), "row_count")


#: The fact score by its formula, from the columns and row counts that DuckDB sees and the star's keys.
FACT_SQL = """
WITH edges(child, col, parent) AS (VALUES ('nation', 'n_regionkey', 'region'), ('customer', 'c_nationkey', 'nation'), ('supplier', 's_nationkey', 'nation'), ('orders', 'o_custkey', 'customer'), ('lineitem', 'l_orderkey', 'orders'), ('lineitem', 'l_partkey', 'part'), ('lineitem', 'l_suppkey', 'supplier')),
keys AS (SELECT child AS t, col AS c FROM edges UNION VALUES ('region', 'r_regionkey'), ('nation', 'n_nationkey'), ('customer', 'c_custkey'), ('supplier', 's_suppkey'), ('part', 'p_partkey'), ('orders', 'o_orderkey')),
tables(t) AS (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem')),
cols AS (SELECT DISTINCT table_name AS t, column_name AS c, data_type AS d FROM duckdb_columns() WHERE table_name IN (SELECT t FROM tables)),
plain AS (SELECT t, COUNT(*) AS n, COUNT(*) FILTER (d IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR d LIKE 'DECIMAL%') AS numeric FROM cols WHERE (t, c) NOT IN (SELECT (t, c) FROM keys) GROUP BY t),
times AS (SELECT t, COUNT(*) AS n FROM cols WHERE d LIKE 'TIMESTAMP%' OR d = 'DATE' GROUP BY t),
signals AS (
  SELECT t, COALESCE(p.numeric / p.n * LEAST(p.numeric, 4) / 4.0, 0) AS density, LEAST(COALESCE(x.n, 0), 2) / 2.0 AS time,
         (SELECT COUNT(*) FROM edges WHERE child = t) AS outward, (SELECT COUNT(*) FROM edges WHERE parent = t) AS inward
  FROM tables LEFT JOIN plain p USING (t) LEFT JOIN times x USING (t)),
scores AS (SELECT *, (0.40 * density + 0.20 * time + 0.25 * outward / MAX(outward) OVER ()) / 0.85 AS s FROM signals)
SELECT t AS table_name, CASE WHEN outward + inward = 0 THEN 'isolated' WHEN s >= 0.35 AND outward > 0 THEN 'fact' ELSE 'dimension' END AS role, CAST(ROUND(s, 4) AS DOUBLE) AS score FROM scores
"""


def nested_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, maps, structs and JSON in a query over a wide model."""
    return orders_layer(spark, sf_dir).query(
        "SELECT n_name, SIZE(COLLECT_SET(c_mktsegment)) AS segments, ARRAY_JOIN(ARRAY_SORT(COLLECT_SET(o_orderstatus)), ',') AS statuses, "
        "ELEMENT_AT(MAP('F', COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END), 'O', COUNT(CASE WHEN o_orderstatus = 'O' THEN 1 END)), 'O') AS open_orders, "
        "GET_JSON_OBJECT(TO_JSON(NAMED_STRUCT('name', n_name)), '$.name') AS again FROM orders GROUP BY n_name"
    )


def with_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that calls a registered vectorised function."""

    @F.pandas_udf("string")
    def initial(names):
        return names.str[:1]

    spark.udf.register("widegrain_initial", initial)
    return orders_layer(spark, sf_dir).query("SELECT widegrain_initial(n_name) AS letter, COUNT(*) AS n FROM orders GROUP BY 1")


def with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parameters, also in a condition that moves into a child's aggregate."""
    sql = "SELECT c_mktsegment, SUM(lineitems_count) AS n FROM orders WHERE lineitems_l_returnflag = :flag AND o_totalprice > :least AND n_name <> ':flag' GROUP BY c_mktsegment"
    return orders_layer(spark, sf_dir).query(sql, {"flag": "R", "least": 150_000})


FRAMES: dict[str, tuple[Query, str | None]] = {
    "wide_child_min_max_avg": (min_max_avg, "SELECT o_orderkey, ROUND(a, 4) AS mean, low, high FROM orders LEFT JOIN (SELECT l_orderkey, AVG(l_quantity) AS a, MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
    "role_playing_dims": (role_playing_dimensions, "SELECT a.c_mktsegment AS bill, b.c_mktsegment AS ship, COUNT(*) AS n FROM orders JOIN customer a ON o_custkey = a.c_custkey LEFT JOIN customer b ON o_custkey % 100 + 1 = b.c_custkey GROUP BY 1, 2"),
    "role_playing_children": (role_playing_children, "SELECT c_custkey, s.n AS sent, d.n AS got, ROUND(d.q, 2) AS qty FROM customer LEFT JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY 1) s ON s.k = c_custkey LEFT JOIN (SELECT o_custkey % 50 + 1 AS k, COUNT(*) AS n, SUM(o_totalprice) AS q FROM orders GROUP BY 1) d ON d.k = c_custkey"),
    "composite_key_join": (composite_key, "SELECT sold, COUNT(*) AS n FROM lineitem JOIN (SELECT l_partkey, l_suppkey, COUNT(*) AS sold FROM lineitem GROUP BY 1, 2) USING (l_partkey, l_suppkey) GROUP BY 1"),
    "period_anchor": (period_anchor, "SELECT m AS YYYYMM, SUBSTRING(m, 1, 4) AS YYYY FROM (SELECT strftime(o_orderdate, '%Y%m') AS m FROM orders UNION SELECT strftime(l_shipdate, '%Y%m') FROM lineitem UNION SELECT strftime(ts, '%Y%m') FROM events)"),
    "period_two_facts": (period_two_facts, "SELECT m AS YYYYMM, o AS orders, ROUND(q, 2) AS qty, e AS events FROM (SELECT strftime(o_orderdate, '%Y%m') AS m FROM orders UNION SELECT strftime(l_shipdate, '%Y%m') FROM lineitem UNION SELECT strftime(ts, '%Y%m') FROM events) LEFT JOIN (SELECT strftime(o_orderdate, '%Y%m') AS m, COUNT(*) AS o FROM orders GROUP BY 1) USING (m) LEFT JOIN (SELECT strftime(l_shipdate, '%Y%m') AS m, SUM(l_quantity) AS q FROM lineitem GROUP BY 1) USING (m) LEFT JOIN (SELECT strftime(ts, '%Y%m') AS m, COUNT(*) AS e FROM events GROUP BY 1) USING (m)"),
    "derived_key_join": (derived_key_join, "SELECT strftime(l_shipdate, '%Y') AS YYYY, COUNT(*) AS n FROM lineitem GROUP BY 1"),
    "monthly_summary": (monthly_summary, "SELECT strftime(l_shipdate, '%Y%m') AS YYYYMM, l_partkey, ROUND(SUM(l_quantity), 2) AS qty, COUNT(*) AS ROW_CNT FROM lineitem GROUP BY 1, 2"),
    "monthly_summary_by_dim": (monthly_summary_by_dim, "SELECT strftime(l_shipdate, '%Y%m') AS YYYYMM, p_brand, ROUND(SUM(l_quantity), 2) AS qty, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    "range_join_scd2": (range_join, "SELECT CASE WHEN o_orderdate <= TIMESTAMP '1997-12-31 23:59:59' THEN 'grade0' WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'grade1' END AS grade, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "link_axis_count": (link_axis_count, "SELECT p_name AS name, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "link_axis_multi": (link_axis_multi, "SELECT p_brand AS brand, s_name AS supplier, o_orderstatus AS status, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_name < 'Supplier#000000020' GROUP BY 1, 2, 3"),
    "snapshot_union": (snapshot_union, "SELECT strftime(l_shipdate, '%Y%m') AS month, p_brand, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"),
    "snapshot_period_filter": (snapshot_period_filter, "SELECT COUNT(*) AS n FROM lineitem WHERE strftime(l_shipdate, '%Y%m') = '199602'"),
    "snapshot_overlap": (snapshot_overlap, "WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE strftime(l_shipdate, '%Y%m') = '199601'), b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE strftime(l_shipdate, '%Y%m') = '199602') SELECT (SELECT COUNT(*) FROM (FROM a INTERSECT FROM b)) AS common, (SELECT COUNT(*) FROM (FROM a UNION FROM b)) AS either"),
    "fk_violation_rate": (fk_violation_rate, "SELECT COUNT(*) AS total, COUNT(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS orphans FROM documents"),
    "fk_orphans_anti": (fk_orphans, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "containment_probe": (containment_probe, "SELECT COUNT(*) AS total, COUNT(*) FILTER (v NOT IN (SELECT c_custkey FROM customer)) AS missing FROM (SELECT DISTINCT user_id AS v FROM events WHERE user_id IS NOT NULL)"),
    "pk_unique_subset": (pk_unique_subset, "SELECT 'nation' AS table_name, 'n_nationkey' AS column_name WHERE (SELECT COUNT(*) = COUNT(DISTINCT n_nationkey) FROM nation)"),
    "distinct_widths": (distinct_widths, "SELECT COUNT(*) AS row_count, COUNT(DISTINCT l_orderkey) AS l_orderkey, COUNT(DISTINCT l_linenumber) AS l_linenumber, COUNT(DISTINCT l_quantity) AS l_quantity, COUNT(DISTINCT l_returnflag) AS l_returnflag, COUNT(DISTINCT l_linestatus) AS l_linestatus, COUNT(DISTINCT l_shipdate) AS l_shipdate FROM lineitem"),
    "mutual_determination": (mutual_determination, "SELECT COUNT(*) AS pairs, COUNT(DISTINCT a) AS n_a, COUNT(DISTINCT b) AS n_b FROM (SELECT DISTINCT n_nationkey AS a, n_name AS b FROM nation)"),
    "equivalent_columns": (equivalent_columns, "SELECT 'nation' AS table_name, unnest(['n_nationkey', 'nation_cd']) AS column_name"),
    "information_bits": (information_bits, "SELECT column_name, n AS n_distinct, ROUND(log2(greatest(n, 1)) + 1, 6) AS bits FROM (SELECT 'c_custkey' AS column_name, COUNT(DISTINCT c_custkey) AS n FROM customer UNION ALL SELECT 'c_name', COUNT(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_nationkey', COUNT(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', COUNT(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', COUNT(DISTINCT c_mktsegment) FROM customer)"),
    "infer_fk_by_name": (infer_fk_by_name, "SELECT * FROM (VALUES ('orders', 'customer_id', 'customers'), ('items', 'order_id', 'orders')) v(child, child_columns, parent)"),
    "infer_fk_by_pk": (infer_fk_by_pk, "SELECT * FROM (VALUES ('labels', 'doc_id', 'documents')) v(child, child_columns, parent)"),
    "infer_fk_by_tokens": (infer_fk_by_tokens, "SELECT * FROM (VALUES ('orders', 'customer_id', 'customers'), ('items', 'order_id', 'orders'), ('items', 'SA_PART_CD', 'd_sa_part'), ('labels', 'doc_id', 'documents')) v(child, child_columns, parent)"),
    "recover_relationships_data": (recover_relationships, "SELECT * FROM (VALUES ('labels', 'doc_id', 'documents'), ('orders', 'customer_id', 'customers'), ('items', 'SA_PART_CD', 'd_sa_part'), ('items', 'order_id', 'orders')) v(child, child_columns, parent)"),
    "fact_scores": (fact_scores, FACT_SQL),
    "candidate_lattice": (candidate_lattice, "SELECT table_name, CAST(reach AS INTEGER) AS reach, CAST(inlined AS INTEGER) AS inlined FROM (VALUES ('lineitem', 7, 7), ('orders', 5, 4), ('customer', 4, 3), ('nation', 4, 2), ('supplier', 4, 3), ('part', 2, 1), ('region', 2, 1)) v(table_name, reach, inlined)"),
    "greedy_selection": (greedy_selection, None),
    "explicit_pruned": (explicit_pruned, None),
    "layer_fields": (layer_fields, None),
    "lineage_edges": (lineage_edges, "SELECT * FROM (VALUES ('orders', 'c_name', 'joined', 'customer.c_name', 'customer'), ('orders', 'c_acctbal', 'joined', 'customer.c_acctbal', 'customer'), ('orders', 'c_mktsegment', 'joined', 'customer.c_mktsegment', 'customer'), ('orders', 'n_name', 'joined', 'nation.n_name', 'customer > nation'), ('orders', 'r_name', 'joined', 'region.r_name', 'customer > nation > region')) v(model, field, kind, source, path)"),
    "fidelity_report": (fidelity_report, None),
    "compression_flows": (compression_flows, None),
    "answerability": (answerable_cases, "SELECT * FROM (VALUES ('A_1', true, 'orders', ''), ('B_1', false, NULL, 'supplier.s_name')) v(case_id, answerable, model, missing)"),
    "fold_layer": (fold_layer, None),
    "expand_rejections": (expand_rejections, "SELECT * FROM (VALUES ('unparseable', 'ExpansionError'), ('cte_shadows', 'ExpansionError'), ('self_join', 'ExpansionError'), ('no_model', 'ExpansionError'), ('two_models', 'ExpansionError'), ('unknown_field', 'ExpansionError'), ('filter_selected', 'FilterOnlyMisuse'), ('filter_in_or', 'FilterOnlyMisuse'), ('filter_grouped', 'FilterOnlyMisuse'), ('two_filters_in_one', 'FilterOnlyMisuse'), ('physical_table', 'ExpansionError'), ('not_a_query', 'ExpansionError'), ('accepted', 'accepted')) v(rule, outcome)"),
    "model_text_equals_dataframe": (text_equals_frame, "SELECT CAST(0 AS BIGINT) AS differing"),
    "nested_types": (nested_types, "SELECT n_name, CAST(COUNT(DISTINCT c_mktsegment) AS INTEGER) AS segments, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT unnest(list_distinct(list(o_orderstatus))) AS s)) AS statuses, COUNT(*) FILTER (o_orderstatus = 'O') AS open_orders, n_name AS again FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "registered_function": (with_function, "SELECT n_name[1] AS letter, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "named_parameters": (with_parameters, "SELECT c_mktsegment, CAST(SUM(k) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, COUNT(*) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_totalprice > 150000 GROUP BY 1"),
    "value_match_grades": (value_match_grades, GRADED_SQL),
    "streamed_rollup": (streamed_rollup, "SELECT strftime(ts, '%Y%m%d') AS day, event_type, ROUND(SUM(value), 2) AS value, COUNT(*) AS row_count FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {n: asked(sql, **OPTIONS.get(n, {})) for n, (sql, _) in WIDE.items()}
    out["wide_select_star"] = _select_star
    return out | {n: f for n, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = {n: sql for n, (_, sql) in WIDE.items()}
    out["wide_select_star"] = f"SELECT * REPLACE (ROUND(customers_c_acctbal_sum, 2) AS customers_c_acctbal_sum, ROUND(suppliers_s_acctbal_sum, 2) AS suppliers_s_acctbal_sum) FROM ({out['wide_select_star']})"
    return out | {n: sql for n, (_, sql) in FRAMES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(WIDE["push_filter_child"][0])(spark, sf_dir)
