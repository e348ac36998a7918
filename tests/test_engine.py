"""Wide models on small tables whose right answers are known."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from widegrain.engine import WideLayer, wide_layer
from widegrain.graph import SchemaGraph
from widegrain.naming import aliases, plural, prefixed, role_of, singular
from widegrain.operators import probe
from widegrain.operators.equivalence import dedupe_fields, find_equivalents
from widegrain.operators.virtual import add_monthly_summaries, add_period_anchor, consolidate, partition_of
from widegrain.plans.compose import ComposeOptions
from widegrain.plans.expand import ExpansionError, FilterOnlyMisuse, normalize_dialect
from widegrain.plans.fold import fold, fold_star, prepare, split_anchors
from widegrain.plans.infer import by_key, by_name, by_tokens, value_candidates
from widegrain.plans.select import Policy, explicit, greedy, lattice, profiles
from widegrain.plans.tune import autotune, curve, knee, render_curve
from widegrain.reports import quality
from widegrain.reports.grading import CLOSE, EXACT, EXECUTED, FAILED, PARTIAL, Figures, figures_of, grade, judge
from widegrain.reports.information import measure, table_bits
from widegrain.reports.text import field_cost, render_catalog, render_model, render_report, render_text
from widegrain.sources.app_schema import read_rails, read_sqlite
from widegrain.sources.catalog import from_frames
from widegrain.sources.ddl import read_ddl, write_ddl
from widegrain.sources.goldset import Case, load_jsonl
from widegrain.sources.jdbc import SourceUnavailable, assemble, sqlserver_from_env
from widegrain.sources.layer_file import fields_frame, from_dict, from_json, to_dict, to_json
from widegrain.t2sql.engine import Example, GenerationError, SQLNotFound, TextToSQL, checking_executor, extract_sql, render_trace, without_layer
from widegrain.types import Catalog, Edge, FieldKind


@pytest.fixture(scope="module")
def shop(spark):
    rows = {
        "tiers": ([(1, "gold"), (2, "silver")], "id long, label string"),
        "customers": ([(1, 1, "a@x", "Ada"), (2, 2, "b@x", "Bo")], "id long, tier_id long, email string, name string"),
        "orders": ([(1, 1, 100.0, 10.0, dt.datetime(2026, 1, 5)), (2, 2, 50.0, 5.0, dt.datetime(2026, 2, 5)), (3, 1, 25.0, 2.0, dt.datetime(2026, 3, 5))], "id long, customer_id long, total double, tax double, placed_at timestamp"),
        "order_items": ([(1, 1, 2, 60.0), (2, 1, 1, 40.0), (3, 2, 5, 50.0)], "id long, order_id long, quantity int, line_total double"),
    }
    frames = {n: spark.createDataFrame(r, s) for n, (r, s) in rows.items()}
    return from_frames(frames, {n: ("id",) for n in frames})


@pytest.fixture(scope="module")
def wide(spark, shop):
    catalog = shop.with_edges(by_name(shop))
    return wide_layer(spark, catalog, ["orders", "customers"], expose_child_filters=True)


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_inferred_by_name(shop):
    assert {(e.child, e.child_cols, e.parent) for e in by_name(shop)} == {("customers", ("tier_id",), "tiers"), ("orders", ("customer_id",), "customers"), ("order_items", ("order_id",), "orders")}


@pytest.mark.parametrize(
    ("sql", "expect"),
    [
        ("SELECT SUM(total) AS t FROM orders", [(175.0,)]),
        ("SELECT SUM(order_items_line_total_sum) AS t FROM orders", [(150.0,)]),
        ("SELECT id, order_items_count FROM orders", [(1, 2), (2, 1), (3, None)]),
        ("SELECT COUNT(*) AS n FROM orders", [(3,)]),
        ("SELECT tier_label, SUM(total) AS t FROM orders GROUP BY tier_label", [("gold", 125.0), ("silver", 50.0)]),
        ("SELECT id FROM orders WHERE placed_at >= TIMESTAMP '2026-02-01'", [(2,), (3,)]),
        ("SELECT id, order_items_quantity_sum FROM orders WHERE order_items_line_total > 1 AND total > 60", []),
    ],
)
def test_answers(wide, sql, expect):
    if "line_total >" in sql:  # a measure isn't a channel
        with pytest.raises(ExpansionError, match="has no field"):
            wide.query(sql)
    else:
        assert values(wide.query(sql)) == expect


def test_every_field_of_every_model_answers_as_its_text(spark, wide, shop):
    for t in shop.tables:
        t.frame(spark).createOrReplaceTempView(t.name)
    for m in wide.layer.models:
        for f in m.fields:
            if not f.filter_only:
                sql = f"SELECT {f.name} FROM {m.name}"
                assert values(spark.sql(wide.expand(sql).sql)) == values(wide.query(sql)), f.name


def test_joins_are_pruned(wide):
    e = wide.expand("SELECT SUM(total) FROM orders")
    assert e.joins_emitted == 0 and e.joins_pruned == e.joins_available > 0 and "JOIN" not in e.sql


@pytest.mark.parametrize(
    ("sql", "error", "says"),
    [
        ("SELEC 1", ExpansionError, "could not parse"),
        ("WITH orders AS (SELECT 1 AS x) SELECT * FROM orders", ExpansionError, "WITH part"),
        ("SELECT 1 FROM orders, orders o", ExpansionError, "stands twice"),
        ("SELECT 1 FROM other", ExpansionError, "is a model"),
        ("SELECT 1 FROM orders JOIN customers ON true", ExpansionError, "reads one model|is none"),
        ("SELECT nope FROM orders", ExpansionError, "has no field"),
        ("INSERT INTO orders SELECT 1", ExpansionError, "only queries"),
        ("SELECT orders_placed_at FROM customers", FilterOnlyMisuse, "no value"),
        ("SELECT id FROM customers WHERE orders_placed_at > TIMESTAMP '2026-01-01' OR id = 1", FilterOnlyMisuse, "joined by AND"),
        ("SELECT COUNT(*) FROM customers HAVING MAX(orders_placed_at) > TIMESTAMP '2026-01-01'", FilterOnlyMisuse, "joined by AND"),
    ],
)
def test_refusals(wide, sql, error, says):
    with pytest.raises(error, match=says):
        wide.expand(sql)


def test_conditions_move_inside(wide):
    sql = "SELECT id, orders_count FROM customers WHERE (orders_placed_at BETWEEN TIMESTAMP '2026-01-01' AND TIMESTAMP '2026-01-31' AND (id > 0))"
    e = wide.expand(sql)
    assert "INNER JOIN" in e.sql and e.sql.count("BETWEEN") == 1
    assert values(wide.query(sql)) == [(1, 1)]
    # only the block that states it is filtered
    both = "SELECT COUNT(*) AS n FROM customers WHERE id IN (SELECT id FROM customers WHERE orders_placed_at > TIMESTAMP '2026-02-01')"
    assert values(wide.query(both)) == [(2,)]
    assert values(wide.query("SELECT id FROM customers WHERE (orders_placed_at) IN (TIMESTAMP '2026-02-05')")) == [(2,)]


def test_dialects():
    assert normalize_dialect("PG") == "postgres"
    with pytest.raises(ExpansionError, match="known"):
        normalize_dialect("cobol")


def test_link_axis(spark):
    frames = {
        "orders": spark.createDataFrame([(1, "R1", 100), (2, "R1", 200), (3, "R2", 300)], "order_id long, region_cd string, amount long"),
        "customers": spark.createDataFrame([(10, "Kim"), (20, "Lee")], "customer_id long, name string"),
        "order_customer_links": spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, 3, 20), (4, 1, 10)], "link_id long, order_id long, customer_id long"),
    }
    c = from_frames(frames, {"orders": ("order_id",), "customers": ("customer_id",), "order_customer_links": ("link_id",)}, (Edge("order_customer_links", ("order_id",), "orders", ("order_id",)), Edge("order_customer_links", ("customer_id",), "customers", ("customer_id",))))
    w = wide_layer(spark, c, ["orders"], expose_groupable_children=True)
    assert values(w.query("SELECT order_customer_links_name AS n, order_customer_links_order_id_count AS k FROM orders")) == [("Kim", 2), ("Lee", 1)]
    assert values(w.query("SELECT order_customer_links_name AS n, region_cd, order_customer_links_order_id_count AS k FROM orders")) == [("Kim", "R1", 2), ("Lee", "R2", 1)]
    for sql, says in (("SELECT order_customer_links_name, amount FROM orders", "numeric"), ("SELECT order_customer_links_name, order_customer_links_count FROM orders", "mix"), ("SELECT order_customer_links_name, COUNT(*) FROM orders GROUP BY 1", "COUNT")):
        with pytest.raises(ExpansionError, match=says):
            w.expand(sql)


def test_ranges_warn(spark):
    frames = {"orders": spark.createDataFrame([(1, "R")], "order_id long, region_cd string"), "items": spark.createDataFrame([(1, 1, 2)], "item_id long, order_id long, qty int"), "notes": spark.createDataFrame([(1, "R", 3)], "note_id long, region_cd string, n int")}
    c = from_frames(frames, {"orders": ("order_id",), "items": ("item_id",), "notes": ("note_id",)}, (Edge("items", ("order_id",), "orders", ("order_id",)), Edge("notes", ("region_cd",), "orders", ("region_cd",))))
    w = wide_layer(spark, c, ["orders"])
    assert "ranges differ" in w.expand("SELECT items_count, notes_count FROM orders").warnings[0]
    assert not w.expand("SELECT items_count FROM orders").warnings


def test_range_condition(spark):
    frames = {"F_ATT": spark.createDataFrame([("E1", "20250110", 8.0), ("E1", "20250210", 7.0)], "EMP_NO string, WORK_YMD string, WORK_HOURS double"), "H_ASG": spark.createDataFrame([("E1", "A", "20250101", "20250131"), ("E1", "B", "20250201", "99991231")], "EMP_NO string, DEPT_NM string, VALID_FROM string, VALID_TO string")}
    edge = Edge("F_ATT", ("EMP_NO",), "H_ASG", ("EMP_NO",), condition="{L}.EMP_NO = {R}.EMP_NO AND {L}.WORK_YMD BETWEEN {R}.VALID_FROM AND {R}.VALID_TO")
    c = from_frames(frames, {"H_ASG": ("EMP_NO", "VALID_FROM")}, (edge,))
    w = wide_layer(spark, c, ["F_ATT"], prefix_joined_fields=False)
    assert values(w.query("SELECT DEPT_NM, SUM(WORK_HOURS) AS h FROM F_ATT GROUP BY DEPT_NM")) == [("A", 8.0), ("B", 7.0)]
    with pytest.raises(ValueError, match="column must follow"):
        Edge("a", ("x",), "b", ("y",), condition="{L} = 1")
    with pytest.raises(ValueError, match="differ"):
        Edge("a", ("x", "z"), "b", ("y",))


def test_periods(spark):
    frames = {"F_PL": spark.createDataFrame([("202507", 100.0), ("202507", 200.0), ("202508", 50.0)], "YYYYMM string, PL_AMT double"), "F_SALES": spark.createDataFrame([("20250703", 10.0), ("20250715", 20.0), ("20250801", 5.0)], "YYYYMMDD string, SALES_AMT double"), "D_ITEM": spark.createDataFrame([("ABCDEFGH",)], "ITEM_CD string")}
    c = add_period_anchor(from_frames(frames))
    w = wide_layer(spark, c, ["V_PERIOD"])
    assert values(w.query("SELECT YYYYMM, f_pls_PL_AMT_sum AS p, f_sales_SALES_AMT_sum AS s FROM V_PERIOD")) == [("202507", 300.0, 30.0), ("202508", 50.0, 5.0)]
    assert add_period_anchor(c) is c
    made = add_monthly_summaries(c)
    assert values(made.table("V_F_SALES_MON").frame(spark)) == [("202507", 30.0, 2), ("202508", 5.0, 1)]
    for t in made.tables:
        if not t.is_virtual:
            t.frame(spark).createOrReplaceTempView(t.name)
    for n in ("V_PERIOD", "V_F_SALES_MON"):
        assert values(spark.sql(made.table(n).sql)) == values(made.table(n).frame(spark))
    assert made.table("V_D_ITEM_MON") is None


def test_consolidation(spark):
    assert partition_of("F_LEDGER_202506")[:3] == ("F_LEDGER", "month", "202506") and partition_of("T_12345") is None
    schema = "ID long, CUST_CD string, AMT long"
    frames = {"D_CUST": spark.createDataFrame([("C1", "x"), ("C2", "y")], "CUST_CD string, NM string"), "F_LEDGER_202506": spark.createDataFrame([(1, "C1", 100), (2, "C2", 200)], schema), "F_LEDGER_202507": spark.createDataFrame([(1, "C1", 300), (2, "C2", 400)], schema)}
    edges = tuple(Edge(n, ("CUST_CD",), "D_CUST", ("CUST_CD",)) for n in list(frames)[1:])
    made, (report,) = consolidate(from_frames(frames, {"D_CUST": ("CUST_CD",), "F_LEDGER_202506": ("ID",), "F_LEDGER_202507": ("ID",)}, edges), spark)
    assert made.table("F_LEDGER").primary_key == () and report.kept_edges == 1 and report.overlap == 1.0 and report.snapshot_like
    w = wide_layer(spark, made, ["F_LEDGER"])
    assert values(w.query("SELECT SUM(AMT) AS s FROM F_LEDGER")) == [(1000,)]
    assert values(w.query("SELECT SUM(AMT) AS s FROM F_LEDGER WHERE SNAPSHOT_YYYYMM = '202507'")) == [(700,)]
    alone, none = consolidate(Catalog(made.tables[:1]))
    assert not none and alone.table_names == ("D_CUST",)


def test_probes(spark):
    frames = {
        "member_info": spark.createDataFrame([(k, "g") for k in (1, 2, 3, 4)], "MEMBER_NO int, GRADE string"),
        "card_info": spark.createDataFrame([(101, 1), (102, 3), (103, 4), (104, None)], "SEQ int, CUST_ID int"),
        "decoy": spark.createDataFrame([(900,), (901,)], "ZOMBIE_NO int"),
    }
    c = from_frames(frames, {"member_info": ("MEMBER_NO",), "card_info": ("SEQ",), "decoy": ("ZOMBIE_NO",)})
    assert values(probe.containment(frames["card_info"], "CUST_ID", frames["member_info"], "MEMBER_NO")) == [(3, 0)]
    found = probe.recover(spark, c)
    assert [(e.child, e.child_cols, e.parent) for e in found.edges] == [("card_info", ("CUST_ID",), "member_info")] and found.edges[0].confidence >= 0.99
    assert probe.violation_rate(spark, c, Edge("card_info", ("CUST_ID",), "decoy", ("ZOMBIE_NO",))) == 1.0
    empty = from_frames({"a": frames["decoy"].limit(0), "b": frames["decoy"]})
    assert probe.violation_rate(spark, empty, Edge("a", ("ZOMBIE_NO",), "b", ("ZOMBIE_NO",))) == 1.0
    assert len(value_candidates(c)) >= 1


def test_snowflake_bridge_and_shared_codes(spark):
    frames = {"D_TOP": spark.createDataFrame([("T1", "x"), ("T2", "y")], "TOP_CD string, TOP_NM string"), "D_MID": spark.createDataFrame([("M1", "T1"), ("M2", "T2")], "MID_CD string, TOP_CD string"), "F_SALES": spark.createDataFrame([(1, "M1", 100), (2, "M2", 200)], "SALES_ID long, MID_CD string, AMT long")}
    c = from_frames(frames, {"D_TOP": ("TOP_CD",), "D_MID": ("MID_CD",), "F_SALES": ("SALES_ID",)}, (Edge("D_MID", ("TOP_CD",), "D_TOP", ("TOP_CD",)),))
    new = [e for e in probe.recover(spark, c).edges if e.inferred]
    assert [(e.child, e.parent) for e in new] == [("F_SALES", "D_MID")]
    pair = from_frames({"F_A": spark.createDataFrame([("X", 1)], "CODE_CD string, N long"), "F_B": spark.createDataFrame([("X", 2)], "CODE_CD string, N long")})
    assert not probe.recover(spark, pair).edges


def test_equivalence_and_information(spark):
    rows = [(f"O{k}", 100 + k, f"Z{k % 3}", f"H{k}", 100 * k) for k in range(10)]
    df = spark.createDataFrame(rows, "ORG_CD string, ORG_ID long, ORG_NM string, HEAD_NM string, AMT long")
    c = from_frames({"D_ORG": df}, {"D_ORG": ("ORG_CD",)})
    (g,) = find_equivalents(spark, c)
    assert g.columns == ("ORG_CD", "ORG_ID")
    assert not find_equivalents(spark, from_frames({"D_ORG": df.limit(2)}, {"D_ORG": ("ORG_CD",)}))
    w = wide_layer(spark, c, ["D_ORG"])
    slim = dedupe_fields(w.layer, (g,))
    assert "ORG_ID" not in slim.models[0].field_names and "same value as ORG_ID" in slim.models[0].field("ORG_CD").description
    bits = table_bits(spark, from_frames({"t": spark.createDataFrame([(1, 10, 7), (2, 20, 7), (3, 30, 7)], "A int, B int, C int")}))
    assert [round(bits["t", x], 9) for x in "abc"] == [round(math.log2(3) + 1, 9)] * 2 + [1.0]
    assert measure(w.layer, c, table_bits(spark, c)).retention == 1.0


DDL = """
-- comments are passed over
CREATE TABLE regions (id bigint PRIMARY KEY, name varchar(50) NOT NULL);
CREATE TABLE "order" ("select" integer, region_id bigint REFERENCES regions(id), total numeric(12,2) DEFAULT 0, at timestamp with time zone, PRIMARY KEY ("select"));
CREATE TABLE lines (order_no integer, n double precision, CONSTRAINT fk FOREIGN KEY (order_no) REFERENCES "order" ("select"));
CREATE INDEX i ON lines (n);
ALTER TABLE ONLY lines ADD CONSTRAINT gone FOREIGN KEY (n) REFERENCES missing (x);
COMMENT ON TABLE regions IS 'Sales regions (all)';
"""


def test_ddl():
    c = read_ddl(DDL)
    assert c.table_names == ("regions", "order", "lines") and c.table("order").primary_key == ("select",)
    assert c.table("order").column("total").dtype.simpleString() == "decimal(12,2)" and c.table("order").column("at").is_temporal
    assert {(e.child, e.parent) for e in c.edges} == {("order", "regions"), ("lines", "order")}
    again = read_ddl(write_ddl(c))
    assert again.table_names == c.table_names and {e.key for e in again.edges} == {e.key for e in c.edges} and again.table("regions").comment == "Sales regions (all)"


def test_jdbc_rows():
    c = assemble([("a", "id", "bigint", False, None), ("a", "b_id", "NUMBER(10,0)", True, "to b"), ("b", "id", "nvarchar(20)", False, "")], [("a", "id"), ("b", "id")], [("fk", "a", "b_id", "b", "id"), ("x", "a", "id", "gone", "id")], [("a", 5, "As"), ("b", -1, None)])
    assert c.table("a").rows == 5 and c.table("b").rows is None and len(c.edges) == 1 and c.table("a").column("b_id").is_numeric
    with pytest.raises(SourceUnavailable, match="WIDEGRAIN_MSSQL_HOST"):
        sqlserver_from_env({})


def test_layer_round_trip(spark, wide):
    assert from_json(to_json(wide.layer)) == wide.layer
    with pytest.raises(ValueError, match="version"):
        from_dict({**to_dict(wide.layer), "version": 2})
    again = WideLayer(spark, from_json(to_json(wide.layer)), wide.graph)
    assert values(again.query("SELECT COUNT(*) AS n FROM orders")) == [(3,)]
    assert fields_frame(spark, wide.layer).count() == wide.layer.field_count


def test_naming():
    assert [singular(x) for x in ("categories", "F_SALES", "status", "boxes", "addresses", "orders", "news")] == ["category", "f_sales", "status", "box", "address", "order", "news"]
    assert plural("D_ITEM") == "d_items" and aliases("orders") == {"orders", "order"}
    assert prefixed("customer", "customer_id") == "customer_id" and prefixed("tier", "label") == "tier_label"
    assert role_of(("seller_id",), "users", "orders") == "seller" and role_of(("user_id",), "users") is None


def star(n=6):
    return read_ddl("\n".join(["CREATE TABLE hub (hub_cd varchar(8) PRIMARY KEY, nm varchar(20));"] + [f"CREATE TABLE f{k} (f{k}_no bigint PRIMARY KEY, hub_cd varchar(8) REFERENCES hub (hub_cd), amt{k} double precision, at timestamp);" for k in range(n)]))


def test_selection():
    c = star()
    g = SchemaGraph.build(c)
    assert profiles(g)[0].role.value == "fact" and {p.name: p.role.value for p in profiles(g)}["hub"] == "dimension"
    cs = lattice(g, ComposeOptions())
    s = greedy(cs)
    assert s.anchors[0] == "hub" and s.stop == "coverage_reached"
    assert greedy(cs, Policy(max_areas=1, target=1.0)).stop in ("coverage_reached", "max_areas") and greedy([]).stop == "no_candidates"
    assert greedy(cs, Policy(max_cost=0.1)).stop == "gain_exhausted"
    assert explicit(cs, ["hub", "f1"], drop_redundant=True).anchors == ("hub", "f1")  # f1 alone joins the hub
    with pytest.raises(ValueError):
        explicit(cs, ["nope"])
    with pytest.raises(ValueError):
        Policy(target=0)
    assert split_anchors(g) == (["hub"], [f"f{k}" for k in range(6)])


def test_budgets_and_reports():
    c = star()
    full = fold_star(c)
    texts = render_text(full.layer)
    assert render_text(fold_star(c).layer) == texts and render_report(full.layer) and render_catalog(full.layer)
    last = 0
    for budget in (300, 800, 1600, 5000):
        made = fold_star(c, field_budget=10_000, prompt_budget=budget)
        assert made.layer.field_count >= last
        last = made.layer.field_count
    assert fold(c, ComposeOptions(field_budget=5)).layer.field_count == 5
    m = full.layer.models[0]
    assert sum(field_cost(f) for f in m.fields) < len(render_model(m))
    f = quality.fidelity(full.layer, full.graph)
    assert f.column_retention > 0.7 and f.join_absorption == 1.0 and 0 < f.pair_answerability <= 1
    assert sum(n for *_, n in quality.compression(full.layer)) == full.layer.field_count == len(quality.lineage(full.layer))
    assert {n["table"] for n in quality.lineage_graph(full.layer, full.graph)["nodes"]} == set(c.table_names)


def test_tuning():
    c = star()
    cases = [Case("A_1", "A", "q", "", frozenset({("hub", "nm"), ("f0", "amt0")})), Case("B_1", "B", "q", "", frozenset({("f1", "nothing")}))]
    points = curve(c, cases)
    assert points[-1].answered == 1 and knee(points).answered == 1 and "knee" in render_curve(points)
    assert autotune(c, limit=6).score > 0
    made = fold_star(c)
    assert quality.schema_gap(cases, made.graph) == ["f1.nothing"] and quality.by_subject(quality.answerable(made.layer, cases, made.graph)) == {"A": (1, 1), "B": (0, 1)}


def test_prepare(spark, shop):
    p = prepare(spark, shop.with_edges(by_name(shop)), measure_information=True)
    w = WideLayer(spark, p.fold.layer, p.fold.graph)
    assert p.notes and values(w.query("SELECT SUM(total) AS t FROM orders" if w.layer.model("orders") else "SELECT 1 AS t")) == [(175.0,)]


def test_names_of_keys():
    c = read_ddl("CREATE TABLE D_SA_ORG (ORG_CD varchar(8) PRIMARY KEY, HEAD_NM varchar(9)); CREATE TABLE F (SA_ORG_CD varchar(8), ORG_CD varchar(8), AMT double);")
    assert [(e.child_cols, e.parent) for e in by_key(c)] == [(("ORG_CD",), "D_SA_ORG")]
    assert ("SA_ORG_CD",) in [e.child_cols for e in by_tokens(c)]


def test_text_to_sql(spark, wide, tmp_path):
    replies = iter(["orders please", "Sure:\n```sql\nSELECT nope FROM orders\n```", "SELECT SUM(total) AS t FROM orders;\nThat is all."])
    t = TextToSQL(wide, lambda prompt: next(replies), examples=[Example("n?", "SELECT COUNT(*) FROM orders"), Example("bad", "SELECT x FROM y")], execute=checking_executor(wide))
    assert len(t.examples) == 1
    out = t.generate("How much?")
    assert out.ok and out.model == "orders" and out.repairs == 1 and "SUM(total)" in out.sql and "question" in render_trace(out)
    with pytest.raises(GenerationError):
        TextToSQL(wide, lambda p: "orders").generate("?")
    with pytest.raises(SQLNotFound):
        extract_sql(spark, "no query here")
    assert without_layer(spark, wide.graph.catalog, "?", lambda p: "SELECT 1").ok
    path = tmp_path / "gold.jsonl"
    path.write_text(json.dumps({"case_id": "A_1", "question": "q", "sql": "SELECT o.total FROM orders o JOIN customers c ON o.customer_id = c.id"}))
    (case,) = load_jsonl(spark, str(path), wide.graph.catalog)
    assert case.references == {("orders", "total"), ("orders", "customer_id"), ("customers", "id")}


def test_cli(tmp_path, capsys, spark):
    from widegrain.cli import main

    path = tmp_path / "s.sql"
    path.write_text(write_ddl(star(3)))
    assert main(["fold", str(path)]) == 0 and main(["inspect", str(path)]) == 0 and main(["fold", str(path), "--star", "--format", "json"]) == 0 and main(["context", str(path), "--star"]) == 0
    assert "hub" in capsys.readouterr().out


def test_plan_reads_only_what_it_needs(spark, tmp_path):
    spark.range(100).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "t"))
    w = wide_layer(spark, from_frames({"t": spark.read.parquet(str(tmp_path / "t"))}, {"t": ("id",)}), ["t"])
    plan = w.query("SELECT COUNT(*) AS n FROM t WHERE k = 3")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<k:bigint>" in plan and "EqualTo(k,3)" in plan


def test_field_kinds(wide):
    assert {f.source.kind for m in wide.layer.models for f in m.fields} >= {FieldKind.BASE, FieldKind.JOINED, FieldKind.AGGREGATED}


def test_grades_of_values(spark):
    rows = spark.createDataFrame([("a", 1.5, "1,000"), ("b", None, "x"), ("b", float("nan"), None)], "k string, v double, s string")
    assert figures_of(rows).first()[:2] == (3, 1001.5)
    same = grade(rows, lambda: rows.orderBy(F.desc("v")).toDF("x", "y", "z").repartition(3))
    assert same.verdict == EXACT and same.same_rows
    # totals match, rows don't; a repeated row counts
    other = grade(rows, lambda: rows.withColumn("k", F.lit("c")))
    assert other.verdict == EXACT and not other.same_rows
    assert not grade(rows.limit(1), lambda: rows.limit(1).union(rows.limit(1))).same_rows
    assert grade(rows, lambda: rows.select("v").union(spark.range(1).select(F.lit(960.0)))).verdict == CLOSE
    assert grade(rows, lambda: rows.limit(1).select("v")).verdict == PARTIAL
    assert grade(rows, lambda: rows.limit(0)).verdict == EXECUTED
    assert grade(rows.limit(0), lambda: rows.limit(0).select("k")).verdict == EXACT
    failed = grade(rows, lambda: rows.select("nope"))
    assert failed.verdict == FAILED and "nope" in failed.error and failed.wanted_rows == 3
    assert grade(rows, lambda: rows.select(F.expr("1 / (length(k) - 1)"))).verdict == FAILED
    assert judge(Figures(2, -5.0, ""), Figures(2, -5.05, "")) == EXACT and judge(Figures(2, -5.0, ""), Figures(2, -5.2, "")) == PARTIAL


def test_rails_schema():
    made = read_rails("""
ActiveRecord::Schema[7.1].define(version: 1) do
  create_table "companies", force: :cascade do |t|
    t.string "name", null: false
    t.decimal "worth", precision: 12, scale: 2, comment: "in cents"
    t.index ["name"], name: "by_name"
  end
  create_table "posts", id: :uuid, default: -> { "gen()" }, force: :cascade do |t|
    t.bigint "company_id"
    t.bigint "writer_id"
    t.jsonb "extra", default: {}
  end
  create_table "tags_posts", primary_key: ["tag", "post"], force: :cascade do |t|
    t.integer "tag", null: false
    t.integer "post", null: false
  end
  create_table "logs", id: false, force: :cascade do |t|
    t.datetime "at"
  end
  add_foreign_key "posts", "companies"
  add_foreign_key "posts", "companies", column: "writer_id", on_delete: :cascade
  add_foreign_key "posts", "nowhere"
  add_foreign_key "logs", "companies"
end
""")
    tables = {t.name: t for t in made.tables}
    assert {n: t.primary_key for n, t in tables.items()} == {"companies": ("id",), "posts": ("id",), "tags_posts": ("tag", "post"), "logs": ()}
    assert tables["companies"].column_names == ("id", "name", "worth") and not tables["companies"].column("name").nullable and tables["companies"].column("worth").comment == "in cents"
    assert tables["companies"].column("worth").dtype.simpleString() == "decimal(12,2)" and tables["posts"].column("id").is_textual and tables["logs"].column_names == ("at",)
    assert sorted((e.child, e.child_cols, e.parent, e.parent_cols) for e in made.edges) == [("posts", ("company_id",), "companies", ("id",)), ("posts", ("writer_id",), "companies", ("id",))]


def test_sqlite_catalogue(tmp_path):
    import sqlite3

    path = str(tmp_path / "shop.db")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE makers (id INTEGER PRIMARY KEY, name TEXT NOT NULL);
        CREATE TABLE goods (maker INT REFERENCES makers, code TEXT, price DECIMAL(8,2), PRIMARY KEY (maker, code));
        CREATE TABLE "sold items" (n INTEGER PRIMARY KEY AUTOINCREMENT, m INT, c TEXT, FOREIGN KEY (m, c) REFERENCES Goods (maker, code));
        INSERT INTO makers VALUES (1, 'a'), (2, 'b');
        CREATE VIEW seen AS SELECT * FROM makers;
    """)
    db.close()
    made = read_sqlite(path)
    tables = {t.name: t for t in made.tables}
    assert {n: (t.primary_key, t.rows) for n, t in tables.items()} == {"makers": (("id",), 2), "goods": (("maker", "code"), 0), "sold items": (("n",), 0)}
    assert not tables["makers"].column("name").nullable and tables["goods"].column("price").dtype.simpleString() == "decimal(8,2)"
    assert sorted((e.child, e.child_cols, e.parent, e.parent_cols) for e in made.edges) == [("goods", ("maker",), "makers", ("id",)), ("sold items", ("m", "c"), "goods", ("maker", "code"))]
    with pytest.raises(sqlite3.OperationalError):
        read_sqlite(str(tmp_path / "none.db"))
