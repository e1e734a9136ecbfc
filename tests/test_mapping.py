"""Dataset roles, field candidates and source-to-target tables."""

import pytest
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.functions.scalars import formula_safe, normalize_currency, normalize_number, to_moment
from auditframe.plans.mapping import SALES_ROLES, clarifications, column_catalog, field_candidates, field_options, identify_roles, propose_mappings, run_transform
from auditframe.plans.specs import DerivationRule, FieldMapping, FieldReference, JoinRule, TargetColumn, TransformPlan


def test_roles(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    catalog = column_catalog(
        {
            "aug": empty("transaction_id string, date string, salesperson string, customer_id string, amount double, discount double, status string"),
            "people": empty("customer_id string, region string, name string"),
            "goals": empty("region string, target long"),
            "goals2": empty("region string, target long"),
        }
    )
    found = {r["role"]: (r["matching_datasets"], r["dataset"]) for r in identify_roles(catalog, SALES_ROLES).collect()}
    assert found == {"transactions": (1, "aug"), "customers": (1, "people"), "targets": (2, None)}


SOURCES = [
    ("orders", "order_id", "bigint"), ("orders", "customer_id", "string"), ("orders", "gross_sales", "string"), ("orders", "Returns", "double"),
    ("master", "cust_id", "string"), ("master", "territory", "string"), ("master", "customer_name", "string"), ("master", "order id", "string"),
    ("master", "is_active", "boolean"),
]


def proposals(spark, targets, sources=SOURCES, **options):
    t = spark.createDataFrame(targets, "target_field string, target_type string")
    s = spark.createDataFrame(sources, "source_role string, source_field string, data_type string")
    rows = propose_mappings(field_candidates(t, s, **options), t).collect()
    return {r["target_field"]: (r["mapping_type"], r["source_field"], r["confidence"], r["status"]) for r in rows}


def test_stages(spark):
    found = proposals(
        spark,
        [
            ("returns", "number"), ("Gross Sales", "number"), ("Region", "text"), ("Order ID", "text"), ("Active Flag", "number"),
            ("Flag Active", "boolean"), ("Chosen", "text"), ("Ghost", "text"), ("Nothing", "text"), ("Customer Label", "text"), ("Is Active", "number"),
        ],
        explicit={"Chosen": "orders.order_id", "Ghost": "orders.nope"},
    )
    assert found == {
        "returns": ("exact", "Returns", 0.99, "proposed_high_confidence"),
        "Gross Sales": ("normalized", "gross_sales", 0.97, "proposed_high_confidence"),
        "Region": ("documented_alias", "territory", 0.94, "proposed_high_confidence"),
        # an exact name wins over several normalised ones
        "Order ID": ("exact", "order id", 0.99, "proposed_high_confidence"),
        "Active Flag": ("unmapped", None, 0.0, "missing"),
        "Flag Active": ("semantic_candidate", "is_active", 0.75, "ambiguous"),
        "Chosen": ("explicit", "order_id", 1.0, "confirmed"),
        "Ghost": ("unmapped", None, 0.0, "incompatible"),
        "Nothing": ("unmapped", None, 0.0, "missing"),
        "Customer Label": ("unmapped", None, 0.0, "ambiguous"),
        "Is Active": ("normalized", "is_active", 0.0, "incompatible"),
    }


def test_ambiguity_and_given_aliases(spark):
    sources = [("a", "territory", "string"), ("b", "sales_area", "string"), ("a", "x-y", "string"), ("b", "x_y", "string"), ("b", "area51", "string")]
    found = proposals(spark, [("Region", "text"), ("XY", "text"), ("Zone", "text")], sources, aliases={"Zone": ["Area 51"]})
    assert found["Region"][3] == "ambiguous" and found["XY"][3] == "ambiguous"
    assert found["Zone"] == ("documented_alias", "area51", 0.94, "proposed_high_confidence")


def test_options_of_open_fields(spark, as_rows):
    fields = spark.createDataFrame([("Customer Label", "text"), ("Region", "text")], "target_field string, target_type string")
    s = spark.createDataFrame(SOURCES, "source_role string, source_field string, data_type string")
    found = {r["target_field"]: r["options"] for r in field_options(fields, s).collect()}
    assert found == {"Customer Label": ["master.customer_name", "orders.customer_id"], "Region": ["master.territory"]}
    assert field_options(fields, s, k=1).where("target_field = 'Customer Label'").first()["options"] == ["master.customer_name"]


def test_options_of_a_word_that_all_columns_share(spark):
    fields = spark.createDataFrame([("Total Amount", "number"), ("total", "text")], "target_field string, target_type string")
    rows = [(f"r{i:04}", f"total_{i:04}", "date" if i % 2 else "double") for i in range(2000)] + [("z", "amount", "int"), ("z", "totalamount", "boolean")]
    s = spark.createDataFrame(rows, "source_role string, source_field string, data_type string")
    found = {r["target_field"]: r["options"] for r in field_options(fields, s, k=3).collect()}
    assert found["Total Amount"] == [f"r{i:04}.total_{i:04}" for i in (0, 2, 4)] and found["total"] == [f"r{i:04}.total_{i:04}" for i in (0, 1, 2)]
    asked = clarifications(spark.createDataFrame([("total", "ambiguous"), ("Total Amount", "missing")], "target_field string, status string"), ["total", "Total Amount"], options=field_options(fields, s, k=3))
    assert {r["target_field"]: len(r["options"]) for r in asked.collect()} == {"total": 3, "Total Amount": 0}


def test_one_column_behind_two_words(spark):
    sources = [("a", "big_red_box", "string"), ("b", "small_red", "boolean")]
    found = proposals(spark, [("Box Red", "number"), ("Red Box", "text"), ("Box Big", "text")], sources)
    assert found["Box Red"][:2] == ("semantic_candidate", "big_red_box")
    assert found["Red Box"][3] == "ambiguous" and found["Red Box"][1] is None
    assert found["Box Big"] == ("semantic_candidate", "big_red_box", 0.75, "ambiguous")


def test_clarifications(spark, as_rows):
    mappings = spark.createDataFrame(
        [("A", "ambiguous"), ("B", "missing"), ("C", "incompatible"), ("D", "confirmed"), ("E", "missing"), ("F", "missing")], "target_field string, status string"
    )
    found = clarifications(mappings, ["A", "B", "C", "D", "E"], ["E"])
    assert as_rows(found) == [
        ("A", "ambiguous_mapping", "ambiguous"), ("B", "missing_required_field", "missing"), ("C", "incompatible_type", "incompatible")
    ]


def test_number_cleaning(spark):
    texts = [("$1,000.50",), ("(250)",), ("$(1,5)",), ("abc",), (None,), ("-3",), ("",), ("1 2",)]
    df = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in df.select(normalize_currency(F.col("t"))).collect()] == [1000.5, -250.0, -15.0, None, None, -3.0, None, None]
    assert [r[0] for r in df.select(normalize_number(F.col("t"))).collect()] == [None, None, None, None, None, -3.0, None, None]


def test_formula_text(spark):
    texts = ["=2+2", "  @SUM(A1)", "\t-1", " +x", "plain", "a=b", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(formula_safe(F.col("t"))).collect()]
    assert got == ["'=2+2", "'  @SUM(A1)", "'\t-1", "' +x", "plain", "a=b", "", None]


ORDERS = [(1, "C1", "$1,000.00", "100"), (2, "C2", "$500.00", "0")]
MASTER = [("C1", " Ann ", "North"), ("C2", "=Bob", "South")]


def plan(**changes):
    base = dict(
        source_roles=["orders", "master"],
        expected_source_columns={"orders": ["order_id", "cust", "gross", "returns"], "master": ["cust_id", "name", "territory"]},
        target=[
            TargetColumn("Order ID", "number"), TargetColumn("Customer Name", "text"), TargetColumn("Region", "text"), TargetColumn("Net Sales", "number"),
            TargetColumn("Commission", "number"), TargetColumn("Note"),
        ],
        mappings=[
            FieldMapping("Order ID", "orders", "order_id"), FieldMapping("Customer Name", "master", "name", "trim"),
            FieldMapping("Region", "master", "territory", "upper"), FieldMapping("Net Sales"), FieldMapping("Commission"), FieldMapping("Note"),
        ],
        joins=[JoinRule("master", ["cust"], ["cust_id"])],
        derivations=[
            DerivationRule("Net Sales", "subtract", [FieldReference("orders", "gross", "normalize_currency"), FieldReference("orders", "returns")]),
            DerivationRule("Commission", "policy_multiply", [FieldReference("target", "Net Sales")], policy_query="commission rate"),
        ],
        required_fields=["Order ID", "Customer Name"],
        unique_fields=["Order ID"],
    )
    return TransformPlan(**{**base, **changes})


def frames(spark, orders=ORDERS, master=MASTER):
    return {
        "orders": spark.createDataFrame(orders, "order_id long, cust string, gross string, returns string"),
        "master": spark.createDataFrame(master, "cust_id string, name string, territory string"),
    }


def policy(spark, text="The commission rate is 5%."):
    return spark.createDataFrame([("p1", text)], "chunk_id string, text string")


def test_transform(spark, as_rows):
    result = run_transform(plan(), frames(spark), policy(spark))
    assert result.frame.columns == ["Order ID", "Customer Name", "Region", "Net Sales", "Commission", "Note"]
    assert as_rows(result.frame) == [(1.0, "Ann", "NORTH", 900.0, 45.0, None), (2.0, "=Bob", "SOUTH", 500.0, 25.0, None)]
    assert result.checks.filter("NOT passed").count() == 0 and result.warnings == []
    assert [r["chunk_id"] for r in result.citations["Commission"].collect()] == ["p1"]
    lineage = {r["target_field"]: r["source_fields"] for r in result.provenance.collect()}
    assert lineage["Net Sales"] == "orders.gross, orders.returns"


@pytest.mark.parametrize(
    "change, data, message",
    [
        ({}, {"orders": [(1, "C1", "$1", "x")]}, "requires numeric input"),
        ({}, {"orders": [(1, "C1", "$1", "0"), (1, "C2", "$1", "0")]}, "violate uniqueness"),
        ({}, {"master": [("C1", "  ", "N"), ("C2", "b", "S")]}, "missing required values"),
        ({}, {"master": MASTER + [("C1", "Eve", "N")]}, "repeated keys"),
        ({"mappings": [FieldMapping(h) for h in ("Customer Name", "Region", "Net Sales", "Commission", "Note")] + [FieldMapping("Order ID", status="missing")]}, {}, "unresolved"),
        ({"source_roles": ["master", "orders"]}, {}, "Source-role drift"),
        ({"expected_source_columns": {"orders": ["a"], "master": ["b"]}}, {}, "Schema drift"),
        ({"mappings": [FieldMapping("Order ID", "orders", "nope")] + [FieldMapping(h) for h in ("Customer Name", "Region", "Net Sales", "Commission", "Note")]}, {}, "does not exist"),
        ({"target": [TargetColumn(h, "date" if h == "Region" else "unknown") for h in ("Order ID", "Customer Name", "Region", "Net Sales", "Commission", "Note")]}, {}, "incompatible with expected type date"),
        ({"derivations": [DerivationRule("Commission", "policy_multiply", [FieldReference("target", "Net Sales")], policy_query="rate")]}, {}, "before it is available"),
        ({"derivations": [DerivationRule("Net Sales", "divide", [FieldReference("orders", "order_id"), FieldReference("orders", "returns")])]}, {}, "divide by zero"),
    ],
)
def test_transform_refusals(spark, change, data, message):
    with pytest.raises(RefusedError, match=message):
        run_transform(plan(**change), frames(spark, **data), policy(spark))


def test_policy_refusals(spark):
    with pytest.raises(RefusedError, match="requires retrieved policy"):
        run_transform(plan(), frames(spark))
    with pytest.raises(RefusedError, match="exactly one"):
        run_transform(plan(), frames(spark), policy(spark, "The commission rate is 5% or 7%."))


def test_normalised_to_nothing_passes_unless_required(spark, as_rows):
    mappings = [
        FieldMapping("Order ID", "orders", "gross", "normalize_currency"), FieldMapping("Customer Name", "master", "name"), FieldMapping("Region"),
        FieldMapping("Net Sales"), FieldMapping("Commission"), FieldMapping("Note", "orders", "returns", "normalize_number"),
    ]
    orders = [(1, "C1", "$1", "x"), (2, "C2", "$2", "5")]
    result = run_transform(plan(mappings=mappings, derivations=[], required_fields=["Order ID"]), frames(spark, orders=orders))
    assert sorted((r["Note"] is not None, r["Note"]) for r in result.frame.collect()) == [(False, None), (True, 5.0)]


def test_booleans_and_concat(spark, as_rows):
    p = plan(
        target=[TargetColumn("Done", "boolean"), TargetColumn("Label", "text")],
        mappings=[FieldMapping("Done", "orders", "returns"), FieldMapping("Label")],
        derivations=[DerivationRule("Label", "concat", [FieldReference("master", "name", "trim"), FieldReference("master", "territory")], separator="-")],
        required_fields=[], unique_fields=[],
    )
    data = frames(spark, orders=[(1, "C1", "x", " YES"), (2, "C2", "x", "0"), (3, "C9", "x", None)])
    assert as_rows(run_transform(p, data).frame) == [(None, "-"), (False, "=Bob-South"), (True, "Ann-North")]
    with pytest.raises(RefusedError, match="type boolean"):
        run_transform(p, frames(spark, orders=[(1, "C1", "x", "maybe")]))


def test_text_dates(spark):
    texts = [
        "2026-08-31", " 2026-08-31T10:05:00 ", "2026-08", "08/31/2026", "8/5/2026 7:30", "August 5, 2026", "Aug 5, 2026", "5 August 2026",
        "5-Aug-2026", "2026/8/5", "20260805", "12:30", "31/08/2026", "soon", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", to_moment(F.col("t")).alias("m"))
    found = [None if r["m"] is None else r["m"].strftime("%Y-%m-%d %H:%M") for r in df.orderBy("i").collect()]
    fifth = "2026-08-05 00:00"
    assert found == [
        "2026-08-31 00:00", "2026-08-31 10:05", "2026-08-01 00:00", "2026-08-31 00:00", "2026-08-05 07:30", fifth, fifth, fifth, fifth, fifth, fifth,
        None, None, None, None, None,
    ]


def test_text_numbers(spark):
    texts = ["5d", "7F", "0x1p3", "1e3", " +.5 ", "-2.", "1_0", "inf", "NaN", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(normalize_number(F.col("t"))).collect()]
    assert found == [None, None, None, 1000.0, 0.5, -2.0, None, float("inf"), None, None]
