"""Scans and sinks on whole tables."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from auditframe.functions.identity import content_sums, fingerprint_of, merged_sums
from auditframe.functions.scalars import neutralize_formulas, normalize_currency, normalize_number, to_moment
from auditframe.session import work_path
from auditframe.sources.scans import file_fingerprints, flatten_records, read_csv, read_json, read_json_lines, read_parquet
from auditframe.sources.sinks import CSV_OPTIONS, check_export, export_csv, require_checks
from auditframe.workload.registry import query, table


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def parquet_scan_pushdown(spark, sf):
    orders = read_parquet(spark, f"{sf}/orders.parquet")
    return orders.filter("o_totalprice > 250000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query(
    """
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '''=' || p_name WHEN p_type = 'SMALL' THEN ''' @' || p_name ELSE p_name END AS label,
           p_size, p_retailprice, CASE WHEN p_brand = 'Brand#7' THEN NULL ELSE p_brand END AS brand
    FROM part
    """
)
def csv_export_and_scan(spark, sf):
    """Export with formula-like names neutralised, re-open check, and a scan with missing tokens."""
    parts = table(spark, sf, "part").select(
        "p_partkey",
        F.expr("CASE WHEN p_type = 'PROMO' THEN concat('=', p_name) WHEN p_type = 'SMALL' THEN concat(' @', p_name) ELSE p_name END").alias("label"),
        "p_size", "p_retailprice", F.expr("CASE WHEN p_brand = 'Brand#7' THEN 'N/A' ELSE p_brand END").alias("brand"),
    )
    export = export_csv(parts, work_path(spark, "parts-csv"))
    require_checks(check_export(spark, export, parts.columns))
    return read_csv(spark, export.path).withColumn("p_size", F.col("p_size").cast("int"))


@query(
    """
    SELECT doc_id, CASE WHEN regexp_matches(text, '^[\\s]*[=+\\-@]') THEN '''' || text ELSE text END AS text
    FROM (SELECT doc_id, CASE lang WHEN 'en' THEN '=' || text WHEN 'de' THEN '  -' || text ELSE text END AS text FROM documents)
    """
)
def formula_neutralised_text(spark, sf):
    texts = table(spark, sf, "documents").selectExpr(
        "doc_id", "CASE lang WHEN 'en' THEN concat('=', text) WHEN 'de' THEN concat('  -', text) ELSE text END AS text"
    )
    return neutralize_formulas(texts)


@query(
    "SELECT event_id, event_type AS \"kind.name\", (props::JSON ->> 'k')::BIGINT AS \"props.k\" FROM events"
)
def json_records_flattened(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("event_type").alias("name")).alias("kind"), F.from_json("props", "k long").alias("props")
    )
    return flatten_records(events)


@query(
    r"""
    SELECT doc_id, nullif(CASE WHEN regexp_matches(text, '^[\s]*[=+\-@]') THEN '''' || text ELSE text END, '') AS text, lang, source, n_chars
    FROM documents
    """
)
def csv_documents_round_trip(spark, sf):
    """Texts with line breaks and quotes through the checked CSV export and back."""
    documents = table(spark, sf, "documents")
    export = export_csv(documents, work_path(spark, "documents-csv"))
    require_checks(check_export(spark, export, documents.columns))
    return read_csv(spark, export.path, types={"doc_id": "bigint", "n_chars": "bigint"}, line_sep="\n")


@query("SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def csv_one_file_in_ranges(spark, sf):
    """All documents, with line breaks and quotes, as one CSV file that many tasks read.

    A task writes a file, so each further ``FILE_BYTES`` of the table are one more file, read in the same way.
    """
    documents = table(spark, sf, "documents")
    path = work_path(spark, "documents-one-csv")
    size = spark.read.format("binaryFile").load(f"{sf}/documents.parquet").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    files = -(-size // FILE_BYTES) or 1
    documents.coalesce(files).write.options(**CSV_OPTIONS).csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_csv(spark, path, types={"doc_id": "bigint", "n_chars": "bigint"}, range_bytes=1 << 19)


#: Bytes of the table, and orders, of one written file; up to these there is a single one.
FILE_BYTES, FILE_RECORDS = 64 << 20, 250_000

_JSON_ORDERS = """
    SELECT o_orderkey AS "order.key", o_orderstatus AS "order.status", o_totalprice AS total, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
"""
#: Records of one written JSON document; a document is written as one row.
DOCUMENT_RECORDS = 5_000


def _order_records(spark, sf):
    return table(spark, sf, "orders").select(
        F.struct(
            F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("order"),
            F.col("o_totalprice").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        ).alias("record")
    )


def _json_documents(spark, records, content):
    """Records dealt evenly to documents, one file each; ``content`` makes the text of the collected records."""
    documents = -(-records.count() // DOCUMENT_RECORDS) or 1
    dealt = records.groupBy(F.pmod(F.xxhash64("record"), F.lit(documents)).alias("part")).agg(F.collect_list("record").alias("records"))
    path = work_path(spark, "orders-json")
    dealt.select(content(F.col("records")).alias("value"), "part").write.partitionBy("part").text(path)
    return f"{path}/part=*"


@query(_JSON_ORDERS)
def json_array_scan(spark, sf):
    """Documents that are an array of nested records."""
    return read_json(spark, _json_documents(spark, _order_records(spark, sf), F.to_json))


@query(_JSON_ORDERS)
def json_one_array_in_ranges(spark, sf):
    """All orders as one array in one file that many tasks read.

    A task orders and writes a file, so each further ``FILE_RECORDS`` orders are one more array and file.
    """
    records = _order_records(spark, sf).select("record", F.col("record.order.key").alias("key"))
    files = -(-records.count() // FILE_RECORDS) or 1
    dealt = records.withColumn("part", F.pmod(F.xxhash64("record"), F.lit(files)))
    in_file = Window.partitionBy("part").orderBy("key")
    place = F.row_number().over(in_file).alias("place")
    placed = dealt.select("record", "part", place, F.lead(F.lit(True)).over(in_file).isNull().alias("last"))
    line = F.concat(F.when(F.col("place") == 1, "[").otherwise(""), F.to_json("record"), F.when(F.col("last"), "]").otherwise(","))
    path = work_path(spark, "orders-one-json")
    placed.sortWithinPartitions("part", "place").select(line.alias("value"), "part").write.partitionBy("part").text(path)
    path = f"{path}/part=*"
    return read_json(spark, path, range_bytes=1 << 18)


@query(_JSON_ORDERS)
def json_wrapped_scan(spark, sf):
    """Documents that wrap one array of records among other fields."""

    def content(records):
        return F.to_json(F.struct(F.size(records).alias("count"), records.alias("orders")))

    return read_json(spark, _json_documents(spark, _order_records(spark, sf), content))


@query(_JSON_ORDERS)
def json_records_key_scan(spark, sf):
    """Documents with two arrays; the key tells which holds the records."""

    def content(records):
        return F.to_json(F.struct(records.alias("orders"), F.transform(records, lambda r: r["day"]).alias("days")))

    return read_json(spark, _json_documents(spark, _order_records(spark, sf), content), "orders")


@query(_JSON_ORDERS)
def json_lines_scan(spark, sf):
    """One record per line, the form that splits."""
    path = work_path(spark, "orders-jsonl")
    _order_records(spark, sf).select(F.to_json("record").alias("value")).write.text(path)
    return read_json_lines(spark, path)


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS day,
           CASE WHEN o_orderkey % 4 < 2 THEN round(o_totalprice, 2) WHEN o_orderkey % 4 = 2 THEN -round(o_totalprice, 2) END AS price,
           o_orderkey * 1000.0::DOUBLE AS thousands
    FROM orders
    """
)
def text_numbers_and_dates(spark, sf):
    """Dates in four notations and prices in three; a time alone and a number with a suffix are unreadable."""
    texts = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy')
           WHEN 2 THEN date_format(o_orderdate, ' MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'd MMM yyyy') ELSE '12:30' END AS day""",
        """CASE o_orderkey % 4 WHEN 0 THEN format_string('$%.2f', o_totalprice) WHEN 1 THEN concat(' ', format_number(o_totalprice, 2))
           WHEN 2 THEN concat('(', format_number(o_totalprice, 2), ')') ELSE concat(cast(o_orderkey AS string), 'd') END AS price""",
        "format_number(o_orderkey * 1000, 0) AS thousands",
    )
    return texts.select(
        "o_orderkey", to_moment(F.col("day")).alias("day"), normalize_currency(F.col("price")).alias("price"),
        normalize_number(F.col("thousands")).alias("thousands"),
    )


@query()
def source_file_fingerprints(spark, sf):
    """Fingerprints of every source file (the hashed bytes are not visible to a SQL view)."""
    files = file_fingerprints(spark, f"{sf}/*.parquet")
    return files.select(F.element_at(F.split("path", os.sep), -1).alias("file"), "byte_size", "sha256")


# The flat tables and their columns; one more holds a list column and has no row text.
_FLAT = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _sums_sql(name, columns):
    row = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns.split())
    halves = ", ".join(f"coalesce(sum(('0x' || substr(d, {at}, 16))::UBIGINT), 0)::HUGEINT AS {n}" for at, n in ((1, "high"), (17, "low")))
    return f"SELECT '{name}' AS table_name, count(*) AS row_count, {halves} FROM (SELECT md5({row}) AS d FROM {name})"


@query(
    "SELECT table_name, row_count, sha256(row_count || ':' || high || ':' || low) AS fingerprint FROM ("
    + " UNION ALL ".join(_sums_sql(*x) for x in _FLAT.items()) + ")"
)
def table_content_fingerprints(spark, sf):
    """Order-independent fingerprints of tables; that of the orders is merged from two halves."""

    def sums(name):
        rows = table(spark, sf, name)
        if name != "orders":
            return content_sums(rows)
        halves = [rows.filter(F.col("o_orderkey") % 2 == i) for i in (0, 1)]
        return merged_sums(content_sums(halves[0]).unionByName(content_sums(halves[1])))

    frames = [fingerprint_of(sums(name)).select(F.lit(name).alias("table_name"), "row_count", "fingerprint") for name in _FLAT]
    return reduce(DataFrame.unionByName, frames)
