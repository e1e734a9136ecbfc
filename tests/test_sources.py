"""Scans and sinks on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from auditframe.errors import RefusedError
from auditframe.sources import scans
from auditframe.sources.scans import (
    expect_size, file_fingerprints, jdbc_options, provenance, read_csv, read_json, read_json_lines, read_parquet, read_text_documents, write_text_documents,
)
from auditframe.sources.sinks import Export, check_export, export_csv, integrity_findings, require_checks, write_tables
from auditframe.sources.text_files import folder_groups
from auditframe.workload import QUERIES, sources
from conftest import plan_of


def put(path, content, name="data"):
    path.mkdir(exist_ok=True)
    (path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path / name)


def test_csv(spark, tmp_path, as_rows):
    path = put(tmp_path, '﻿id,name,amount,flag,day,none\n1,"a, b",1.5,true,2026-08,\n2,NA,n/a,False,2026-09,NULL\n3,"say ""x""",7,TRUE,x,nan\n', "x.csv")
    df = read_csv(spark, path)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("amount", "double"), ("flag", "boolean"), ("day", "string"), ("none", "double")]
    assert as_rows(df) == [
        (1, "a, b", 1.5, True, "2026-08", None), (2, None, None, False, "2026-09", None), (3, 'say "x"', 7.0, True, "x", None)
    ]
    typed = read_csv(spark, path, types={"id": "int", "amount": "double"})
    assert dict(typed.dtypes)["id"] == "int" and dict(typed.dtypes)["flag"] == "string"


@pytest.mark.parametrize("content", ["a,b\n1,2,3\n", ""])
def test_csv_refusals(spark, tmp_path, content):
    with pytest.raises(Exception):
        read_csv(spark, put(tmp_path, content, "x.csv")).collect()


def test_csv_line_breaks_and_headers(spark, tmp_path, as_rows):
    texts = spark.createDataFrame([(1, " one\ntwo"), (2, 'a "b",\r\n\nc '), (3, "plain")], "id long, t string")
    export = export_csv(texts, str(tmp_path / "out"))
    assert check_export(spark, export, ["id", "t"]).filter("not passed").count() == 0
    assert as_rows(read_csv(spark, export.path, line_sep="\n")) == as_rows(texts)
    put(tmp_path / "many", "id,amount\n1,10\n", "a.csv")
    put(tmp_path / "many", "id,amount\n2,20\n", "b.csv")
    assert as_rows(read_csv(spark, str(tmp_path / "many"))) == [(1, 10), (2, 20)]
    put(tmp_path / "many", "amount,id\n30,3\n", "c.csv")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "many"), types={"id": "bigint", "amount": "bigint"}).collect()


def test_csv_suffixed_numbers_stay_text(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a,b,c\n1D,1e3,0x1\n2F,.5,7\n", "x.csv"))
    assert df.dtypes == [("a", "string"), ("b", "double"), ("c", "string")]


def test_json_lines(spark, tmp_path, as_rows):
    path = put(tmp_path, '{"id": 1, "who": {"name": "Ann"}}\n{"id": 2, "who": {"name": null}}\n', "x.jsonl")
    df = read_json_lines(spark, path)
    assert sorted(df.columns) == ["id", "who.name"] and as_rows(df.select("id", "`who.name`")) == [(1, "Ann"), (2, None)]
    with pytest.raises(Exception):
        read_json_lines(spark, put(tmp_path, '{"id": 1}\n{"id": \n', "y.jsonl")).collect()


def test_csv_repeated_and_empty_names(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a,a,,a.1,a\n1,2,3,4,5\n", "x.csv"))
    assert df.columns == ["a", "a.2", "Unnamed: 2", "a.1", "a.3"] and tuple(df.first()) == (1, 2, 3, 4, 5)


def test_width_and_size(spark, tmp_path):
    path = put(tmp_path, "a,b\n1,2\n3,4\n", "x.csv")
    with pytest.raises(RefusedError, match="1 columns"):
        read_csv(spark, path, max_columns=1)
    with pytest.raises(RefusedError, match="1 rows"):
        expect_size(read_csv(spark, path), max_rows=1)
    assert expect_size(read_csv(spark, path), max_rows=2).count() == 2


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumn("v", F.col("id") * 1.0).withColumn("w", F.lit("x")).write.parquet(path)
    plan = plan_of(read_parquet(spark, path).filter("v > 50").select("id"))
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,50.0)]" in plan and "ReadSchema: struct<id:bigint,v:double>" in plan
    nested = str(tmp_path / "n")
    spark.range(1).select(F.array("id").alias("items")).write.parquet(nested)
    with pytest.raises(RefusedError, match="Nested"):
        read_parquet(spark, nested)


def test_json_records(spark, tmp_path, as_rows):
    records = [{"order_id": 1, "customer": {"name": "Ann", "region": "N"}}, {"order_id": 2, "customer": {"name": "Bob", "region": None}}]
    for payload, key in ((records, None), ({"records": records}, None), ({"records": records, "other": [1]}, "records"), ({"n": 1, "records": records, "empty": []}, None)):
        path = put(tmp_path, json.dumps(payload, indent=1), "x.json")
        df = read_json(spark, path, key)
        assert sorted(df.columns) == ["customer.name", "customer.region", "order_id"]
        assert as_rows(df.select("order_id", "`customer.name`", "`customer.region`")) == [(1, "Ann", "N"), (2, "Bob", None)]
    assert as_rows(read_json(spark, put(tmp_path, "﻿ [1, 2, 3]", "x.json"))) == [(1,), (2,), (3,)]
    assert as_rows(read_json(spark, put(tmp_path, '{"v": ["a", "b"]}', "x.json"))) == [("a",), ("b",)]


@pytest.mark.parametrize(
    "text, key",
    [
        ('{"a": [1], "b": [2]}', None), ('{"a": 1}', None), ('{"a": [1]}', "zz"), ('{"a": 1}', "a"), ("[1, 2]", "a"), ("[]", None),
        ('{"a": []}', "a"), ("5", None), ('[{"a": [1]}]', None), ('[{"a": {"b": {"c": 1}}}]', None),
        ('[{"customer": {"name": "x"}, "customer.name": "y"}]', None), ('[{"a": NaN}]', None), ('[{"a": 1}, {"a": ', None),
        ('{"a": [1, {"b": 2}]}', None), ('[1, {"b": 2}]', None), ('[{"b": 2}, 1]', None), ('{"a": [{"b": 1}, 2]}', None),
    ],
)
def test_json_refusals(spark, tmp_path, text, key):
    path = put(tmp_path, text, "x.json")
    with pytest.raises(RefusedError):
        read_json(spark, path, key).collect()


def test_text_documents(spark, tmp_path):
    put(tmp_path / "d", "﻿Hello  world \n", "a.txt")
    row = read_text_documents(spark, str(tmp_path / "d")).first()
    assert (row["filename"], row["text"], row["page_number"]) == ("a.txt", "Hello world", 1)
    for bad in (b"\xff\xfe\xfa", b"a\0b", b"  \n", b"%PDF-1.4"):
        put(tmp_path / "d", bad, "b.txt")
        with pytest.raises(RefusedError):
            read_text_documents(spark, str(tmp_path / "d"))


def test_jdbc_options():
    options = jdbc_options("jdbc:x", "sales", 'or"ders', "id", (0, 100), 8)
    assert options["dbtable"] == '"sales"."or""ders"' and options["numPartitions"] == "8"
    for schema in ("pg_catalog", "Information_Schema", "pg_temp_1"):
        with pytest.raises(RefusedError):
            jdbc_options("jdbc:x", schema, "t")
    with pytest.raises(RefusedError):
        jdbc_options("jdbc:x", "s", "t", "id")


def test_provenance(spark):
    row = provenance(spark.range(3), "upload", "upload:x.csv", "f" * 64, {"file_type": "csv"}).first()
    assert (row["row_count"], row["identity"], row["details"]) == (3, "upload:x.csv", {"file_type": "csv"})
    assert provenance(spark.range(0), "upload", "x", "y").first()["details"] == {}


def test_export_and_reopen(spark, tmp_path, as_rows):
    df = spark.createDataFrame([(1, "=2+2"), (2, 'a "quoted", text'), (3, "line\\end")], "id long, label string")
    export = export_csv(df, str(tmp_path / "out"))
    assert (export.row_count, export.column_count) == (3, 2)
    checks = check_export(spark, export, ["id", "label"])
    require_checks(checks)
    assert as_rows(read_csv(spark, export.path)) == [(1, "'=2+2"), (2, 'a "quoted", text'), (3, "line\\end")]
    with pytest.raises(RefusedError, match="schema/order"):
        require_checks(check_export(spark, export, ["label", "id"]))
    with pytest.raises(RefusedError, match="contains 3 rows"):
        require_checks(check_export(spark, Export(export.path, 4, 2), ["id", "label"]))
    with pytest.raises(Exception):
        export_csv(df, str(tmp_path / "out"))


def test_integrity(spark, tmp_path):
    folder = tmp_path / "files"
    put(folder, "one", "a.bin"), put(folder, "two", "b.bin")
    manifest = spark.createDataFrame(file_fingerprints(spark, str(folder)).collect())
    assert integrity_findings(spark, str(folder), manifest).count() == 0
    put(folder, "owt", "b.bin"), put(folder, "longer", "a.bin"), put(folder, "x", "c.bin")
    gone = manifest.union(spark.createDataFrame([("file:/gone", 1, "x")], manifest.schema))
    found = {r["path"].split("/")[-1]: r["finding"] for r in integrity_findings(spark, str(folder), gone).collect()}
    assert found == {"a.bin": "size_changed", "b.bin": "content_changed", "c.bin": "unexpected", "gone": "missing"}


def test_write_tables(spark, tmp_path):
    written = write_tables({"a": spark.range(2), "b": spark.range(3)}, str(tmp_path / "set"))
    assert {n: spark.read.parquet(p).count() for n, p in written.items()} == {"a": 2, "b": 3}


def test_texts_are_files_of_their_own_in_few_folders(spark, tmp_path):
    texts = [f"text {i % 90}\nline two" for i in range(100)]
    write_text_documents(spark.createDataFrame([(t,) for t in texts], "body string").repartition(3), "body", str(tmp_path / "t"))
    assert len(list(tmp_path.glob("t/folder=*"))) <= 3 and len(list(tmp_path.glob("t/folder=*/*.txt"))) == 100
    read = read_text_documents(spark, f"{tmp_path}/t/folder=*")
    assert sorted(r["text"] for r in read.collect()) == sorted(t.replace("\n", " ") for t in texts)


def test_texts_in_a_folder_are_written_by_the_tasks(spark, tmp_path):
    """Spark's writer adds a checksum file to each text there and starts a process for the mode of both."""
    texts = ["plain", "größe\r\nzwei", "", None, "x" * 100_000]
    write_text_documents(spark.createDataFrame([(t,) for t in texts], "body string").repartition(2), "body", str(tmp_path / "t"))
    files = [p for p in tmp_path.glob("t/**/*") if p.is_file()]
    assert sorted(p.read_bytes() for p in files if p.name != "_SUCCESS") == sorted(((t or "") + "\n").encode() for t in texts)
    assert all(p.parent.name.startswith("folder=") for p in files if p.name != "_SUCCESS")
    with pytest.raises(Exception):
        write_text_documents(spark.createDataFrame([("again",)], "body string"), "body", str(tmp_path / "t"))
    broken = spark.range(20).select(F.when(F.col("id") < 15, "a").otherwise(F.raise_error(F.lit("stop")).cast("string")).alias("body"))
    with pytest.raises(Exception, match="stop"):
        write_text_documents(broken, "body", str(tmp_path / "u"))
    assert not list(tmp_path.glob("u/*"))


def test_other_stores_get_the_same_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "system_path", lambda *_: None)
    monkeypatch.setattr(scans, "FOLDER_FILES", 4)
    texts = sorted(f"text {i}" for i in range(30))
    write_text_documents(spark.createDataFrame([(t,) for t in texts], "body string").repartition(3), "body", str(tmp_path / "t"))
    assert sorted(r["text"] for r in read_text_documents(spark, f"{tmp_path}/t/folder=*").collect()) == texts


def test_folders_are_listed_some_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "FOLDER_FILES", 4)
    monkeypatch.setattr(scans, "FOLDERS_AT_ONCE", 2)
    texts = [f"text {i % 20}" for i in range(30)]
    write_text_documents(spark.createDataFrame([(t,) for t in texts], "body string").repartition(3), "body", str(tmp_path / "t"))
    put(tmp_path / "t" / "folder=[a]*", "\ufeff odd  name\n", "x.txt")
    pattern = f"{tmp_path}/t/folder=*"
    groups = folder_groups(spark, pattern, 2)
    assert len(groups) > 4 and {len(g) for g in groups} <= {1, 2} and folder_groups(spark, pattern, 100) == [[pattern]]
    assert folder_groups(spark, f"{pattern}/*.txt", 2) == [[f"{pattern}/*.txt"]]
    read = read_text_documents(spark, pattern)
    assert sorted(r["text"] for r in read.collect()) == sorted([*texts, "odd name"])
    put(tmp_path / "t" / "folder=zz", b"\xff\xfe", "bad.txt")
    with pytest.raises(RefusedError, match="UTF-8"):
        read_text_documents(spark, pattern)


def test_documents_of_one_id_share_a_file(spark, tmp_path):
    rows = [(1, "same words"), (1, "same words"), (2, "same words"), (None, "third"), (None, "third")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["text"]: r["files"] for r in QUERIES["text_files_scan"](spark, str(tmp_path)).collect()}
    assert found == {"same words same words": 1, "same words": 1, "third third": 1}


def test_large_tables_are_written_as_several_files(spark, tmp_path, monkeypatch):
    """Past a bound a further file is begun, so that no task reads the whole table."""
    monkeypatch.setattr(sources, "FILE_RECORDS", 7)
    monkeypatch.setattr(sources, "FILE_BYTES", 3000)
    monkeypatch.setattr(sources, "work_path", lambda session, label: f"{tmp_path}/{label}")
    when = datetime(2024, 5, 6)
    orders = [(i // 2, "O", 1.5 * i, when) for i in range(30)] + [(None, "F", 2.0, when)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    found = sorted(r["total"] for r in QUERIES["json_one_array_in_ranges"](spark, str(tmp_path)).collect())
    assert found == sorted(x[2] for x in orders) and len(list(tmp_path.glob("orders-one-json/part=*/*.txt"))) > 2
    docs = [(i, f'line "{i}"\nnext', "en", "s", 9) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["csv_one_file_in_ranges"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == docs and len(list(tmp_path.glob("documents-one-csv/*.csv"))) > 1
