"""Scans: CSV, Parquet, JSON, text, JDBC tables and SELECT results, with explicit refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from auditframe.errors import RefusedError
from auditframe.functions.columns import ref, require_unique_names
from auditframe.functions.scalars import collapse_spaces, to_number
from auditframe.session import session_with, work_path
from auditframe.sources import csv_ranges
from auditframe.sources.json_ranges import stage_elements
from auditframe.sources.ranges import range_digests
from auditframe.sources.text_files import folder_groups, system_path, write_files

# The texts a CSV scan reads as missing, and schemas that are never imported.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast")
# Files of a folder of text documents; folders whose files the driver lists at one time.
FOLDER_FILES = 10_000
FOLDERS_AT_ONCE = 10
# Opening a small file counts for few bytes, so that a task reads thousands of them; tasks list folders side by side, and no list is kept.
FOLDER_SETTINGS = {
    "spark.sql.files.openCostInBytes": 32 << 10, "spark.sql.sources.parallelPartitionDiscovery.threshold": 1,
    "spark.sql.hive.filesourcePartitionFileCacheSize": 0,
}


def expect_size(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Opt-in bounds; a table beyond them is refused."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise RefusedError(f"Datasets may contain at most {max_columns} columns.")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise RefusedError(f"Datasets may contain at most {max_rows} rows.")
    return df


# ---- CSV --------------------------------------------------------------------------------------


def read_csv(
    spark: SparkSession, path: str, types: dict[str, str] | None = None, max_columns: int | None = None,
    multi_line: bool = True, line_sep: str | None = None, range_bytes: int | None = None,
) -> DataFrame:
    """CSV with a header. Missing tokens become null first, then columns get their type.

    Without ``types``, one aggregate over the files finds the narrowest of long, double, boolean and
    string for every column; dates stay text until asked. Quoted text may hold line breaks: files are
    read in ranges of ``range_bytes`` by many tasks, after a pass that finds out which ranges begin
    inside a quoted text (``csv_ranges``). ``multi_line=False`` saves that pass for files that are
    known to hold none. All files below ``path`` need one header: a file that differs from it in a
    name or in the order fails the job. Lines end in LF, CR and LF, or ``line_sep``.
    """
    options = {"multiLine": multi_line, "escape": '"'} | ({"lineSep": line_sep} if line_sep else {})
    given, names = _header_names(spark, path, options)
    if max_columns is not None and len(names) > max_columns:
        raise RefusedError(f"Datasets may contain at most {max_columns} columns.")
    if multi_line:
        text = csv_ranges.parse_records(csv_ranges.read_records(spark, path, given, line_sep or "\n", range_bytes), names)
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        text = spark.read.options(**options).csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=given != names)
    text = text.select(*[F.when(~ref(c).isin(*MISSING_TOKENS), ref(c)).alias(c) for c in names])
    types = types or infer_types(text)
    unknown = sorted(set(types) - set(names))
    if unknown:
        raise RefusedError(f"Unknown column(s) in CSV: {', '.join(unknown)}.")
    return text.select(*[_typed(c, types.get(c, "string")).alias(c) for c in names])


def _header_names(spark: SparkSession, path: str, options: dict) -> tuple[list[str], list[str]]:
    """Header as given, and its names: a repeated one gets a number and an empty one its position, as CSV readers do."""
    header = spark.read.options(**options).csv(path, header=False, encoding="UTF-8").first()
    if header is None:
        raise RefusedError("The CSV dataset is empty.")
    given = csv_ranges.given_names(list(header))
    names: list[str] = []
    for name in given:
        repeat, candidate = 0, name
        while candidate in names or (repeat and candidate in given):
            repeat += 1
            candidate = f"{name}.{repeat}"
        names.append(candidate)
    return given, names


_BOOLEAN_WORDS = ("true", "True", "TRUE", "false", "False", "FALSE")


def _typed(column: str, type_name: str) -> Column:
    return ref(column) if type_name == "string" else ref(column).cast(type_name)


def infer_types(text: DataFrame) -> dict[str, str]:
    """Type per column of an all-string table, from one aggregate."""
    checks = []
    for i, c in enumerate(text.columns):
        v = ref(c)
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.isNotNull() & F.trim(v).try_cast("long").isNull()).alias(f"l{i}"),
            F.count_if(v.isNotNull() & to_number(v).isNull()).alias(f"d{i}"),
            F.count_if(v.isNotNull() & ~v.isin(*_BOOLEAN_WORDS)).alias(f"b{i}"),
            F.count_if(v.rlike("[.eE]")).alias(f"p{i}"),
        ]
    row = text.agg(*checks).first()
    types = {}
    for i, c in enumerate(text.columns):
        if not row[f"n{i}"]:
            types[c] = "double"
        elif not row[f"l{i}"] and not row[f"p{i}"]:
            types[c] = "bigint"
        elif not row[f"d{i}"]:
            types[c] = "double"
        elif not row[f"b{i}"]:
            types[c] = "boolean"
        else:
            types[c] = "string"
    return types


# ---- Parquet ----------------------------------------------------------------------------------


def read_parquet(spark: SparkSession, path: str, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Parquet with unique, flat columns; the scan stays lazy, so filters and columns are pushed down.

    NaN is left to the operators, all of which treat it as missing: rewriting it here would keep
    float filters from reaching the files.
    """
    df = spark.read.parquet(path)
    require_unique_names(df)
    refuse_nested(df)
    return expect_size(df, max_rows, max_columns)


def refuse_nested(df: DataFrame) -> None:
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    if nested:
        raise RefusedError(f"Nested column types are not supported by table operations: {', '.join(nested)}.")


# ---- JSON -------------------------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, records_key: str | None = None, range_bytes: int | None = None) -> DataFrame:
    """JSON documents holding an array of records, or an object wrapping exactly one such array.

    A document is cut into its elements by many tasks (``json_ranges``), in ranges of ``range_bytes``,
    and staged as one element a line. Records are flattened one level (``parent.child``); arrays,
    deeper nesting, name collisions and non-finite constants are refused.
    """
    staged = stage_elements(spark, path, records_key, range_bytes)
    if staged.records:
        return flatten_records(_parse(spark, staged.path))
    if staged.wrapped:
        return _parse(spark, staged.path)
    return _scalar_column(spark.read.schema("value string").json(staged.path, mode="FAILFAST", allowNonNumericNumbers=False))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per line, flattened like ``read_json``; the only form whose files split."""
    return flatten_records(_parse(spark, path))


def _parse(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.json(path, mode="FAILFAST", allowNonNumericNumbers=False)
    except Exception as exc:
        raise RefusedError("The JSON is malformed or holds values that are not accepted.") from exc


def _scalar_column(values: DataFrame) -> DataFrame:
    return values.select(_typed("value", infer_types(values)["value"]).alias("value"))


def flatten_records(df: DataFrame) -> DataFrame:
    """Struct columns become ``parent.child`` columns, one level deep."""
    selected: list[Column] = []
    names: list[str] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType)):
            raise RefusedError(f"JSON field '{f.name}' is an array; nested arrays are not flattened.")
        if isinstance(f.dataType, T.StructType):
            for child in f.dataType.fields:
                if isinstance(child.dataType, (T.StructType, T.ArrayType, T.MapType)):
                    raise RefusedError(f"JSON field '{f.name}' contains nested structures that cannot be flattened safely.")
                names.append(f"{f.name}.{child.name}")
                selected.append(ref(f.name).getField(child.name).alias(names[-1]))
        else:
            names.append(f.name)
            selected.append(ref(f.name))
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise RefusedError(f"JSON records have colliding field '{repeated[0]}'.")
    return df.select(*selected)


# ---- text -------------------------------------------------------------------------------------


def write_text_documents(df: DataFrame, text: str, path: str) -> None:
    """Every row's text, with a line end, as a file of its own below ``path/folder=*``.

    A folder holds at most ``FOLDER_FILES`` files, all of one task, so that it is moved in place as one
    and folders are listed side by side. In a folder of the operating system, which every machine then
    sees under this path, tasks write the files themselves (``text_files``); Spark writes to other stores.
    """
    local = system_path(df.sparkSession, path)
    if local is not None:
        write_files(df, text, local, FOLDER_FILES)
        return
    folder = F.floor(F.monotonically_increasing_id() / FOLDER_FILES)
    df.select(F.col(text).alias("value"), folder.alias("folder")).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per UTF-8 text file: name, sha256 of the bytes, and the text with white space collapsed.

    The files are opened once: their rows are kept, with what the checks ask for. Of many folders the
    driver lists the files of ``FOLDERS_AT_ONCE`` at a time.
    """
    session = session_with(spark, FOLDER_SETTINGS)
    kept = work_path(spark, "text-documents")
    for paths in folder_groups(spark, path, FOLDERS_AT_ONCE):
        _decoded(session.read.format("binaryFile").load(paths)).write.mode("append").parquet(kept, compression="zstd")
    decoded = spark.read.schema(_DECODED).parquet(kept)
    faults = ("invalid", "nulls", "empty", "binary")
    checked = decoded.agg(*[F.count_if(name).alias(name) for name in faults]).first()
    for name, message in (
        ("invalid", "Text documents must be valid UTF-8."),
        ("nulls", "Text documents containing null bytes are not accepted."),
        ("empty", "A text document contains no extractable text."),
        ("binary", "A file is not plain text."),
    ):
        if checked[name]:
            raise RefusedError(message)
    return decoded.select("filename", "digest", F.lit(1).alias("page_number"), "text")


_DECODED = "filename string, digest string, text string, invalid boolean, nulls boolean, empty boolean, binary boolean"


def _decoded(files: DataFrame) -> DataFrame:
    """(filename, digest, text) of files, and what the checks ask of each."""
    raw = F.col("raw")
    marked = raw.startswith("\ufeff")
    decoded = files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.sha2(F.col("content"), 256).alias("digest"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("raw"),
    )
    texts = decoded.withColumn("text", collapse_spaces(F.when(marked, F.regexp_replace(raw, "^\\x{feff}", "")).otherwise(raw)))
    return texts.select(
        "filename", "digest", "text",
        raw.isNull().alias("invalid"),
        raw.contains("\0").alias("nulls"),
        ((F.length("text") == 0) & ~marked).alias("empty"),
        (raw.startswith("%PDF-") | raw.startswith("PK")).alias("binary"),
    )


# ---- relational sources -----------------------------------------------------------------------


def jdbc_options(
    url: str, schema: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 1, fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options of a schema-qualified table; a large table is read in ranges of one column."""
    if schema.lower() in SYSTEM_SCHEMAS or schema.lower().startswith("pg_"):
        raise RefusedError("System schemas are not available through table imports.")
    quoted = ".".join('"' + part.replace('"', '""') + '"' for part in (schema, table))
    options = {"url": url, "dbtable": quoted, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        if bounds is None or partitions < 1:
            raise RefusedError("A partitioned import needs bounds and a positive number of partitions.")
        options |= {
            "partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, options: dict[str, str], properties: dict[str, str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Import a relational table through Spark's JDBC reader; filters and columns are pushed down."""
    df = spark.read.format("jdbc").options(**options, **(properties or {})).load()
    require_unique_names(df)
    return expect_size(df, max_rows)


# ---- provenance -------------------------------------------------------------------------------


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, byte_size, sha256) of every file below a path, from the digests of its ranges, read by many tasks.

    A file of one range has the sha256 of its bytes; a larger one that of its range digests in order, so
    a file of any size is read in parts, and one that grows changes its last branch only.
    """
    branches = file_branches(spark, path)
    listed = F.sort_array(F.collect_list(F.struct("start", "sha256")))
    whole = branches.groupBy("path", "byte_size").agg(listed.alias("b"))
    joined = F.concat_ws("", F.transform("b", lambda x: x["sha256"]))
    return whole.select("path", "byte_size", F.when(F.size("b") == 1, F.col("b")[0]["sha256"]).otherwise(F.sha2(joined, 256)).alias("sha256"))


def file_branches(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(path, byte_size, start, sha256): one row per range of every file, the leaves of its fingerprint."""
    listed = spark.read.format("binaryFile").load(path)
    files = listed.select("path", F.col("length").alias("byte_size"), F.xxhash64("_metadata.file_path").alias("file"))
    ranges = range_digests(spark, path, range_bytes)
    per_file = ranges.groupBy("file").agg(F.sum("size").alias("counted"), F.max("start").alias("last"))
    named = files.join(per_file, "file", "left").join(ranges, "file", "left")
    # The reader does not tell whether a file ends in a line end; its size does.
    without = (F.col("start") == F.col("last")) & (F.col("counted") == F.col("byte_size") + 1)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return named.select("path", "byte_size", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce(F.when(without, F.col("unended")).otherwise(F.col("ended")), nothing).alias("sha256"))


def provenance(df: DataFrame, source_type: str, identity: str, fingerprint: str, details: dict[str, str] | None = None) -> DataFrame:
    """One row describing where a table came from."""
    pairs = [F.lit(part) for item in (details or {}).items() for part in item]
    extra = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(source_type).alias("source_type"),
        F.lit(identity).alias("identity"),
        F.current_timestamp().alias("retrieved_at"),
        F.lit(fingerprint).alias("config_fingerprint"),
        "row_count",
        extra.alias("details"),
    )
