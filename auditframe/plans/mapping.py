"""Source-to-target tables: dataset roles, field candidates, clarifications, execution, validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.columns import family, missing
from auditframe.functions.scalars import blank, coerce, map_value, name_tokens, normalized_name, strip, to_number
from auditframe.operators.joins import join_sources
from auditframe.operators.transforms import arithmetic
from auditframe.plans.evidence import policy_rate
from auditframe.plans.specs import DerivationRule, TransformPlan
from auditframe.sources.sinks import Export, check_export, export_csv, require_checks

# Business aliases of normalised target names, confidence per kind of match, and
# the source type words that fit a target type.
ALIASES = {
    "customerid": ("customer", "customerkey", "custid", "custkey", "accountid"),
    "firstname": ("givenname", "forename"),
    "lastname": ("surname", "familyname"),
    "fullname": ("customername", "employeename", "salespersonname"),
    "region": ("territory", "salesarea", "marketregion"),
    "grosssales": ("grossamount", "salesamount", "amount"),
    "netsales": ("netamount", "eligibleamount"),
    "returns": ("returnamount", "refunds", "refundamount"),
    "orderdate": ("transactiondate", "purchasedate", "date"),
}
#: Source columns that a question to a person lists.
OPTIONS = 20
CONFIDENCE = {"explicit": 1.0, "exact": 0.99, "normalized": 0.97, "documented_alias": 0.94, "semantic_candidate": 0.75}
SALES_ROLES = {
    "transactions": ["transaction_id", "date", "salesperson", "customer_id", "amount", "discount", "status"],
    "customers": ["customer_id", "region"],
    "targets": ["region", "target"],
}


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table: dataset, position, column_name, data_type."""
    rows = [
        (name, i, f.name, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "dataset string, position int, column_name string, data_type string")


def identify_roles(catalog: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """Per role, how many datasets hold all its required columns, and which one if it is unique."""
    spark = catalog.sparkSession
    required = spark.createDataFrame(
        [(role, c) for role, columns in roles.items() for c in columns], "role string, column_name string"
    )
    sizes = spark.createDataFrame([(role, len(set(c))) for role, c in roles.items()], "role string, needed int")
    held = (
        catalog.select("dataset", "column_name").distinct()
        .join(F.broadcast(required.distinct()), "column_name")
        .groupBy("role", "dataset")
        .agg(F.count(F.lit(1)).alias("held"))
    )
    matches = held.join(F.broadcast(sizes), "role").filter(F.col("held") == F.col("needed"))
    counted = matches.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("dataset").alias("first"))
    return sizes.join(counted, "role", "left").select(
        "role", F.coalesce("n", F.lit(0)).alias("matching_datasets"), F.when(F.col("n") == 1, F.col("first")).alias("dataset")
    )


# ---- field candidates -------------------------------------------------------------------------


def type_compatible(target_type: Column, data_type: Column) -> Column:
    """Text fits every target; numbers, dates and booleans need their own type or text."""
    text = data_type.rlike("string|char")
    return (
        F.when(target_type == "number", text | data_type.rlike("int|float|double|decimal"))
        .when(target_type == "date", text | data_type.rlike("date|timestamp"))
        .when(target_type == "boolean", text | data_type.rlike("bool"))
        .otherwise(F.lit(True))
    )


def _aliased_targets(fields: DataFrame, extra: dict[str, list[str]]) -> DataFrame:
    """(target_field, target_type, alias_norm): documented aliases by normalised name, given ones by name."""
    spark = fields.sparkSession
    documented = spark.createDataFrame([(t, a) for t, aliases in ALIASES.items() for a in aliases], "t_norm string, alias string")
    given = spark.createDataFrame([(t, a) for t, aliases in extra.items() for a in aliases], "target_field string, alias string")
    columns = ["target_field", "target_type", normalized_name(F.col("alias")).alias("alias_norm")]
    by_norm = fields.join(documented, "t_norm").select(*columns)
    return by_norm.unionByName(fields.join(given, "target_field").select(*columns)).distinct()


# Which target types accept a source, as one flag per class of target types.
_CLASSES = ("any", "number", "date", "boolean")


def _class_of(target_type: Column) -> Column:
    return F.when(target_type.isin("number", "date", "boolean"), target_type).otherwise(F.lit("any"))


def _summary(sources: DataFrame, key: str) -> DataFrame:
    """Per key value: how many source columns there are, and one of them."""
    return sources.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("source_role", "source_field", "data_type")).alias("one")
    )


def field_candidates(
    targets: DataFrame, sources: DataFrame, explicit: dict[str, str] | None = None, aliases: dict[str, list[str]] | None = None
) -> DataFrame:
    """Per target field and stage: whether one or several source columns match, and one of them.

    ``targets``: target_field, target_type. ``sources``: source_role, source_field, data_type.
    The stages are explicit reference, name, normalised name, documented alias and shared word;
    only fields without any earlier match go on to the shared words. The sources are folded to
    one row per name or word before they meet the targets, so a word that a third of all columns
    share costs one row, and no target-source pairs are produced.
    """
    spark = targets.sparkSession
    t = targets.select(
        "target_field", "target_type", F.lower("target_field").alias("t_name"), normalized_name(F.col("target_field")).alias("t_norm")
    )
    s = sources.select("source_role", "source_field", "data_type").withColumns(
        {"s_name": F.lower("source_field"), "s_norm": normalized_name(F.col("source_field"))}
    )

    def stage(matches: DataFrame, order: int, kind: str) -> DataFrame:
        return matches.select("target_field", "target_type", "one", F.col("n") > 1, F.lit(order), F.lit(kind)).toDF(
            "target_field", "target_type", "one", "several", "stage", "mapping_type"
        )

    wishes = spark.createDataFrame(
        [(f, *(reference.split(".", 1) if "." in reference else (None, None))) for f, reference in (explicit or {}).items()],
        "target_field string, wish_role string, wish_field string",
    )
    wished = F.struct("source_role", "source_field", "data_type")
    chosen = (
        t.join(wishes, "target_field")
        .join(s, (F.col("wish_role") == F.col("source_role")) & (F.col("wish_field") == F.col("source_field")), "left")
        .withColumn("one", F.when(F.col("source_field").isNotNull(), wished))
        .withColumn("n", F.lit(1))
    )
    free = t.join(wishes.select("target_field"), "target_field", "left_anti")
    by_norm = _summary(s, "s_norm")
    # Different aliases name different columns, so their counts add up.
    aliased = _aliased_targets(free, aliases or {}).join(by_norm, F.col("alias_norm") == F.col("key"))
    aliased = aliased.groupBy("target_field", "target_type").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    by_name = (
        stage(chosen, 0, "explicit")
        .unionByName(stage(free.join(_summary(s, "s_name"), F.col("t_name") == F.col("key")), 1, "exact"))
        .unionByName(stage(free.join(by_norm, F.col("t_norm") == F.col("key")), 2, "normalized"))
        .unionByName(stage(aliased, 3, "documented_alias"))
    )
    open_fields = free.join(by_name.select("target_field").distinct(), "target_field", "left_anti")
    return by_name.unionByName(stage(_word_matches(open_fields, s), 4, "semantic_candidate"))


def _word_matches(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """Fields sharing a word with type-compatible columns. ``n`` is 1 or "more than 1": the columns
    behind several words are one column exactly if every word names one and all name the same."""
    column = F.struct("source_role", "source_field", "data_type")
    words = sources.select(column.alias("c"), F.explode(name_tokens(F.col("source_field"))).alias("word"))
    folded = []
    for name in _CLASSES:
        fits = type_compatible(F.lit(name), F.col("c.data_type"))
        folded += [
            F.count_if(fits).alias(f"n_{name}"), F.min(F.when(fits, F.col("c"))).alias(f"low_{name}"),
        ]
    per_word = words.groupBy("word").agg(*folded)
    asked = fields.select("target_field", "target_type", F.explode(name_tokens(F.col("target_field"))).alias("word"))
    joined = asked.join(per_word, "word")
    n, low = F.lit(None).cast("long"), None
    for name in _CLASSES:
        chosen = _class_of(F.col("target_type")) == name
        n = F.when(chosen, F.col(f"n_{name}")).otherwise(n)
        low = F.when(chosen, F.col(f"low_{name}")) if low is None else F.when(chosen, F.col(f"low_{name}")).otherwise(low)
    matches = joined.withColumn("k", n).withColumn("low", low).filter("k > 0").groupBy("target_field", "target_type").agg(
        F.max("k").alias("k"), F.min("low").alias("one"), F.max("low").alias("other")
    )
    return matches.withColumn("n", F.when(F.col("one") == F.col("other"), F.col("k")).otherwise(F.lit(2)))


def propose_mappings(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target field: mapping type, source, confidence and status.

    A stage with a single match decides; otherwise the first stage with several is reported. An
    ambiguous name outranks an alias, but a single normalised name outranks an ambiguous one.
    """
    order = F.when(F.col("stage") == 0, 0).when(~F.col("several"), 2 * F.col("stage")).otherwise(
        F.when(F.col("stage") == 1, 5).otherwise(2 * F.col("stage") + 1)
    )
    best = F.min_by(F.struct("one", "several", "mapping_type"), F.struct(order.alias("o"), F.col("stage")))
    decided = candidates.groupBy("target_field").agg(best.alias("b")).select("target_field", "b.*")
    decided = targets.join(decided, "target_field", "left")
    single = ~F.col("several") & F.col("one").isNotNull()
    compatible = type_compatible(F.col("target_type"), F.col("one.data_type"))
    confidence = F.element_at(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p]), F.col("mapping_type"))
    status = (
        F.when(F.col("mapping_type").isNull(), "missing")
        .when(F.col("several"), "ambiguous")
        .when(F.col("one").isNull() | ~compatible, "incompatible")
        .when(F.col("mapping_type") == "explicit", "confirmed")
        .when(F.col("mapping_type") == "semantic_candidate", "ambiguous")
        .otherwise("proposed_high_confidence")
    )
    return decided.select(
        "target_field",
        "target_type",
        F.when(single, F.col("mapping_type")).otherwise("unmapped").alias("mapping_type"),
        F.when(single, F.col("one.source_role")).alias("source_role"),
        F.when(single, F.col("one.source_field")).alias("source_field"),
        F.when(single & compatible, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        status.alias("status"),
    )


def field_options(
    fields: DataFrame, sources: DataFrame, aliases: dict[str, list[str]] | None = None, k: int = OPTIONS
) -> DataFrame:
    """(target_field, options): the first ``k`` source columns by name that may be meant by each field.

    A column may be meant if its name or an alias equals the field's, or if it shares a word with it and
    fits its type. Of every word, name and class of types only the first ``k`` columns go on to the
    fields: the first ``k`` of a union are among the first ``k`` of its parts, so a word that a third of
    all columns share costs ``k`` rows per field.
    """
    t = fields.select("target_field", "target_type", normalized_name(F.col("target_field")).alias("t_norm"))
    s = sources.select("source_role", "source_field", "data_type", normalized_name(F.col("source_field")).alias("s_norm")).distinct()
    column = F.struct("source_role", "source_field")
    # Names are asked for as words of a class that every type fits.
    words = s.select(F.explode(name_tokens(F.col("source_field"))).alias("word"), column.alias("column"), "data_type")
    classes = F.array(*[F.when(type_compatible(F.lit(name), F.col("data_type")), F.lit(name)) for name in _CLASSES])
    entries = words.select("word", "column", F.explode(F.array_compact(classes)).alias("class")).unionByName(
        s.select(F.concat(F.lit("="), "s_norm").alias("word"), column.alias("column"), F.lit("name").alias("class"))
    )
    first = Window.partitionBy("word", "class").orderBy("column")
    lists = entries.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")
    by_word = t.select("target_field", F.explode(name_tokens(F.col("target_field"))).alias("word"), _class_of(F.col("target_type")).alias("class"))
    by_name = t.select("target_field", F.concat(F.lit("="), "t_norm").alias("word"), F.lit("name").alias("class"))
    by_alias = _aliased_targets(t, aliases or {}).select("target_field", F.concat(F.lit("="), "alias_norm").alias("word"), F.lit("name").alias("class"))
    met = by_word.unionByName(by_name).unionByName(by_alias).join(lists, ["word", "class"]).select("target_field", "column").distinct()
    best = Window.partitionBy("target_field").orderBy("column")
    kept = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    listed = kept.groupBy("target_field").agg(F.sort_array(F.collect_list("column")).alias("c"))  # at most k
    return listed.select("target_field", F.transform("c", lambda x: F.concat(x["source_role"], F.lit("."), x["source_field"])).alias("options"))


def clarifications(mappings: DataFrame, required: list[str], derived: list[str] = (), options: DataFrame | None = None) -> DataFrame:
    """Required fields whose mapping is not settled, with the kind of question to ask.

    With ``options`` (of ``field_options``), an ambiguous field also lists the columns to choose from.
    """
    codes = {"ambiguous": "ambiguous_mapping", "missing": "missing_required_field", "incompatible": "incompatible_type"}
    code = F.element_at(F.create_map(*[F.lit(x) for p in codes.items() for x in p]), F.col("status"))
    open_fields = mappings.filter(F.col("target_field").isin([f for f in required if f not in derived]))
    asked = open_fields.filter(F.col("status").isin(*codes)).select("target_field", code.alias("code"), "status")
    if options is None:
        return asked
    nothing = F.array().cast("array<string>")
    listed = F.when(F.col("status") == "ambiguous", F.coalesce("options", nothing)).otherwise(nothing)
    return asked.join(options, "target_field", "left").withColumn("options", listed)


# ---- execution --------------------------------------------------------------------------------


@dataclass(frozen=True)
class TargetTable:
    """The target-shaped table, its checks, per-field provenance, join warnings and cited evidence per field."""

    frame: DataFrame
    checks: DataFrame
    provenance: DataFrame
    warnings: list[str]
    join_accounts: list[dict]
    citations: dict[str, DataFrame]


def run_transform(plan: TransformPlan, sources: dict[str, DataFrame], evidence: DataFrame | None = None) -> TargetTable:
    """Drift check, audited joins, mapping, coercion, derivations and output validation.

    All columns are built lazily; coercion losses, zero divisors, required and numeric checks of
    every field come from a single aggregate before the table is handed out.
    """
    if list(sources) != plan.source_roles:
        raise RefusedError(f"Source-role drift detected: expected {plan.source_roles}, received {list(sources)}.")
    for role, df in sources.items():
        expected = plan.expected_source_columns.get(role)
        if expected != df.columns:
            raise RefusedError(f"Schema drift detected for {role}: expected columns {expected}, received {df.columns}.")
    derived = [rule.target_field for rule in plan.derivations]
    unsettled = [
        m.target_field for m in plan.mappings
        if m.target_field in plan.required_fields and m.target_field not in derived
        and m.status not in ("confirmed", "proposed_high_confidence")
    ]
    if unsettled:
        raise RefusedError(f"Required target fields remain unresolved: {', '.join(unsettled)}.")
    merged, accounts = join_sources(sources, plan.source_roles, plan.joins)
    types = {c.name: c.type for c in plan.target}
    mapping = {m.target_field: m for m in plan.mappings}
    guards: list[tuple[str, Column]] = []
    lineage: list[tuple[str, str, str]] = []
    citations: dict[str, DataFrame] = {}
    work = merged
    names = {h: f"__t{i}" for i, h in enumerate(plan.headers)}
    outputs: dict[str, str] = {}

    def add(target: str, value: Column) -> None:
        nonlocal work
        work = work.withColumn("__raw", value)
        kind = family(work.schema["__raw"].dataType)
        coerced = coerce(F.col("__raw"), kind, types[target])
        work = work.withColumn(names[target], coerced).withColumn(
            f"{names[target]}_lost", F.col("__raw").isNotNull() & F.col(names[target]).isNull()
        ).drop("__raw")
        guards.append(
            (f"{{n}} value(s) of target field '{target}' are incompatible with expected type {types[target]}.", F.col(f"{names[target]}_lost"))
        )
        outputs[target] = names[target]

    for header in plan.headers:
        m = mapping[header]
        if header in derived or m.source_field is None:
            continue
        source = f"{m.source_role}.{m.source_field}"
        if source not in merged.columns:
            raise RefusedError(f"Mapped source field '{source}' does not exist after joins.")
        add(header, map_value(merged, source, m.transformation))
        lineage.append((header, source, m.transformation))

    for rule in plan.derivations:
        inputs = []
        for reference in rule.inputs:
            if reference.source_role == "target":
                if reference.source_field not in outputs:
                    raise RefusedError(
                        f"Derivation '{rule.target_field}' references target field '{reference.source_field}' before it is available."
                    )
                column = outputs[reference.source_field]
            else:
                column = f"{reference.source_role}.{reference.source_field}"
                if column not in merged.columns:
                    raise RefusedError(f"Mapped source field '{column}' does not exist after joins.")
            inputs.append(map_value(work, column, reference.transformation))
        if rule.operation == "concat":
            value = strip(F.concat_ws(rule.separator, *[F.coalesce(i.cast("string"), F.lit("")) for i in inputs]))
        else:
            value, more, cited = _arithmetic(rule, work, inputs, evidence)
            guards += more
            if cited is not None:
                citations[rule.target_field] = cited
        add(rule.target_field, value)
        lineage.append((rule.target_field, ", ".join(f"{i.source_role}.{i.source_field}" for i in rule.inputs), rule.operation))

    output = work.select(
        *[F.col(outputs[h]).alias(h) if h in outputs else F.lit(None).cast("string").alias(h) for h in plan.headers]
    )
    counters = [F.count(F.lit(1)).alias("rows")]
    counters += [F.count_if(bad).alias(f"g{i}") for i, (_, bad) in enumerate(guards)]
    counters += [F.count_if(_unfilled(work, outputs.get(f))).alias(f"r{i}") for i, f in enumerate(plan.required_fields)]
    row, shared = _checked_counts(work, counters, outputs, plan.unique_fields)
    for i, (message, _) in enumerate(guards):
        if row[f"g{i}"]:
            raise RefusedError(message.format(n=row[f"g{i}"]))
    checks = [
        ("exact_schema_order", output.columns == plan.headers, "Output columns match the target schema and order."),
        ("row_count", True, f"Output contains {row['rows']} rows."),
    ]
    for i, f in enumerate(plan.required_fields):
        checks.append((f"required:{f}", row[f"r{i}"] == 0, f"{row[f'r{i}']} missing required values in {f}."))
    for f in plan.unique_fields:
        n = shared[f]
        checks.append((f"unique:{f}", n == 0, f"{n} rows violate uniqueness for {f}."))
    failed = [detail for _, passed, detail in checks if not passed]
    if failed:
        raise RefusedError("; ".join(failed))
    warnings = [
        f"Join {i} left {a['left_unmatched_rows']} source rows and {a['right_unmatched_rows']} lookup rows unmatched."
        for i, a in enumerate(accounts, 1)
        if a["left_unmatched_rows"] or a["right_unmatched_rows"]
    ]
    spark = merged.sparkSession
    return TargetTable(
        output,
        spark.createDataFrame(checks, "name string, passed boolean, detail string"),
        spark.createDataFrame(lineage, "target_field string, source_fields string, transformation string"),
        warnings,
        accounts,
        citations,
    )


def export_target(target: TargetTable, path: str) -> Export:
    """Write a target table as CSV, open it again and refuse it unless columns, order and rows are the target's."""
    export = export_csv(target.frame, path)
    require_checks(check_export(target.frame.sparkSession, export, target.frame.columns))
    return export


def _checked_counts(
    work: DataFrame, counters: list[Column], outputs: dict[str, str], unique_fields: list[str]
) -> tuple[dict, dict[str, int]]:
    """All counters, and per unique field the rows sharing their value, in one pass per unique field.

    The counters ride along with the first unique field: counted per value, then summed.
    """
    names = work.agg(*counters).columns

    def shared_rows(field: str, extra: list[Column]) -> dict:
        key = F.col(outputs[field]) if field in outputs else F.lit(None).cast("string")
        per_value = work.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("__n"), *extra)
        sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (names if extra else [])]
        repeated = F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n"))), F.lit(0)).alias("__shared")
        return per_value.agg(repeated, *sums).first().asDict()

    if not unique_fields:
        return work.agg(*counters).first().asDict(), {}
    first = shared_rows(unique_fields[0], counters)
    shared = {f: (first if i == 0 else shared_rows(f, []))["__shared"] for i, f in enumerate(unique_fields)}
    return first, shared


def _unfilled(df: DataFrame, column: str | None) -> Column:
    if column is None:
        return F.lit(True)
    return blank(F.col(column)) if family(df.schema[column].dataType) == "text" else missing(df, column)


def _arithmetic(
    rule: DerivationRule, df: DataFrame, inputs: list[Column], evidence: DataFrame | None
) -> tuple[Column, list[tuple[str, Column]], DataFrame | None]:
    """The derived column, the checks it needs and the cited evidence."""
    kinds = [family(t.dataType) for t in df.select(*[c.alias(f"i{k}") for k, c in enumerate(inputs)]).schema.fields]
    numbers = [to_number(c) if k == "text" else c.try_cast("double") for c, k in zip(inputs, kinds)]
    checks = [
        (f"Derivation '{rule.target_field}' requires numeric input ({{n}} row(s)).", raw.isNotNull() & n.isNull())
        for raw, n in zip(inputs, numbers)
    ]
    if rule.operation == "policy_multiply":
        if evidence is None:
            raise RefusedError("A policy-grounded derivation requires retrieved policy evidence.")
        rate = policy_rate(evidence, rule.policy_query)
        return numbers[0] * F.lit(rate.value), checks, rate.citations
    right = numbers[1] if len(numbers) == 2 else F.lit(float(rule.constant))
    if rule.operation == "divide":
        checks.append((f"Derivation '{rule.target_field}' would divide by zero ({{n}} row(s)).", right == 0))
    return arithmetic(rule.operation, numbers[0], right), checks, None
