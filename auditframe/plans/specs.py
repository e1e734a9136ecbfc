"""Typed, closed specifications. Unknown fields and impossible combinations are refused up front."""

from __future__ import annotations

import math
from dataclasses import MISSING, dataclass, field, fields
from typing import Any, Union

from auditframe.errors import RefusedError

Scalar = Union[str, int, float, bool, None]


@dataclass(frozen=True)
class Fields:
    """What one kind of a specification does with the fields that its table names.

    Fields in neither list must be left empty.
    """

    needs: tuple[str, ...] = ()
    takes: tuple[str, ...] = ()


def refuse(spec, code: str, *names: str, detail: str = "") -> None:
    """Refuse a specification: what is wrong as a code, and the fields it is about."""
    about = f" ({detail})" if detail else ""
    raise RefusedError(f"{type(spec).__name__}: {code} {', '.join(names)}{about}.", code=code, fields=names)


def _choice(spec, **allowed: tuple) -> None:
    """Each named field has one of its allowed values."""
    for name, values in allowed.items():
        if getattr(spec, name) not in values:
            refuse(spec, "unknown_value", name, detail=f"'{getattr(spec, name)}', allowed: {', '.join(values)}")


def _finite(spec, name: str) -> None:
    value = getattr(spec, name)
    if any(isinstance(x, float) and not math.isfinite(x) for x in (value if isinstance(value, (list, tuple)) else [value])):
        refuse(spec, "not_finite", name)


def _distinct(spec, name: str, values: list) -> None:
    repeated = sorted({v for v in values if values.count(v) > 1})
    if repeated:
        refuse(spec, "repeated", name, detail=", ".join(repeated))


def _filled(spec, *names: str) -> None:
    empty = [n for n in names if not getattr(spec, n)]
    if empty:
        refuse(spec, "missing", *empty)


def _by_kind(spec, kind: str, table: dict[str, Fields]) -> None:
    """The one check of all tables below: the kind's own fields are there, and no other field of the table is."""
    own = table[kind]
    governed = dict.fromkeys(n for fields_ in table.values() for n in (*fields_.needs, *fields_.takes))
    absent = [n for n in own.needs if getattr(spec, n) in (None, "", [], ())]
    foreign = [n for n in governed if n not in own.needs and n not in own.takes and getattr(spec, n) not in (None, [], ())]
    if absent:
        refuse(spec, "missing", *absent, detail=kind)
    if foreign:
        refuse(spec, "not_used", *foreign, detail=kind)


def from_mapping(cls, payload: dict[str, Any]):
    """Build a specification from plain data; unknown or missing fields are refused."""
    known = {f.name: f for f in fields(cls)}
    unknown = sorted(set(payload) - set(known))
    open_fields = (n for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING)
    absent = sorted(n for n in open_fields if n not in payload)
    for code, names in (("unknown_field", unknown), ("missing", absent)):
        if names:
            raise RefusedError(f"{cls.__name__}: {code} {', '.join(names)}.", code=code, fields=tuple(names))
    return cls(**payload)


# ---- table operations -------------------------------------------------------------------------

# Fixed values of the payloads: operator and field names.
FILTER_OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in", "is_null", "not_null")
PLAN_FILTER_OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "is_null", "not_null")


# The shape of a filter's value by operator; operators that are not listed take any.
_COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")
TABLE_VALUE_SHAPES = {"contains": "text", "in": "list"} | dict.fromkeys(_COMPARISONS, "scalar")
PLAN_VALUE_SHAPES = {"in": "filled list", "not_in": "filled list", "is_null": "nothing", "not_null": "nothing"} | dict.fromkeys(_COMPARISONS, "scalar")
_SHAPES = {
    "text": lambda v: isinstance(v, str),
    "list": lambda v: isinstance(v, (list, tuple)),
    "filled list": lambda v: isinstance(v, (list, tuple)) and len(v) > 0,
    "scalar": lambda v: v is not None and not isinstance(v, (list, tuple)),
    "nothing": lambda v: v is None,
}


def _shaped(spec, shapes: dict[str, str]) -> None:
    shape = shapes.get(spec.operator)
    if shape and not _SHAPES[shape](spec.value):
        refuse(spec, "wrong_shape", "value", detail=f"{spec.operator} takes {shape}")


@dataclass(frozen=True)
class SelectColumns:
    columns: list[str]


@dataclass(frozen=True)
class FilterRows:
    column: str
    operator: str
    value: Any = None

    def __post_init__(self) -> None:
        _choice(self, operator=FILTER_OPERATORS)
        _finite(self, "value")
        _shaped(self, TABLE_VALUE_SHAPES)


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class SortRows:
    keys: list[SortKey]

    def __post_init__(self) -> None:
        _filled(self, "keys")


@dataclass(frozen=True)
class RenameColumns:
    mapping: dict[str, str]

    def __post_init__(self) -> None:
        if not all(self.mapping.values()):
            refuse(self, "missing", "mapping", detail="a new name")


@dataclass(frozen=True)
class DropDuplicates:
    """``order_by`` states what "first" and "last" mean; remaining columns break ties."""

    columns: list[str] | None = None
    keep: str = "first"
    order_by: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        _choice(self, keep=("first", "last"))


@dataclass(frozen=True)
class HandleMissing:
    action: str
    columns: list[str] | None = None
    value: Scalar = None

    def __post_init__(self) -> None:
        _choice(self, action=("fill", "drop"))
        _finite(self, "value")
        if self.action == "fill" and self.value is None:
            refuse(self, "missing", "value", detail="fill")


DERIVE_OPERATORS = ("add", "subtract", "multiply", "divide", "ratio", "percentage")


@dataclass(frozen=True)
class DeriveColumn:
    new_column: str
    left_column: str
    operator: str
    right_column: str | None = None
    constant: float | None = None

    def __post_init__(self) -> None:
        _choice(self, operator=DERIVE_OPERATORS)
        _finite(self, "constant")
        _filled(self, "new_column")
        if [self.right_column, self.constant].count(None) != 1:
            refuse(self, "one_of", "right_column", "constant")


AGGREGATIONS = ("count", "sum", "mean", "median", "min", "max")


@dataclass(frozen=True)
class Aggregation:
    column: str
    function: str
    alias: str | None = None

    def __post_init__(self) -> None:
        _choice(self, function=AGGREGATIONS)

    @property
    def output(self) -> str:
        return self.alias or f"{self.column}_{self.function}"


@dataclass(frozen=True)
class GroupAggregate:
    group_by: list[str]
    aggregations: list[Aggregation]

    def __post_init__(self) -> None:
        _filled(self, "group_by", "aggregations")
        _distinct(self, "aggregations", [*dict.fromkeys(self.group_by), *(a.output for a in self.aggregations)])


OPERATIONS = {
    "select": SelectColumns,
    "filter": FilterRows,
    "sort": SortRows,
    "rename": RenameColumns,
    "drop_duplicates": DropDuplicates,
    "missing": HandleMissing,
    "derive": DeriveColumn,
    "group": GroupAggregate,
}


def operation(payload: dict[str, Any]):
    """One table operation from plain data with a ``type`` field."""
    body = dict(payload)
    kind = body.pop("type", None)
    if kind not in OPERATIONS:
        raise RefusedError(f"unknown_value type ('{kind}', allowed: {', '.join(OPERATIONS)}).", code="unknown_value", fields=("type",))
    if kind == "sort":
        body["keys"] = [from_mapping(SortKey, key) for key in body.get("keys", [])]
    if kind == "group":
        body["aggregations"] = [from_mapping(Aggregation, item) for item in body.get("aggregations", [])]
    return from_mapping(OPERATIONS[kind], body)


# ---- joins ------------------------------------------------------------------------------------

JOIN_KINDS = ("inner", "left", "right", "outer")


@dataclass(frozen=True)
class JoinSpec:
    left_on: list[str]
    right_on: list[str]
    how: str = "inner"

    def __post_init__(self) -> None:
        _choice(self, how=JOIN_KINDS)
        _filled(self, "left_on", "right_on")
        if len(self.left_on) != len(self.right_on):
            refuse(self, "uneven", "left_on", "right_on")


# ---- analytics --------------------------------------------------------------------------------

METRICS = ("count", "distinct_count", "sum", "mean", "median", "min", "max", "variance", "std", "percentile")
# Fields of a plan by analysis.
PLAN_FIELDS = {
    "metrics": Fields(takes=("group_by", "metrics")),
    "group_compare": Fields(needs=("value_column", "group_by")),
    "distribution": Fields(needs=("value_column",)),
    "rank": Fields(needs=("value_column",)),
    "correlation": Fields(needs=("value_column", "second_column")),
    "target_variance": Fields(needs=("value_column", "second_column", "group_by"), takes=("contributor_column",)),
    "percent_change": Fields(needs=("value_column", "order_column")),
    "growth_rate": Fields(needs=("value_column", "order_column")),
    "rolling_mean": Fields(needs=("value_column", "order_column", "window"), takes=("group_by",)),
}
ANALYSES = tuple(PLAN_FIELDS)
METRIC_FIELDS = {name: Fields(needs=("column",)) for name in METRICS} | {"count": Fields(), "percentile": Fields(needs=("column", "percentile"))}
LEAST_WINDOW, LONGEST_WINDOW = 2, 365


@dataclass(frozen=True)
class PlanFilter:
    column: str
    operator: str
    value: Any = None

    def __post_init__(self) -> None:
        _choice(self, operator=PLAN_FILTER_OPERATORS)
        _finite(self, "value")
        _shaped(self, PLAN_VALUE_SHAPES)


@dataclass(frozen=True)
class Metric:
    name: str
    column: str | None = None
    percentile: float | None = None
    alias: str | None = None

    def __post_init__(self) -> None:
        _choice(self, name=METRICS)
        _by_kind(self, self.name, METRIC_FIELDS)
        if not 0 <= (self.percentile or 0) <= 100:
            refuse(self, "out_of_range", "percentile", detail="0 to 100")

    @property
    def calculation(self) -> str:
        if self.name == "count":
            return "count"
        if self.name == "percentile":
            return f"p{self.percentile:.15g}".replace(".", "_") + f"_{self.column}"
        return f"{self.name}_{self.column}"

    @property
    def output(self) -> str:
        return self.alias or self.calculation


@dataclass(frozen=True)
class AnalyticsPlan:
    analysis: str = "metrics"
    filters: list[PlanFilter] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    value_column: str | None = None
    second_column: str | None = None
    order_column: str | None = None
    contributor_column: str | None = None
    window: int | None = None
    rank_method: str = "dense"
    ascending: bool = False
    limit: int | None = None
    nulls: str = "exclude"
    expected_columns: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        _choice(self, analysis=ANALYSES, rank_method=("dense", "min", "max"), nulls=("exclude", "fail"))
        _by_kind(self, self.analysis, PLAN_FIELDS)
        if self.analysis == "metrics" and not self.metrics:
            object.__setattr__(self, "metrics", [Metric("count")])
        for name, low, high in (("limit", 1, math.inf), ("window", LEAST_WINDOW, LONGEST_WINDOW)):
            if getattr(self, name) is not None and not low <= getattr(self, name) <= high:
                refuse(self, "out_of_range", name, detail=f"{low} to {high}")
        _distinct(self, "group_by", self.group_by)
        _distinct(self, "expected_columns", self.expected_columns)
        _distinct(self, "metrics", [*self.group_by, *(m.output for m in self.metrics)])

    def referenced_columns(self) -> list[str]:
        names = [*self.group_by, *(f.column for f in self.filters), *(m.column for m in self.metrics if m.column)]
        names += [c for c in (self.value_column, self.second_column, self.order_column, self.contributor_column) if c]
        return list(dict.fromkeys(names))

    def value_columns(self) -> list[str]:
        names = [m.column for m in self.metrics if m.column]
        names += [c for c in (self.value_column, self.second_column) if c]
        return list(dict.fromkeys(names))


# ---- source-to-target mapping -----------------------------------------------------------------

MAPPING_TRANSFORMATIONS = ("none", "trim", "upper", "lower", "normalize_number", "normalize_currency", "normalize_date")
TARGET_TYPES = ("unknown", "text", "number", "date", "boolean", "formula")
MAPPING_STATUSES = ("confirmed", "proposed_high_confidence", "ambiguous", "missing", "incompatible")
# Fields of a derivation by operation, and how many operands one takes that is not arithmetic between two.
DERIVATION_FIELDS = {name: Fields(needs=("inputs",), takes=("constant",)) for name in ("add", "subtract", "multiply", "divide")} | {
    "concat": Fields(needs=("inputs",)),
    "policy_multiply": Fields(needs=("inputs", "policy_query")),
}
DERIVATIONS = tuple(DERIVATION_FIELDS)
OPERANDS = {"concat": (1, 2), "policy_multiply": (1,)}


@dataclass(frozen=True)
class TargetColumn:
    name: str
    type: str = "unknown"

    def __post_init__(self) -> None:
        _choice(self, type=TARGET_TYPES)


@dataclass(frozen=True)
class FieldMapping:
    target_field: str
    source_role: str | None = None
    source_field: str | None = None
    transformation: str = "none"
    status: str = "confirmed"

    def __post_init__(self) -> None:
        _choice(self, transformation=MAPPING_TRANSFORMATIONS, status=MAPPING_STATUSES)
        if [self.source_role, self.source_field].count(None) == 1:
            refuse(self, "only_together", "source_role", "source_field")


@dataclass(frozen=True)
class JoinRule:
    right_role: str
    left_on: list[str]
    right_on: list[str]
    how: str = "left"
    block_many_to_many: bool = True
    block_row_multiplication: bool = True
    max_unmatched_left_percentage: float = 100.0


@dataclass(frozen=True)
class FieldReference:
    source_role: str
    source_field: str
    transformation: str = "none"

    def __post_init__(self) -> None:
        _choice(self, transformation=MAPPING_TRANSFORMATIONS)


@dataclass(frozen=True)
class DerivationRule:
    target_field: str
    operation: str
    inputs: list[FieldReference]
    constant: float | None = None
    separator: str = " "
    policy_query: str | None = None

    def __post_init__(self) -> None:
        _choice(self, operation=DERIVATIONS)
        _by_kind(self, self.operation, DERIVATION_FIELDS)
        operands = len(self.inputs) + (self.constant is not None)
        if operands not in OPERANDS.get(self.operation, (2,)) or len(self.inputs) > 2:
            refuse(self, "wrong_number", "inputs", "constant", detail=self.operation)


@dataclass(frozen=True)
class TransformPlan:
    source_roles: list[str]
    expected_source_columns: dict[str, list[str]]
    target: list[TargetColumn]
    mappings: list[FieldMapping]
    joins: list[JoinRule] = field(default_factory=list)
    derivations: list[DerivationRule] = field(default_factory=list)
    required_fields: list[str] = field(default_factory=list)
    unique_fields: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        _distinct(self, "source_roles", self.source_roles)
        named = {"mappings": [m.target_field for m in self.mappings], "derivations": [d.target_field for d in self.derivations]}
        for name, fields_ in named.items():
            _distinct(self, name, fields_)
        named |= {"required_fields": self.required_fields, "unique_fields": self.unique_fields}
        for name, fields_ in named.items():
            outside = sorted(set(fields_) - set(self.headers))
            if outside:
                refuse(self, "unknown_field", name, detail=", ".join(outside))
        unmapped = sorted(set(self.headers) - set(named["mappings"]))
        if unmapped:
            refuse(self, "missing", "mappings", detail=", ".join(unmapped))

    @property
    def headers(self) -> list[str]:
        return [column.name for column in self.target]
