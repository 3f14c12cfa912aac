"""Filter trees compiled to Spark ``Column`` predicates.

Two dialects: the search dialect (groups of conditions over search documents) and the record dialect (nested ``where``
objects over employee records). The schema decides how a field compares, so predicates stay built-in expressions that
Catalyst can push down.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How the shipped index treats the document's fields.
ANALYSED_FIELDS = {"first_name", "last_name"}
CHOICE_FIELDS = {"pay_type", "is_active"}
DATE_FIELDS = {"hire_date", "pay_periods.pay_period_start", "pay_periods.pay_period_end"}
HIDDEN_FIELDS = {"employee_id"}

# Fixed value: hits per page.
PAGE_SIZE = 200

# A word: letters, digits and underscores, joined by some marks between two letters or between two digits.
_WORD = r"(?:[\p{L}\p{N}_]|(?<=\p{L})['’.:·](?=\p{L})|(?<=\p{N})['.,;](?=\p{N}))+"
_QUERY_WORD = r"(?:\w|(?<=[^\W\d_])['’.:·](?=[^\W\d_])|(?<=\d)['.,;](?=\d))+"


@dataclass(frozen=True)
class Field:
    """A searchable field: ``kind`` is text, number, select or date; ``analysed`` text is matched word by word."""

    path: str
    kind: str
    data_type: T.DataType
    analysed: bool = False
    nested: bool = False


def searchable_fields(
    schema: T.StructType,
    analysed: Iterable[str] = ANALYSED_FIELDS,
    choices: Iterable[str] = CHOICE_FIELDS,
    dates: Iterable[str] = DATE_FIELDS,
    hidden: Iterable[str] = HIDDEN_FIELDS,
) -> dict[str, Field]:
    """Fields of a document schema; arrays of structs contribute their members as nested fields."""
    found: dict[str, Field] = {}

    def visit(struct: T.StructType, prefix: str, nested: bool) -> None:
        for f in struct:
            path = prefix + f.name
            if path in hidden:
                continue
            kind = f.dataType
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                visit(kind.elementType, path + ".", True)
            elif isinstance(kind, T.StructType):
                visit(kind, path + ".", nested)
            elif path in choices or isinstance(kind, T.BooleanType):
                found[path] = Field(path, "select", kind, nested=nested)
            elif path in dates or isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                found[path] = Field(path, "date", kind, nested=nested)
            elif isinstance(kind, T.NumericType):
                found[path] = Field(path, "number", kind, nested=nested)
            elif isinstance(kind, T.StringType):
                found[path] = Field(path, "text", kind, analysed=path in analysed, nested=nested)

    visit(schema, "", False)
    return found


# Text ----------------------------------------------------------------------------------------------------------------


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def query_words(query: str) -> list[str]:
    return re.findall(_QUERY_WORD, query.lower())


def phrase_prefix(text: Column, query: str) -> Column:
    """Whether the query's words occur in a row, the last one possibly cut short."""
    asked = query_words(query)
    if not asked:
        return F.lit(False)
    # One space before each word, so that a phrase is found from the start of a word on.
    return F.concat(F.lit(" "), F.array_join(words(text), " ")).contains(" " + " ".join(asked))


def wildcard(text: Column, pattern: str) -> Column:
    """Whole-value match where ``*`` is any run, ``?`` any character and a backslash quotes the next one."""
    inner = pattern[1:-1] if len(pattern) >= 2 and pattern[0] == pattern[-1] == "*" else None
    if inner is not None and not re.search(r"[*?\\]", inner):
        return text.contains(inner)
    parts, quoted = [], False
    for char in pattern:
        if quoted or char not in "*?\\":
            parts.append("\\x{%x}" % ord(char))
            quoted = False
        elif char == "\\":
            quoted = True
        else:
            parts.append(".*" if char == "*" else ".")
    return text.rlike("(?s)^" + "".join(parts) + r"\z")


def _text(field: Field, column: Column, operator: str, value) -> Column | None:
    value = str(value)
    if operator == "equals":
        return column == value
    if operator == "contains":
        hit: Callable[[Column], Column] = lambda c: wildcard(c, f"*{value.lower()}*")
    elif operator == "starts_with":
        hit = lambda c: c.startswith(value.lower())
    else:
        return None
    return F.exists(words(column), hit) if field.analysed else hit(column)


# Numbers, choices, dates ---------------------------------------------------------------------------------------------


def leading_number(value) -> float | None:
    """The number a value starts with, as in '12 hours'; None if there is none."""
    match = re.match(r"\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))", str(value))
    return float(match.group(1)) if match else None


def _differs(equal: Column) -> Column:
    """Negation that keeps missing values."""
    return ~F.coalesce(equal, F.lit(False))


def _number(column: Column, operator: str, value) -> Column | None:
    number = leading_number(value)
    if number is None:
        return None
    bound = F.lit(number)
    compare = {
        "eq": lambda: column == bound,
        "neq": lambda: _differs(column == bound),
        "gt": lambda: column > bound,
        "gte": lambda: column >= bound,
        "lt": lambda: column < bound,
        "lte": lambda: column <= bound,
    }.get(operator)
    return compare() if compare else None


def _select(field: Field, column: Column, operator: str, value) -> Column | None:
    if isinstance(field.data_type, T.BooleanType):
        flag = {"true": True, "false": False}.get(str(value).lower())
        equal = F.lit(False) if flag is None else column == F.lit(flag)
    else:
        equal = column.cast("string") == str(value)
    return {"is": equal, "is_not": _differs(equal)}.get(operator)


def date_bound(value) -> tuple[datetime, datetime]:
    """First instant a bound covers and the first one after it; a bound without time of day covers the whole day."""
    if isinstance(value, datetime):
        start, width = value, timedelta(microseconds=1)
    else:
        text = str(value).strip()
        start = datetime.fromisoformat(text.replace("Z", "+00:00"))
        width = timedelta(days=1) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else timedelta(microseconds=1)
    if start.tzinfo is None:
        start = start.replace(tzinfo=timezone.utc)
    return start, start + width


def _date(column: Column, operator: str, value, value2) -> Column | None:
    moment = column.try_cast("timestamp")
    if operator == "between":
        if not value2:
            return None
        return (moment >= F.lit(date_bound(value)[0])) & (moment < F.lit(date_bound(value2)[1]))
    start, after = date_bound(value)
    compare = {
        "eq": lambda: (moment >= F.lit(start)) & (moment < F.lit(after)),
        "before": lambda: moment < F.lit(start),
        "after": lambda: moment >= F.lit(after),
    }.get(operator)
    return compare() if compare else None


# Search dialect ------------------------------------------------------------------------------------------------------


def _condition(condition: dict, fields: dict[str, Field]) -> Column | None:
    name, operator = condition.get("field"), condition.get("operator")
    value, value2 = condition.get("value"), condition.get("value2")
    if not name or not operator or (value == "" and operator != "between"):
        return None
    field = fields.get(name)
    if field is None:
        return None

    def clause(column: Column) -> Column | None:
        if field.kind == "text":
            return _text(field, column, operator, value)
        if field.kind == "number":
            return _number(column, operator, value)
        if field.kind == "select":
            return _select(field, column, operator, _plain(value))
        return _date(column, operator, value, value2)

    if not field.nested:
        return clause(F.col(name))
    array, member = name.split(".", 1)
    if clause(F.lit(None).cast(field.data_type)) is None:
        return None
    return F.exists(F.col(array), lambda element: clause(element[member]))


def _plain(value):
    return str(value).lower() if isinstance(value, bool) else value


def compile_tree(group: dict, fields: dict[str, Field]) -> Column | None:
    """Predicate of a group, or None when nothing in it applies. Conditions that say nothing are left out.

    Only ``neq`` and ``is_not`` negate, and they settle missing values themselves. The rest keeps SQL's NULL, which a
    filter drops, so that plain comparisons reach the Parquet scan.
    """
    clauses = []
    for child in group.get("children", []):
        if child.get("type") == "group":
            clause = compile_tree(child, fields)
        elif child.get("type") == "condition":
            clause = _condition(child, fields)
        else:
            clause = None
        if clause is not None:
            clauses.append(clause)
    if not clauses:
        return None
    whole = clauses[0]
    for clause in clauses[1:]:
        whole = (whole & clause) if group.get("operator") == "AND" else (whole | clause)
    return whole


def compile_simple(text: str | None, fields: dict[str, Field], status: str = "all", pay_type: str = "all") -> Column:
    """Free text over name words and keyword fields, with status and pay-type filters; true when nothing is asked."""
    parts = []
    asked = (text or "").strip()
    if asked:
        texts = [f for f in fields.values() if f.kind == "text" and not f.nested]
        hits = [
            phrase_prefix(F.col(f.path), asked) if f.analysed else wildcard(F.col(f.path), f"*{asked.lower()}*")
            for f in texts
        ]
        if hits:
            found = hits[0]
            for hit in hits[1:]:
                found = found | hit
            parts.append(found)
    if status and status != "all":
        parts.append(F.col("is_active") == F.lit(status == "active"))
    if pay_type and pay_type != "all":
        parts.append(F.col("pay_type") == pay_type)
    whole = F.lit(True)
    for part in parts:
        whole = whole & part
    return whole


def search(documents: DataFrame, tree: dict) -> DataFrame:
    """Documents that satisfy a filter tree; a tree without any usable condition matches all."""
    predicate = compile_tree(tree, searchable_fields(documents.schema))
    return documents if predicate is None else documents.filter(predicate)


def page(matches: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """The first ``size`` matches by employee id, each with the number of all matches.

    The count is a scalar subquery over a distributed aggregate; a window without keys would pull every match into one
    task. The limit is a top-k, which keeps ``size`` rows per task.
    """
    total = matches.agg(F.count(F.lit(1)).alias("n"))
    return matches.orderBy("employee_id").limit(size).withColumn("total_hits", total.scalar())


# Record dialect ------------------------------------------------------------------------------------------------------


def compile_where(where: dict, schema: T.StructType, prefix: str = "", ignore_case: bool = True) -> Column:
    """Predicate of a nested ``where`` object such as {"or": [{"pay_rate": {"gt": 20}}, {"last_name": {"startsWith": "S"}}]}.

    Members of one object are all required. Negated operators keep missing values. Strings compare without case, as the
    default collation of the relational store does, unless ``ignore_case`` is off.
    """
    whole = F.lit(True)
    for name, spec in where.items():
        if name in ("and", "or"):
            parts = [compile_where(part, schema, prefix, ignore_case) for part in spec]
            if not parts:
                continue
            clause = parts[0]
            for part in parts[1:]:
                clause = (clause & part) if name == "and" else (clause | part)
        else:
            kind = schema[name].dataType
            path = prefix + name
            if isinstance(kind, T.StructType):
                clause = compile_where(spec, kind, path + ".", ignore_case)
            else:
                clause = F.lit(True)
                for operator, value in spec.items():
                    clause = clause & _operation(F.col(path), kind, operator, value, ignore_case)
        whole = whole & clause
    return whole


_NEGATED = {
    "neq": "eq", "nin": "in", "ngt": "gt", "ngte": "gte", "nlt": "lt", "nlte": "lte",
    "ncontains": "contains", "nstartsWith": "startsWith", "nendsWith": "endsWith",
}


def _operation(column: Column, kind: T.DataType, operator: str, value, ignore_case: bool) -> Column:
    if operator in _NEGATED:
        return _differs(_operation(column, kind, _NEGATED[operator], value, ignore_case))
    fold = ignore_case and isinstance(kind, T.StringType)
    subject = F.lower(column) if fold else column
    lowered = lambda v: v.lower() if fold and isinstance(v, str) else v
    if operator == "eq":
        hit = column.isNull() if value is None else subject == F.lit(lowered(value))
    elif operator == "in":
        present = [lowered(v) for v in value if v is not None]
        hit = subject.isin(present) if present else F.lit(False)
        if len(present) < len(value):
            hit = F.coalesce(hit, F.lit(False)) | column.isNull()
    else:
        hit = {
            "gt": lambda: subject > F.lit(lowered(value)),
            "gte": lambda: subject >= F.lit(lowered(value)),
            "lt": lambda: subject < F.lit(lowered(value)),
            "lte": lambda: subject <= F.lit(lowered(value)),
            "contains": lambda: subject.contains(lowered(value)),
            "startsWith": lambda: subject.startswith(lowered(value)),
            "endsWith": lambda: subject.endswith(lowered(value)),
        }[operator]()
    return hit
