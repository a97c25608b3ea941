"""The JSON filter language, compiled to one boolean column over a JSON payload.

{"must": [...], "must_not": [...], "should": [...]}; a condition is {"key": path, op: value} with op match, any_of,
range or exists, or a nested filter. Values stand plainly, {"match": 3}, {"any_of": [1, 2]}, {"exists": true}, or as on
the wire, {"match": {"value": 3}}, {"any_of": {"any": [1, 2]}}, {"exists": {"exists": true}}. A row without a payload
never passes a filter that isn't empty.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import IndexKind, InvalidRequest

EPSILON = 2.220446049250313e-16
BOUNDS = {"gte": lambda x, b: x >= b, "lte": lambda x, b: x <= b, "gt": lambda x, b: x > b, "lt": lambda x, b: x < b}
SIDES = ("must", "must_not", "should")
#: fixed values: the key under which an operator's value stands on the wire
WIRE = {"match": "value", "any_of": "any", "exists": "exists"}
#: Lists within lists that an index flattens.
NESTED_LISTS = 8


def parse_filter(text: str | dict | None) -> dict:
    """A filter from JSON, values plain; blank is the empty filter, anything malformed an InvalidRequest."""
    if text is None or isinstance(text, str) and not text.strip():
        return {}
    try:
        found = json.loads(text) if isinstance(text, str) else text
    except ValueError as e:
        raise InvalidRequest(f"filter isn't JSON: {e}") from e
    return _plain(found)


def _plain(f) -> dict:
    if not isinstance(f, dict) or set(f) - set(SIDES):
        raise InvalidRequest(f"a filter has must, must_not and should only: {f!r}")
    for side, own in f.items():
        if own is not None and not isinstance(own, list | tuple):
            raise InvalidRequest(f"{side} takes a list of conditions: {own!r}")
    return {side: [_condition(c) for c in own or []] for side, own in f.items()}


def _condition(c) -> dict:
    if not isinstance(c, dict):
        raise InvalidRequest(f"not a condition: {c!r}")
    if set(c) == {"filter"}:
        return {"filter": _plain(c["filter"])}
    if c and not set(c) - set(SIDES):
        return {"filter": _plain(c)}
    ops = set(c) - {"key"}
    if not isinstance(c.get("key"), str) or len(ops) != 1 or not ops <= {*WIRE, "range"}:
        raise InvalidRequest(f"a condition has key and one of match, any_of, range, exists: {c!r}")
    op = ops.pop()
    value = c[op]
    if op in WIRE and isinstance(value, dict):
        if set(value) != {WIRE[op]}:
            raise InvalidRequest(f"{op} takes a value or {{{WIRE[op]!r}: value}}: {value!r}")
        value = value[WIRE[op]]
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if op == "any_of" and not isinstance(value, list | tuple) or op == "exists" and not isinstance(value, bool):
        raise InvalidRequest(f"{op} doesn't take {value!r}")
    if op == "range" and not (isinstance(value, dict) and not set(value) - set(BOUNDS) and all(b is None or number(b) for b in value.values())):
        raise InvalidRequest(f"range takes numbers for {', '.join(BOUNDS)}: {value!r}")
    return {"key": c["key"], op: value}


def is_empty(f: dict | None) -> bool:
    return not any((f or {}).get(s) for s in SIDES)


def payload_variant(payload: Column) -> Column:
    """The payload as VARIANT; text that isn't JSON becomes {"_raw": text}."""
    return F.coalesce(F.try_parse_json(payload), F.when(payload.isNotNull(), F.to_variant_object(F.struct(payload.alias("_raw")))))


def _path(key: str) -> str:
    return "$" + "".join("['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']" for part in key.split("."))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), _get(v, "$", "double"))


def _equals(v: Column, value) -> Column:
    if isinstance(value, bool):
        test = (_kind(v) == "BOOLEAN") & (_get(v, "$", "boolean") == F.lit(value))
    elif isinstance(value, int | float):
        test = F.abs(_number(v) - F.lit(float(value))) < EPSILON
    elif isinstance(value, str):
        test = (_kind(v) == "STRING") & (_get(v, "$", "string") == F.lit(value))
    elif value is None:
        test = _kind(v) == "VOID"
    else:
        test = F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))
    return F.coalesce(test, F.lit(False))


def _leaf(payload: Column, c: dict) -> Column:
    v = _get(payload, _path(c["key"]), "variant")
    items = _get(v, "$", "array<variant>")
    is_list = F.coalesce(F.startswith(_kind(v), F.lit("ARRAY")), F.lit(False))
    if "match" in c:
        return F.when(is_list, F.exists(items, lambda x: _equals(x, c["match"]))).otherwise(_equals(v, c["match"]))
    if "any_of" in c:
        any_ = lambda x: reduce(lambda a, b: a | b, [_equals(x, y) for y in c["any_of"]], F.lit(False))
        return F.when(is_list, F.exists(items, any_)).otherwise(any_(v))
    if "exists" in c:
        return (v.isNotNull() & F.coalesce(_kind(v) != "VOID", F.lit(False))) == F.lit(bool(c["exists"]))
    first = F.try_element_at(F.filter(F.transform(items, _number), lambda x: x.isNotNull()), F.lit(1))
    x = F.when(is_list, first).otherwise(_number(v))
    return reduce(lambda a, b: a & b, [BOUNDS[k](x, F.lit(float(b))) for k, b in c["range"].items() if b is not None], x.isNotNull())


def compile_filter(f: dict | str | None, payload: Column) -> Column:
    """The filter over a VARIANT payload."""
    f = parse_filter(f)
    if is_empty(f):
        return F.lit(True)

    def condition(c: dict) -> Column:
        return tree(c["filter"]) if "filter" in c else F.coalesce(_leaf(payload, c), F.lit(False))

    def tree(x: dict) -> Column:
        out = reduce(lambda a, b: a & b, [condition(c) for c in x.get("must") or []], F.lit(True))
        out = reduce(lambda a, b: a & ~b, [condition(c) for c in x.get("must_not") or []], out)
        should = [condition(c) for c in x.get("should") or []]
        return out & reduce(lambda a, b: a | b, should) if should else out

    return payload.isNotNull() & tree(f)


def _flat(v: Column) -> Column:
    """The scalars of a payload field, its lists flattened; a list of one for a scalar."""
    items = F.array(v)
    for _ in range(NESTED_LISTS):
        items = F.flatten(F.transform(items, lambda x: F.when(F.startswith(_kind(x), F.lit("ARRAY")), _get(x, "$", "array<variant>")).otherwise(F.array(x))))
    return items


def index_tokens(v: Column) -> Column:
    """What a keyword index holds of a payload field: its text, or its elements'; nothing for objects and null."""
    one = lambda x: F.when(_kind(x).rlike("^(STRING|BOOLEAN|BIGINT|DECIMAL|DOUBLE|FLOAT)"), _get(x, "$", "string"))
    return F.filter(F.transform(_flat(v), one), lambda x: x.isNotNull())


def index_numbers(v: Column) -> Column:
    """What a numeric index holds of a payload field: its number, or its elements'."""
    return F.filter(F.transform(_flat(v), _number), lambda x: x.isNotNull())


def index_columns(payload: Column, indexes: dict[str, IndexKind]) -> dict[str, Column]:
    """For each indexed key the least and greatest of what its index holds, as plain columns: scans skip by them."""
    out = {}
    for n, (key, kind) in enumerate(sorted(indexes.items())):
        field = _get(payload, _path(key), "variant")
        held = index_numbers(field) if kind is IndexKind.NUMERIC else index_tokens(field)
        out |= {f"ix{n}_low": F.array_min(held), f"ix{n}_high": F.array_max(held)}
    return out


def index_bounds(f: dict | str | None, indexes: dict[str, IndexKind]) -> Column | None:
    """What index_columns() must say of every row that passes the filter; None if they say nothing.

    Only leaves of `must` count, nested or not. Comparisons of plain columns with literals reach the Parquet scan.
    """
    found = []
    names = {key: (f"ix{n}", kind) for n, (key, kind) in enumerate(sorted(indexes.items()))}

    def number(x):
        return isinstance(x, int | float) and not isinstance(x, bool)

    def leaf(c):
        name, kind = names[c["key"]]
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        if kind is IndexKind.NUMERIC and "range" in c:
            r = c["range"]
            for k, b in r.items():
                if b is not None:
                    found.append(BOUNDS[k](high if k in ("gte", "gt") else low, F.lit(float(b))))
            return
        values = [c["match"]] if "match" in c else list(c.get("any_of") or [])
        if not values:
            return
        if kind is IndexKind.NUMERIC and all(number(x) for x in values):
            found.extend([low <= max(values) + EPSILON, high >= min(values) - EPSILON])
        elif kind is not IndexKind.NUMERIC and all(isinstance(x, str | bool) for x in values):
            texts = [x if isinstance(x, str) else str(x).lower() for x in values]
            # as Spark compares, by bytes
            found.extend([low <= max(texts, key=str.encode), high >= min(texts, key=str.encode)])

    def walk(x):
        for c in x.get("must") or []:
            if "filter" in c:
                walk(c["filter"])
            elif c["key"] in names:
                leaf(c)

    walk(parse_filter(f))
    return reduce(lambda a, b: a & b, found) if found else None
