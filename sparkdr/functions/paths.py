"""Path expressions over nested columns, resolved against the schema when the plan is built.

``a|b|c`` is the first alternative that the schema has; ``a.b`` a field, ``a.0`` or
``a[0]`` an element, ``a[*]`` (also ``a[]``) every element, and a field of an array of
structs is taken from every element that has it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

_STEP = re.compile(r"([^.\[\]]+)|\[(\d*|\*)\]")


class PathError(KeyError):
    """No alternative of a path exists in the schema."""


def steps(path: str) -> list[str | int]:
    """``a.b[0].c[*]`` as ``["a", "b", 0, "c", "*"]``."""
    out: list[str | int] = []
    at = 0
    for part in _STEP.finditer(path):
        if path[at : part.start()].strip("."):
            raise PathError(f"bad path: {path}")
        at = part.end()
        name, index = part.groups()
        if name is not None:
            out.append(int(name) if name.isdigit() else name)
        else:
            out.append(int(index) if index and index != "*" else "*")
    if path[at:].strip(".") or not out:
        raise PathError(f"bad path: {path}")
    return out


def _walk(column: Column, kind: T.DataType, rest: list, path: str) -> tuple[Column, T.DataType]:
    if not rest:
        return column, kind
    step, after = rest[0], rest[1:]
    if isinstance(kind, T.ArrayType):
        if isinstance(step, int):
            return _walk(F.get(column, F.lit(step)), kind.elementType, after, path)
        inner = after if step == "*" else rest
        if not inner:
            return column, kind
        _, found = _walk(F.lit(None), kind.elementType, inner, path)
        every = F.transform(column, lambda x: _walk(x, kind.elementType, inner, path)[0])
        every = F.filter(every, lambda x: x.isNotNull())
        if isinstance(found, T.ArrayType) and "*" in inner:
            return F.flatten(every), found
        return every, T.ArrayType(found)
    if isinstance(kind, T.StructType) and step in kind.names:
        return _walk(column.getField(step), kind[step].dataType, after, path)
    if isinstance(kind, T.MapType) and isinstance(step, str) and step != "*":
        return _walk(F.try_element_at(column, F.lit(step)), kind.valueType, after, path)
    raise PathError(f"{path}: no {step!r} in {kind.simpleString()}")


def nested(df: DataFrame, path: str) -> Column:
    """The column at one path; fails when the schema lacks it."""
    first, *rest = steps(path)
    if first not in df.columns:
        raise PathError(f"{path}: no column {first!r}")
    return _walk(F.col(f"`{first}`"), df.schema[first].dataType, rest, path)[0]


def first_present(df: DataFrame, path: str, default=None) -> Column:
    """The first alternative of ``a|b.c`` that the schema has; ``default`` where none is.

    Over typed data, presence is a property of the schema: a present null wins.
    """
    for one in path.split("|"):
        try:
            return nested(df, one.strip())
        except PathError:
            continue
    if default is None:
        raise PathError(path)
    return F.lit(default)


def json_first_present(json: Column, path: str) -> Column:
    """First alternative of a path in a JSON string column, as text; a present null wins."""
    out = None
    for one in reversed(path.split("|")):
        keys = steps(one.strip())
        dollar = "$" + "".join(f"[{k}]" if isinstance(k, int) else ("[*]" if k == "*" else f".{k}") for k in keys)
        value = F.get_json_object(json, dollar)
        parent = "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" for k in keys[:-1])
        held = F.json_object_keys(json if len(keys) == 1 else F.get_json_object(json, parent)) if isinstance(keys[-1], str) else None
        present = value.isNotNull() if held is None else F.coalesce(F.array_contains(held, str(keys[-1])), value.isNotNull())
        out = F.when(present, value) if out is None else F.when(present, value).otherwise(out)
    return out
