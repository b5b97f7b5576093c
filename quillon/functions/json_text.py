"""JSON text: a JSON5 reader, an RFC 8259 writer, paths, and edits by path, with Arrow-batched column functions.

Numbers keep their text. Objects keep the order of their members and repeated names. A path is $,
followed by .name, ."name", [n], [#-n] (from the end) or [#] (behind the last element).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTH = 1000
_SPACE = re.compile(r"(?:[\s ﻿]|//[^\n]*|/\*.*?\*/)*", re.S)
_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*")
_STRICT_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}


class Number(str):
    """A number's text as JSON writes it."""

    @property
    def value(self) -> int | float:
        return int(self) if re.fullmatch(r"-?\d+", self) else float(self)


class Object(list):
    """Members (name, value) in order."""

    def find(self, name: str) -> int:
        return next((i for i, (k, _) in enumerate(self) if k == name), -1)


class BadJson(ValueError):
    def __init__(self, at: int):
        super().__init__(f"malformed JSON at {at}")
        self.at = at


class _Reader:
    def __init__(self, text: str, strict: bool):
        self.text, self.strict = text, strict

    def space(self, at: int) -> int:
        if self.strict:
            while at < len(self.text) and self.text[at] in " \t\n\r":
                at += 1
            return at
        return _SPACE.match(self.text, at).end()

    def read(self) -> Any:
        value, at = self.value(self.space(0), 0)
        at = self.space(at)
        if at < len(self.text):
            raise BadJson(at)
        return value

    def value(self, at: int, depth: int) -> tuple[Any, int]:
        text = self.text
        if at >= len(text) or depth > DEPTH:
            raise BadJson(at)
        c = text[at]
        if c in "{[":
            return self.members(at, depth, c == "{")
        if c == '"' or c == "'" and not self.strict:
            return self.string(at)
        for word, value in (("true", True), ("false", False), ("null", None)):
            if text.startswith(word, at):
                return value, at + len(word)
        m = _NUMBER.match(text, at)
        if not m or self.strict and not _STRICT_NUMBER.match(m[0]):
            raise BadJson(at)
        return self.number(m[0]), m.end()

    @staticmethod
    def number(raw: str) -> Any:
        sign, body = ("-" if raw[0] == "-" else ""), raw.lstrip("+-")
        if body[:2] in ("0x", "0X"):
            return Number(sign + str(int(body, 16)))
        if body == "Infinity":
            return Number(sign + "9.0e+999")
        if body == "NaN":
            return None
        if body.startswith("."):
            body = "0" + body
        return Number(sign + re.sub(r"\.(?=$|[eE])", ".0", body))

    def string(self, at: int) -> tuple[str, int]:
        quote, out, text = self.text[at], [], self.text
        at += 1
        while True:
            if at >= len(text):
                raise BadJson(at)
            c = text[at]
            if c == quote:
                return "".join(out), at + 1
            if c == "\\":
                c = text[at + 1 : at + 2]
                if c == "u":
                    try:
                        code, at = int(text[at + 2 : at + 6], 16), at + 6
                    except ValueError:
                        raise BadJson(at) from None
                    if 0xD800 <= code < 0xDC00 and text[at : at + 2] == "\\u":
                        low = int(text[at + 2 : at + 6], 16)
                        code, at = 0x10000 + (code - 0xD800 << 10) + (low - 0xDC00), at + 6
                    out.append(chr(code))
                    continue
                if c == "x" and not self.strict:
                    out.append(chr(int(text[at + 2 : at + 4], 16)))
                    at += 4
                    continue
                if c == "\n" and not self.strict:
                    at += 2
                    continue
                if c in '"\\/' or c in "bfnrt" or c in "v0'" and not self.strict:
                    out.append(_ESCAPES.get(c, c))
                    at += 2
                    continue
                raise BadJson(at)
            if self.strict and c < " ":
                raise BadJson(at)
            out.append(c)
            at += 1

    def members(self, at: int, depth: int, is_object: bool) -> tuple[Any, int]:
        found, end, comma = (Object() if is_object else []), "}" if is_object else "]", False
        at = self.space(at + 1)
        text = self.text
        while True:
            if at < len(text) and text[at] == end and not (self.strict and comma):
                return found, at + 1
            if is_object:
                if at < len(text) and (text[at] == '"' or text[at] == "'" and not self.strict):
                    name, at = self.string(at)
                elif not self.strict and (m := _NAME.match(text, at)):
                    name, at = m[0], m.end()
                else:
                    raise BadJson(at)
                at = self.space(at)
                if at >= len(text) or text[at] != ":":
                    raise BadJson(at)
                at = self.space(at + 1)
            value, at = self.value(at, depth + 1)
            found.append((name, value) if is_object else value)
            at = self.space(at)
            comma = at < len(text) and text[at] == ","
            if comma:
                at = self.space(at + 1)
            elif at >= len(text) or text[at] != end:
                raise BadJson(at)


def load(text: str, strict: bool = False) -> Any:
    return _Reader(text, strict).read()


def dump(value: Any, indent: str | None = None, level: int = 0) -> str:
    """RFC 8259 text, without white space unless an indent is given."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value) if math.isfinite(value) else ("9.0e+999" if value > 0 else "-9.0e+999")
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    is_object = isinstance(value, Object)
    colon = ":" if indent is None else ": "
    items = [dump(k) + colon + dump(v, indent, level + 1) for k, v in value] if is_object else [dump(v, indent, level + 1) for v in value]
    a, b = "{}" if is_object else "[]"
    if indent is None or not items:
        return a + ",".join(items) + b
    inner = "\n" + indent * (level + 1)
    return a + inner + ("," + inner).join(items) + "\n" + indent * level + b


def parse_path(path: str) -> list[str | int | tuple[str, int]]:
    """Steps of a path: names, indexes, and ('end', n) for [#-n]."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path {path!r}")
    steps: list[str | int | tuple[str, int]] = []
    at = 1
    pattern = re.compile(r'\."((?:[^"\\]|\\.)*)"|\.([^.\[]+)|\[(\d+)\]|\[#(?:-(\d+))?\]')
    while at < len(path):
        m = pattern.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path {path!r}")
        steps.append(json.loads(f'"{m[1]}"') if m[1] is not None else m[2] if m[2] is not None else int(m[3]) if m[3] is not None else ("end", int(m[4] or 0)))
        at = m.end()
    return steps


MISSING = object()


def _index(value: Any, step: Any) -> int:
    """Where a step leads in a value: a place, its length to append, or -1."""
    if isinstance(step, str):
        if not isinstance(value, Object):
            return -1
        i = value.find(step)
        return len(value) if i < 0 else i
    if not isinstance(value, list) or isinstance(value, Object):
        return -1
    i = len(value) - step[1] if isinstance(step, tuple) else step
    return i if 0 <= i <= len(value) else -1


def follow(value: Any, steps: list) -> Any:
    for step in steps:
        i = _index(value, step)
        if i < 0 or i >= len(value):
            return MISSING
        value = value[i][1] if isinstance(value, Object) else value[i]
    return value


def edit(value: Any, path: str, new: Any, mode: str) -> Any:
    """value after an insert (create only), replace (existing only), set (either), remove or
    array_insert (before the element) at a path."""
    steps = parse_path(path)
    if not steps:
        return None if mode == "remove" else value if mode == "insert" else new
    holder = value
    for k, step in enumerate(steps[:-1]):
        found = follow(holder, [step])
        if found is MISSING:
            i = _index(holder, step)
            if mode not in ("insert", "set") or i < 0:
                return value
            found = Object() if isinstance(steps[k + 1], str) else []
            holder.append((step, found) if isinstance(holder, Object) else found)
        holder = found
    i = _index(holder, steps[-1])
    if i < 0:
        return value
    there = i < len(holder)
    if mode == "remove":
        if there:
            del holder[i]
    elif mode == "array_insert":
        if not isinstance(holder, Object):
            holder.insert(i, new)
    elif there and mode in ("replace", "set"):
        holder[i] = (holder[i][0], new) if isinstance(holder, Object) else new
    elif not there and mode in ("insert", "set"):
        holder.append((steps[-1], new) if isinstance(holder, Object) else new)
    return value


def merge_patch(target: Any, patch: Any) -> Any:
    """RFC 7396."""
    if not isinstance(patch, Object):
        return patch
    out = Object(target) if isinstance(target, Object) else Object()
    for name, value in patch:
        i = out.find(name)
        if value is None:
            if i >= 0:
                del out[i]
        elif i >= 0:
            out[i] = (name, merge_patch(out[i][1], value))
        else:
            out.append((name, merge_patch(None, value)))
    return out


def kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Number):
        return "integer" if re.fullmatch(r"-?\d+", value) else "real"
    return "text" if isinstance(value, str) else "object" if isinstance(value, Object) else "array"


def as_sql(value: Any) -> str | None:
    """A value as SQL text: strings bare, true and false as 1 and 0, null as null, others as JSON."""
    if value is None or value is MISSING:
        return None
    if isinstance(value, bool):
        return "1" if value else "0"
    return str(value) if isinstance(value, str) else dump(value)


# --- column functions -----------------------------------------------------------------------------------


class _Lazy:
    """Builds the pandas function when a session is there."""

    def __init__(self, f: Callable[..., Any], returns: str):
        self.f, self.returns = f, returns

    def __call__(self, *columns: Column) -> Column:
        f = self.f

        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for series in batches:
                rows = zip(*(s.astype(object).where(s.notna(), None) for s in (series if isinstance(series, tuple) else (series,))), strict=True)
                yield pd.Series([None if r[0] is None else f(*r) for r in rows], dtype=object)

        if len(columns) == 1:
            def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                yield from run((s,) for s in batches)

            return F.pandas_udf(one, self.returns)(*columns)

        def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            yield from run(batches)

        return F.pandas_udf(many, self.returns)(*columns)


def _extract(text: str, *paths: str) -> str | None:
    value = load(text)
    found = [follow(value, parse_path(p)) for p in paths]
    if len(paths) == 1:
        return as_sql(found[0])
    return dump([None if v is MISSING else v for v in found])


def _arrow(text: str, path: str) -> str | None:
    steps = parse_path(path) if path.startswith("$") else [int(path)] if re.fullmatch(r"\d+", path) else [path]
    found = follow(load(text), steps)
    return None if found is MISSING else dump(found)


def _edited(mode: str) -> Callable[..., str]:
    def run(text: str, *pairs: Any) -> str:
        value = load(text)
        if mode == "remove":
            for path in pairs:
                value = edit(value, path, None, mode)
        else:
            for path, new in zip(pairs[::2], pairs[1::2], strict=True):
                value = edit(value, path, _sql_value(new), mode)
        return dump(value)

    return run


def _sql_value(x: Any) -> Any:
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, bool):
        return Number(int(x))
    return Number(int(x)) if float(x).is_integer() and not isinstance(x, float) else Number(repr(float(x)) if not float(x).is_integer() else f"{float(x):.1f}")


def _valid(text: str, flags: int = 1) -> int:
    try:
        load(text, strict=not int(flags) & 2)
        return 1
    except (BadJson, RecursionError):
        return 0


def _error(text: str) -> int:
    try:
        load(text)
        return 0
    except BadJson as e:
        return e.at + 1


def _length(text: str, path: str = "$") -> int | None:
    found = follow(load(text), parse_path(path))
    return None if found is MISSING else len(found) if kind(found) == "array" else 0


def _type(text: str, path: str = "$") -> str | None:
    found = follow(load(text), parse_path(path))
    return None if found is MISSING else kind(found)


json_minified = _Lazy(lambda t: dump(load(t)), "string")
json_pretty = _Lazy(lambda t, indent="    ": dump(load(t), indent), "string")
json_valid = _Lazy(_valid, "int")
json_error_position = _Lazy(_error, "int")
json_array_length = _Lazy(_length, "long")
json_type = _Lazy(_type, "string")
json_extract = _Lazy(_extract, "string")
json_arrow = _Lazy(_arrow, "string")
json_insert = _Lazy(_edited("insert"), "string")
json_replace = _Lazy(_edited("replace"), "string")
json_set = _Lazy(_edited("set"), "string")
json_remove = _Lazy(_edited("remove"), "string")
json_array_insert = _Lazy(_edited("array_insert"), "string")
json_patch = _Lazy(lambda a, b: dump(merge_patch(load(a), load(b))), "string")


def json_quote(x: Column, numeric: bool = False) -> Column:
    """A value as JSON; numbers as they are."""
    if numeric:
        return F.coalesce(x.cast("string"), F.lit("null"))
    return F.when(x.isNull(), "null").otherwise(_quoted(x))


def _quoted(x: Column) -> Column:
    body = F.to_json(F.struct(x.alias("v")))
    return F.substr(body, F.lit(6), F.length(body) - 6)


def json_array(*xs: Column) -> Column:
    """Elements by their types; null stays."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.when(x.isNull(), F.lit("null")).otherwise(_quoted(x)) for x in xs]), F.lit("]"))


def json_object(**members: Column) -> Column:
    parts = [F.concat(F.lit(json.dumps(name) + ":"), F.when(x.isNull(), F.lit("null")).otherwise(_quoted(x))) for name, x in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_group_array(x: Column, *order: Column) -> Column:
    """An aggregate: the elements, nulls too, in the given order."""
    item = F.when(x.isNull(), F.lit("null")).otherwise(_quoted(x))
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item.alias("item"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["item"]), ","), F.lit("]"))


def json_group_object(key: Column, x: Column) -> Column:
    """An aggregate: an object of name and value pairs, by name."""
    item = F.concat(_quoted(key.cast("string")), F.lit(":"), F.when(x.isNull(), F.lit("null")).otherwise(_quoted(x)))
    rows = F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), item.alias("item"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda r: r["item"]), ","), F.lit("}"))


# --- table functions ------------------------------------------------------------------------------------

NODE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("type", T.StringType()), T.StructField("atom", T.StringType()),
    T.StructField("id", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("fullkey", T.StringType()), T.StructField("path", T.StringType()),
])
_PLAIN = re.compile(r"[A-Za-z_]\w*$")


def _nodes(text: str | None, path: str, deep: bool) -> list[tuple]:
    if text is None:
        return []
    root = follow(load(text), parse_path(path))
    if root is MISSING:
        return []
    out: list[tuple] = []

    def add(key: str | None, value: Any, parent: int | None, full: str, base: str) -> int:
        k = kind(value)
        out.append((key, as_sql(value), k, None if k in ("array", "object") else as_sql(value), len(out), parent, full, base))
        return len(out) - 1

    def children(value: Any) -> Iterator[tuple[str, Any, str]]:
        if isinstance(value, Object):
            for name, v in value:
                yield name, v, f".{name}" if _PLAIN.match(name) else "." + json.dumps(name, ensure_ascii=False)
        else:
            for i, v in enumerate(value):
                yield str(i), v, f"[{i}]"

    def walk(value: Any, me: int | None, full: str) -> None:
        for key, v, step in children(value):
            at = add(key, v, me, full + step, full)
            if deep and kind(v) in ("array", "object"):
                walk(v, at, full + step)

    nested = kind(root) in ("array", "object")
    if deep or not nested:
        me = add(None, root, None, path, path)
        if nested:
            walk(root, me, path)
    else:
        walk(root, None, path)
    return out


def json_nodes(text: Column, path: str = "$", deep: bool = True) -> Column:
    """The rows of json_tree (or json_each, if not deep) of a text, as an array of structs to be exploded."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = NODE.names
        for s in batches:
            yield pd.Series([[dict(zip(names, n, strict=True)) for n in _nodes(None if not isinstance(t, str) else t, path, deep)] for t in s], dtype=object)

    return F.pandas_udf(run, T.ArrayType(NODE))(text)


# --- binary JSON ----------------------------------------------------------------------------------------------


def jsonb(text: Column) -> Column:
    """Binary JSON of a text; an error if it is none."""
    return F.parse_json(text)


def _binary(f: Callable[..., Column]) -> Callable[..., Column]:
    """The same edit from binary JSON to binary JSON."""

    def run(value: Column, *rest: Column) -> Column:
        return F.parse_json(f(F.to_json(value), *rest))

    return run


jsonb_set, jsonb_insert, jsonb_replace = _binary(json_set), _binary(json_insert), _binary(json_replace)
jsonb_remove, jsonb_patch, jsonb_array_insert = _binary(json_remove), _binary(json_patch), _binary(json_array_insert)


def jsonb_array(*xs: Column) -> Column:
    return F.parse_json(json_array(*xs))


def jsonb_object(**members: Column) -> Column:
    return F.parse_json(json_object(**members))


def jsonb_group_array(x: Column, *order: Column) -> Column:
    return F.parse_json(json_group_array(x, *order))


def jsonb_group_object(key: Column, x: Column) -> Column:
    return F.parse_json(json_group_object(key, x))
