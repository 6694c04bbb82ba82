"""Tool calls in model output, and where their numbers come from; Arrow UDFs over text columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGGED = re.compile(r"<tool_call>(.*?)(?:</tool_call>|\Z)", re.S)
FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.S)
NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
CALLS = T.StructType([T.StructField("calls", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))), T.StructField("cleaned", T.StringType())])


def _balanced(text: str) -> str:
    """text up to the bracket that closes its first one, with what is missing at the end added."""
    open_, quoted, skip = [], False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
            if not open_:
                return text[: i + 1]
    return text + '"' * quoted + "".join(reversed(open_))


def _number(text: str) -> str:
    """A number as JSON; whole ones stay whole."""
    value = float(text)
    return json.dumps(int(value) if re.fullmatch(r"[-+]?\d+", text) else value)


def _rows(text: str) -> str:
    """Number lists that are parted by blanks, and rows by blanks or semicolons, as JSON arrays."""

    def one(found: re.Match) -> str:
        rows = [NUMBER.findall(r) for r in found[1].split(";")]
        lists = ["[" + ", ".join(_number(x) for x in r) + "]" for r in rows if r]
        return lists[0] if len(lists) == 1 else "[" + ", ".join(lists) + "]"

    return re.sub(r"\]\s+\[", "], [", re.sub(r"\[((?:\s*[-+.\deE]+)(?:[\s;]+[-+.\deE]+)+\s*)\]", one, text))


def tolerant(text: str):
    """The value of JSON that may have stray backslashes, blank-parted arrays, trailing commas or a missing end; None if nothing helps."""
    escaped = lambda t: re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", t)
    commas = lambda t: re.sub(r",\s*([}\]])", r"\1", t)
    for repair in (lambda t: t, escaped, _rows, lambda t: commas(_rows(escaped(t))), lambda t: _balanced(commas(_rows(escaped(t)))), lambda t: commas(_balanced(_rows(escaped(t))))):
        try:
            return json.loads(repair(text.strip()))
        except ValueError:
            continue
    return None


def calls_in(text: str | None) -> tuple[list[tuple[str, str]], str]:
    """([(name, arguments as JSON)], text without the calls): tags first, then fenced blocks, then bare objects."""
    text = text or ""
    for pattern in (TAGGED, FENCED):
        if found := pattern.findall(text):
            values = [tolerant(x) for x in found]
            cleaned = pattern.sub("", text).strip()
            break
    else:
        at = re.search(r'\{\s*"name"\s*:', text)
        part = _balanced(text[at.start() :]) if at else ""
        values, cleaned = ([tolerant(part)], (text[: at.start()] + text[at.start() + len(part) :]).strip()) if at else ([], text)
    calls = [(v["name"], json.dumps(v.get("arguments", {}), sort_keys=True)) for v in values if isinstance(v, dict) and isinstance(v.get("name"), str)]
    return calls, cleaned


@F.pandas_udf(CALLS)
def tool_calls(texts: pd.Series) -> pd.DataFrame:
    found = [calls_in(t) for t in texts]
    return pd.DataFrame({"calls": [[{"name": n, "arguments": a} for n, a in c] for c, _ in found], "cleaned": [t for _, t in found]})


def arrays_in(text: str | None) -> list[list[float]]:
    """Number lists of a text, rows of matrices one by one."""
    return [list(map(float, NUMBER.findall(row))) for found in re.findall(r"\[([^\[\]]*)\]", text or "") for row in found.split(";") if NUMBER.search(row)]


def provenance(arguments: str | None, context: str | None, rtol: float = 1e-6) -> list[str]:
    """Names of array arguments that no list, matrix or transposed matrix of the context matches."""
    known = arrays_in(context)
    near = lambda a, b: len(a) == len(b) and all(abs(x - y) <= rtol * max(1.0, abs(y)) for x, y in zip(a, b))

    def seen(value) -> bool:
        if value and isinstance(value[0], list):
            return all(any(near(r, k) for k in known) for r in value) or all(any(near(list(r), k) for k in known) for r in zip(*value))
        return any(near(value, k) for k in known)

    values = json.loads(arguments or "{}")
    return sorted(n for n, v in values.items() if isinstance(v, list) and v and not seen(v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unfounded_arguments(arguments: pd.Series, context: pd.Series) -> pd.Series:
    return pd.Series([provenance(a, c) for a, c in zip(arguments, context)])


def coerced_value(value, schema: dict, path: str, errors: list[str]):
    """value with texts parsed where the schema has arrays, at any depth; what stays of the wrong type is noted by its path."""
    kind = schema.get("type")
    if kind == "array":
        if isinstance(value, str):
            found = tolerant(value)
            value = value if found is None else found
        if not isinstance(value, list):
            errors.append(f"{path}: not an array")
            return value
        items = schema.get("items")
        return value if items is None else [coerced_value(v, items, f"{path}[{i}]", errors) for i, v in enumerate(value)]
    fits = {
        "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
        "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "object": lambda v: isinstance(v, dict),
    }
    if kind in fits and not fits[kind](value):
        errors.append(f"{path}: not a {kind}")
    if kind == "object" and isinstance(value, dict):
        return {k: coerced_value(v, schema.get("properties", {}).get(k, {}), f"{path}.{k}", errors) for k, v in value.items()}
    return value


COERCED = T.StructType([T.StructField("arguments", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))])


@F.pandas_udf(COERCED)
def coerced(arguments: pd.Series, schema: pd.Series) -> pd.DataFrame:
    """struct<arguments, errors> of JSON arguments under a JSON schema of an object: arrays that came as text are arrays, missing required values and bad leaves are errors."""
    known: dict = {}
    out = []
    for text, rules in zip(arguments, schema):
        rules = known.setdefault(rules, json.loads(rules))
        value, errors = tolerant(text) if isinstance(text, str) else None, []
        if not isinstance(value, dict):
            out.append((None, ["arguments: not an object"]))
            continue
        made = coerced_value(value, {"type": "object"} | rules, "", errors)
        errors += [f".{name}: missing" for name in rules.get("required", []) if name not in value]
        out.append((json.dumps(made, separators=(",", ":")), errors))
    return pd.DataFrame(out, columns=COERCED.names)
