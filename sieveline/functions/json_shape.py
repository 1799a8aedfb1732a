"""Answers of typed stores that keep number text, and objects found in noisy text. UDFs, since engines normalise numbers; the printers of values and types are expressions (``json_tokens``)."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Number(str):
    pass


def parse(text: str):
    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)


def _udf(printer):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else printer(parse(t))
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return run


def _plain_number(x):
    """Whole numbers in their plain form, others as they are written; what isn't a number stays a string."""
    if re.fullmatch(r"[+-]?[0-9]+", x) and -(2**63) <= int(x) < 2**63:
        return _Number(int(x))
    try:
        float(x)
    except ValueError:
        return x
    return _Number(x) if x == x.strip() and "_" not in x else x


def unwrap_typed(v, depth: int = 0):
    """Values of a typed store ({"S": ...}, {"N": ...}, {"L": ...}, {"M": ...}) as plain ones, ten levels deep at most; other objects field by field."""
    if depth > 10 or not isinstance(v, dict):
        return v
    kind, x = next(iter(v.items())) if len(v) == 1 else (None, None)
    is_text = isinstance(x, str) and not isinstance(x, _Number)
    if kind in ("S", "B", "BOOL", "SS", "BS"):
        return x
    if kind == "N":
        return _plain_number(x) if is_text else x
    if kind == "NULL":
        return None
    if kind == "L" and isinstance(x, list):
        return [unwrap_typed(y, depth + 1) for y in x]
    if kind == "M" and isinstance(x, dict):
        return {k: unwrap_typed(y, depth + 1) for k, y in x.items()}
    if kind == "NS":
        return [_plain_number(y) for y in x if isinstance(y, str) and not isinstance(y, _Number)] if isinstance(x, list) else x
    return {k: unwrap_typed(y, depth + 1) for k, y in v.items()}


#: Characters that JSON for web pages escapes.
_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}


def _quoted(s: str) -> str:
    return re.sub("[<>&\u2028\u2029]", lambda m: _ESCAPES[m[0]], json.dumps(s, ensure_ascii=False))


def _dump(v) -> str:
    if isinstance(v, _Number):
        return str(v)
    if isinstance(v, list):
        return "[" + ",".join(map(_dump, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_quoted(k)}:{_dump(x)}" for k, x in v.items()) + "}"
    return _quoted(v) if isinstance(v, str) else json.dumps(v)


def shortest(x: float) -> str:
    """The fewest digits that give the number back; with an exponent below 1e-4 and from 1e6 on."""
    d = Decimal(repr(x)).normalize()
    if not x or -4 <= d.adjusted() < 6:
        return format(d, "f") if x else "0"
    digits = str(abs(int("".join(map(str, d.as_tuple().digits)))))
    return ("-" if x < 0 else "") + digits[0] + ("." + digits[1:] if digits[1:] else "") + f"e{d.adjusted():+03d}"


def _capacity(v: dict) -> list[str]:
    units = v["ConsumedCapacity"].get("CapacityUnits") if isinstance(v.get("ConsumedCapacity"), dict) else None
    return [f"Capacity: {shortest(float(units))} RCU"] if isinstance(units, _Number) else []


def _whole(x, other: int) -> int:
    return int(x) if isinstance(x, _Number) and re.fullmatch(r"-?[0-9]+", x) else other


def table_items(v, cap: int = 20) -> str | None:
    """The answer of a query or scan of a typed store; null if it has no items."""
    if not isinstance(v, dict) or not isinstance(items := v.get("Items"), list):
        return None
    count = _whole(v.get("Count"), len(items))
    out = [f"Count: {count}/{_whole(v.get('ScannedCount'), count)}", *_capacity(v)]
    if isinstance(v.get("LastEvaluatedKey"), dict):
        out.append("(paginated — more results available)")
    out += [_dump(unwrap_typed(x)) for x in items[:cap]]
    return "\n".join(out + [f"… +{len(items) - cap} more items"] * (len(items) > cap))


def table_item(v) -> str | None:
    """The answer with one item of a typed store; null if it has neither item nor capacity."""
    if not isinstance(v, dict):
        return None
    item = [_dump(unwrap_typed(v["Item"]))] if isinstance(v.get("Item"), dict) else []
    return "\n".join(item + _capacity(v)) or None


typed_item = _udf(lambda item: _dump(unwrap_typed(item)))
items_report, item_report = _udf(table_items), _udf(table_item)


def embedded_object(text: str) -> str | None:
    """The first balanced JSON object in noisy text."""
    at = text.find("{")
    while at >= 0:
        depth, quote, i = 0, False, at
        while i < len(text):
            ch = text[i]
            if quote:
                i += ch == "\\"
                quote = ch != '"'
            elif ch == '"':
                quote = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    try:
                        json.loads(text[at : i + 1])
                        return text[at : i + 1]
                    except ValueError:
                        break
            i += 1
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def extract_object(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else embedded_object(t))
