"""JSON printers over tokens, held against printers over parsed values."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions import json_tokens as J


class Number(str):
    pass


def parsed(text):
    return json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)), strict=True).raw_decode(text.lstrip(" \t\r\n"))[0]


def plain(v):
    return not isinstance(v, list | dict)


def compact(v, depth=0, most=10):
    pad = "  " * depth
    if depth > most:
        return pad + "..."
    if isinstance(v, Number):
        return pad + v
    if isinstance(v, str):
        raw = v.encode()
        return f'{pad}"{raw[:77].decode(errors="ignore")}..."' if len(raw) > 80 else f'{pad}"{v}"'
    if plain(v):
        return pad + json.dumps(v)
    if not v:
        return pad + ("[]" if isinstance(v, list) else "{}")
    if isinstance(v, list):
        if len(v) > 5:
            return f"{pad}[{compact(v[0], depth + 1, most).strip(' ')}, ... +{len(v) - 1} more]"
        rows = [compact(x, depth + 1, most) for x in v]
        return pad + "[" + ", ".join(r.strip(" ") for r in rows) + "]" if all(map(plain, v)) else "\n".join([pad + "[", *(r + "," for r in rows), pad + "]"])
    out = [pad + "{"]
    for i, k in enumerate(sorted(v, key=str.encode)):
        out += [f"{pad}  {k}: {compact(v[k], 0, most).strip(' ')}"] if plain(v[k]) else [f"{pad}  {k}:", compact(v[k], depth + 1, most)]
        if i >= 20:
            out.append(f"{pad}  ... +{len(v) - i - 1} more keys")
            break
    return "\n".join([*out, pad + "}"])


def shape(v, depth=0, most=10):
    pad = "  " * depth
    if depth > most:
        return pad + "..."
    if isinstance(v, Number):
        return pad + ("float" if re.search("[.eE]", v) else "int")
    if isinstance(v, str):
        n = len(v.encode())
        return pad + (f"string[{n}]" if n > 50 else "url" if v.startswith("http") else "date?" if "-" in v and n == 10 else "string")
    if plain(v):
        return pad + ("null" if v is None else "bool")
    if not v:
        return pad + ("[]" if isinstance(v, list) else "{}")
    if isinstance(v, list):
        first = shape(v[0], depth + 1, most)
        return f"{pad}[\n{first}\n{pad}]" if len(v) == 1 else f"{pad}[{first.strip(' ')}] ({len(v)})"
    out = [pad + "{"]
    for i, k in enumerate(sorted(v, key=str.encode)):
        x = shape(v[k], depth + 1, most)
        out += [f"{pad}  {k}: {x.strip(' ')}" + "," * (i < len(v) - 1)] if plain(v[k]) else [f"{pad}  {k}:", x]
        if i >= 15:
            out.append(f"{pad}  ... +{len(v) - i - 1} more keys")
            break
    return "\n".join([*out, pad + "}"])


def some(rng, depth=0):
    kind = rng.randrange(9 if depth < 5 else 6)
    if kind < 6:
        return rng.choice(["1.50", "-0", "1e400", "42", "123456789012345678901234567890", "true", "false", "null", '""', '"a\\"b"', '"2024-01-02"', '"http://x"', json.dumps("é" * rng.randrange(60)), '"\\u00e9\\n"', json.dumps("x" * rng.randrange(100))])
    n = rng.choice([0, 1, 2, 4, 6, 25])
    if kind == 6:
        return "{" + ", ".join(f'"k{rng.randrange(30)}é" : {some(rng, depth + 2 + n // 9)}' for _ in range(n)) + "}"
    return "[ " + ",".join(some(rng, depth + 1 + n // 9) for _ in range(n)) + "]"


@pytest.mark.parametrize("most", [10, 1])
def test_printers(spark, most):
    rng = random.Random(most)
    texts = [some(rng) for _ in range(150)] + ["[" * 12 + "1" + "]" * 12, ' {"a":1} trailing', "\n3", json.dumps({f"k{i:02}": i for i in range(22)}), json.dumps({f"k{i:02}": i for i in range(16)})]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", J.compact("t", most).alias("c"), J.shape("t", most).alias("s")).collect()
    for r in rows:
        v = parsed(r.t)
        assert (r.c, r.s) == (compact(v, most=most), shape(v, most=most)), r.t


def test_not_json(spark):
    texts = ["", "  ", "no", "{", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "{a:1}", "[1 2]", "01", "1.", "+1", '"a', "'a'", "]", "[}", '{"a":1]', '"\\x"', "NaN", "[tru]", '{1:2}', '"a\nb"']
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(J.compact("t").alias("c"), J.shape("t").alias("s")).collect()
    assert all(r.c is None and r.s is None for r in rows)


def test_no_python_worker(spark):
    plan = spark.range(1).select(J.compact(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)
