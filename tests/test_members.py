"""Members are cut by one pattern where brackets are few levels deep, by a walk where they are not."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docframe.functions import route
from docframe.operators import records
from docframe.spec import RecordSpec


def _value(r, depth):
    kind = r.randrange(6 if depth else 3)
    if kind < 3:
        return (r.choice(['a,b', 'q"}', "[\\", "é{", ""]), r.randrange(-9, 99) / 2, r.choice([None, True]))[kind]
    if kind == 3:
        return [_value(r, depth - 1) for _ in range(r.randrange(4))]
    return {r.choice(["k", 'k"', "k:,", "{"]) + str(i): _value(r, depth - 1) for i in range(r.randrange(4))}


def _cut(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["m"] for r in rows.select("i", route.split_members(F.col("t")).alias("m")).orderBy("i").collect()]


def test_shallow_texts_are_not_walked(spark, monkeypatch):
    monkeypatch.setattr(route, "_stepped", lambda text: F.raise_error(F.lit("walked")).cast("struct<tokens:array<string>,depth:array<bigint>>"))
    big = "x" * 200_000
    got = _cut(spark, [' { "a" : [1, {"b":2}] , "c":"d,}" } ', "[1, [2,3] ,{}]", "{}", "[ ]", f'{{"s":"{big}","l":[{"1," * 50_000}1]}}', "[" * 8 + "]" * 8])
    pairs = [[(m["name"], m["raw"]) for m in ms] for ms in got]
    assert pairs[:4] == [[("a", '[1, {"b":2}]'), ("c", '"d,}"')], [(None, "1"), (None, "[2,3]"), (None, "{}")], [], []]
    assert [len(raw) for _, raw in pairs[4]] == [200_002, 100_003]
    assert pairs[5] == [(None, "[" * 7 + "]" * 7)]


@pytest.mark.parametrize("depth", [3, 12])
def test_members_of_any_depth(spark, depth):
    r = random.Random(depth)
    held = [{"k": _value(r, depth), "l": _value(r, depth)} for _ in range(40)] + [{"deep": json.loads("[" * 11 + "1" + "]" * 11)}]
    for spaced in ((",", ":"), (" , ", " : ")):
        got = _cut(spark, [json.dumps(h, separators=spaced) for h in held])
        assert [[(m["name"], m["raw"]) for m in ms] for ms in got] == [[(k, json.dumps(v, separators=spaced)) for k, v in h.items()] for h in held]


@pytest.mark.parametrize("kind", ["timestamp", "u64", "bigint", "double", "decimal(12,2)"])
def test_a_variant_is_looked_into_once(spark, kind):
    made = spark.range(1).select(records._scalar(F.parse_json(F.lit("1")), kind, RecordSpec(())).alias("v"))
    assert made._jdf.queryExecution().analyzed().toString().count("variant_get(") <= 1
