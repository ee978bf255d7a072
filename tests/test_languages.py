"""Table-driven semantics: nulls, kinds, precedence, errors."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions import values as V
from tidemark.plans.compile import run_kql, run_opl, run_ottl
from tidemark.plans.kql import parse_kql
from tidemark.plans.opl import parse_opl, parse_ottl
from tidemark.plans.syntax import Binary, Literal, QueryError


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, 2.5, "abc", None, True)], "i long, d double, s string, n string, b boolean")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("7 % 4", 3), ("1 / 0", None), ("1.5 + 1", 2.5), ("i + d", 3.5), ("s + 1", None), ("'3' * 2", 6.0),
        ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("n == string(null)", True), ("n == 'x'", False), ("n != 'x'", True), ("i < n", False), ("1 == '1'", True), ("s == 5", False), ("s != 5", True),
        ("true or false and false", True), ("1 < 2 == true", True), ("not(n == 'x')", True), ("s in ('abc')", True), ("s !in ('abc')", False), ("s in~ ('ABC')", True), ("s contains 'BC'", True), ("s contains_cs 'BC'", False), ("s !has 'z'", True),
        ("s matches regex 'b.'", True), ("strlen(s)", 3), ("substring('hello world', 6)", "world"), ("substring('hello world', 0, 5)", "hello"), ("substring('hello world', 1, 4)", "ello"), ("substring('hello world', 0, 50)", "hello world"),
        ("coalesce(tolong('invalid'), 18)", 18), ("strcat('hello', n, s)", "helloabc"), ("strcat_delim('-', 'a', n, 'b')", "a--b"), ("tostring(n)", ""), ("toint('12')", 12), ("toint('x')", None), ("tobool('true')", True), ("toreal('1.5')", 1.5),
        ("bin(7, 5)", 5), ("bin(-1, 5)", -5), ("bin(7.5, 2)", 6.0), ("bin(7, 0)", None), ("extract('(b)(c)', 2, s)", "c"), ("extract('x(y)', 1, s)", None), ("gettype(i)", "long"), ("gettype(n)", "null"), ("iff(i > 0, 1, 2.5)", 1.0), ("case(i > 5, 'a', i > 0, 'b', 'c')", "b"),
        ("extract_json('$.a', '{\"a\": 5}', typeof(long))", 5), ("tostring(parse_json('{\"a\": [1, {\"b\": 2}]}').a[1].b)", "2"), ("dynamic([1, 2, 3])[-1]", 3), ("real(+inf) > 1", True), ("totimespan('01:30:00') == 90m", True), ("1h + 30m == 90m", True), ("missing", None),
        ("replace_string(s, 'b', 'x')", "axc"), ("'a\\u0041\\n'", "aA\n"), ("-i", -1),
    ],
)
def test_kql_expression(one, text, want):
    got = run_kql(f"source | project x = {text}", one).first()["x"]
    assert got == want and isinstance(got, bool) == isinstance(want, bool)


@pytest.mark.parametrize("text", ["source | where i = 1", "source | sort by i", "source | where", "source | extend x = nothing(i)", "source | project x = strlen()", "source | where i == ", "source | summarize", "source | project x = 'open"])
def test_kql_errors(one, text):
    with pytest.raises(QueryError):
        run_kql(text, one)


def test_precedence():
    predicate = parse_kql("source | where a or b and c == 1").stages[0].parts["predicate"]
    assert predicate.op == "or" and predicate.right.op == "and"
    assert predicate.right.right == Binary("==", predicate.right.right.left, Literal(1, "int"))


def test_kql_functions(one):
    got = run_kql("let twice = (x: long) { x * 2 }; let add = (x: long, y: long = 10) { let z = twice(x); z + y }; let k = 5; source | project a = add(i), b = add(i, y = k), c = k // the end", one).first()
    assert tuple(got) == (12, 7, 5)
    with pytest.raises(QueryError):
        run_kql("let f = (x: long) { x }; source | project a = f(1, 2)", one)
    assert run_kql("source | project x = up(s)", one, {"up": lambda a: V.Value(F.upper(a[0].col), "string")}).first()["x"] == "ABC"


def test_summarize(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v long")
    got = {r.k: (r.n, r.sum_v, r.avg_v) for r in run_kql("t | summarize n = count(), sum(v), avg(v) by k", df).collect()}
    assert got == {"a": (2, 1, 1.0), None: (1, 3, 3.0)}
    assert run_kql("t | where v > 100 | summarize count()", df).count() == 0
    assert run_kql("t | summarize count() | where count == 3", df).count() == 1
    assert run_kql("t | summarize n = count() by k", df, max_groups=2).count() == 2
    with pytest.raises(Exception, match="more than 1 groups"):
        run_kql("t | summarize n = count() by k", df, max_groups=1).collect()


KINDS = {"s": "string", "i": "int", "d": "double", "b": "bool"}


@pytest.fixture(scope="module")
def logs(spark):
    attributes = F.create_map(
        F.lit("s"), V.wrap(V.literal("x", "string")), F.lit("i"), V.wrap(V.literal(5, "int")), F.lit("d"), V.wrap(V.literal(2.5, "double")), F.lit("b"), V.wrap(V.literal(True, "bool")), F.lit("e"), F.lit(None).cast(V.ANY_VALUE)
    )
    resource = F.struct(F.create_map(F.lit("service.name"), V.wrap(V.literal("svc", "string"))).alias("attributes"))
    points = F.array(F.struct(F.lit(1).alias("int_value"), F.lit(1.5).alias("double_value")), F.struct(F.lit(7).alias("int_value"), F.lit(2.5).alias("double_value")))
    df = spark.range(2).select("id", F.lit("INFO").alias("severity_text"), F.lit(9).alias("severity_number"), attributes.alias("attributes"), resource.alias("resource"), points.alias("data_points"))
    empty = df.limit(1).withColumn("id", F.lit(2).cast("long")).withColumn("attributes", F.lit(None).cast(V.ATTRIBUTES))
    return df.unionByName(empty)


def kept(logs, predicate):
    return sorted(r.id for r in run_opl(f"logs | where {predicate}", logs)["default"].collect())


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        ('attributes["s"] == "x"', [0, 1]), ('attributes["s"] == 5', []), ('attributes["s"] != 5', [0, 1, 2]), ('attributes["s"] != "x"', [2]), ('attributes["i"] > 4', [0, 1]), ('attributes["i"] == 5.0', [0, 1]), ('attributes["d"] <= 2.5', [0, 1]), ('attributes["b"] == true', [0, 1]),
        ('attributes["e"] == null', [0, 1, 2]), ('attributes["s"] == null', [2]), ('not(attributes["s"] == null)', [0, 1]), ('attributes["e"] is Null', [0, 1, 2]), ('attributes["s"] is String', [0, 1]), ('attributes["i"] is Integer and attributes["d"] is Double and attributes["b"] is Boolean', [0, 1]), ('attributes["i"] is String', []),
        ('attributes["s"] =~ "X"', [0, 1]), ("is Log", [0, 1, 2]), ("is Metric", []), ('resource.attributes["service.name"] == "svc" and id < 1', [0]), ('attributes["i"] + 1 == 6', [0, 1]), ('attributes["i"] * attributes["d"] == 12.5', [0, 1]), ("severity_number as String == \"9\"", [0, 1, 2]),
        ('contains(attributes["s"], "x") or id == 2', [0, 1, 2]), ('regexp_substr("a1b22", r"[0-9]+", 1, 2) == "22"', [0, 1, 2]), ('regexp_substr("key=val", r"(?<k>\\\\w+)=(?<v>\\\\w+)", 1, 1, "c", "v") == "val"', [0, 1, 2]), ('regexp_capture("ab", r"x(b)", 1) == null', [0, 1, 2]),
    ],
)
def test_opl_where(logs, predicate, want):
    assert kept(logs, predicate) == want


def test_keys_in_any_case(logs):
    query = 'logs | where attributes["S"] == "x"'
    assert run_opl(query, logs)["default"].count() == 0
    assert run_opl(query, logs, any_case=True)["default"].count() == 2
    assert run_opl('logs | where attributes["NONE"] == null', logs, any_case=True)["default"].count() == 3


def test_opl_flow(logs):
    out = run_opl('logs | if (id == 0) { set attributes["t"] = "a" } else if (id == 1) { route_to "p" } else { set severity_text = "none" }', logs)
    assert {r.id: (r.severity_text, (r.attributes or {}).get("t")) for r in out["default"].collect()}.keys() == {0, 2}
    assert [r.id for r in out["p"].collect()] == [1]
    twice = run_opl("logs | fork { where id < 2 } { where id < 1 }", logs)["default"]
    assert sorted(r.id for r in twice.collect()) == [0, 0, 1]
    same = run_opl('logs | if (id == 1) { set severity_text = "A" } else { set severity_text = "A" }', logs)["default"]
    assert {r.severity_text for r in same.collect()} == {"A"} and same.count() == 3
    assert run_opl("logs | drop", logs)["default"].count() == 0


def test_opl_maps(logs):
    first = lambda q: run_opl(f"logs | where id == 0 | {q}", logs)["default"].first()
    assert set(first('rename attributes "s" as "i", "none" as "d"').attributes) == {"i", "d", "b", "e"}
    assert first('rename attributes "s" as "i"').attributes["i"].str == "x"
    assert set(first('rename attributes "s" as "i", "i" as "s"').attributes) == {"s", "i", "d", "b", "e"}
    assert set(first('remove attributes["s"], attributes["none"]').attributes) == {"i", "d", "b", "e"}
    assert set(first("apply attributes { where value is Integer or key == \"s\" }").attributes) == {"s", "i"}
    assert first('apply attributes { if (value is Integer) { set value = value + 1 } else { drop } }').attributes["i"].int == 6
    assert first("apply attributes { drop }").attributes == {}
    assert first('apply resource.attributes { set value = concat("x-", value) }').resource.attributes["service.name"].str == "x-svc"
    assert [p.int_value for p in first("apply data_points { where int_value > 3 | set int_value = int_value + 1 }").data_points] == [8]
    assert first('set resource.attributes["k"] = 1, attributes["new"] = resource.attributes["service.name"]').attributes["new"].str == "svc"
    assert run_opl('logs | where id == 2 | set attributes["k"] = 1', logs)["default"].first().attributes["k"].int == 1


@pytest.mark.parametrize(
    "text",
    ['logs | rename attributes "a" as "b", "c" as "b"', 'logs | rename attributes "a" as "a"', 'logs | set resource.attributes["a"] = attributes["s"]', "logs | apply attributes { fork { drop } }", 'logs | apply attributes { set key = "x" }', "logs | remove severity_text", "nothing | drop", "logs", 'logs | where attributes["s"] = 1', 'logs | where matches(severity_text, r"a(?=b)")', "logs | where -id > 1"],
)
def test_opl_errors(logs, text):
    with pytest.raises(QueryError):
        run_opl(text, logs)


def test_signals_and_metrics(spark, logs):
    metrics = spark.createDataFrame([(1, 1), (2, 3)], "id long, metric_type int")
    out = run_opl("signals | where id == 1", {"logs": logs, "metrics": metrics})
    assert out["logs"].count() == 1 and out["metrics"].count() == 1
    assert run_opl("histograms | where id > 0", metrics)["default"].count() == 1
    assert run_opl("metrics | where is Gauge", metrics)["default"].count() == 1


def test_ottl(logs):
    got = run_ottl('set(severity_text, "W") where attributes["s"] == "x"\nset(attributes["k"], 1)', logs)
    assert sorted(r.severity_text for r in got.collect()) == ["INFO", "W", "W"]
    with pytest.raises(QueryError, match="SyntaxNotSupported"):
        parse_ottl('delete_key(attributes, "a")')


def test_parsers_accept_comments_and_nesting():
    assert parse_opl("logs /* c */ | where (a == 1) // d\n | drop").stages[1].op == "drop"
    assert scalars.java_pattern("%Y-%m-%dT%H:%M:%S at") == "yyyy-MM-dd'T'HH:mm:ss' at'"
    with pytest.raises(QueryError):
        scalars.java_pattern("%Q")
