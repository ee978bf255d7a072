"""Trees to DataFrames: KQL queries over any frame, OPL and OTTL pipelines over telemetry frames.

Nothing is executed here. Every operator becomes projections, filters, unions and aggregates of the
DataFrame API, so the optimiser sees one declarative plan from the scan on.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars
from tidemark.functions import values as V
from tidemark.functions.values import Value
from tidemark.plans import kql, opl
from tidemark.plans.syntax import Access, Binary, Call, IsType, Items, Literal, Negate, Not, Path, QueryError, Stage

# expressions


@dataclass
class Scope:
    """What names mean: columns of a frame, variables, user functions, lambda variables."""

    language: str
    schema: T.StructType | None = None
    variables: dict[str, Value] = field(default_factory=dict)
    functions: dict[str, object] = field(default_factory=dict)
    signal: str | None = None
    #: in `apply`: only the lambda's names are known
    closed: bool = False
    #: aliases of columns, by name
    aliases: dict[str, str] = field(default_factory=dict)
    #: whether attribute keys match in any case
    any_case: bool = False

    def with_variables(self, more: dict[str, Value]) -> Scope:
        return replace(self, variables=self.variables | more)

    # names

    def resolve(self, path: Path) -> Value:
        name, steps = path.root, path.steps
        if name in self.variables:
            return self.steps(self.variables[name], steps)
        if self.closed:
            raise QueryError(f"{name!r} isn't known here; only {', '.join(self.variables)}")
        if name == "source" and self.language == "kql" and steps and "source" not in self.schema.fieldNames():
            name, steps = steps[0], steps[1:]
        name = self.aliases.get(name, name)
        if name in self.schema.fieldNames():
            return self.steps(V.typed(F.col(f"`{name}`"), self.schema[name].dataType), steps)
        if "attributes" in self.schema.fieldNames() and isinstance(self.schema["attributes"].dataType, T.MapType) and self.language == "kql":
            return self.steps(V.typed(F.col("attributes"), self.schema["attributes"].dataType), (name, *steps))
        return V.null()

    def steps(self, v: Value, steps: tuple) -> Value:
        for step in steps:
            v = self.step(v, step)
        return v

    def step(self, v: Value, step) -> Value:
        if not isinstance(step, str | int):
            at = self.value(step)
            step = at.constant if at.constant is not None else at
        if v.kind == "null":
            return v
        if v.kind == "any":  # nested values are kept as CBOR
            v = Value(F.try_parse_json(scalars.hashing.cbor_json(v.col["ser"])), "variant")
        if v.kind == "variant":
            if isinstance(step, Value):
                raise QueryError("a dynamic value takes literal keys")
            where = f"$[{step}]" if isinstance(step, int) else "$['" + step.replace("'", "\\'") + "']"
            return Value(F.try_variant_get(v.col, where, "variant"), "variant")
        if v.kind == "struct":
            if step not in v.dtype.fieldNames():
                return V.null()
            return V.typed(v.col.getField(step), v.dtype[step].dataType)
        if v.kind == "map":
            key = step.col if isinstance(step, Value) else F.lit(step)
            found = F.get(F.map_values(F.map_filter(v.col, lambda k, _: F.lower(k) == F.lower(key))), F.lit(0)) if self.any_case else F.try_element_at(v.col, key)
            return V.typed(found, v.dtype.valueType)
        if v.kind == "array":
            # 0-based, from the end where negative
            at = V.to_int(step).cast("int") if isinstance(step, Value) else F.lit(step)
            return V.typed(F.try_element_at(v.col, F.when(at >= 0, at + 1).otherwise(at)), v.dtype.elementType)
        return V.null()

    # trees

    def value(self, tree) -> Value:
        if isinstance(tree, Literal):
            return V.literal(tree.value, tree.kind)
        if isinstance(tree, Path):
            return self.resolve(tree)
        if isinstance(tree, Access):
            return self.steps(self.value(tree.arg), tree.steps)
        if isinstance(tree, Binary):
            return self.binary(tree)
        if isinstance(tree, Not):
            return Value(~V.truth(self.value(tree.arg)), "bool")
        if isinstance(tree, Negate):
            return V.arithmetic("-", V.literal(0, "int"), self.value(tree.arg))
        if isinstance(tree, IsType):
            return Value(self.is_type(tree), "bool")
        if isinstance(tree, Items):
            return self.items(tree)
        if isinstance(tree, Call):
            return self.call(tree)
        raise QueryError(f"no meaning for {tree!r}")

    def truth(self, tree) -> Column:
        return V.truth(self.value(tree))

    def items(self, tree: Items) -> Value:
        parts = [self.value(x) for x in tree.values]
        kind = scalars.common_kind(parts) if parts else "string"
        columns = [scalars.convert(p, kind) for p in parts]
        if tree.keys is not None:
            text = F.to_json(F.struct(*(c.alias(k) for k, c in zip(tree.keys, columns, strict=True)))) if parts else F.lit("{}")
            return Value(F.parse_json(text), "variant")
        element = {"int": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "datetime": T.TimestampType(), "any": V.ANY_VALUE}.get(kind, T.StringType())
        return Value(F.array(*columns).cast(T.ArrayType(element)), "array", T.ArrayType(element))

    def binary(self, tree: Binary) -> Value:
        op = tree.op
        if op in ("and", "or"):
            left, right = self.truth(tree.left), self.truth(tree.right)
            return Value(left & right if op == "and" else left | right, "bool")
        left = self.value(tree.left)
        if op in ("in", "!in", "in~", "!in~"):
            same = V.equal if "~" not in op else V.equal_ignoring_case
            items = tree.right.values
            if "~" not in op and left.kind in ("int", "string") and all(isinstance(i, Literal) and i.kind == left.kind and i.value is not None for i in items):
                out = F.coalesce(left.col.isin([i.value for i in items]), F.lit(False))
            else:
                out = F.lit(False)
                for item in items:
                    out = out | same(left, self.value(item))
            return Value(~out if op.startswith("!") else out, "bool")
        right = self.value(tree.right)
        if op in ("==", "!="):
            out = V.equal(left, right)
        elif op in ("=~", "!~"):
            out = V.equal_ignoring_case(left, right)
        elif op in ("<", "<=", ">", ">="):
            return Value(V.ordered(op, left, right), "bool")
        elif op in ("+", "-", "*", "/", "%"):
            return V.arithmetic(op, left, right)
        elif op == "matches regex":
            return Value(F.coalesce(V.to_string(left).rlike(scalars.pattern_of(op, right)), F.lit(False)), "bool")
        else:  # contains and has, both substring tests
            text, part = V.to_string(left), V.to_string(right)
            if not op.endswith("_cs"):
                text, part = F.lower(text), F.lower(part)
            out = F.coalesce(F.contains(text, part), F.lit(False))
        return Value(~out if op.startswith("!") else out, "bool")

    def is_type(self, tree: IsType) -> Column:
        name = tree.name
        if tree.arg is None or name in opl.SIGNAL_TYPES or name in opl.METRIC_TYPES:
            if name in opl.SIGNAL_TYPES:
                return F.lit(self.signal == {"Log": "logs", "Metric": "metrics", "Span": "traces"}[name])
            if name in opl.METRIC_TYPES:
                if self.signal != "metrics":
                    return F.lit(False)
                return F.coalesce(F.col("metric_type") == opl.METRIC_TYPES[name], F.lit(False))
            raise QueryError(f"unknown type {name!r}")
        if name not in opl.VALUE_TYPES:
            raise QueryError(f"unknown type {name!r}")
        v = self.value(tree.arg)
        if v.kind == "any":
            return V.tag(v) == opl.VALUE_TYPES[name]
        kinds = {"String": "string", "Integer": "int", "Double": "double", "Boolean": "bool", "Bytes": "binary", "Array": "array", "Map": "map"}
        if name == "Null":
            return V.is_null(v)
        return v.col.isNotNull() if v.kind == kinds[name] else F.lit(False)

    def call(self, tree: Call) -> Value:
        if tree.name in self.functions:
            return self.invoke(tree)
        if tree.named:
            raise QueryError(f"{tree.name} takes no named arguments")
        name = tree.name
        if name == "not":
            return Value(~self.truth(tree.args[0]), "bool")
        if name in ("iff", "iif"):
            scalars.arity(name, tree.args, 3, 3)
            return scalars.choose([self.truth(tree.args[0])], [self.value(tree.args[1])], self.value(tree.args[2]))
        if name == "case":
            if len(tree.args) < 3 or len(tree.args) % 2 == 0:
                raise QueryError("case takes pairs of a condition and a value, and a last value")
            pairs = tree.args[:-1]
            return scalars.choose([self.truth(c) for c in pairs[::2]], [self.value(r) for r in pairs[1::2]], self.value(tree.args[-1]))
        library = scalars.KQL if self.language == "kql" else scalars.OPL
        if name not in library:
            raise QueryError(f"unknown function {name!r}")
        return library[name]([self.value(a) for a in tree.args])

    def invoke(self, tree: Call) -> Value:
        """A user function: its body with the arguments in place of the parameters."""
        f = self.functions[tree.name]
        if callable(f):
            return f([self.value(a) for a in tree.args])
        if len(tree.args) > len(f.parameters):
            raise QueryError(f"{tree.name} takes {len(f.parameters)} arguments, got {len(tree.args)}")
        given: dict[str, Value] = {p.name: self.value(a) for p, a in zip(f.parameters, tree.args, strict=False)}
        for key, arg in tree.named:
            if key in given or key not in {p.name for p in f.parameters}:
                raise QueryError(f"{tree.name} has no free parameter {key!r}")
            given[key] = self.value(arg)
        for p in f.parameters:
            if p.name not in given:
                if p.default is None:
                    raise QueryError(f"{tree.name} misses {p.name!r}")
                given[p.name] = self.value(p.default)
            if p.kind not in ("any", "table", "regex") and given[p.name].kind != p.kind:
                given[p.name] = Value(scalars.convert(given[p.name], p.kind), p.kind)
        inner = self.with_variables(given)
        for name, value in f.lets:
            inner = inner.with_variables({name: inner.value(value)})
        if f.body is None:
            raise QueryError(f"{tree.name} returns nothing")
        return inner.value(f.body)


# KQL


def run_kql(query: str, df: DataFrame, functions: dict[str, Callable] | None = None, aliases: dict[str, str] | None = None, max_groups: int | None = None) -> DataFrame:
    """The query's result over ``df``, whatever name the query gives its source.

    ``functions`` are further scalar functions (a list of Values to a Value); ``aliases`` map names
    of the query to columns. Summarize over no rows gives no rows. ``max_groups`` refuses (raises
    when run) a summarize of more groups; there is no limit otherwise.
    """
    parsed = kql.parse_kql(query)
    scope = Scope("kql", df.schema, {}, dict(functions or {}), aliases=dict(aliases or {}))
    for name, tree in parsed.lets:
        if isinstance(tree, kql.Function):
            scope.functions[name] = tree
        else:
            scope = scope.with_variables({name: scope.value(tree)})
    for stage in parsed.stages:
        scope.schema = df.schema
        df = _KQL_STAGES[stage.op](df, stage, scope) if stage.op != "summarize" else _summarize(df, stage, scope, max_groups)
    return df


def _target(path: Path, df: DataFrame) -> str:
    if not path.steps:
        return path.root
    if path.root in ("source", "attributes") and len(path.steps) == 1 and path.root not in df.columns:
        return str(path.steps[0])
    raise QueryError(f"can't assign to a part of {path.root!r}")


def _assign(df: DataFrame, scope: Scope, path: Path, value: Value) -> DataFrame:
    if path.steps and path.root in df.columns and isinstance(df.schema[path.root].dataType, T.MapType) and len(path.steps) == 1:
        return df.withColumn(path.root, _put(F.col(path.root), df.schema[path.root].dataType, str(path.steps[0]), value))
    return df.withColumn(_target(path, df), value.col)


def _kql_where(df: DataFrame, stage: Stage, scope: Scope) -> DataFrame:
    return df.where(scope.truth(stage.parts["predicate"]))


def _kql_extend(df: DataFrame, stage: Stage, scope: Scope) -> DataFrame:
    for path, tree in stage.parts["items"]:  # each sees what the ones before it set
        scope.schema = df.schema
        df = _assign(df, scope, path, scope.value(tree))
    return df


def _kql_project(df: DataFrame, stage: Stage, scope: Scope) -> DataFrame:
    return df.select(*(scope.value(tree).col.alias(_target(path, df) if path is not tree or not path.steps else str(path.steps[-1])) for path, tree in stage.parts["items"]))


def _matching(df: DataFrame, patterns: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if any(fnmatch.fnmatchcase(c, p.replace("[", "[[]")) for p in patterns)]


def _kql_keep(df: DataFrame, stage: Stage, scope: Scope) -> DataFrame:
    return df.select(*(f"`{c}`" for c in _matching(df, stage.parts["patterns"])))


def _kql_away(df: DataFrame, stage: Stage, scope: Scope) -> DataFrame:
    return df.drop(*_matching(df, stage.parts["patterns"]))


def _kql_rename(df: DataFrame, stage: Stage, scope: Scope) -> DataFrame:
    return df.withColumnsRenamed({_target(old, df): _target(new, df) for new, old in stage.parts["items"]})


def _summarize(df: DataFrame, stage: Stage, scope: Scope, max_groups: int | None) -> DataFrame:
    keys = [(name or _named(tree), scope.value(tree)) for name, tree in stage.parts["keys"]]
    keys.sort(key=lambda k: k[0])
    aggregates = [_aggregate(name, f, arg, scope) for name, f, arg in stage.parts["aggregates"]]
    if not keys and not aggregates:
        raise QueryError("summarize needs an aggregate or a key")
    columns = [v.col.alias(n) for n, v in keys]
    if not aggregates:
        out = df.select(*columns).distinct()
    elif keys:
        out = df.groupBy(*columns).agg(*aggregates)
    else:
        out = df.groupBy(F.lit(1).alias("_all")).agg(*aggregates).drop("_all")  # no rows, no group
    if max_groups is not None:
        total = out.agg(F.count("*").alias("_n"))
        refused = F.assert_true(F.col("_n") <= max_groups, F.lit(f"more than {max_groups} groups"))
        out = out.crossJoin(F.broadcast(total)).where(refused.isNull()).drop("_n")  # one row
    return out


def _named(tree) -> str:
    if isinstance(tree, Path):
        return str(tree.steps[-1]) if tree.steps else tree.root
    if isinstance(tree, Call) and tree.args:
        return _named(tree.args[0])
    raise QueryError("a key that is computed needs a name")


def _aggregate(name: str | None, function: str, arg, scope: Scope) -> Column:
    if function == "count":
        return F.count(F.lit(1)).alias(name or "count")
    v = scope.value(arg)
    name = name or f"{function}_{_named(arg)}"
    if function == "avg":
        return F.avg(V.to_double(v)).alias(name)
    if function == "sum":
        return F.sum(v.col if v.kind == "int" else V.to_double(v)).alias(name)
    return {"min": F.min, "max": F.max}[function](v.col).alias(name)


_KQL_STAGES = {
    "where": _kql_where,
    "extend": _kql_extend,
    "project": _kql_project,
    "project-keep": _kql_keep,
    "project-away": _kql_away,
    "project-rename": _kql_rename,
}


# OPL and OTTL

DEFAULT_PORT = "default"
# Scopes a field belongs to; a destination can't read what stands below it.
LEVELS = {"resource": 0, "instrumentation_scope": 1}


def _put(m: Column, dtype: T.MapType, key: str, value: Value) -> Column:
    """A map with one key set; a null map becomes one of that key."""
    item = V.wrap(value) if V.is_any(dtype.valueType) else value.col.cast(dtype.valueType)
    new = F.create_map(F.lit(key), item)
    rest = F.map_filter(m, lambda k, v: k != key)
    return F.when(m.isNull(), new).otherwise(F.map_concat(rest, new))


def _without(key: str) -> Callable[[Column, T.MapType], Column]:
    return lambda m, _: F.map_filter(m, lambda k, v: k != key)


def _level(path: Path) -> int:
    return LEVELS.get(path.root, 2)


def _paths(tree) -> list[Path]:
    if isinstance(tree, Path):
        return [tree]
    parts = []
    if isinstance(tree, Binary):
        parts = [tree.left, tree.right]
    elif isinstance(tree, Call):
        parts = list(tree.args)
    elif isinstance(tree, Not | Negate) or isinstance(tree, IsType) and tree.arg is not None:
        parts = [tree.arg]
    elif isinstance(tree, Items):
        parts = list(tree.values)
    return [p for part in parts for p in _paths(part)]


class OplRun:
    """One pipeline over one signal's frame; ``ports`` gathers what is routed away."""

    def __init__(self, signal: str, functions: dict[str, Callable] | None = None, any_case: bool = False):
        self.signal, self.functions, self.any_case = signal, dict(functions or {}), any_case
        self.ports: dict[str, list[DataFrame]] = {}

    def scope(self, df: DataFrame) -> Scope:
        return Scope("opl", df.schema, {}, self.functions, self.signal, any_case=self.any_case)

    def stages(self, df: DataFrame, stages: list[Stage]) -> DataFrame:
        for stage in stages:
            df = getattr(self, f"stage_{stage.op}")(df, stage)
        return df

    def stage_where(self, df: DataFrame, stage: Stage) -> DataFrame:
        return df.where(self.scope(df).truth(stage.parts["predicate"]))

    def stage_drop(self, df: DataFrame, stage: Stage) -> DataFrame:
        return df.where(F.lit(False))

    def stage_route_to(self, df: DataFrame, stage: Stage) -> DataFrame:
        self.ports.setdefault(stage.parts["port"], []).append(df)
        return df.where(F.lit(False))

    def stage_fork(self, df: DataFrame, stage: Stage) -> DataFrame:
        """Every branch gets every row; the union keeps duplicates."""
        return _union([self.stages(df, branch) for branch in stage.parts["branches"]])

    def stage_set(self, df: DataFrame, stage: Stage, guard: Column | None = None) -> DataFrame:
        for path, tree in stage.parts["items"]:
            lower = [p for p in _paths(tree) if _level(p) > _level(path)]
            if lower:
                raise QueryError(f"{path.root} can't be set from {lower[0].root}, which stands below it")
            df = self.put(df, path, self.scope(df).value(tree), guard)
        return df

    def put(self, df: DataFrame, path: Path, value: Value, guard: Column | None) -> DataFrame:
        names = (path.root, *path.steps)
        if path.root in df.columns:
            column, dtype = F.col(f"`{path.root}`"), df.schema[path.root].dataType
            new = _put_at(column, dtype, names[1:], value)
        elif len(names) == 1:
            new, dtype = value.col, None
            column = F.lit(None)
        else:
            raise QueryError(f"unknown field {path.root!r}")
        return df.withColumn(path.root, new if guard is None else F.when(guard, new).otherwise(column))

    def edit_map(self, df: DataFrame, root: str, steps: tuple, edit: Callable[[Column, T.MapType], Column], guard: Column | None) -> DataFrame:
        if root not in df.columns:
            return df  # nothing there to change
        column, dtype = F.col(f"`{root}`"), df.schema[root].dataType
        new = _edit_at(column, dtype, steps, edit)
        return df.withColumn(root, new if guard is None else F.when(guard, new).otherwise(column))

    def stage_remove(self, df: DataFrame, stage: Stage, guard: Column | None = None) -> DataFrame:
        for path in stage.parts["paths"]:
            if not path.steps or not isinstance(path.steps[-1], str):
                raise QueryError("only attributes can be removed")
            key = path.steps[-1]
            df = self.edit_map(df, path.root, path.steps[:-1], _without(key), guard)
        return df

    def stage_rename(self, df: DataFrame, stage: Stage, guard: Column | None = None) -> DataFrame:
        pairs = stage.parts["pairs"]
        new_names = [new for _, new in pairs]
        if len(set(new_names)) < len(new_names) or any(old == new for old, new in pairs):
            raise QueryError("Duplicate key in rename target")
        target = stage.parts["target"]
        return self.edit_map(df, target[0], target[1:], lambda m, dtype: _renamed(m, pairs), guard)

    def stage_if(self, df: DataFrame, stage: Stage) -> DataFrame:
        scope = self.scope(df)
        at = None
        for i, (condition, _) in enumerate(stage.parts["branches"]):
            hit = scope.truth(condition)
            at = F.when(hit, i) if at is None else at.when(hit, i)
        bodies = [body for _, body in stage.parts["branches"]]
        if stage.parts["else"] is not None:
            bodies.append(stage.parts["else"])
            at = at.otherwise(len(bodies) - 1)
        else:
            at = at.otherwise(-1)
        tagged = df.withColumn("_branch", at)
        if all(s.op in ("set", "remove", "rename") for body in bodies for s in body):
            for i, body in enumerate(bodies):  # one pass: each change holds for its branch's rows
                for s in body:
                    tagged = getattr(self, f"stage_{s.op}")(tagged, s, F.col("_branch") == i)
            return tagged.drop("_branch")
        parts = [self.stages(tagged.where(F.col("_branch") == i).drop("_branch"), body) for i, body in enumerate(bodies)]
        if stage.parts["else"] is None:
            parts.append(tagged.where(F.col("_branch") == -1).drop("_branch"))
        return _union(parts)

    def stage_apply(self, df: DataFrame, stage: Stage) -> DataFrame:
        target, stages = stage.parts["target"], stage.parts["stages"]
        if target.root == "data_points" and not target.steps:
            return df.withColumn("data_points", self.over_points(F.col("data_points"), df.schema["data_points"].dataType.elementType, stages))
        return self.edit_map(df, target.root, target.steps if target.root != "attributes" else (), lambda m, dtype: self.over_pairs(m, dtype, stages), None)

    def over_pairs(self, m: Column, dtype: T.MapType, stages: list[Stage]) -> Column:
        """where, drop, set value and if over the pairs (key, value) of a map."""
        for stage in stages:
            if stage.op == "drop":
                m = F.map_filter(m, lambda k, v: F.lit(False))
            elif stage.op == "where":
                m = self.kept_pairs(m, dtype, stage)
            elif stage.op in ("set", "if"):
                m = self.changed_pairs(self.kept_pairs(m, dtype, stage), dtype, stage)
            else:
                raise QueryError(f"{stage.op} can't be applied to attributes")
        return m

    def kept_pairs(self, m: Column, dtype: T.MapType, stage: Stage) -> Column:
        return F.map_filter(m, lambda k, v: self.pair(k, v, dtype, [stage])[1])

    def changed_pairs(self, m: Column, dtype: T.MapType, stage: Stage) -> Column:
        return F.transform_values(m, lambda k, v: self.pair(k, v, dtype, [stage])[0])

    def pair_scope(self, k: Column, v: Column, dtype: T.MapType) -> Scope:
        return Scope("opl", None, {"key": Value(k, "string"), "value": V.typed(v, dtype.valueType)}, self.functions, self.signal, closed=True)

    def pair(self, k: Column, v: Column, dtype: T.MapType, stages: list[Stage]) -> tuple[Column, Column]:
        """(value, kept) of one pair after the stages."""
        kept = F.lit(True)
        for stage in stages:
            scope = self.pair_scope(k, v, dtype)
            if stage.op == "where":
                kept = kept & scope.truth(stage.parts["predicate"])
            elif stage.op == "drop":
                kept = F.lit(False)
            elif stage.op == "set":
                for path, tree in stage.parts["items"]:
                    if path.root != "value" or path.steps:
                        raise QueryError("only value can be set here")
                    new = self.pair_scope(k, v, dtype).value(tree)
                    v = V.wrap(new) if V.is_any(dtype.valueType) else new.col.cast(dtype.valueType)
            elif stage.op == "if":
                out, stays = None, None
                for condition, body in stage.parts["branches"]:
                    hit = scope.truth(condition)
                    new, keep = self.pair(k, v, dtype, body)
                    out = F.when(hit, new) if out is None else out.when(hit, new)
                    stays = F.when(hit, keep) if stays is None else stays.when(hit, keep)
                rest, keep = self.pair(k, v, dtype, stage.parts["else"] or [])
                v, kept = out.otherwise(rest), kept & stays.otherwise(keep)
            else:
                raise QueryError(f"{stage.op} can't be applied to attributes")
        return v, kept

    def over_points(self, points: Column, dtype: T.StructType, stages: list[Stage]) -> Column:
        def scope(p: Column) -> Scope:
            return Scope("opl", None, {f.name: V.typed(p[f.name], f.dataType) for f in dtype.fields}, self.functions, self.signal, closed=True)

        for stage in stages:
            if stage.op == "drop":
                points = F.filter(points, lambda p: F.lit(False))
            elif stage.op == "where":
                predicate = stage.parts["predicate"]
                points = F.filter(points, lambda p: scope(p).truth(predicate))  # noqa: B023  built at once
            elif stage.op == "set":
                for path, tree in stage.parts["items"]:
                    if path.root not in dtype.fieldNames():
                        raise QueryError(f"data points have no field {path.root!r}")
                    points = F.transform(points, self.point_change(path, tree, dtype, scope))
            else:
                raise QueryError(f"{stage.op} can't be applied to data points")
        return points

    def point_change(self, path: Path, tree, dtype: T.StructType, scope: Callable[[Column], Scope]) -> Callable[[Column], Column]:
        def change(p: Column) -> Column:
            fields = {f.name: p[f.name] for f in dtype.fields}
            fields[path.root] = _put_at(fields[path.root], dtype[path.root].dataType, path.steps, scope(p).value(tree))
            return F.struct(*(c.alias(n) for n, c in fields.items()))

        return change


def _put_at(column: Column, dtype: T.DataType, steps: tuple, value: Value) -> Column:
    if not steps:
        if V.is_any(dtype):
            return V.wrap(value)
        kind = V.kind_of(dtype)
        known = ("int", "double", "string", "bool", "datetime", "timespan")
        return (scalars.convert(value, kind) if kind in known else value.col).cast(dtype)
    if isinstance(dtype, T.MapType) and len(steps) == 1:
        return _put(column, dtype, str(steps[0]), value)
    if isinstance(dtype, T.StructType) and steps[0] in dtype.fieldNames():
        return column.withField(steps[0], _put_at(column[steps[0]], dtype[steps[0]].dataType, steps[1:], value))
    raise QueryError(f"can't set {steps[0]!r}")


def _edit_at(column: Column, dtype: T.DataType, steps: tuple, edit: Callable[[Column, T.MapType], Column]) -> Column:
    if not steps:
        if not isinstance(dtype, T.MapType):
            raise QueryError("only attributes can be edited")
        return edit(column, dtype)
    if isinstance(dtype, T.StructType) and steps[0] in dtype.fieldNames():
        return column.withField(steps[0], _edit_at(column[steps[0]], dtype[steps[0]].dataType, steps[1:], edit))
    raise QueryError(f"unknown attributes {steps[0]!r}")


def _renamed(m: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Keys renamed at once; an old entry under a new name goes where the renamed key is present."""
    present = F.map_keys(m)

    def stays(e: Column) -> Column:
        out = F.lit(True)
        for old, new in pairs:
            renamed_away = e["key"].isin([o for o, _ in pairs])
            out = out & ~((e["key"] == new) & F.array_contains(present, old) & ~renamed_away)
        return out

    def entry(e: Column) -> Column:
        key = e["key"]
        out = None
        for old, new in pairs:
            out = F.when(key == old, F.lit(new)) if out is None else out.when(key == old, F.lit(new))
        return F.struct(out.otherwise(key).alias("key"), e["value"].alias("value"))

    return F.map_from_entries(F.transform(F.filter(F.map_entries(m), stays), entry))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_opl(query: str, frames: DataFrame | dict[str, DataFrame], functions: dict[str, Callable] | None = None, any_case: bool = False) -> dict[str, DataFrame]:
    """The pipeline's rows by port; what isn't routed away is under "default".

    ``frames`` is the source's frame, or all frames by signal (logs, traces, metrics). Over
    ``signals`` the result has the ports "logs", "traces" and "metrics", and "signal:port" for
    routed rows. Frames the source doesn't name are left alone. With ``any_case`` attribute keys
    are read in any case (writing always names a key exactly).
    """
    return _run(opl.parse_opl(query), frames, functions, any_case)


def run_ottl(statements: str, df: DataFrame) -> DataFrame:
    """OTTL ``set`` statements on logs."""
    return _run(opl.parse_ottl(statements), df, None)[DEFAULT_PORT]


def _run(parsed: opl.Pipeline, frames: DataFrame | dict[str, DataFrame], functions, any_case: bool = False) -> dict[str, DataFrame]:
    if parsed.source == "signals":
        if isinstance(frames, DataFrame):
            raise QueryError("signals needs a frame for each signal")
        out: dict[str, DataFrame] = {}
        for signal, df in frames.items():
            done = _run_signal(parsed.stages, df, signal, functions, any_case)
            out |= {signal if port == DEFAULT_PORT else f"{signal}:{port}": f for port, f in done.items()}
        return out
    metric = opl.METRIC_SOURCES.get(parsed.source)
    signal = "metrics" if metric else parsed.source
    df = frames if isinstance(frames, DataFrame) else frames[signal]
    if metric:
        df = df.where(F.col("metric_type") == opl.METRIC_TYPES[metric])
    return _run_signal(parsed.stages, df, signal, functions, any_case)


def _run_signal(stages: list[Stage], df: DataFrame, signal: str, functions, any_case: bool) -> dict[str, DataFrame]:
    run = OplRun(signal, functions, any_case)
    out = {DEFAULT_PORT: run.stages(df, stages)}
    return out | {port: _union(parts) for port, parts in run.ports.items()}
