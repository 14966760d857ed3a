"""Document requests (find and aggregation pipelines) compiled to DataFrames, schema inference and nested masking.

A collection is a DataFrame whose nested fields are structs, arrays and maps; JSON text becomes one by
documents_of_json(). Only stages and operators listed here compile; all else is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.mask import masked
from ..functions.names import name_type
from .gate import Denied, check_document

# Fields


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of a dotted path; through arrays, that of their elements. None if it does not exist."""
    kind: T.DataType = schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.MapType):
            kind = kind.valueType
        elif isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
        else:
            return None
    return kind


def field(df: DataFrame, path: str) -> Column:
    """A field, null where it is missing."""
    if field_type(df.schema, path) is None:
        return F.lit(None)
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def is_array(df: DataFrame, path: str) -> bool:
    kind: T.DataType = df.schema
    for part in path.split("."):
        if isinstance(kind, T.ArrayType):
            return True
        kind = field_type(T.StructType([T.StructField("x", kind)]), "x." + part) if not isinstance(kind, T.StructType) else (kind[part].dataType if part in kind.names else T.NullType())
    return isinstance(kind, T.ArrayType)


# Filters

COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)),
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: F.coalesce(c.isin([x for x in v if x is not None]), F.lit(False)) | (c.isNull() if None in v else F.lit(False)),
    "$nin": lambda c, v: ~(F.coalesce(c.isin([x for x in v if x is not None]), F.lit(False)) | (c.isNull() if None in v else F.lit(False))),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$mod": lambda c, v: c % v[0] == v[1],
}
TYPE_NAMES = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "bool": T.BooleanType, "array": T.ArrayType, "object": T.StructType, "date": T.TimestampType}


def _some(column: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(column, lambda x: test(x))


def _compare(op: str, value: Any) -> Callable[[Column], Column]:
    return lambda x: COMPARE[op](x, value)


def _regex(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def _element_test(test: dict[str, Any]) -> Callable[[Column], Column]:
    return lambda x: _element(x, test)


def condition(df: DataFrame, path: str, test: Any) -> Column:
    """The test of one field; of an array, plain tests ask whether some element passes."""
    if not isinstance(test, dict) or not any(str(k).startswith("$") for k in test):
        test = {"$eq": test}
    column, many = field(df, path), is_array(df, path)
    parts = []
    for op, value in test.items():
        if op == "$options":
            continue
        if op == "$not":
            parts.append(~F.coalesce(condition(df, path, value), F.lit(False)))
        elif op == "$regex":
            flags = "".join(f for f in test.get("$options", "") if f in "imsx")
            parts.append(_some(column, _regex((f"(?{flags})" if flags else "") + value)) if many else column.rlike((f"(?{flags})" if flags else "") + value))
        elif op == "$size":
            parts.append(F.size(column) == value)
        elif op == "$all":
            parts.append(reduce(lambda a, b: a & b, (F.array_contains(column, v) for v in value), F.lit(True)))
        elif op == "$elemMatch":
            parts.append(_some(column, _element_test(value)))
        elif op == "$type":
            kind = field_type(df.schema, path)
            parts.append(column.isNotNull() & F.lit(isinstance(kind, TYPE_NAMES.get(value, ())) or (value == "array" and many)))
        elif op in COMPARE:
            if many and op not in ("$exists", "$ne", "$nin"):
                parts.append(_some(column, _compare(op, value)))
            elif many and op in ("$ne", "$nin"):
                inverse = {"$ne": "$eq", "$nin": "$in"}[op]
                parts.append(~F.coalesce(_some(column, _compare(inverse, value)), F.lit(False)))
            else:
                parts.append(COMPARE[op](column, value))
        else:
            raise Denied("OPERATOR", op)
    return reduce(lambda a, b: a & b, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(True))


def _element(x: Column, test: dict[str, Any]) -> Column:
    parts = []
    for key, value in test.items():
        if key.startswith("$"):
            parts.append(COMPARE[key](x, value))
        else:
            own = value if isinstance(value, dict) and any(k.startswith("$") for k in value) else {"$eq": value}
            parts += [COMPARE[op](x[key], v) for op, v in own.items()]
    return reduce(lambda a, b: a & b, (F.coalesce(p, F.lit(False)) for p in parts), F.lit(True))


def matching(df: DataFrame, test: dict[str, Any]) -> Column:
    parts = []
    for key, value in test.items():
        if key in ("$and", "$or", "$nor"):
            each = [matching(df, v) for v in value]
            both = reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), each)
            parts.append(~both if key == "$nor" else both)
        elif key.startswith("$"):
            raise Denied("OPERATOR", key)
        else:
            parts.append(condition(df, key, value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


# Expressions


def _fold(op: Callable[[Column, Column], Column]):
    return lambda args: reduce(op, args)


EXPRESSIONS: dict[str, Callable[[list[Column]], Column]] = {
    "$concat": lambda a: F.concat(*(x.cast("string") for x in a)),
    "$toUpper": lambda a: F.upper(a[0].cast("string")),
    "$toLower": lambda a: F.lower(a[0].cast("string")),
    "$substr": lambda a: F.substring(a[0].cast("string"), a[1] + 1, a[2]),
    "$substrCP": lambda a: F.substring(a[0].cast("string"), a[1] + 1, a[2]),
    "$strLenCP": lambda a: F.char_length(a[0]),
    "$trim": lambda a: F.trim(a[0]),
    "$add": _fold(lambda x, y: x + y),
    "$subtract": _fold(lambda x, y: x - y),
    "$multiply": _fold(lambda x, y: x * y),
    "$divide": lambda a: F.try_divide(a[0].cast("double"), a[1].cast("double")),
    "$mod": lambda a: a[0] % a[1],
    "$abs": lambda a: F.abs(a[0]),
    "$round": lambda a: F.bround(a[0], 0),
    "$ifNull": lambda a: F.coalesce(*a),
    "$year": lambda a: F.year(a[0]),
    "$month": lambda a: F.month(a[0]),
    "$dayOfMonth": lambda a: F.dayofmonth(a[0]),
    "$size": lambda a: F.size(a[0]),
    "$arrayElemAt": lambda a: F.get(a[0], a[1]),
    "$eq": lambda a: a[0].eqNullSafe(a[1]),
    "$ne": lambda a: ~a[0].eqNullSafe(a[1]),
    "$gt": lambda a: a[0] > a[1],
    "$gte": lambda a: a[0] >= a[1],
    "$lt": lambda a: a[0] < a[1],
    "$lte": lambda a: a[0] <= a[1],
    "$and": _fold(lambda x, y: x & y),
    "$or": _fold(lambda x, y: x | y),
    "$not": lambda a: ~a[0],
}
DATE_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def expression(df: DataFrame, e: Any) -> Column:
    if isinstance(e, str) and e.startswith("$"):
        return field(df, e[1:])
    if not isinstance(e, dict):
        return F.lit(e)
    if len(e) != 1 or not next(iter(e)).startswith("$"):
        return F.struct(*(expression(df, v).alias(k) for k, v in e.items()))
    op, args = next(iter(e.items()))
    if op == "$literal":
        return F.lit(args)
    if op == "$cond":
        test, yes, no = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else args
        return F.when(expression(df, test), expression(df, yes)).otherwise(expression(df, no))
    if op == "$dateToString":
        pattern = reduce(lambda p, f: p.replace(*f), DATE_FORMATS.items(), args.get("format", "%Y-%m-%d"))
        return F.date_format(expression(df, args["date"]), pattern)
    if op not in EXPRESSIONS:
        raise Denied("OPERATOR", op)
    if op == "$trim" and isinstance(args, dict):
        args = args["input"]
    return EXPRESSIONS[op]([expression(df, a) for a in (args if isinstance(args, list) else [args])])


# Stages


def project(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Fields kept, left out or computed. _id stays unless it is set to 0."""
    out = {k: v for k, v in spec.items() if v in (0, False) and not isinstance(v, (dict, str))}
    if len(out) == len(spec) or (set(out) == {"_id"} and len(spec) == 1):
        return drop(df, list(out))
    columns = []
    if "_id" in df.columns and "_id" not in spec:
        columns.append(F.col("_id"))
    for key, value in spec.items():
        if key in out:
            continue
        plain = value in (1, True) and not isinstance(value, (dict, str))
        columns.append((field(df, key) if plain else expression(df, value)).alias(key.split(".")[-1] if plain else key))
    return df.select(*columns)


def drop(df: DataFrame, paths: list[str]) -> DataFrame:
    for path in paths:
        top, _, rest = path.partition(".")
        df = df.withColumn(top, F.col(f"`{top}`").dropFields(rest)) if rest and top in df.columns else df.drop(top)
    return df


def add_fields(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    for key, value in spec.items():
        top, _, rest = key.partition(".")
        column = expression(df, value)
        df = df.withColumn(top, F.col(top).withField(rest, column) if rest else column)
    return df


ACCUMULATORS: dict[str, Callable[[Column], Column]] = {
    "$sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "$avg": F.avg,
    "$min": F.min,
    "$max": F.max,
    "$first": lambda c: F.first(c),
    "$last": lambda c: F.last(c),
    "$push": F.collect_list,
    "$addToSet": lambda c: F.sort_array(F.collect_set(c)),
    "$stdDevPop": F.stddev_pop,
    "$stdDevSamp": F.stddev_samp,
}


def group(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    spec = dict(spec)
    key, sums = spec.pop("_id"), []
    for name, accumulator in spec.items():
        op, arg = next(iter(accumulator.items()))
        if op == "$count" or (op == "$sum" and arg == 1):
            sums.append(F.count(F.lit(1)).alias(name))
        elif op in ACCUMULATORS:
            sums.append(ACCUMULATORS[op](expression(df, arg)).alias(name))
        else:
            raise Denied("OPERATOR", op)
    if key is None:
        return df.agg(*(sums or [F.count(F.lit(1)).alias("__n")])).select(F.lit(None).cast("string").alias("_id"), *(s for s in spec))
    grouped = df.groupBy(expression(df, key).alias("_id"))
    return grouped.agg(*sums) if sums else grouped.agg(F.count(F.lit(1)).alias("__n")).drop("__n")


def sort(df: DataFrame, spec: dict[str, int]) -> DataFrame:
    return df.orderBy(*(field(df, k).asc_nulls_first() if v > 0 else field(df, k).desc_nulls_last() for k, v in spec.items()))


def unwind(df: DataFrame, spec: str | dict[str, Any]) -> DataFrame:
    spec = {"path": spec} if isinstance(spec, str) else spec
    path = spec["path"].lstrip("$")
    top, _, rest = path.partition(".")
    keep, index = spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    others = [F.col(f"`{c}`") for c in df.columns]
    explode = F.posexplode_outer if keep else F.posexplode
    out = df.select(*others, explode(field(df, path)).alias("__at", "__item"))
    out = out.withColumn(top, F.col(top).withField(rest, F.col("__item")) if rest else F.col("__item"))
    if index:
        out = out.withColumn(index, F.col("__at").cast("long"))
    return out.drop("__at", "__item")


def bucket(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    by, edges = expression(df, spec["groupBy"]), spec["boundaries"]
    label = reduce(lambda c, e: c.when((by >= e[0]) & (by < e[1]), F.lit(e[0])), zip(edges, edges[1:]), F.when(F.lit(False), F.lit(edges[0])))
    if "default" in spec:
        label = F.coalesce(label.cast("string"), F.lit(str(spec["default"])))
    out = df.withColumn("__bucket", label)
    return group(out, {"_id": "$__bucket", **(spec.get("output") or {"count": {"$sum": 1}})})


def run_stage(df: DataFrame, stage: dict[str, Any], most: int) -> DataFrame:
    (name, spec), = stage.items()
    if name == "$match":
        return df.where(matching(df, spec))
    if name == "$project":
        return project(df, spec)
    if name in ("$addFields", "$set"):
        return add_fields(df, spec)
    if name == "$unset":
        return drop(df, [spec] if isinstance(spec, str) else spec)
    if name == "$group":
        return group(df, spec)
    if name == "$sort":
        return sort(df, spec)
    if name == "$limit":
        return df.limit(min(int(spec), most))
    if name == "$skip":
        return df.offset(int(spec))
    if name == "$unwind":
        return unwind(df, spec)
    if name == "$count":
        return df.agg(F.count(F.lit(1)).alias(spec))
    if name == "$sortByCount":
        return df.groupBy(expression(df, spec).alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_first("_id"))
    if name == "$sample":
        return df.orderBy(F.rand(17)).limit(min(int(spec["size"]), most))
    if name == "$bucket":
        return bucket(df, spec)
    if name == "$replaceRoot":
        root = expression(df, spec["newRoot"]).alias("__root")
        return df.select(root).select("__root.*")
    if name == "$facet":
        parts = [pipeline(df, stages, most).agg(F.collect_list(F.struct("*")).alias(key)) for key, stages in spec.items()]
        return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    raise Denied("STAGE", name)


def pipeline(df: DataFrame, stages: list[dict[str, Any]], most: int, limited: bool = True) -> DataFrame:
    for stage in stages:
        df = run_stage(df, stage, most)
    return df if not limited or any("$limit" in s for s in stages) else df.limit(most)


def parse(text: Any, kind: type) -> Any:
    """A JSON argument of a request, checked against the deny lists."""
    try:
        value = json.loads(text) if isinstance(text, str) else text
    except ValueError as error:
        raise Denied("JSON", str(error)) from None
    if value is not None and not isinstance(value, kind):
        raise Denied("JSON", f"a {kind.__name__} is needed")
    check_document(value)
    return value


def find(df: DataFrame, test: Any = None, projection: Any = None, limit: int | None = 100) -> DataFrame:
    test, projection = parse(test, dict), parse(projection, dict)
    out = df.where(matching(df, test)) if test else df
    out = project(out, projection) if projection else out
    return out if limit is None else out.limit(limit)


def aggregate(df: DataFrame, stages: Any, limit: int | None = 100) -> DataFrame:
    stages = parse(stages, list)
    if any(not isinstance(s, dict) or len(s) != 1 for s in stages):
        raise Denied("JSON", "a stage is an object with one key")
    return pipeline(df, stages, 2**31 - 1 if limit is None else limit, limit is not None)


# Schema


def documents_of_json(df: DataFrame, column: str) -> DataFrame:
    """JSON text in a column as a collection: the schema is inferred from all rows in one aggregation."""
    text = F.try_parse_json(F.col(column))
    ddl = df.agg(F.call_function("schema_of_variant_agg", text)).first()[0] or "OBJECT<>"
    parsed = F.from_json(F.col(column), ddl.replace("OBJECT<", "STRUCT<")).alias("__doc")
    return df.select(parsed).select("__doc.*")


# Names of the kinds of values.
KINDS = [("OBJECT", "dict"), ("ARRAY", "list"), ("STRING", "str"), ("BIGINT", "int"), ("DECIMAL", "float"), ("DOUBLE", "float"), ("FLOAT", "float"), ("BOOLEAN", "bool"), ("VOID", "NoneType"), ("TIMESTAMP", "datetime"), ("DATE", "datetime"), ("BINARY", "bytes")]


def infer_schema(df: DataFrame, column: str) -> DataFrame:
    """(name, types, frequency) of every dotted path in JSON documents; arrays are not entered. One level of nesting is
    taken apart at a time, by variant_explode; a document counts once for each path it has."""
    spark = df.sparkSession
    rows = df.select(F.try_parse_json(F.col(column)).alias("value")).where(F.col("value").isNotNull())
    total = rows.agg(F.count("*").alias("__total"))
    level = rows.select(F.lit("").alias("path"), "value")
    kind = F.schema_of_variant("value")
    named = reduce(lambda c, k: c.when(kind.startswith(k[0]), F.lit(k[1])), KINDS, F.when(F.lit(False), F.lit("")))
    levels = []
    while True:
        level.createOrReplaceTempView("__documents_level")
        opened = spark.sql("SELECT d.path, e.key, e.value FROM __documents_level d, LATERAL variant_explode(d.value) e WHERE e.key IS NOT NULL")
        level = opened.select(F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key")).alias("path"), "value")
        levels.append(level.select("path", named.alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("n")))
        level = level.where(F.schema_of_variant("value").startswith("OBJECT"))
        if level.isEmpty():
            break
    spark.catalog.dropTempView("__documents_level")
    found = reduce(lambda a, b: a.unionByName(b), levels)
    out = found.groupBy(F.col("path").alias("name")).agg(F.sort_array(F.collect_set("kind")).alias("types"), F.sum("n").alias("n"))
    return out.crossJoin(F.broadcast(total)).select("name", "types", F.round(F.col("n") / F.col("__total"), 2).alias("frequency"))  # the total is one row


def field_types(schema: T.StructType, settings: Settings) -> dict[str, str]:
    """Types of all dotted paths, arrays' elements included."""
    out: dict[str, str] = {}

    def visit(kind: T.DataType, path: str) -> None:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                own = f"{path}.{f.name}" if path else f.name
                found = name_type(f.name, settings, path=own)
                if found:
                    out[own] = found
                visit(f.dataType, own)

    visit(schema, "")
    return out


# Masking


def masked_nested(value: Column, kind: T.DataType, types: dict[str, str], salt: str, path: str, inherited: str | None = None) -> Column:
    """A value of any type with its fields masked. A field has its path's type, its name's, or its parent's."""
    name = path.rsplit(".", 1)[-1]
    own = types.get(path) or types.get(name) or inherited
    if isinstance(kind, T.StructType):
        fields = [masked_nested(value.getField(f.name), f.dataType, types, salt, f"{path}.{f.name}" if path else f.name, own).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: masked_nested(x, kind.elementType, types, salt, path, inherited))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: masked_nested(v, kind.valueType, types, salt, path, inherited))
    if isinstance(kind, T.VariantType):
        return F.when(value.isNotNull(), F.lit("[REDACTED]")) if own not in (None, "SAFE") else value
    return masked(value, kind, own, salt, name)


def masked_documents(df: DataFrame, types: dict[str, str], salt: str, sources: dict[str, str] | None = None) -> DataFrame:
    """All columns masked. `sources` has types of columns found otherwise (by lineage)."""
    sources = sources or {}
    return df.select(*(masked_nested(F.col(f"`{f.name}`"), f.dataType, types, salt, f.name, sources.get(f.name)).alias(f.name) for f in df.schema.fields))


def masked_json(df: DataFrame, column: str, settings: Settings, salt: str) -> Column:
    """JSON text with its fields masked; the schema is inferred from all rows. Text that is no JSON object is redacted."""
    ddl = df.agg(F.call_function("schema_of_variant_agg", F.try_parse_json(F.col(column)))).first()[0] or "OBJECT<>"
    if not ddl.startswith("OBJECT<") or ddl == "OBJECT<>":
        return F.when(F.col(column).isNotNull(), F.lit("[REDACTED]"))
    parsed = F.from_json(F.col(column), ddl.replace("OBJECT<", "STRUCT<"))
    kind = df.select(parsed.alias("x")).schema["x"].dataType
    return F.to_json(masked_nested(parsed, kind, field_types(kind, settings), salt, ""))
