"""Where each output column of a query comes from, on Spark's analysed plan.

Attributes are followed by their expression ids, through aliases, aggregates, windows, set operations, common table
expressions and subqueries. Functions whose result cannot hold an argument's value (counts, ranks, comparisons,
lengths) end a line. What the walk does not know inherits from everything below it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from .gate import Denied, class_name, sequence

Source = tuple[str, str]
Edges = dict[int, frozenset[Source]]

#: Expressions that cannot hold a value of their arguments.
CLEAN = {
    "Count", "CountIf", "CountMinSketchAgg", "HyperLogLogPlusPlus", "ApproxCountDistinct", "RegrCount", "BoolAnd", "BoolOr",
    "RowNumber", "Rank", "DenseRank", "NTile", "CumeDist", "PercentRank", "Grouping", "GroupingID",
    "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "InSet", "InSubquery", "Exists",
    "IsNull", "IsNotNull", "IsNaN", "Like", "ILike", "RLike", "LikeAll", "LikeAny", "NotLikeAll", "NotLikeAny", "StartsWith", "EndsWith", "Contains", "And", "Or", "Not", "Between", "ArrayContains",
}
#: Lengths, clean if what they measure is as long as a stored value; of anything made by a value (space(n), repeat(s, n),
#: substr(s, 1, n), sequence(1, n)) a length would tell that value.
LENGTHS = {"Length", "CharLength", "OctetLength", "BitLength", "Size", "ArraySize"}
AS_LONG = {"AttributeReference", "OuterReference", "Alias", "GetStructField", "Upper", "Lower", "InitCap", "StringTrim", "StringTrimLeft", "StringTrimRight", "StringReverse", "Reverse", "Cast", "Collate"}
#: Sums of these depend on the order of rows if they are floating point.
SUMS = {"Sum", "Average", "TrySum", "TryAverage"}
#: Reversible encodings, which would carry a value past the mask: denied on sensitive arguments.
DENIED_ENCODERS = {"Base64", "Hex", "Encode", "ToBinary", "AesEncrypt", "TryAesEncrypt", "UrlEncode"}
PASSING = {"Filter", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Limit", "Distinct", "Deduplicate", "SubqueryAlias", "Repartition", "RepartitionByExpression", "Join", "AsOfJoin", "WithCTE", "UnresolvedHint", "ResolvedHint", "Sample", "LateralJoin", "WithWindowDefinition", "Tail"}
#: Rows that stand in the query itself.
INLINE = "?inline"
LEAVES = {"LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "OneRowRelation", "View", "DataSourceV2Relation", "HiveTableRelation", "EmptyRelation"}


def as_long(e) -> bool:
    """Whether an expression is a stored value, or one of the same length."""
    name, children = class_name(e), sequence(e.children())
    if name not in AS_LONG or (name == "Cast" and e.child().dataType().simpleString() not in ("string", "binary")):
        return False
    return len(children) < 2 and all(as_long(c) for c in children)


class Walk:
    def __init__(self, sensitive: Callable[[Iterable[Source]], bool]):
        self.edges: Edges = {}
        self.ctes: dict[int, list[frozenset[Source]]] = {}
        self.loops: dict[int, list[frozenset[Source]]] = {}
        #: Fields of attributes that are made as structs.
        self.fields: dict[int, dict[str, frozenset[Source]]] = {}
        self.sensitive = sensitive
        self.tables: set[str] = set()
        #: Where in which text sums and averages of sensitive floating-point numbers stand.
        self.float_sums: set[tuple[str, int, int]] = set()

    # Expressions

    def sources(self, e) -> frozenset[Source]:
        name = class_name(e)
        if name in ("AttributeReference", "Alias", "OuterReference") or name == "LateralColumnAliasReference":
            if name == "AttributeReference":
                return self.edges.get(e.exprId().id(), frozenset())
            return self.sources(e.child() if name == "Alias" else sequence(e.children())[0] if e.children().size() else e.e())
        if name == "GetStructField":
            field = e.childSchema().apply(e.ordinal()).name().lower()
            made = self.fields.get(e.child().exprId().id(), {}) if class_name(e.child()) == "AttributeReference" else {}
            if field in made:
                return made[field]
            return frozenset((t, f"{c}.{field}") for t, c in self.sources(e.child()))
        if name == "GetArrayStructFields":
            return frozenset((t, f"{c}.{e.field().name().lower()}") for t, c in self.sources(e.child()))
        if name == "WindowExpression":
            return self.sources(e.windowFunction())
        if name == "AggregateExpression":
            function = e.aggregateFunction()
            found = self.sources(function)
            if class_name(function) in SUMS and function.children().apply(0).dataType().simpleString() in ("double", "float") and self.sensitive(found):
                origin = e.origin()
                if origin.startIndex().isDefined() and origin.stopIndex().isDefined() and origin.sqlText().isDefined():
                    self.float_sums.add((origin.sqlText().get(), origin.startIndex().get(), origin.stopIndex().get()))
            return found
        if name in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
            out = self.outputs(e.plan())
            return frozenset().union(*out) if name == "ScalarSubquery" else frozenset()
        if name in CLEAN or (name in LENGTHS and as_long(sequence(e.children())[0])):
            for child in sequence(e.children()):
                self.sources(child)  # for denied encoders inside
            return frozenset()
        children = sequence(e.children())
        if name == "CaseWhen":
            branches = sequence(e.branches())
            for b in branches:
                self.sources(b._1())
            values = [b._2() for b in branches]
            found = [self.sources(v) for v in values]
            if e.elseValue().isDefined():
                found.append(self.sources(e.elseValue().get()))
            return frozenset().union(*found)
        if name == "If":
            self.sources(children[0])
            children = children[1:]
        found = frozenset().union(*(self.sources(c) for c in children))
        if name in DENIED_ENCODERS and self.sensitive(found):
            raise Denied("ENCODED", name)
        return found

    # Plans

    def outputs(self, plan) -> list[frozenset[Source]]:
        """The sources of each output of a plan."""
        self.visit(plan)
        return [self.edges.get(a.exprId().id(), frozenset()) for a in sequence(plan.output())]

    def name_leaf(self, plan, table: str) -> None:
        self.tables.add(table)
        for a in sequence(plan.output()):
            self.edges[a.exprId().id()] = frozenset([(table, a.name().lower())])

    def visit(self, plan) -> None:
        name = class_name(plan)
        if name == "View":
            self.name_leaf(plan, plan.desc().identifier().table().lower())
            return
        if name in LEAVES:
            if name not in ("OneRowRelation", "Range"):
                self.name_leaf(plan, INLINE if name in ("LocalRelation", "EmptyRelation") else "?")
            else:
                for a in sequence(plan.output()):
                    self.edges[a.exprId().id()] = frozenset()
            return
        if name == "SubqueryAlias" and class_name(plan.child()) in LEAVES and class_name(plan.child()) != "View":
            self.name_leaf(plan.child(), plan.identifier().name().lower())
            return
        if name == "CTERelationRef":
            for a, found in zip(sequence(plan.output()), self.ctes.get(plan.cteId(), [])):
                self.edges[a.exprId().id()] = found
            return
        if name == "UnionLoopRef":
            found = self.loops.get(plan.loopId(), [])
            for i, a in enumerate(sequence(plan.output())):
                self.edges[a.exprId().id()] = found[i] if i < len(found) else frozenset()
            return
        if name == "WithCTE":
            for d in sequence(plan.cteDefs()):
                self.visit(d)
            self.visit(plan.plan())
            return
        if name == "UnionLoop":
            found = self.outputs(plan.anchor())
            while True:
                self.loops[plan.id()] = found
                merged = [a | b for a, b in zip(found, self.outputs(plan.recursion()))]
                if merged == found:
                    break
                found = merged
            self.set(plan, found)
            return
        children = sequence(plan.children())
        for child in children:
            self.visit(child)
        if name == "CTERelationDef":
            self.ctes[plan.id()] = [self.edges.get(a.exprId().id(), frozenset()) for a in sequence(children[0].output())]
        elif name == "Project":
            self.aliases(sequence(plan.projectList()))
        elif name == "Aggregate":
            self.aliases(sequence(plan.aggregateExpressions()))
        elif name == "Window":
            self.aliases(sequence(plan.windowExpressions()))
        elif name == "Generate":
            found = self.sources(plan.generator())
            for a in sequence(plan.generatorOutput()):
                self.edges[a.exprId().id()] = found
        elif name == "Expand":
            rows = [[self.sources(e) for e in sequence(p)] for p in sequence(plan.projections())]
            self.set(plan, [frozenset().union(*column) for column in zip(*rows)])
        elif name in ("Union", "Intersect", "Except"):
            outs = [[self.edges.get(a.exprId().id(), frozenset()) for a in sequence(c.output())] for c in children]
            self.set(plan, [frozenset().union(*column) for column in zip(*outs)])
        elif name not in PASSING:
            below = frozenset().union(*(self.edges.get(a.exprId().id(), frozenset()) for c in children for a in sequence(c.output())), *(self.sources(e) for e in sequence(plan.expressions())))
            for a in sequence(plan.output()):
                self.edges.setdefault(a.exprId().id(), below)
        if name in ("Filter", "Join"):
            for e in sequence(plan.expressions()):
                self.sources(e)  # subqueries and denied encoders inside
        if name == "LateralJoin":
            sub = plan.right().plan()
            self.visit(sub)
        # Whatever has no edge by now inherits from everything below.
        missing = [a for a in sequence(plan.output()) if a.exprId().id() not in self.edges]
        if missing:
            below = frozenset().union(*(self.edges.get(a.exprId().id(), frozenset()) for c in children for a in sequence(c.output())))
            for a in missing:
                self.edges[a.exprId().id()] = below

    def aliases(self, expressions: list) -> None:
        for e in expressions:
            if class_name(e) != "AttributeReference":
                self.edges[e.exprId().id()] = self.sources(e)
                if class_name(e) == "Alias" and class_name(e.child()) == "CreateNamedStruct":
                    parts, kind = sequence(e.child().children()), e.child().dataType()
                    self.fields[e.exprId().id()] = {kind.apply(i).name().lower(): self.sources(value) for i, value in enumerate(parts[1::2])}

    def set(self, plan, found: list[frozenset[Source]]) -> None:
        for a, own in zip(sequence(plan.output()), found):
            self.edges[a.exprId().id()] = own


def trace(df: DataFrame, sensitive: Callable[[Iterable[Source]], bool] = lambda found: False) -> list[tuple[str, frozenset[Source]]]:
    """(output name, source columns) in order. Encoders of sensitive sources are Denied."""
    return walked(df, sensitive)[0]


def walked(df: DataFrame, sensitive: Callable[[Iterable[Source]], bool]) -> tuple[list[tuple[str, frozenset[Source]]], set[tuple[str, int, int]]]:
    """trace(), and where sums of sensitive floating-point numbers stand: (text, first, last character)."""
    plan = df._jdf.queryExecution().analyzed()
    walk = Walk(sensitive)
    found = walk.outputs(plan)
    return list(zip([a.name() for a in sequence(plan.output())], found)), walk.float_sums


#: A string, a quoted name or a comment, in which parentheses do not count.
QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)


def exact_sums(query: str, spans: Iterable[tuple[int, int]]) -> str:
    """The query with the arguments of these sums and averages as decimals of six places, whose sums are exact.

    What is no decimal (NaN, infinities) is left out of them."""
    inserts: list[tuple[int, str]] = []
    bare = QUOTED.sub(lambda m: " " * len(m[0]), query)
    for start, stop in spans:
        opened = bare.find("(", start)
        depth, at = 0, opened
        while 0 <= at <= stop:
            depth += (bare[at] == "(") - (bare[at] == ")")
            if not depth:
                break
            at += 1
        if opened < 0 or at > stop:
            continue
        first = opened + 1 + len(re.match(r"\s*(?:(?:DISTINCT|ALL)\b)?", bare[opened + 1 :], re.IGNORECASE)[0])
        inserts += [(first, " TRY_CAST(("), (at, ") AS DECIMAL(38, 6))")]
    for at, text in sorted(inserts, reverse=True):
        query = query[:at] + text + query[at:]
    return query


def tables(df: DataFrame) -> set[str]:
    """Names of all views that a query reads; `?` stands for any other relation but rows in the query itself."""
    walk = Walk(lambda found: False)
    walk.outputs(df._jdf.queryExecution().analyzed())
    return walk.tables - {INLINE}


def kind_of(source: Source, types: dict[Source, str], below: bool) -> list[str | None]:
    """Types of a source path: its own, else that of the nearest field around it, else (with `below`) those inside it."""
    table, path = source
    parts = path.split(".")
    for n in range(len(parts), 0, -1):
        kind = types.get((table, ".".join(parts[:n])))
        if kind:
            return [kind]
    inside = [k for (t, p), k in types.items() if below and t == table and p.startswith(path + ".")]
    return inside or [None]


def resolve(found: Iterable[Source], types: dict[Source, str], precedence: list[str], below: bool = True) -> str | None:
    """The type of a column with these sources: the strongest that is not SAFE; SAFE if all sources are. `below`:
    the column may hold any field inside its sources."""
    kinds = {k for s in found for k in kind_of(s, types, below)}
    order = {k: i for i, k in enumerate(precedence)}
    strong = sorted(kinds - {None, "SAFE"}, key=lambda k: (order.get(k, len(order)), k))
    if strong:
        return strong[0]
    return "SAFE" if kinds == {"SAFE"} else None
