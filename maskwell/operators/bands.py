"""Band joins: inner joins whose only tie is that a number lies in a fixed range around another one.

Spark compares every row of one side with every row of the other where no equality ties them. Here such a join gets one
more condition, an equality of ranges of numbers, which follows from its own; that one stays as it is, so the rows are
the same. Each left row is repeated for the two or three ranges that its partners can lie in. Known are bounds on whole
numbers: columns, plus or minus literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

from .gate import class_name, sequence

#: Whole numbers and their widths; sums are followed in the last two only, as narrower ones may wrap.
WHOLE = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}
#: Bounds beyond this are left alone: below it a sum that wraps cannot fulfil both bounds.
FAR = 1 << 29
ORDERED = {"LessThan": 1, "LessThanOrEqual": 0, "GreaterThan": 1, "GreaterThanOrEqual": 0}

Term = tuple[object, int]


def conjuncts(e) -> list:
    if class_name(e) == "And":
        return [c for child in sequence(e.children()) for c in conjuncts(child)]
    return [e]


def term(e) -> Term | None:
    """(attribute or None, constant) if the expression is their sum."""
    name, kind = class_name(e), e.dataType().simpleString()
    if kind not in WHOLE:
        return None
    if name == "AttributeReference":
        return e, 0
    if name == "Literal":
        return None if e.value() is None or abs(int(e.value())) > FAR else (None, int(e.value()))
    if name == "Cast" and WHOLE.get(e.child().dataType().simpleString(), 9) <= WHOLE[kind]:
        return term(e.child())
    if name in ("Add", "Subtract") and WHOLE[kind] >= 4:
        left, right = term(e.left()), term(e.right())
        if left and right and right[0] is None:
            return left[0], left[1] + (right[1] if name == "Add" else -right[1])
        if left and right and left[0] is None and name == "Add":
            return right[0], left[1] + right[1]
    return None


def bounds(e) -> list[tuple[Term, Term]]:
    """Pairs of terms of which the first is at most the second, as the condition says."""
    name = class_name(e)
    if name == "Between":
        low, value, high = term(e.lower()), term(e.input()), term(e.upper())
        return [(a, b) for a, b in ((low, value), (value, high)) if a and b]
    if name not in ORDERED:
        return []
    left, right = term(e.left()), term(e.right())
    if not left or not right:
        return []
    if name.startswith("Greater"):
        left, right = right, left
    return [((left[0], left[1] + ORDERED[name]), right)]


def band_of(conditions: list, left: set[int], right: set[int]) -> tuple[object, object, int, int] | None:
    """(y, x, low, high): y of the left side and x of the right one, with low <= x - y <= high; the narrowest."""
    found: dict[tuple[int, int], list] = {}
    for condition in conditions:
        for (a, c), (b, d) in bounds(condition):
            if a is None or b is None:
                continue
            p, q = a.exprId().id(), b.exprId().id()
            if p in right and q in left:  # x + c <= y + d
                band = found.setdefault((q, p), [b, a, None, None])
                band[3] = d - c if band[3] is None else min(band[3], d - c)
            elif p in left and q in right:  # y + c <= x + d
                band = found.setdefault((p, q), [a, b, None, None])
                band[2] = c - d if band[2] is None else max(band[2], c - d)
    whole = [tuple(b) for b in found.values() if b[2] is not None and b[3] is not None and -FAR < b[2] <= b[3] < FAR]
    return min(whole, key=lambda b: b[3] - b[2], default=None)


def ids(plan) -> set[int]:
    return {a.exprId().id() for a in sequence(plan.output())}


class Rewrite:
    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.jvm = self.spark._jvm.org.apache.spark
        self.seq = self.jvm.api.python.PythonUtils.toSeq

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.jvm.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def column(self, attribute) -> Column:
        return Column(self.jvm.sql.classic.ExpressionUtils.column(attribute))

    def plan(self, plan, above: list):
        """The plan with its band joins rewritten; `above` are the conditions of a filter right over it."""
        below = conjuncts(plan.condition()) if class_name(plan) == "Filter" else []
        children = sequence(plan.children())
        new = [self.plan(c, below) for c in children]
        if any(a is not b for a, b in zip(children, new)):
            plan = plan.withNewChildren(self.seq(new))
        return self.join(plan, above) if class_name(plan) == "Join" else plan

    def join(self, plan, above: list):
        if plan.joinType().toString() not in ("Inner", "Cross"):
            return plan
        own = plan.condition()
        conditions = above + (conjuncts(own.get()) if own.isDefined() else [])
        if any(class_name(c) in ("EqualTo", "EqualNullSafe") and c.left().references().nonEmpty() and c.right().references().nonEmpty() for c in conditions):
            return plan  # is dealt by that
        band = band_of(conditions, ids(plan.left()), ids(plan.right()))
        if not band:
            return plan
        y, x, low, high = band
        shift = max(1, (high - low).bit_length())
        range_ = lambda a: F.shiftright(self.column(a).cast("long"), shift)
        steps = range(low >> shift, -(-high >> shift) + 1)  # up to the ceiling
        left = self.frame(plan.left()).select("*", F.explode(F.array(*(range_(y) + F.lit(s).cast("long") for s in steps))).alias("__band"))
        right = self.frame(plan.right()).select("*", range_(x).alias("__band"))
        left, right = (df._jdf.queryExecution().analyzed() for df in (left, right))
        expressions, logical = self.jvm.sql.catalyst.expressions, self.jvm.sql.catalyst.plans.logical
        tie = expressions.EqualTo(left.output().last(), right.output().last())
        condition = expressions.And(tie, own.get()) if own.isDefined() else tie
        inner = getattr(getattr(self.jvm.sql.catalyst.plans, "Inner$"), "MODULE$")
        joined = logical.Join(left, right, inner, self.spark._jvm.scala.Option.apply(condition), plan.hint())
        return logical.Project(plan.output(), joined)


def banded(df: DataFrame) -> DataFrame:
    """The same rows; band joins outside of subquery expressions are dealt by ranges of numbers."""
    rewrite, plan = Rewrite(df), df._jdf.queryExecution().analyzed()
    new = rewrite.plan(plan, [])
    return df if new is plan else rewrite.frame(new)
