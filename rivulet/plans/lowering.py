"""SQL views as trees of change-maintaining operators, from the plans that Catalyst makes of them.

A view's query is planned over leaves whose contents Catalyst can't see. Its optimised plan
has subqueries as joins, DISTINCT and set operations as aggregates and joins. Each of its
operators becomes a node here: the operator itself is kept, and its children are replaced
by the frames that a step has at hand, under the attributes that the operator asks for.

A frame's columns are c0, c1, ... in the order of the operator's output, and the weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.operators import zset
from rivulet.operators.incremental import Node, Recomputed, Step, Sum, accumulated, bilinear, hashed
from rivulet.operators.zset import W

#: Operators that a change goes through row by row.
ROW_BY_ROW = {"Filter", "Generate"}
#: Joins that are computed again for the keys that a change touches.
KEYED_JOINS = {"LeftOuter", "RightOuter", "FullOuter", "LeftSemi", "LeftAnti", "ExistenceJoin"}


class NotIncremental(ValueError):
    """A plan that can't be maintained from changes."""


def kind(x) -> str:
    """A JVM object's class, without its package; Scala's objects end in a dollar sign there."""
    return x.getClass().getSimpleName().rstrip("$")


def items(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


class Catalyst:
    """What is needed of Catalyst's classes, for one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.base = self.jvm.org.apache.spark.sql.catalyst

    def seq(self, values: Iterable):
        out = self.jvm.java.util.ArrayList()
        for v in values:
            out.add(v)
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(out)

    def map(self, pairs: Iterable[tuple]):
        out = self.jvm.java.util.HashMap()
        for k, v in pairs:
            out.put(k, v)
        return self.jvm.org.apache.spark.api.python.PythonUtils.toScalaMap(out)

    def alias(self, expression, name: str, expr_id=None):
        new = expr_id or getattr(self.base.expressions, "NamedExpression$").__getattr__("MODULE$").newExprId()
        return self.base.expressions.Alias(expression, name, new, self.seq(()), self.jvm.scala.Option.apply(None), self.seq(()))

    def project(self, expressions: Iterable, plan):
        return self.base.plans.logical.Project(self.seq(expressions), plan)

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def bound(self, df: DataFrame, attributes: list, extra: tuple[str, ...] = ()):
        """df's plan with its first columns as the attributes given, and extra columns as new attributes, which are returned too."""
        plan = df._jdf.queryExecution().analyzed()
        own = dict(zip(df.columns, items(plan.output()), strict=True))
        made = [self.alias(own[f"c{i}"], a.name(), a.exprId()) for i, a in enumerate(attributes)]
        more = [self.alias(own[name], name) for name in extra]
        return self.project([*made, *more], plan), [m.toAttribute() for m in more]

    def numbered(self, plan, attributes: list, extra: dict | None = None) -> DataFrame:
        """The frame of a plan: attributes as c0, c1, ..., and extra expressions by name."""
        made = [self.alias(a, f"c{i}") for i, a in enumerate(attributes)]
        return self.frame(self.project([*made, *(self.alias(e, n) for n, e in (extra or {}).items())], plan))

    def over(self, op, children: list):
        return op.withNewChildren(self.seq(children))


def _found(expression, name: str) -> list:
    """Parts of an expression of a class, the expression itself included."""
    out = [expression] if kind(expression) == name else []
    for child in items(expression.children()):
        out += _found(child, name)
    return out


class RowByRow(Node):
    """Filter, projection, unnesting, grouping sets' copies: the operator over the change."""

    def __init__(self, catalyst: Catalyst, op, child: Node):
        self.catalyst, self.op, self.children = catalyst, op, (child,)

    def delta(self, step: Step) -> DataFrame:
        c, op = self.catalyst, self.op
        below = items(op.child().output())
        plan, (weight,) = c.bound(step.delta(self.children[0]), below, (W,))
        if kind(op) == "Project":
            made = [x if kind(x) == "Alias" else c.alias(x, x.name(), x.exprId()) for x in items(op.projectList())]
            plan = c.project([*made, weight], plan)
        elif kind(op) == "Expand":
            out = c.alias(weight, W).toAttribute()
            rows = [c.seq([*items(r), weight]) for r in items(op.projections())]
            plan, weight = c.base.plans.logical.Expand(c.seq(rows), c.seq([*items(op.output()), out]), plan), out
        else:
            plan = c.over(op, [plan])
        return c.numbered(plan, items(op.output()), {W: weight})


class Renamed(Node):
    """A table's or view's rows under the names of frames."""

    def __init__(self, child: Node):
        self.children = (child,)

    def delta(self, step: Step) -> DataFrame:
        z = step.delta(self.children[0])
        return z.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(zset.columns(z))), W)


class Named(Node):
    """A frame under the names of a view's columns."""

    def __init__(self, child: Node, names: tuple[str, ...]):
        self.children, self.names = (child,), names

    def delta(self, step: Step) -> DataFrame:
        return step.delta(self.children[0]).toDF(*self.names, W)


class Rows(Node):
    """Rows that the query itself holds: there from the first step on."""

    def __init__(self, catalyst: Catalyst, op):
        self.catalyst, self.op = catalyst, op

    def delta(self, step: Step) -> DataFrame:
        z = zset.weighted(self.catalyst.numbered(self.op, items(self.op.output())))
        return z if step.first else z.where(F.lit(False))


class InnerJoin(Node):
    """Bilinear, whatever the condition: dA * B + A * dB + dA * dB, without the parts in which nothing changes.

    keys: for each side the expressions that an equality of the condition compares.
    """

    def __init__(self, catalyst: Catalyst, op, left: Node, right: Node, keys: list[list]):
        self.catalyst, self.op, self.children, self.keys = catalyst, op, (left, right), keys

    def _pairs(self, a: DataFrame, b: DataFrame) -> DataFrame:
        c, op = self.catalyst, self.op
        left, (wa,) = c.bound(a, items(op.left().output()), (W,))
        right, (wb,) = c.bound(b, items(op.right().output()), (W,))
        z = c.numbered(c.over(op, [left, right]), items(op.output()), {"__wa": wa, "__wb": wb})
        return z.withColumn(W, F.col("__wa") * F.col("__wb")).drop("__wa", "__wb")

    def delta(self, step: Step) -> DataFrame:
        kept = []
        for i, (child, side) in enumerate(zip(self.children, (self.op.left(), self.op.right()), strict=True)):
            z = _with_hash(self.catalyst, step.delta(child), items(side.output()), self.keys[i])
            kept.append((*step.keep(self, i, z, step.idle(child)), step.idle(child)))
        return bilinear(step, self._pairs, *kept)


def _with_hash(c: Catalyst, z: DataFrame, attributes: list, keys: list) -> DataFrame:
    """A frame and the hash of key expressions over its attributes."""
    if not keys:
        return z.select("*", hashed([]))
    plan, (weight,) = c.bound(z, attributes, (W,))
    names = [f"__key{k}" for k in range(len(keys))]
    return c.numbered(plan, attributes, {W: weight} | dict(zip(names, keys, strict=True))).select("*", hashed([F.col(n) for n in names])).drop(*names)


class Again(Recomputed):
    """An operator computed again for touched keys. keys: for each child the expressions that rows belong together by."""

    def __init__(self, catalyst: Catalyst, op, children: tuple[Node, ...], keys: list[list], run: Callable | None = None):
        self.catalyst, self.op, self.children, self.keys = catalyst, op, children, keys
        self.always = not keys[0]
        self.inputs = [items(x.output()) for x in (items(op.children()) if run is None else run.inputs)]
        self.plan = run or (lambda plans: catalyst.over(op, plans))

    def _hashed(self, z: DataFrame, i: int) -> DataFrame:
        return _with_hash(self.catalyst, z, self.inputs[i], self.keys[i])

    def run(self, *zs: DataFrame) -> DataFrame:
        plans = [self.catalyst.bound(zset.rows(z), a)[0] for z, a in zip(zs, self.inputs, strict=True)]
        return self.catalyst.numbered(self.plan(plans), items(self.op.output()))


class Sums(Node):
    """An aggregate of counts, exact sums and averages: a row of accumulators a group is kept, and the change's are added.

    Without grouping there is one group that always exists. A DISTINCT is such an
    aggregate of none, whose groups exist while they have rows.
    """
    settled = True

    def __init__(self, catalyst: Catalyst, op, child: Node, calls: list):
        self.catalyst, self.op, self.children, self.calls = catalyst, op, (child,), calls
        self.groups = [f"g{i}" for i in range(op.groupingExpressions().size())]

    @staticmethod
    def calls_of(op) -> list | None:
        """The aggregate calls of an Aggregate, or None if some can't be added up from changes."""
        out = []
        for e in items(op.aggregateExpressions()):
            for call in _found(e, "AggregateExpression"):
                f = call.aggregateFunction()
                exact = {"Count": ("LongType",), "Sum": ("LongType", "DecimalType"), "Average": ("DoubleType",)}.get(kind(f), ())
                whole = kind(f) != "Average" or kind(f.child().dataType()) in ("ByteType", "ShortType", "IntegerType", "LongType")
                if call.isDistinct() or kind(f.dataType()) not in exact or not whole or (kind(f) == "Sum" and kind(f.child().dataType()) in ("FloatType", "DoubleType")):
                    return None
                if call not in out:
                    out.append(call)
        return out

    def _flat(self, z: DataFrame) -> DataFrame:
        """Group values, for each call whether it counts a row (n) and what it adds (x), and the weight."""
        plan, (weight,) = self.catalyst.bound(z, items(self.op.child().output()), (W,))
        extra = dict(zip(self.groups, items(self.op.groupingExpressions()), strict=True)) | {W: weight}
        for i, call in enumerate(self.calls):
            if call.filter().isDefined():
                extra[f"f{i}"] = call.filter().get()
            for k, x in enumerate(items(call.aggregateFunction().children())):
                extra[f"x{i}_{k}"] = x
        return self.catalyst.numbered(plan, [], extra)

    def _sums(self, flat: DataFrame) -> DataFrame:
        made = [F.sum(W).alias("__n")]
        for i, call in enumerate(self.calls):
            counts = F.lit(True)
            for k in range(call.aggregateFunction().children().size()):
                counts = counts & F.col(f"x{i}_{k}").isNotNull()
            if f"f{i}" in flat.columns:
                counts = counts & F.coalesce(F.col(f"f{i}"), F.lit(False))
            made.append(F.sum(F.when(counts, F.col(W)).otherwise(0)).alias(f"n{i}"))
            if kind(call.aggregateFunction()) != "Count":
                decimal = kind(call.aggregateFunction().dataType()) == "DecimalType"
                exact = f"decimal(38,{call.aggregateFunction().dataType().scale()})" if decimal else "bigint"
                made.append(F.sum(F.when(counts, F.col(f"x{i}_0").cast(exact) * F.col(W)).otherwise(F.lit(0))).cast(exact).alias(f"s{i}"))
        added = flat.groupBy(*self.groups).agg(*made)
        return added.select(*self.groups, *(F.coalesce(c, F.lit(0)).cast(added.schema[c].dataType).alias(c) for c in added.columns[len(self.groups) :]))

    def _view(self, acc: DataFrame) -> DataFrame:
        """What the aggregate gives for accumulators: its result expressions over the calls' values."""
        values = []
        for i, call in enumerate(self.calls):
            f = kind(call.aggregateFunction())
            value = F.col(f"n{i}") if f == "Count" else F.when(F.col(f"n{i}") != 0, F.col(f"s{i}").cast("double") / F.col(f"n{i}") if f == "Average" else F.col(f"s{i}"))
            values.append(value.cast(call.aggregateFunction().dataType().sql()).alias(f"v{i}"))
        plan = acc.select(*self.groups, *values)._jdf.queryExecution().analyzed()
        own = items(plan.output())
        groups, c = items(self.op.groupingExpressions()), self.catalyst
        made = [c.alias(a, g.name(), g.exprId()) if kind(g) == "AttributeReference" else c.alias(a, "g") for a, g in zip(own, groups, strict=False)]
        vs = [c.alias(a, f"v{i}") for i, a in enumerate(own[len(groups) :])]
        named = [(g, m.toAttribute()) for g, m in zip(groups, made, strict=True) if kind(g) != "AttributeReference"]
        swap = c.map([*named, *((call, v.toAttribute()) for call, v in zip(self.calls, vs, strict=True))])
        out = [e.transform(swap) for e in items(self.op.aggregateExpressions())]
        return c.numbered(c.project([e if kind(e) == "Alias" else c.alias(e, e.name(), e.exprId()) for e in out], c.project([*made, *vs], plan)), items(self.op.output()))

    def delta(self, step: Step) -> DataFrame:
        added = self._sums(self._flat(step.delta(self.children[0])))
        return accumulated(step, self, self.groups, added, self._view)


class Lowering:
    """Plans a program's views over opaque leaves, and makes nodes of the plans."""

    def __init__(self, spark: SparkSession, planning: SparkSession):
        """spark: the session that steps run in; planning: another one, with leaves as its views."""
        self.catalyst, self.planning = Catalyst(spark), planning
        self.leaves: dict[int, Node] = {}
        #: Why some operators are computed whole each step, filled while views are lowered.
        self.whole: list[str] = []
        rules = planning.conf.get("spark.sql.optimizer.excludedRules")
        planning.conf.set("spark.sql.optimizer.excludedRules", f"{rules},org.apache.spark.sql.catalyst.optimizer.InferWindowGroupLimit")

    def leaf(self, name: str, schema, node: Node) -> None:
        """A table or view that queries may read, with what makes its changes."""
        df = self.planning.createDataFrame(self.planning.sparkContext.emptyRDD(), schema)
        df.createOrReplaceTempView(name)
        self.leaves[df._jdf.queryExecution().analyzed().rdd().id()] = Renamed(node)

    def view(self, query: str, names: tuple[str, ...]) -> Node:
        return Named(self.node(self.planning.sql(query)._jdf.queryExecution().optimizedPlan()), names)

    def _whole(self, reason: str) -> None:
        if reason not in self.whole:
            self.whole.append(reason)

    def node(self, op) -> Node:
        name, c = kind(op), self.catalyst
        if name == "LogicalRDD":
            if op.rdd().id() not in self.leaves:
                raise NotIncremental("a relation that is no table of the program")
            return self.leaves[op.rdd().id()]
        if name in ("OneRowRelation", "LocalRelation", "Range"):
            return Rows(c, op)
        if name in ("Project", "Filter"):
            op = self._without_subqueries(op)
            name = kind(op)
        for e in items(op.expressions()):
            if not e.deterministic():
                raise NotIncremental(f"{e.sql()} has no fixed value")
            for x in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery"):
                if _found(e, x):
                    raise NotIncremental(f"a subquery in {name}")
        if name in ROW_BY_ROW or name in ("Project", "Expand"):
            return RowByRow(c, op, self.node(op.child()))
        if name == "Union":
            return Sum(tuple(self.node(x) for x in items(op.children())))
        if name in ("Sort", "RebalancePartitions", "RepartitionByExpression", "Repartition", "ResolvedHint"):
            return self.node(op.child())
        if name == "Join":
            return self._join(op)
        if name == "Aggregate":
            calls = Sums.calls_of(op)
            child = self.node(op.child())
            if calls is not None:
                return Sums(c, op, child, calls)
            keys = items(op.groupingExpressions())
            if not keys:
                self._whole("an aggregate without groups that isn't a count or an exact sum")
            return Again(c, op, (child,), [keys])
        if name == "Window":
            keys = items(op.partitionSpec())
            if not keys:
                self._whole("a window without PARTITION BY")
            return Again(c, op, (self.node(op.child()),), [keys])
        if name in ("GlobalLimit", "LocalLimit", "Offset"):
            return self._limited(op)
        raise NotIncremental(f"{name} isn't maintained from changes")

    def _without_subqueries(self, op):
        """Single values of subqueries as columns of a join with the one row that each is."""
        calls = [x for e in items(op.expressions()) for x in _found(e, "ScalarSubquery")]
        if not calls:
            return op
        c, child, swap = self.catalyst, op.child(), []
        inner = getattr(c.base.plans, "Inner$").__getattr__("MODULE$")
        for x in calls:
            same = next((value for y, value in swap if y.semanticEquals(x)), None)
            if same is not None:
                swap.append((x, same))
                continue
            core = x.plan()
            while kind(core) == "Project":
                core = core.child()
            if items(x.children()) or not (kind(core) == "Aggregate" and not core.groupingExpressions().size()):
                raise NotIncremental("a single-value subquery that may have no row")
            child = c.base.plans.logical.Join(child, x.plan(), inner, c.jvm.scala.Option.apply(None), c.base.plans.logical.JoinHint.NONE())
            swap.append((x, items(x.plan().output())[0]))
        swap = c.map(swap)
        if kind(op) == "Project":
            return c.project([e.transform(swap) for e in items(op.projectList())], child)
        return c.project(items(op.output()), c.base.plans.logical.Filter(op.condition().transform(swap), child))

    def _join(self, op) -> Node:
        c, how = self.catalyst, kind(op.joinType())
        left, right = self.node(op.left()), self.node(op.right())
        if how not in KEYED_JOINS | {"Inner", "Cross"}:
            raise NotIncremental(f"{how} joins aren't maintained from changes")
        keys: list[list] = [[], []]
        sides = [x.outputSet() for x in (op.left(), op.right())]

        def take(e) -> None:
            if kind(e) == "And":
                take(e.left())
                take(e.right())
            elif kind(e) in ("EqualTo", "EqualNullSafe"):
                for a, b in ((e.left(), e.right()), (e.right(), e.left())):
                    if a.references().size() and b.references().size() and a.references().subsetOf(sides[0]) and b.references().subsetOf(sides[1]):
                        keys[0].append(a)
                        keys[1].append(b)
                        return

        if op.condition().isDefined():
            take(op.condition().get())
        if how in ("Inner", "Cross"):
            return InnerJoin(c, op, left, right, keys)
        if not keys[0]:
            self._whole(f"a {how} join without an equality")
        return Again(c, op, (left, right), keys)

    def _limited(self, op) -> Node:
        """LIMIT and OFFSET, with the order below them."""
        chain, ends = [op], 1
        while kind(chain[-1].child()) in ("GlobalLimit", "LocalLimit", "Offset", "Project", "Sort"):
            chain.append(chain[-1].child())
            if kind(chain[-1]) != "Project":
                ends = len(chain)
            if kind(chain[-1]) == "Sort":
                break
        chain = chain[:ends]  # a projection belongs here only where an order stands below it
        c, below = self.catalyst, chain[-1].child()

        def run(plans):
            plan = plans[0]
            for x in reversed(chain):
                plan = c.over(x, [plan])
            return plan

        run.inputs = [below]
        self._whole("LIMIT")
        return Again(c, op, (self.node(below),), [[]], run)
