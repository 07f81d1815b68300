"""Views as trees of operators, and the rules that turn table changes into view changes.

Linear operators (filter, projection, unnesting, sum, negation) apply to the change as they
are. A join is bilinear. Aggregates that are sums keep one accumulator row a group and add
the change to it. The others (distinct, outer joins, windows, minimum and maximum, set
operations, ...) are computed again for the keys that the change touches, before and after.

State is kept in shared storage as logs of changes: each operator writes what its inputs
change, under the hash of the key that it looks rows up by. Logs are sorted by that hash, so
a step that touches few keys reads the pages of files that hold them and no more. A manifest
tells which files make up the states of the last step; another driver goes on from it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators import zset
from rivulet.operators.zset import W
from rivulet.session import IN_LENGTH, list_names, read_text, remove, shared_path, write_text

#: Changes that a state holds before they are summed up into one.
COMPACT = 16
#: Touched keys up to which their hashes are handed to the scan of a state; more are joined with it.
MOST_HASHES = 10_000
#: The hash of a row's key, in states.
H = "__h"


class Store:
    """States as logs of changes under one folder, and the manifest that says which of its files count.

    A step's files are written first, then a new manifest under a new name, then what is
    no longer needed is deleted: whenever a driver dies, the newest manifest is whole.
    """

    def __init__(self, spark: SparkSession, home: str | None = None):
        self.spark, self.home = spark, home or shared_path(spark, "states")
        self.logs: dict[str, list[str]] = {}
        self.schemas: dict[str, T.StructType] = {}
        self.steps, self.batch, self.outputs, self.shape = 0, None, {}, None
        self._old: list[str] = []
        found = sorted(n for n in list_names(spark, self.home) if n.startswith("manifest-") and n.endswith(".json")) if home else []
        if found:
            m = json.loads(read_text(spark, f"{self.home}/{found[-1]}"))
            self.logs, self.steps, self.batch, self.outputs, self.shape = m["logs"], m["steps"], m["batch"], m["outputs"], m["shape"]
            self.schemas = {k: T.StructType.fromJson(v) for k, v in m["schemas"].items()}

    def get(self, key: str) -> DataFrame | None:
        """All changes of a state so far, not summed up; None before the first."""
        paths = self.logs.get(key)
        return self.spark.read.schema(self.schemas[key]).parquet(*paths) if paths else None

    def write(self, df: DataFrame, name: str = "change") -> tuple[str, DataFrame]:
        path = f"{self.home}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    def summed_up(self, key: str, sum_up: Callable[[DataFrame], DataFrame]) -> None:
        """One log instead of many, in ranges of the hash."""
        log = sum_up(self.get(key))
        if H in log.columns:
            log = log.repartitionByRange(H).sortWithinPartitions(H)
        self._old += self.logs[key]
        self.logs[key] = [self.write(log, key)[0]]

    def commit(self, appended: dict, outputs: dict[str, tuple[str, T.StructType]], batch: int | None, shape: list) -> None:
        """appended: for each state the path of its change, its schema and what sums a log up."""
        for key, (path, schema, sum_up) in appended.items():
            self.schemas[key] = schema
            self.logs.setdefault(key, []).append(path)
            if len(self.logs[key]) > COMPACT:
                self.summed_up(key, sum_up)
        self.steps += 1
        self.batch, self.shape = self.batch if batch is None else batch, shape
        self.outputs = {n: [path, schema.jsonValue()] for n, (path, schema) in outputs.items()}
        text = json.dumps({"steps": self.steps, "batch": self.batch, "logs": self.logs, "schemas": {k: v.jsonValue() for k, v in self.schemas.items()}, "outputs": self.outputs, "shape": shape})
        write_text(self.spark, f"{self.home}/manifest-{self.steps:09d}.json", text)
        remove(self.spark, f"{self.home}/manifest-{self.steps - 1:09d}.json")
        for path in self._old:
            remove(self.spark, path)
        self._old.clear()

    def given(self) -> dict[str, DataFrame]:
        """The view changes of the last step."""
        return {n: self.spark.read.schema(T.StructType.fromJson(s)).parquet(p) for n, (p, s) in self.outputs.items()}


def hashed(columns: list[Column]) -> Column:
    """The hash that rows of equal keys share; without columns all rows are of one key."""
    return (F.xxhash64(*columns) if columns else F.lit(0).cast("bigint")).alias(H)


def among(hashes: list[int]) -> Column:
    """Whether the hash is one of some sorted ones. Parquet's readers get a list as a chain of comparisons that they walk by recursion, so a long one would overflow their stack: it goes as a balanced tree of short ones."""
    if len(hashes) <= IN_LENGTH:
        return F.col(H).isin(hashes) if hashes else F.lit(False)
    half = len(hashes) // 2
    return among(hashes[:half]) | among(hashes[half:])


@dataclass
class Step:
    """What one step knows: changes by table, the store, and what has been worked out."""
    spark: SparkSession
    deltas: dict[str, DataFrame]
    present: set[str]
    store: Store
    first: bool
    changes: dict[int, DataFrame] = field(default_factory=dict)
    idles: dict[int, bool] = field(default_factory=dict)
    appended: dict[str, tuple] = field(default_factory=dict)

    def delta(self, node: Node) -> DataFrame:
        if id(node) not in self.changes:
            if self.idle(node) and node.schema is not None:
                self.changes[id(node)] = zset.empty(self.spark, node.schema)
            else:
                self.changes[id(node)] = node.delta(self)
                node.schema = self.changes[id(node)].schema
        return self.changes[id(node)]

    def idle(self, node: Node) -> bool:
        """Whether the node surely doesn't change in this step."""
        if id(node) not in self.idles:
            self.idles[id(node)] = node.idle(self)
        return self.idles[id(node)]

    def keep(self, node: Node, i: int, change: DataFrame, idle: bool = False, sum_up: Callable[[DataFrame], DataFrame] = zset.consolidate) -> tuple[DataFrame, DataFrame | None]:
        """Makes change (with hashes) part of the node's i-th state: returns it as written, and the log before it."""
        key = f"{node.uid}.{i}"
        old = self.store.get(key)
        if idle and old is not None:
            return zset.empty(self.spark, change.schema), old
        path, written = self.store.write(change.sortWithinPartitions(H), key)
        self.appended[key] = (path, written.schema, sum_up)
        return written, old

    def touched(self, *changes: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """What picks the rows of a log whose hashes are among those of changes."""
        all_hashes = reduce(DataFrame.union, [c.select(H) for c in changes])
        some = [r[0] for r in all_hashes.distinct().limit(MOST_HASHES + 1).collect()]
        if len(some) <= MOST_HASHES:
            return lambda log: log.where(among(sorted(some)))
        wanted = all_hashes.distinct().withColumnRenamed(H, "__t")
        return lambda log: log.join(wanted, F.col(H) == F.col("__t"), "left_semi")


class Node:
    """An operator. children: its inputs; uid: its number among a program's operators, which its states go by."""
    children: tuple[Node, ...] = ()
    uid: int | None = None
    owner: Views | None = None
    #: Of its changes, once there was one.
    schema: T.StructType | None = None
    #: Whether its changes have one row a value already.
    settled = False

    def delta(self, step: Step) -> DataFrame:
        raise NotImplementedError

    def idle(self, step: Step) -> bool:
        return not step.first and all(step.idle(c) for c in self.children)

    def parts(self) -> tuple[Node, ...]:
        """All nodes right below, also those that do its work at times."""
        return self.children

    # --- builders ---
    def where(self, condition: str | Column) -> Node:
        return Linear(lambda z: z.where(condition), self)

    def select(self, *exprs: str | Column) -> Node:
        made = [F.expr(e) if isinstance(e, str) else e for e in exprs]
        return Linear(lambda z: z.select(*made, F.col(W)), self)

    def unnest(self, array: str, name: str, ordinal: str | None = None) -> Node:
        def run(z: DataFrame) -> DataFrame:
            if not ordinal:
                return z.withColumn(name, F.explode(F.expr(array)))
            got = z.select("*", F.posexplode(F.expr(array)).alias("__pos", name))
            return got.withColumn(ordinal, F.col("__pos") + 1).drop("__pos").select(*zset.columns(z), name, ordinal, W)

        return Linear(run, self)

    def negate(self) -> Node:
        return Linear(zset.negate, self)

    def union_all(self, *others: Node) -> Node:
        return Sum((self, *others))

    def union(self, *others: Node) -> Node:
        return Sum((self, *others)).distinct()

    def join(self, other: Node, on: list[tuple[str, str]], condition: str | None = None) -> Node:
        return Join(self, other, on, condition)

    def outer_join(self, other: Node, on: list[tuple[str, str]], how: str = "left") -> Node:
        keys = [[F.col(a) for a, _ in on], [F.col(b) for _, b in on]]
        conditions = reduce(lambda x, y: x & y, (F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in on))

        def run(a: DataFrame, b: DataFrame) -> DataFrame:
            return zset.rows(a).alias("l").join(zset.rows(b).alias("r"), conditions, how)

        return Recomputed((self, other), keys, run)

    def distinct(self) -> Node:
        return Recomputed((self,), None, lambda z: zset.distinct(z).drop(W))

    def except_(self, other: Node, all: bool = False) -> Node:
        return Recomputed((self, other), None, lambda a, b: zset.rows(a).exceptAll(zset.rows(b)) if all else zset.distinct(a).drop(W).subtract(zset.distinct(b).drop(W)))

    def intersect(self, other: Node, all: bool = False) -> Node:
        return Recomputed((self, other), None, lambda a, b: zset.rows(a).intersectAll(zset.rows(b)) if all else zset.distinct(a).drop(W).intersect(zset.distinct(b).drop(W)))

    def aggregate(self, keys: list[str], **aggs: str) -> Node:
        """aggs: name='count(*)', 'sum(x)', ... Sums and counts of exact types keep accumulators; others are computed again for touched groups."""
        if all(Accumulated.fits(a) for a in aggs.values()):
            return Accumulated(self, keys, aggs)
        return grouped_again(self, keys, aggs)

    def window(self, partition: list[str], **exprs: str) -> Node:
        """exprs: name='sum(x) OVER (PARTITION BY ... ORDER BY ... RANGE ...)', all within the partition columns."""
        made = {n: F.expr(e) for n, e in exprs.items()}
        return Recomputed((self,), [[F.col(k) for k in partition]], lambda z: zset.rows(z).withColumns(made), always=not partition)

    def top(self, partition: list[str], order: list[str], k: int) -> Node:
        """The first k rows of each partition in an order that is total."""
        over = f"row_number() OVER (PARTITION BY {', '.join(partition)} ORDER BY {', '.join(order)})"
        return Recomputed((self,), [[F.col(c) for c in partition]], lambda z: zset.rows(z).withColumn("__rank", F.expr(over)).where(F.col("__rank") <= k).drop("__rank"))


class Scan(Node):
    def __init__(self, table: str):
        self.table = table

    def delta(self, step: Step) -> DataFrame:
        return step.deltas[self.table]

    def idle(self, step: Step) -> bool:
        return not step.first and self.table not in step.present


class Constant(Node):
    """Rows that are there from the first step on."""

    def __init__(self, make: Callable[[SparkSession], DataFrame]):
        self.make = make

    def delta(self, step: Step) -> DataFrame:
        z = zset.weighted(self.make(step.spark))
        return z if step.first else z.where(F.lit(False))


class Linear(Node):
    def __init__(self, run: Callable[[DataFrame], DataFrame], child: Node):
        self.run, self.children = run, (child,)

    def delta(self, step: Step) -> DataFrame:
        return self.run(step.delta(self.children[0]))


class Sum(Node):
    def __init__(self, children: tuple[Node, ...]):
        self.children = children

    def delta(self, step: Step) -> DataFrame:
        return zset.plus(*(step.delta(c) for c in self.children))


class Join(Node):
    """Inner equi-join with a further condition: dA * B + A * dB + dA * dB, weights multiplied.

    Of A and B only rows with a key that the other's change has are read.
    """

    def __init__(self, left: Node, right: Node, on: list[tuple[str, str]], condition: str | None = None):
        self.children, self.on, self.condition = (left, right), on, condition

    def _pairs(self, a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = a.withColumnRenamed(W, "__wa"), b.withColumnRenamed(W, "__wb")
        if self.on:
            out = x.join(y, reduce(lambda p, q: p & q, (x[k] == y[m] for k, m in self.on)))
        else:
            out = x.crossJoin(y)
        out = out.where(self.condition) if self.condition else out
        return out.withColumn(W, F.col("__wa") * F.col("__wb")).drop("__wa", "__wb")

    def delta(self, step: Step) -> DataFrame:
        left, right = self.children
        zs = [step.delta(c) for c in self.children]
        keys = [[F.col(f"`{on[k]}`") for on in self.on] for k in (0, 1)]
        (da, a), (db, b) = (step.keep(self, i, z.select("*", hashed(k)), step.idle(c)) for i, (z, k, c) in enumerate(zip(zs, keys, self.children, strict=True)))
        return bilinear(step, self._pairs, (da, a, step.idle(left)), (db, b, step.idle(right)))


def bilinear(step: Step, pairs: Callable[[DataFrame, DataFrame], DataFrame], left: tuple, right: tuple) -> DataFrame:
    """The change of a join from (change, log before, whether it is idle) of both sides, all with hashes."""
    (da, a, quiet_a), (db, b, quiet_b) = left, right
    terms = []
    if not quiet_a and b is not None:
        terms.append(pairs(da.drop(H), step.touched(da)(b).drop(H)))
    if not quiet_b and a is not None:
        terms.append(pairs(step.touched(db)(a).drop(H), db.drop(H)))
    if not terms or not (quiet_a or quiet_b):
        terms.append(pairs(da.drop(H), db.drop(H)))
    return zset.plus(*terms)


class Accumulated(Node):
    """GROUP BY of counts and sums: one row of sums a group is kept, and the change's sums are added.

    Without keys there is one group that always exists, also over no rows.
    """

    settled = True

    def __init__(self, child: Node, keys: list[str], aggs: dict[str, str]):
        self.children, self.keys, self.aggs = (child,), keys, aggs
        self.again = grouped_again(child, keys, aggs)

    def parts(self) -> tuple[Node, ...]:
        return (*self.children, self.again)

    @staticmethod
    def fits(agg: str) -> bool:
        a = agg.lower().replace(" ", "")
        return "distinct" not in a and "over" not in a and a.startswith(("count(", "sum(", "avg(")) and a.endswith(")") and a.count("(") == a.count(")") and _whole_call(a)

    def _sums(self, z: DataFrame) -> dict[str, Column] | None:
        """Accumulators by name; None if a sum of floating-point numbers is asked for, that changes can't be taken back from exactly."""
        out = {"__n": F.sum(W)}
        for i, agg in enumerate(self.aggs.values()):
            name, x = agg.strip().split("(", 1)[0].strip().lower(), agg.strip().split("(", 1)[1][:-1].strip()
            if name == "count" and x == "*":
                continue
            e = F.expr(x)
            out[f"__c{i}"] = F.sum(F.when(e.isNotNull(), F.col(W)).otherwise(0))
            if name != "count":
                kind = z.select(e.alias("x")).schema["x"].dataType.simpleString()
                if kind in ("float", "double", "string"):
                    return None
                exact = "decimal(38,10)" if kind.startswith("decimal") else "bigint"
                out[f"__s{i}"] = F.coalesce(F.sum(e.cast(exact) * F.col(W)), F.lit(0)).cast(exact)
        return out

    def _view(self, acc: DataFrame) -> DataFrame:
        made = [F.col(k) for k in self.keys]
        for i, (n, agg) in enumerate(self.aggs.items()):
            name, star = agg.strip().split("(", 1)[0].strip().lower(), agg.strip().split("(", 1)[1][:-1].strip() == "*"
            if name == "count":
                value = F.col("__n") if star else F.col(f"__c{i}")
            elif name == "sum":
                value = F.when(F.col(f"__c{i}") != 0, F.col(f"__s{i}"))
            else:
                value = F.when(F.col(f"__c{i}") != 0, F.col(f"__s{i}").cast("double") / F.col(f"__c{i}"))
            made.append(value.alias(n))
        return acc.select(*made)

    def delta(self, step: Step) -> DataFrame:
        change = step.delta(self.children[0])
        sums = self._sums(change)
        if sums is None:
            return self.again.delta(step)
        names = list(sums)
        added = change.groupBy(*self.keys).agg(*(c.alias(n) for n, c in sums.items()))
        added = added.select(*self.keys, *(F.coalesce(n, F.lit(0)).cast(added.schema[n].dataType).alias(n) for n in names))
        return accumulated(step, self, self.keys, added, self._view)


def accumulated(step: Step, node: Node, keys: list[str], added: DataFrame, view: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The change of a view of accumulators, that are summed up by keys; added: what a step adds to them, with __n, the rows of a group."""
    names = [c for c in added.columns if c not in keys]
    kinds = {n: added.schema[n].dataType for n in names}

    def sum_up(log: DataFrame) -> DataFrame:
        return log.groupBy(*keys, H).agg(*(F.sum(n).cast(kinds[n]).alias(n) for n in names))

    change, old = step.keep(node, 0, added.select("*", hashed([F.col(f"`{k}`") for k in keys])), sum_up=sum_up)
    exists = F.col("__n") != 0 if keys else F.lit(True)
    if old is None:
        return zset.weighted(view(change.drop(H).where(exists)))
    old = sum_up(step.touched(change)(old))
    new = zset.weighted(view(sum_up(old.unionByName(change)).drop(H).where(exists)))
    gone = zset.weighted(view(old.drop(H).where(exists)), -1)
    return zset.consolidate(zset.plus(new, gone))


def _whole_call(a: str) -> bool:
    """Whether the first bracket closes at the end."""
    depth = 0
    for i, c in enumerate(a):
        depth += (c == "(") - (c == ")")
        if c == ")" and not depth:
            return i == len(a) - 1
    return False


class Recomputed(Node):
    """run() over the rows of touched keys, after the step minus before it.

    keys: for each input the key columns, equal ones of all inputs belong together; None:
    the whole row. always: one key for all rows, that exists from the first step on.
    """
    settled = True

    def __init__(self, children: tuple[Node, ...], keys: list[list[Column]] | None, run: Callable[..., DataFrame], always: bool = False):
        self.children, self.keys, self.run, self.always = children, keys, run, always

    def _hashed(self, z: DataFrame, i: int) -> DataFrame:
        """z and the hash of its rows' keys in the i-th input."""
        return z.select("*", hashed([F.col(f"`{c}`") for c in zset.columns(z)] if self.keys is None else self.keys[i]))

    def delta(self, step: Step) -> DataFrame:
        kept = [step.keep(self, i, self._hashed(step.delta(c), i), step.idle(c)) for i, c in enumerate(self.children)]
        whole = self.always or (self.keys is not None and not self.keys[0])
        some = (lambda log: log) if whole or all(old is None for _, old in kept) else step.touched(*(c for c, _ in kept))
        before, after = [], []
        for change, old in kept:
            old = change.where(F.lit(False)) if old is None else some(old)
            before.append(zset.consolidate(old.drop(H)))
            after.append(zset.consolidate(zset.plus(old, change).drop(H)))
        new = zset.weighted(self.run(*after))
        if step.first:
            return zset.consolidate(new)
        return zset.consolidate(zset.minus(new, zset.weighted(self.run(*before)).select(new.columns)))


def grouped_again(child: Node, keys: list[str], aggs: dict[str, str]) -> Recomputed:
    """GROUP BY whose touched groups are computed again."""
    made = [F.expr(a).alias(n) for n, a in aggs.items()]
    return Recomputed((child,), [[F.col(k) for k in keys]], lambda z: zset.rows(z).groupBy(*keys).agg(*made), always=not keys)


class Views:
    """Named operator trees that share inputs, run step by step."""

    def __init__(self, spark: SparkSession, views: dict[str, Node], tables: dict[str, object], home: str | None = None):
        """tables: the schemas of all scanned tables. home: a shared folder for the states; if it holds those of a run of the same views, steps go on from there."""
        self.spark, self.views, self.tables = spark, views, tables
        self.shape: list[str] = []
        for node in views.values():
            self._number(node)
        self.store = Store(spark, home)
        if self.store.shape not in (None, self.shape):
            raise ValueError(f"{home} holds the states of other views")

    def _number(self, node: Node) -> None:
        """Numbers operators in the order in which views name them, the same in each run."""
        if node.owner is not self:
            node.uid, node.owner, node.schema = len(self.shape), self, None
            self.shape.append(type(node).__name__)
            for part in node.parts():
                self._number(part)

    @property
    def steps(self) -> int:
        return self.store.steps

    def step(self, deltas: dict[str, DataFrame], batch: int | None = None) -> dict[str, DataFrame]:
        """Takes a change of some tables (weights in __w, or all 1) and returns the change of each view.

        The changes are read from storage: later steps do not look at the inputs again.
        batch: a number for the step; one that the states have taken already is not taken
        again, and its changes are given once more.
        """
        if batch is not None and self.store.batch == batch:
            return self.store.given()
        full = {}
        for name, schema in self.tables.items():
            d = deltas.get(name)
            full[name] = zset.empty(self.spark, schema) if d is None else zset.consolidate(zset.weighted(d).select(*(F.col(f"`{f.name}`") for f in schema.fields), W))
        step = Step(self.spark, full, {n for n, d in deltas.items() if d is not None}, self.store, self.steps == 0)
        # changes that are one row a value already needn't be summed up
        out = {n: z if v.settled or step.idle(v) else zset.consolidate(z) for n, v in self.views.items() for z in (step.delta(v),)}
        with ThreadPoolExecutor(4) as pool:
            written = dict(zip(out, pool.map(self.store.write, out.values()), strict=True))
        self.store.commit(step.appended, {n: (path, z.schema) for n, (path, z) in written.items()}, batch, self.shape)
        return {n: z for n, (_, z) in written.items()}

    def forget(self, changes: dict[str, DataFrame]) -> None:
        """Deletes the files of view changes that step() gave, once their rows stand elsewhere. Those of the last step stay, for a step that is asked for again."""
        last = {path for path, _ in self.store.outputs.values()}
        for z in changes.values():
            for path in {f.rsplit("/", 1)[0] for f in z.inputFiles()}:
                if not any(path.endswith(p.split("://")[-1]) for p in last):
                    remove(self.spark, path)

    def close(self) -> None:
        """Deletes all states and changes."""
        remove(self.spark, self.store.home)
