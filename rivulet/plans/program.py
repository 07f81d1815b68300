"""SQL programs: CREATE TABLE declares inputs, CREATE VIEW standing queries over them.

A program runs as a batch (output) or step by step (step): changes of tables in, changes
of views out. Views are maintained from the changes by the operators that Catalyst plans for
them; the few that can't be are computed whole in each step, with a warning.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rivulet import dialect, types
from rivulet.functions import recipes
from rivulet.operators import zset
from rivulet.operators.incremental import Constant, Node, Recomputed, Scan, Views
from rivulet.plans.lowering import Lowering, NotIncremental
from rivulet.session import engine_session

class ProgramError(ValueError):
    """An error with its place, from its first character to its last: what the JSON report says."""

    def __init__(self, kind: str, message: str, start: tuple[int, int] = (0, 0), end: tuple[int, int] = (0, 0), warning: bool = False):
        super().__init__(message)
        self.report = {"start_line_number": start[0], "start_column": start[1], "end_line_number": end[0], "end_column": end[1], "warning": warning, "error_type": kind, "message": message}


@dataclass
class View:
    name: str
    query: str
    columns: tuple[str, ...]
    schema: T.StructType
    reads: set[str]
    output: bool = True


@dataclass
class Program:
    """A catalog of tables and views in a session of its own.

    strict: text that is no number counts as 0, SUM and AVG of integers have their
    argument's type, ROUND takes halves to the even neighbour, times are to the millisecond.
    """
    spark: SparkSession
    strict: bool = False
    #: A shared folder for the states of steps; a program of the same views goes on from them.
    home: str | None = None
    tables: dict[str, T.StructType] = field(default_factory=dict)
    contents: dict[str, DataFrame] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    warnings: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.spark = engine_session(self.spark)
        recipes.register(self.spark)
        self._running: Views | None = None
        self._pending: dict[str, DataFrame] = {}
        #: Tables with contents, which the first step takes as changes.
        self._filled: set[str] = set()
        self._last: dict[str, DataFrame] = {}

    # --- declarations ---
    def sql(self, text: str, output: bool = True, errors: list[dict] | None = None) -> DataFrame | None:
        """Runs all statements of text; returns the last query's rows, if there is one. With errors, a list, those of all statements are reported there, and statements after a wrong one still run."""
        out = None
        for s, start, end in dialect.placed(text):
            try:
                out = self._statement(s, text, start, end, output)
            except ProgramError as e:
                if errors is None:
                    raise
                errors.append(e.report)
        return out

    def _statement(self, sql: str, text: str, start: int, end: int, output: bool) -> DataFrame | None:
        first, last = (dialect.line_and_column(text, at) for at in (start, max(start, end - 1)))
        try:
            st = dialect.parse(sql)
            if st.kind == "table":
                self.table(st.name, self._declared(st.body))
            elif st.kind == "table_as":
                self.table(st.name, self._analysed(st.body)[1].schema)
            elif st.kind == "view":
                self.view(st.name, st.body, st.columns, output)
            elif st.kind == "drop":
                self.drop(st.name)
            elif st.kind == "insert":
                self.insert(st.name, st.body, st.columns)
            else:
                return self._analysed(st.body)[1]
        except PySparkException as e:
            # the place of what Spark names, if the statement has it as it stands in the rewritten query
            context = next(iter(e.getQueryContext() or []), None)
            part = context.fragment() if context is not None and hasattr(context, "fragment") else ""
            at = text.find(part, start, end) if part else -1
            if at >= 0:
                first, last = (dialect.line_and_column(text, x) for x in (at, at + len(part) - 1))
            raise ProgramError(e.getCondition() or "Error", e.getMessage() if hasattr(e, "getMessage") else str(e), first, last) from e
        except ProgramError as e:
            if not e.report["start_line_number"]:
                e.report |= {"start_line_number": first[0], "start_column": first[1], "end_line_number": last[0], "end_column": last[1]}
            raise
        except ValueError as e:
            raise ProgramError("Not supported", str(e), first, last) from e
        return None

    def _declared(self, body: str) -> T.StructType:
        fields = []
        for part in dialect._split_commas(body):
            m = re.match(r'\s*("[^"]+"|`[^`]+`|\w+)\s+(.*)$', part, re.S)
            if not m or m[1].upper() in ("CONSTRAINT", "FOREIGN", "CHECK", "UNIQUE") or re.match(r"PRIMARY\s+KEY", part, re.I):
                raise ValueError(f"not a column: {part}")
            kind, required = re.subn(r"\s+NOT\s+NULL\b", "", m[2], flags=re.I)
            kind = re.sub(r"\s+(NULL|PRIMARY\s+KEY)\s*$", "", kind, flags=re.I)
            fields.append(T.StructField(dialect.plain_name(m[1]), types.parse_type(kind, self._warn), not required))
        return T.StructType(fields)

    def _warn(self, message: str) -> None:
        self.warnings.append(ProgramError("Warning", message, warning=True).report)

    def _known(self, name: str) -> str | None:
        return next((k for k in (*self.tables, *self.views) if k.lower() == name.lower()), None)

    def table(self, name: str, schema: T.StructType, df: DataFrame | None = None) -> None:
        """Declares a table, with contents if df is given."""
        if self._known(name):
            raise ProgramError("Duplicate", f"{name} is declared already")
        self.tables[name] = schema
        if df is not None:
            self._filled.add(name)
        self.contents[name] = df if df is not None else self.spark.createDataFrame([], schema)
        self.contents[name].createOrReplaceTempView(name)

    def read(self, name: str, path: str) -> None:
        """Declares a table over Parquet files."""
        df = self.spark.read.parquet(path)
        self.table(name, df.schema, df)

    def drop(self, name: str) -> None:
        found = self._known(name)
        if not found:
            raise ProgramError("Not found", f"{name} isn't declared")
        for d in (self.tables, self.contents, self.views):
            d.pop(found, None)
        self._filled.discard(found)
        self.spark.catalog.dropTempView(found)

    def insert(self, name: str, body: str, columns: tuple[str, ...] = ()) -> None:
        """Adds rows: VALUES, or SELECT * of a table. A column list must name all columns."""
        found = self._known(name)
        if not found or found not in self.tables:
            raise ProgramError("Not found", f"{name} isn't a table")
        schema = self.tables[found]
        if columns and sorted(c.lower() for c in columns) != sorted(f.name.lower() for f in schema):
            raise ValueError("the column list of INSERT must name all columns")
        if not re.match(r"\s*(VALUES|SELECT\s+\*\s+FROM\s+\S+\s*$)", body, re.I):
            raise ValueError("INSERT takes VALUES, or SELECT * of a table")
        rows = self._analysed(body)[1]
        rows = rows.toDF(*(columns or [f.name for f in schema]))
        typed = rows.select(*(_as(rows[f.name], f).alias(f.name) for f in schema))
        self.contents[found] = self.contents[found].unionByName(typed)
        if self._running is None:
            self._filled.add(found)
        else:
            self.push(found, typed)
        self.contents[found].createOrReplaceTempView(found)
        for v in self.views.values():  # views look at the tables of their time
            self._register(v)

    def view(self, name: str, query: str, columns: tuple[str, ...] = (), output: bool = True) -> None:
        """Declares a view; output=False keeps it inside."""
        if self._known(name):
            raise ProgramError("Duplicate", f"{name} is declared already")
        text, df = self._analysed(query)
        if found := dialect.unstable(df._jdf.queryExecution().analyzed()):
            raise ProgramError("Not supported", f"{found} has no fixed value")
        columns = columns or _names(df.columns)
        df = df.toDF(*columns)
        v = View(name, text, columns, df.schema, self._reads(text), output)
        self.views[name] = v
        self._register(v)

    def _register(self, v: View) -> None:
        df = self.spark.sql(v.query)
        (df.toDF(*v.columns) if v.columns else df).createOrReplaceTempView(v.name)

    def _analysed(self, query: str) -> tuple[str, DataFrame]:
        text = dialect.rewritten(query, lambda q: len(self.spark.sql(dialect.rewritten(q)).columns))
        rules = dialect.DIVISIONS * ("/" in text) + dialect.STRICT * self.strict
        if rules:
            text = dialect.typed(self.spark, text, rules)
        if "approx_count_distinct" in text.lower():
            text = dialect.distinct_sketches(self.spark, text)
        return text, self.spark.sql(text)

    def _reads(self, query: str) -> set[str]:
        names = {t.lower().strip('"`') for t in dialect.tokens(query)}
        return {k for k in (*self.tables, *self.views) if k.lower() in names}

    # --- batch ---
    def output(self, view: str) -> DataFrame:
        """All rows of a view over the tables' present contents."""
        return self.spark.table(self._known(view) or view)

    def outputs(self) -> dict[str, DataFrame]:
        return {n: self.output(n) for n, v in self.views.items() if v.output}

    # --- step by step ---
    def nodes(self) -> dict[str, Node]:
        """The operator tree of each output view, made of what Catalyst plans for it. A view that can't be maintained from changes, in whole or in part, is warned about."""
        planning = engine_session(self.spark)
        recipes.register(planning)
        lowering, made = Lowering(self.spark, planning), {}
        for name, schema in self.tables.items():
            lowering.leaf(name, schema, Scan(name))
        for name, v in self.views.items():
            lowering.whole.clear()
            try:
                made[name] = lowering.view(v.query, v.columns)
            except NotIncremental as e:
                made[name] = self._recomputed(v, made)
                lowering.whole.append(str(e))
            for reason in lowering.whole:
                self._warn(f"View '{name}' is computed whole in each step: {reason}")
            lowering.leaf(name, v.schema, made[name])
        return {n: made[n] for n, v in self.views.items() if v.output}

    def _recomputed(self, v: View, made: dict[str, Node]) -> Node:
        """A view computed whole, before and after, when something that it reads changes."""
        inputs = sorted(v.reads - {v.name})
        if not inputs:
            return Constant(lambda _: self.spark.sql(v.query).toDF(*v.columns))

        def run(*zs: DataFrame) -> DataFrame:
            for n, z in zip(inputs, zs, strict=True):
                zset.rows(z).createOrReplaceTempView(n)
            return self.spark.sql(v.query).toDF(*v.columns)

        return Recomputed(tuple(made.get(n) or Scan(n) for n in inputs), [[]] * len(inputs), run, always=True)

    def push(self, table: str, delta: DataFrame) -> None:
        """Changes of a table for the next step: weights in column __w, or insertions."""
        found = self._known(table)
        z = zset.weighted(self._own(delta))
        self._pending[found] = z if found not in self._pending else zset.plus(self._pending[found], z)

    def _own(self, df: DataFrame) -> DataFrame:
        return DataFrame(df._jdf, self.spark) if df.sparkSession is not self.spark else df

    def step(self, deltas: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """Takes the changes and returns those of all output views; the first step also brings constants and the rows that tables have already. Rows inserted later come with the next step."""
        for name, d in (deltas or {}).items():
            self.push(name, d)
        if self._running is None:
            self._running = Views(self.spark, self.nodes(), self.tables, self.home)
            for name in sorted(self._filled if not self._running.steps else ()):
                self.push(name, self.contents[name])
        pending, self._pending = self._pending, {}
        self._last = self._running.step(pending)
        return self._last

    def pull(self, view: str) -> DataFrame:
        """A view's change of the last step."""
        return self._last[self._known(view) or view]

    # --- reports ---
    def unused(self) -> list[str]:
        """Tables that no view reads; each is warned about."""
        read = set().union(*(v.reads for v in self.views.values())) if self.views else set()
        out = [t for t in self.tables if t not in read]
        for t in out:
            self._warn(f"Table '{t}' is not used")
        return out

    def schema(self, all_tables: bool = False) -> str:
        """Inputs and outputs as JSON; tables that no view reads only if asked for."""
        unused = set() if all_tables else set(self.unused())
        return json.dumps({
            "inputs": [types.schema_json(n, s) for n, s in self.tables.items() if n not in unused],
            "outputs": [types.schema_json(n, v.schema) for n, v in self.views.items() if v.output],
        })

    def explain(self, view: str) -> str:
        return self.output(view)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def dot(self) -> str:
        """The dependencies of tables and views as a graph for dot."""
        lines = [f'  "{n}" [shape=box];' for n in self.tables] + [f'  "{r}" -> "{n}";' for n, v in self.views.items() for r in sorted(v.reads - {n})]
        return "digraph program {\n" + "\n".join(lines) + "\n}\n"


def _names(columns: list[str]) -> tuple[str, ...]:
    """Column names of a view: those of plain columns, each once; EXPR$n for expressions and repeated names."""
    seen: set[str] = set()
    return tuple(f"EXPR${i}" if not re.fullmatch(r"[\w ]+", c) or c.lower() in seen or seen.add(c.lower()) else c for i, c in enumerate(columns))


def _as(column, f: T.StructField):
    """A value for a declared column; text that is no date or time becomes null."""
    return column.try_cast(f.dataType)
