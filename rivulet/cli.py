"""Command line: checks a program, prints its schema, plans or graph, or runs it over Parquet tables.

    python -m rivulet.cli program.sql [-js] [-je] [-dot] [-plans] [-alltables] [--tables DIR --out DIR]
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from rivulet.plans.program import Program, ProgramError


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="rivulet")
    p.add_argument("program")
    p.add_argument("-js", action="store_true", help="print the schema as JSON")
    p.add_argument("-je", action="store_true", help="print errors and warnings as JSON")
    p.add_argument("-dot", action="store_true", help="print the graph of views")
    p.add_argument("-plans", action="store_true", help="print the views' plans")
    p.add_argument("-alltables", action="store_true", help="keep tables that no view reads")
    p.add_argument("--tables", help="folder with a Parquet file or folder for each table")
    p.add_argument("--out", help="folder for the views")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("rivulet").getOrCreate()
    program, errors = Program(spark), []
    try:
        with open(a.program) as f:
            program.sql(f.read(), errors=errors)
        if errors:
            raise ProgramError("Stopped", f"{len(errors)} statements are wrong")
        unused = [] if a.alltables else program.unused()
        if a.tables:
            for name in [t for t in program.tables if t not in unused]:
                path = os.path.join(a.tables, f"{name}.parquet")
                program.contents[name] = program.spark.read.parquet(path).select(*(f.name for f in program.tables[name]))
                program.contents[name].createOrReplaceTempView(name)
            for v in program.views.values():
                program._register(v)
            for name, df in program.outputs().items():
                df.write.mode("overwrite").parquet(os.path.join(a.out, name))
        if a.js:
            print(program.schema(a.alltables))
        if a.dot:
            print(program.dot())
        if a.plans:
            for name in program.outputs():
                print(program.explain(name))
    except ProgramError as e:
        errors += [e.report] if not errors else []
    reports = program.warnings + errors
    if reports:
        print(json.dumps(reports) if a.je else "\n".join(f"{a.program}:{r['start_line_number']}:{r['start_column']}: {'warning' if r['warning'] else 'error'}: {r['error_type']}: {r['message']}" for r in reports), file=sys.stderr)
    return int(bool(errors))


if __name__ == "__main__":
    sys.exit(main())
