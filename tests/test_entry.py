"""The driver's contract: names, SQL, schemas; the core never imports the optional subpackage."""

import ast
import os

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(o) <= set(q)


def test_entry_runs(spark, data):
    df = entry.entry(spark)
    assert df.columns == ["src", "dst", "relationship_type", "probability"] and df.count() == 20


def test_nothing_in_the_core_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "kithgraph")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, f)).read())
                for node in ast.walk(tree):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(".llm" in n for n in names), (f, names)


def test_edges_agree_with_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        if f.endswith(".parquet"):
            con.execute(f"create view \"{f[:-8]}\" as select * from '{data}/{f}'")
    for name in ("agg02_edges", "gra06_reach", "str05_blocking_keys"):
        df = entry.queries()[name](spark, data)
        got = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
        rel = con.execute(entry.oracle_sql()[name])
        order = [c[0] for c in rel.description]
        want = sorted(tuple(str(r[order.index(c)]) for c in sorted(order)) for r in rel.fetchall())
        assert got == want, name


def test_written_tables_can_be_cleared(spark):
    from kithgraph.session import clear_written, written

    clear_written(spark)
    assert written(spark.range(3), "t").count() == 3
    assert clear_written(spark) == 1 and clear_written(spark) == 0
