"""What the SQL endpoint refuses and what it lets through; nothing that is refused runs."""

import pytest

from brindle.plans.sql_endpoint import FUNCTIONS, Refused, run_sql


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("secret")
    (folder / "secret.txt").write_text("secret line\n")
    spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0), (3, "b", None)], "k int, name string, x double").createOrReplaceTempView("sheet")
    spark.createDataFrame([(1, 10), (2, 20)], "k int, y int").createOrReplaceTempView("other")
    return spark, folder / "secret.txt"


REFUSED = [
    "SELECT * FROM IDENTIFIER('text.`{f}`')",
    "SELECT * FROM IDENTIFIER('text' || '.`{f}`')",
    "SELECT (SELECT max(value) FROM IDENTIFIER('text.`{f}`')) AS v",
    "SELECT IDENTIFIER('java_method')('java.lang.System','getProperty','user.name') AS v",
    "SELECT java_method('java.lang.System','getProperty','user.name') AS v",
    "SELECT `reflect`('java.lang.System','getProperty','user.name') AS v",
    "SELECT k FROM sheet WHERE try_reflect('java.lang.System','getProperty','user.name') IS NOT NULL",
    "SELECT * FROM text.`{f}`",
    "SELECT * FROM sheet WHERE name IN (SELECT value FROM text.`{f}`)",
    "SELECT * FROM sheet WHERE EXISTS (SELECT 1 FROM text.`{f}`)",
    "WITH t AS (SELECT * FROM text.`{f}`) SELECT * FROM t",
    "WITH t AS (WITH u AS (SELECT * FROM text.`{f}`) SELECT * FROM u) SELECT * FROM t",
    "SELECT sum(x) OVER w FROM sheet WINDOW w AS (PARTITION BY java_method('java.lang.System','getProperty','user.name'))",
    "SELECT k FROM sheet ORDER BY java_method('java.lang.System','getProperty','user.name')",
    "SELECT k FROM sheet UNION ALL SELECT length(value) FROM text.`{f}`",
    "SELECT * FROM range(5)",
    "SELECT * FROM read_files('{f}')",
    "SELECT TRANSFORM(k) USING 'cat' AS (v) FROM sheet",
    "SELECT * FROM VALUES (java_method('java.lang.System','getProperty','user.name')) AS t(v)",
    "SELECT transform(array(1), v -> java_method('java.lang.System','getProperty','user.name')) AS v FROM sheet",
    "SELECT input_file_name() FROM sheet",
    "SELECT spark_catalog.default.f(k) FROM sheet",
    "SELECT * FROM default.sheet",
    "SELECT * FROM nowhere",
    "SELECT /* x */ current_user()",
    "SELECT assert_true(false)",
    "EXPLAIN SELECT 1",
    "SET x = 1",
    "SHOW TABLES",
    "FROM sheet SELECT *",
    "SELECT 1; SELECT 2",
    "WITH t AS (SELECT * FROM t) SELECT * FROM t",
]

ALLOWED = [
    ("SELECT name, sum(x) AS s FROM sheet GROUP BY name HAVING count(*) > 1", [("b", 3.0)]),
    ('SELECT "name" FROM sheet WHERE "k" = 1', [("a",)]),
    ("WITH t AS (SELECT k, x FROM sheet), u AS (SELECT max(k) AS m FROM t) SELECT t.k FROM t JOIN u ON t.k = u.m", [(3,)]),
    ("SELECT k, row_number() OVER (PARTITION BY name ORDER BY k DESC) AS r FROM sheet ORDER BY k LIMIT 2", [(1, 1), (2, 2)]),
    ("SELECT k, sum(x) OVER w AS s FROM sheet WINDOW w AS (ORDER BY k) ORDER BY k LIMIT 1 OFFSET 1", [(2, 5.0)]),
    ("SELECT s.k FROM sheet s LEFT JOIN other o USING (k) WHERE o.y IS NULL", [(3,)]),
    ("SELECT k FROM sheet WHERE k IN (SELECT k FROM other WHERE y > 10) OR EXISTS (SELECT 1 FROM other WHERE other.k = sheet.k AND y = 10)", [(1,), (2,)]),
    ("SELECT CASE WHEN x BETWEEN 2 AND 2.5 THEN 'low' WHEN x IS NULL THEN 'none' ELSE cast(x AS STRING) END AS v FROM sheet ORDER BY k", [("low",), ("3.0",), ("none",)]),
    ("SELECT count(*) FILTER (WHERE x > 2) AS n, count(DISTINCT name) AS m, (SELECT max(y) FROM other) AS y FROM sheet", [(1, 2, 20)]),
    ("SELECT k FROM sheet EXCEPT SELECT k FROM other", [(3,)]),
    ("SELECT DISTINCT name FROM (SELECT * FROM sheet) t WHERE name LIKE 'b%' AND NOT name RLIKE 'z'", [("b",)]),
    ("SELECT substring(name, 1, 1) AS a, trim(name) AS b, extract(year FROM date '2024-05-06') AS y, -k AS n FROM sheet WHERE k = 1", [("a", "a", 2024, -1)]),
    ("SELECT 'drop table; java_method(' AS v", [("drop table; java_method(",)]),
    ("SELECT name, count(*) AS n FROM sheet GROUP BY ROLLUP (name) ORDER BY name NULLS FIRST", [(None, 3), ("a", 1), ("b", 2)]),
    ("SELECT v FROM VALUES (1), (2) AS t(v) WHERE v > 1", [(2,)]),
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(views, sql):
    spark, path = views
    with pytest.raises(Refused):
        run_sql(spark, sql.format(f=path))


@pytest.mark.parametrize("sql, rows", ALLOWED)
def test_allowed(views, sql, rows):
    assert [tuple(r) for r in run_sql(views[0], sql).collect()] == rows


def test_no_listed_function_reaches_outside():
    reach = {"reflect", "java_method", "try_reflect", "input_file_name", "current_user", "user", "session_user", "version", "assert_true", "raise_error", "read_files", "current_catalog", "from_xml", "xpath", "sleep"}
    assert not FUNCTIONS & reach
