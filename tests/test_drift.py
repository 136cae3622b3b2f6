"""Catalog and configuration differences."""

from conftest import rows
from pyspark.sql import functions as F

from fleetlens.functions import ddl, values
from fleetlens.functions.logtext import as_bigint
from fleetlens.operators import drift
from fleetlens.sources.text import parse_config_lines, read_config_files
from workload.views import view

SQL_A = """CREATE TABLE `t` (
  `id` bigint NOT NULL,
  `price` decimal(10,2) DEFAULT NULL,
  `price_old` decimal(8,2) DEFAULT NULL,
  PRIMARY KEY (`id`),
  UNIQUE KEY `k` (`price`,`id`),
  KEY `k_old` (`price_old`)
) ENGINE=InnoDB AUTO_INCREMENT=7 DEFAULT CHARSET=utf8mb4 COLLATE=utf8mb4_bin"""
SQL_B = SQL_A.replace("AUTO_INCREMENT=7 ", "").replace("InnoDB", "MyISAM")


def catalog(spark, columns, indexes, sql):
    cols = spark.createDataFrame(columns, "table_name string, column_name string, "
                                 "type string, nullable string, column_key string, "
                                 "default_value string, extra string")
    parts = spark.createDataFrame(indexes, "table_name string, key_name string, "
                                  "seq_in_index bigint, column_name string, nullable string")
    tables = spark.createDataFrame(sql, "table_name string, create_sql string")
    return tables, cols, parts


def two(spark):
    a = catalog(spark, [("t", "id", "bigint", "NO", "PRI", None, ""),
                        ("t", "price", "decimal(10,2)", "YES", "", None, ""),
                        ("t", "gone", "int", "YES", "", None, ""),
                        ("only_a", "x", "int", "NO", "", None, "")],
                [("t", "k", 2, "id", ""), ("t", "k", 1, "price", "YES"),
                 ("t", "lost", 1, "id", "")],
                [("t", SQL_A), ("only_a", ") ENGINE=InnoDB")])
    b = catalog(spark, [("t", "id", "bigint", "NO", "PRI", None, ""),
                        ("t", "price", "decimal(10,2)", "YES", "", "", "")],
                [("t", "k", 1, "id", ""), ("t", "k", 2, "price", "YES")],
                [("t", SQL_B)])
    return a, b


def diff(a, b):
    return drift.schema_diff(a[0], b[0], a[1], b[1], a[2], b[2])


def test_schema_diff(spark):
    a, b = two(spark)
    assert rows(diff(a, b), "kind", "table_name", "name", "side_a", "side_b") == [
        ("column", "t", "price.default_value", None, ""),
        ("index", "t", "k.columns", "price, id", "id, price"),
        ("index", "t", "k.nulls", "YES, ", ", YES"),
        ("missing_column", "t", "gone", "int", None),
        ("missing_index", "t", "lost", "id", None),
        ("missing_table", "only_a", None, "present", None),
        ("option", "t", "auto_increment", "7", ""),
        ("option", "t", "engine", "InnoDB", "MyISAM")]


def test_schema_diff_mirrors_and_is_empty_on_itself(spark):
    a, b = two(spark)
    there = rows(diff(a, b), "kind", "table_name", "name", "side_a", "side_b")
    back = rows(diff(b, a), "kind", "table_name", "name", "side_b", "side_a")
    assert there == back
    assert diff(a, a).count() == 0 and diff(b, b).count() == 0


def test_schema_diff_of_many_pairs_at_once(spark):
    a, b = two(spark)
    sides = [[d.withColumn("pair", F.lit(p)) for d in side]
             for p, side in (("ab", a), ("ab", b), ("aa", a), ("aa", a))]
    left = [x.unionByName(y) for x, y in zip(sides[0], sides[2])]
    right = [x.unionByName(y) for x, y in zip(sides[1], sides[3])]
    got = drift.schema_diff(left[0], right[0], left[1], right[1], left[2], right[2],
                            scope=["pair"])
    assert {r["pair"] for r in got.collect()} == {"ab"}
    assert got.count() == diff(a, b).count()


def test_parts_of_the_diff_agree_with_it(spark):
    a, b = two(spark)
    assert rows(drift.missing_tables(a[1], b[1])) == [("only_a", "B")]
    assert rows(drift.missing_columns(a[1], b[1]), "column_name", "missing_on") == [
        ("gone", "B")]
    assert rows(drift.column_drift(a[1], b[1]), "column_name", "differences") == [
        ("price", "default_value")]
    ia, ib = drift.collapse_indexes(a[2]), drift.collapse_indexes(b[2])
    assert rows(drift.missing_indexes(ia, ib), "key_name", "missing_on") == [("lost", "B")]
    assert rows(drift.index_drift(ia, ib), "key_name", "differences") == [
        ("k", "columns,nulls")]
    assert rows(drift.table_option_drift(a[0], b[0]), "option", "value_a", "value_b") == [
        ("auto_increment", "7", ""), ("engine", "InnoDB", "MyISAM")]


def test_extended_index_drift(spark):
    a = spark.createDataFrame([("t", "k", "x", "", "unique")], "table_name string, key_name "
                              "string, columns string, nulls string, uniqueness string")
    b = a.withColumn("uniqueness", F.lit("plain"))
    assert drift.index_drift(a, b).count() == 0
    assert rows(drift.index_drift(a, b, extended=True), "differences") == [("uniqueness",)]


def test_definitions(spark):
    a, b = two(spark)
    got = {(r["kind"], r["name"]): r["definition_a"]
           for r in drift.with_definitions(diff(a, b), a[0], b[0]).collect()}
    assert got["column", "price.default_value"] == "`price` decimal(10,2) DEFAULT NULL"
    assert got["index", "k.columns"] == "UNIQUE KEY `k` (`price`,`id`)"
    assert got["missing_index", "lost"] is None


def test_definitions_of_names_with_dots(spark):
    sql = "CREATE TABLE `t` (\n  `a.b` int,\n  `a` text,\n  `c``d` int,\n  KEY `k.1` (`a.b`),\n  PRIMARY KEY (`a`)\n) ENGINE=x"
    tables = spark.createDataFrame([("t", sql)], "table_name string, create_sql string")
    assert rows(drift.definition_index(tables), "element_kind", "element", "definition") == [
        ("column", "a", "`a` text"), ("column", "a.b", "`a.b` int"), ("column", "c`d", "`c``d` int"),
        ("index", "PRIMARY", "PRIMARY KEY (`a`)"), ("index", "k.1", "KEY `k.1` (`a.b`)")]
    found = spark.createDataFrame([("column", "t", "a.b.type"), ("missing_column", "t", "a.b"), ("index", "t", "k.1.columns"),
                                   ("option", "t", "engine"), ("missing_column", "u", "a")], "kind string, table_name string, name string")
    got = {(r.kind, r.table_name): (r.definition_a, r.definition_b) for r in drift.with_definitions(
        found, tables, tables.filter("false")).collect()}
    assert got == {("column", "t"): ("`a.b` int", None), ("missing_column", "t"): ("`a.b` int", None),
                   ("index", "t"): ("KEY `k.1` (`a.b`)", None), ("option", "t"): (None, None), ("missing_column", "u"): (None, None)}


def test_ddl_functions(spark):
    df = spark.createDataFrame([(SQL_A,)], "s string")
    options = df.select(ddl.table_options(F.col("s")).alias("o")).collect()[0]["o"]
    assert tuple(options) == ("InnoDB", "7", "utf8mb4", "utf8mb4_bin")
    lines = df.select(ddl.index_lines(F.col("s")).alias("o")).collect()[0]["o"]
    assert lines == ["PRIMARY KEY (`id`)", "UNIQUE KEY `k` (`price`,`id`)",
                     "KEY `k_old` (`price_old`)"]


def test_connection_url(spark):
    df = spark.createDataFrame([("me:se:cr@et@db1:3306/shop",), ("me@h:1/x",), ("junk",)],
                               "u string")
    got = [r[0] for r in df.select(ddl.parse_conn_url(F.col("u"))).collect()]
    assert tuple(got[0]) == ("me", "db1", 3306, "shop")
    assert tuple(got[1]) == ("me", "h", 1, "x") and got[2] is None


def test_rendering(spark):
    a, b = two(spark)
    text = [r[0] for r in rows(drift.render_schema_diff(diff(a, b)))]
    assert "[option] table t engine: A=InnoDB B=MyISAM" in text


CONFIG = ["# comment", "[mysqld]", "", "  ", "plain-flag", "a-b = ON", "c=x=y", "d = off",
          "e = 1", "not_dynamic = 5"]


def test_config(spark, tmp_path):
    (tmp_path / "my.cnf").write_text("\n".join(CONFIG) + "\n")
    parsed = read_config_files(spark, str(tmp_path))
    assert rows(parsed, "name", "value") == [
        ("a_b", "ON"), ("c", "x=y"), ("d", "off"), ("e", "1"), ("not_dynamic", "5"),
        ("plain_flag", None)]
    kv = "name string, value string"
    live = spark.createDataFrame([("a_b", "TRUE"), ("c", "x=z"), ("d", "FALSE"), ("e", "ON"),
                                  ("not_dynamic", "6")], kv)
    dynamic = spark.createDataFrame([("a_b",), ("c",), ("d",), ("e",)], "name string")
    assert rows(drift.config_drift(parsed, live, dynamic)) == [
        ("c", "x=y", "x=z"), ("e", "1", "ON")]


def test_config_lines_from_a_table(spark):
    lines = spark.createDataFrame([(7, "x=1\r")], "n bigint, line string")
    assert rows(parse_config_lines(lines)) == [(7, "x", "1")]


def test_instance_drift(spark):
    v = spark.createDataFrame([(1, "a", "x"), (2, "a", "X"), (1, "b", "1"), (2, "c", "1"),
                               (1, "d", "1"), (2, "d", "1"), (1, "e", "1")],
                              "instance bigint, name string, value string")
    pairs = spark.createDataFrame([(1, 2)], "src bigint, dest bigint")
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    assert rows(drift.instance_drift(v, pairs, names), "name", "status") == [
        ("a", "differs"), ("b", "only_src"), ("c", "only_dest")]


def test_variable_changes_across_buckets(spark):
    h = spark.sql("""select 1L instance, 'v' name, cast(t as timestamp_ntz) snapshot_ts,
        id event_id, value from values ('2024-01-01 01:00:00', 1L, 'a'),
        ('2024-01-01 02:00:00', 2L, 'a'), ('2024-01-03 00:00:00', 3L, 'b'),
        ('2024-01-09 00:00:00', 4L, null), ('2024-01-09 00:00:00', 5L, 'c') x(t, id, value)""")
    assert rows(drift.variable_changes(h, tie="event_id"), "event_id", "old_value", "new_value") == [
        (3, "a", "b"), (4, "b", None), (5, None, "c")]


def test_values(spark):
    df = spark.createDataFrame([("12K\t/x",), ("1.5G",), ("0",), ("7",), ("3T",), ("x",),
                                (None,)], "s string")
    got = [r[0] for r in df.select(values.parse_size(F.col("s"))).collect()]
    assert got == [12288, 1610612736, 0, 7, 3 << 40, None, None]
    numbers = spark.createDataFrame([("12",), ("",), ("x1",), ("99999999999999999999",)],
                                    "s string").select(as_bigint(F.col("s")))
    assert [r[0] for r in numbers.collect()] == [12, None, None, None]


def test_diff_of_the_catalog_view_with_itself_is_empty(spark, sf_dir):
    cols = view(spark, sf_dir, "m8_columns").drop("side").dropDuplicates(
        ["table_name", "column_name"])
    assert drift.column_drift(cols, cols).count() == 0
