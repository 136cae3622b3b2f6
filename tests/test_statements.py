"""Table references of statements."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import statements
from fleetlens.functions.statements import extract_tables

CASES = [
    ("select * from a", [(None, "a", None)]),
    ("SELECT x FROM db1.a AS q, b r, `odd name`",
     [("db1", "a", "q"), (None, "b", "r"), (None, "odd name", None)]),
    ("select * from abc join def on abc.id = def.id left outer join s.ghi g on 1=1",
     [(None, "abc", None), (None, "def", None), ("s", "ghi", "g")]),
    ("select * from (select id from inner_t where x in (select y from deep)) z",
     [(None, "inner_t", None), (None, "deep", None)]),
    ("insert into t1 (c1, c2) values (1, 'from x')", [(None, "t1", None)]),
    ("insert into t1 select a, b from t2, t3",
     [(None, "t1", None), (None, "t2", None), (None, "t3", None)]),
    ("insert into t1 values (1) on duplicate key update c = 2", [(None, "t1", None)]),
    ("update low_priority t1 set a = 1 where b = 2", [(None, "t1", None)]),
    ("update t1, t2 set t1.a = t2.a", [(None, "t1", None), (None, "t2", None)]),
    ("alter table `s`.`t` add column c int", [("s", "t", None)]),
    ("drop table if exists a, b", [(None, "a", None), (None, "b", None)]),
    ("delete from t where x = 1", [(None, "t", None)]),
    ("select 'text from nowhere' from real_t", [(None, "real_t", None)]),
    ("select \"from quoted\" from real_t", [(None, "real_t", None)]),
    ("select 1 /* from hidden */ from shown -- from tail\n where 1", [(None, "shown", None)]),
    ("select 1 from shown # from tail", [(None, "shown", None)]),
    ("select * from t where id = 1 for update", [(None, "t", None)]),
    ("select extract(year from ts) from t", [(None, "t", None)]),
    ("select * from order", []), ("select * from group where 1", []),
    ("select 1", []), ("commit", []), ("flush tables with read lock", []),
    ("", []), (None, []),
    ("select * from a straight_join b", [(None, "a", None), (None, "b", None)]),
    ("insert t values (1)", [(None, "t", None)]),
    ("insert ignore t values (1)", [(None, "t", None)]),
    ("insert ignore into t values (1)", [(None, "t", None)]),
    ("truncate t1", [(None, "t1", None)]), ("truncate table t1", [(None, "t1", None)]),
    ("select * from 2020_orders o", [(None, "2020_orders", "o")]),
    ("select * from `we``ird` w", [(None, "we`ird", "w")]),
    ("select 'it''s from a' , 'b\\' from c' from d", [(None, "d", None)]),
]


@pytest.mark.parametrize("sql,expected", CASES)
def test_references(spark, sql, expected):
    df = spark.createDataFrame([(sql,)], "s string")
    found = df.select(extract_tables(F.col("s")).alias("t")).collect()[0]["t"]
    assert [tuple(x) for x in found] == expected


def refs(text):
    """``s.a x, b`` as the expected list."""
    out = []
    for one in filter(None, (t.strip() for t in text.split(","))):
        name, _, alias = one.partition(" ")
        schema, _, table = name.rpartition(".")
        out.append((schema or None, table, alias or None))
    return out


NESTED = [
    ("select * from (select 1 from x) z, b", "x, b"),
    ("select * from a join b on a.id = b.id, c", "a, b, c"),
    ("select * from a x join b as y using (id, k), s.c z where f(1, 2) > 3", "a x, b y, s.c z"),
    ("select * from (a, b) left join (c cross join d) on a.i = c.i and f(b.j, 1) = d.j, e where x in (1, 2)", "a, b, c, d, e"),
    ("select (select max(q, 1) from n1), 2 from n2, (select * from n3, (select 1, 2 from n4) i) o, n5 order by 1, 2",
     "n1, n2, n3, n4, n5"),
    ("select * from a where i in (select i from b, c where k in (1, 2)) and j in (select j from d), e", "a, b, c, d"),
    ("insert into t (a, b) select x, y from u join v on u.i in (select i, j from w), z on duplicate key update a = 1",
     "t, u, v, w, z"),
    ("insert into t (a, b) values (1, 2), (3, 4)", "t"),
    ("update a join b on a.i = b.i, c set a.x = (select 1, 2 from d)", "a, b, c, d"),
    ("delete a, b from a join b using (i), c where a.i = 1", "a, b, c"),
    ("select * from t1 use index (i1, i2), t2 force index (k) x", "t1, t2"),
    ("select * from t1 partition (p0, p1), lateral (select 1, 2 from t2) l, t3", "t1, t2, t3"),
    ("select a, b from order, t where f(1, 2)", ""), ("select f(a, b)", ""), ("from (", ""), (")), from a, b on (", "a, b"),
    ("with q as (select 1, 2 from a) select * from q, b", "a, q, b"),
    ("select * from " + "(select a, b from " * 40 + "deep" + ") x" * 40 + ", last", "deep, last"),
    ("select * from a on 1 = 1, " + ", ".join(f"t{i}" for i in range(300)), "a, " + ", ".join(f"t{i}" for i in range(300))),
]


@pytest.mark.parametrize("sql,expected", NESTED)
def test_nested_references(spark, sql, expected):
    df = spark.createDataFrame([(sql,)], "s string")
    found = df.select(extract_tables(F.col("s")).alias("t")).collect()[0]["t"]
    assert [tuple(x) for x in found] == refs(expected)


def test_fold_agrees_with_the_pattern(spark):
    """Simple statements give the same both ways."""
    texts = [c[0] or "" for c in CASES if c[0] is None or not any(x in c[0] for x in ("(", "lock"))]
    df = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("c", statements.clean_statement(F.col("s")))
    found = df.select("s", extract_tables(F.col("s")).alias("t"), statements._fold(
        F.regexp_extract_all("c", F.lit(statements._TOKENS), 0)).alias("f")).collect()
    for r in found:
        assert len(r.t) == len(r.f), r.s
