"""Column functions for create statements and connection addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = {"engine": "ENGINE", "auto_increment": "AUTO_INCREMENT", "charset": "CHARSET",
           "collate": "COLLATE"}


def table_options(create_sql: Column) -> Column:
    """STRUCT<engine, auto_increment, charset, collate> of the statement's last line, an
    empty string for an option that is absent."""
    tail = F.element_at(F.split(create_sql, "\n"), -1)
    return F.struct(*[F.regexp_extract(tail, rf"\b{word}=(\S+)", 1).alias(name)
                      for name, word in OPTIONS.items()])


def _body(create_sql: Column) -> Column:
    return F.transform(F.split(create_sql, "\n"),
                       lambda x: F.regexp_replace(F.btrim(x, F.lit(" \t\r")), ",$", ""))


def column_definition(create_sql: Column, column: Column) -> Column:
    """Definition line of the column: whole line, exact back-quoted name."""
    head = F.concat(F.lit("`"), column, F.lit("` "))
    return F.try_element_at(F.filter(_body(create_sql), lambda x: x.startswith(head)),
                            F.lit(1))


def index_lines(create_sql: Column) -> Column:
    """Lines that define keys."""
    return F.filter(_body(create_sql),
                    lambda x: x.rlike(r"^(PRIMARY |UNIQUE |FULLTEXT |SPATIAL )?KEY\b"))


def index_definition(create_sql: Column, key_name: Column) -> Column:
    """Key line of one index, by exact name; PRIMARY is the unnamed primary key."""
    named = F.concat(F.lit("KEY `"), key_name, F.lit("`"))
    return F.try_element_at(F.filter(index_lines(create_sql), lambda x: F.when(
        key_name == "PRIMARY", x.startswith("PRIMARY KEY")).otherwise(x.contains(named))),
        F.lit(1))


def definition_lines(create_sql: Column) -> Column:
    """``ARRAY<STRUCT<element_kind, element, definition>>`` of all column and key lines; the primary
    key is named PRIMARY."""
    key = r"^(?:UNIQUE |FULLTEXT |SPATIAL )?KEY `((?:[^`]|``)+)`"

    def named(line: Column, pattern: str) -> Column:
        return F.replace(F.regexp_extract(line, pattern, 1), F.lit("``"), F.lit("`"))

    def entry(line: Column) -> Column:
        kind = F.when(line.startswith("`"), "column").when(
            line.startswith("PRIMARY KEY") | line.rlike(key), "index")
        name = F.when(line.startswith("`"), named(line, r"^`((?:[^`]|``)+)`")).when(
            line.startswith("PRIMARY KEY"), "PRIMARY").otherwise(named(line, key))
        return F.struct(kind.alias("element_kind"), name.alias("element"), line.alias("definition"))
    return F.filter(F.transform(_body(create_sql), entry), lambda e: e["element_kind"].isNotNull())


_URL = r"^([^:@]*)(?::(.*))?@([^@:/]+):(\d+)/(.*)$"


def parse_conn_url(url: Column) -> Column:
    """STRUCT<user, host, port, db> of ``user:password@host:port/db``; the password is
    dropped. NULL for any other text."""
    def part(i: int) -> Column:
        return F.regexp_extract(url, _URL, i)
    return F.when(url.rlike(_URL), F.struct(
        part(1).alias("user"), part(3).alias("host"),
        part(4).try_cast("int").alias("port"), part(5).alias("db")))
