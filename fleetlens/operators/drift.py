"""Differences between two catalogs and between two configurations.

``scope`` names extra key columns (a database, a pair of servers), so that one job compares
any number of pairs; it is empty for a single pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ddl import OPTIONS, definition_lines, table_options
from fleetlens.functions.values import norm_name, norm_value
from fleetlens.operators.ordered import bucketed_offset

COLUMN_ATTRIBUTES = ("type", "nullable", "column_key", "default_value", "extra")


def _missing(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either side without a partner, with the side that lacks them."""
    return (a.join(b.select(*keys), list(keys), "left_anti")
            .withColumn("missing_on", F.lit("B"))
            .unionByName(b.join(a.select(*keys), list(keys), "left_anti")
                         .withColumn("missing_on", F.lit("A"))))


def _table_names(df: DataFrame, scope: Sequence[str]) -> DataFrame:
    return df.select(*scope, "table_name").distinct()


def missing_tables(a: DataFrame, b: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return _missing(_table_names(a, scope), _table_names(b, scope), [*scope, "table_name"])


def common_tables(a: DataFrame, b: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return _table_names(a, scope).join(_table_names(b, scope), [*scope, "table_name"],
                                       "left_semi")


def _in_common(missing: DataFrame, a: DataFrame, b: DataFrame,
               scope: Sequence[str]) -> DataFrame:
    return missing.join(common_tables(a, b, scope), [*scope, "table_name"], "left_semi")


def missing_columns(a: DataFrame, b: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Columns only one side has, within tables both have, with their definition."""
    keys = [*scope, "table_name", "column_name"]
    cols = [*keys, *COLUMN_ATTRIBUTES]
    return _in_common(_missing(a.select(*cols), b.select(*cols), keys), a, b, scope)


def collapse_indexes(parts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Index parts to one row per index, columns joined in part order. The list of one
    index is short by nature: servers allow at most 16 parts."""
    part = F.sort_array(F.collect_list(F.struct("seq_in_index", "column_name", "nullable")))
    rows = parts.groupBy(*scope, "table_name", "key_name").agg(part.alias("_parts"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("_parts", lambda p: p[name]), ", ")
    return rows.select(*scope, "table_name", "key_name",
                       joined("column_name").alias("columns"),
                       joined("nullable").alias("nulls"))


def missing_indexes(a: DataFrame, b: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Indexes (collapsed) only one side has, within tables both have."""
    keys = [*scope, "table_name", "key_name"]
    return _in_common(_missing(a, b, keys), a, b, scope)


def _differing(a: DataFrame, b: DataFrame, keys: Sequence[str],
               attributes: Sequence[str]) -> DataFrame:
    """Inner join on keys, rows where any attribute differs (NULL equals NULL only)."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in attributes])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in attributes])
    names = F.array_compact(F.array(*[
        F.when(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), c) for c in attributes]))
    return (left.join(right, list(keys))
            .withColumn("differences", F.array_join(names, ","))
            .filter("differences <> ''"))


def column_drift(a: DataFrame, b: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return _differing(a, b, [*scope, "table_name", "column_name"], COLUMN_ATTRIBUTES)


def index_drift(a: DataFrame, b: DataFrame, scope: Sequence[str] = (),
                extended: bool = False) -> DataFrame:
    """Indexes (collapsed) whose columns or null flags differ. ``extended`` also compares a
    ``uniqueness`` column that the inputs then carry."""
    attributes = ["columns", "nulls", *(["uniqueness"] if extended else [])]
    return _differing(a, b, [*scope, "table_name", "key_name"], attributes)


def table_option_drift(a: DataFrame, b: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Engine, auto increment, character set and collation that differ, one row each."""
    keys = [*scope, "table_name"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, table_options(F.col("create_sql")).alias(name))
    pairs = F.array(*[F.struct(F.lit(o).alias("option"), F.col("a")[o].alias("value_a"),
                               F.col("b")[o].alias("value_b")) for o in OPTIONS])
    return (side(a, "a").join(side(b, "b"), keys)
            .select(*keys, F.inline(pairs)).filter("value_a <> value_b"))


def _paired(a: DataFrame, b: DataFrame, keys: Sequence[str],
            attributes: Sequence[str]) -> DataFrame:
    """Full outer join on keys: each attribute of both sides, and which sides exist."""
    sides = [d.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in attributes],
                      F.lit(True).alias(f"in_{s}")) for d, s in ((a, "a"), (b, "b"))]
    return sides[0].join(sides[1], list(keys), "full")


def _findings(pairs: DataFrame, scope: Sequence[str], element: Column, kind: str,
              attributes: dict[str, Column], shown: str | None) -> DataFrame:
    """A missing element as one row, a differing one as a row per attribute."""
    lone = F.col("in_a").isNull() | F.col("in_b").isNull()

    def value(side: str) -> Column:
        if shown is None:
            return F.when(F.col(f"in_{side}"), "present")
        return F.col(f"{shown}_{side}")
    rows = [F.when(lone, F.struct(F.lit(f"missing_{kind[0]}").alias("kind"),
                                  element.alias("name"), value("a").alias("side_a"),
                                  value("b").alias("side_b")))]
    for c, name in attributes.items():
        left, right = F.col(f"{c}_a"), F.col(f"{c}_b")
        rows.append(F.when(~lone & ~left.eqNullSafe(right), F.struct(
            F.lit(kind[1]).alias("kind"), name.alias("name"), left.alias("side_a"),
            right.alias("side_b"))))
    return pairs.select(*scope, "table_name", F.inline(F.array_compact(F.array(*rows))))


def schema_diff(tables_a: DataFrame, tables_b: DataFrame, columns_a: DataFrame,
                columns_b: DataFrame, indexes_a: DataFrame, indexes_b: DataFrame,
                scope: Sequence[str] = ()) -> DataFrame:
    """Every structural difference of two catalogs in one table of findings. ``tables_*``
    (one row per table) decide which tables exist; ``indexes_*`` are index parts.

    One full outer join per level (tables, columns, indexes) gives the missing and the
    differing elements together; elements count only in tables both sides have.
    """
    keys = [*scope, "table_name"]

    def options(df: DataFrame) -> DataFrame:
        return df.select(*keys, table_options(F.col("create_sql")).alias("o")).select(
            *keys, *[F.col("o")[o].alias(o) for o in OPTIONS])
    tables = _paired(options(tables_a), options(tables_b), keys, list(OPTIONS))
    shared = tables.filter("in_a and in_b").select(*keys)

    def inner(a: DataFrame, b: DataFrame, element: str, attributes: Sequence[str],
              kind: tuple[str, str], shown: str) -> DataFrame:
        pairs = _paired(a, b, [*keys, element], attributes).join(shared, keys, "left_semi")
        names = {c: F.concat(F.col(element), F.lit(f".{c}")) for c in attributes}
        return _findings(pairs, scope, F.col(element), kind, names, shown)
    found = (
        _findings(tables, scope, F.lit(None).cast("string"), ("table", "option"),
                  {o: F.lit(o) for o in OPTIONS}, None),
        inner(columns_a, columns_b, "column_name", COLUMN_ATTRIBUTES,
              ("column", "column"), "type"),
        inner(collapse_indexes(indexes_a, scope), collapse_indexes(indexes_b, scope),
              "key_name", ("columns", "nulls"), ("index", "index"), "columns"))
    return reduce(DataFrame.unionByName, found)


def definition_index(tables: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(table_name, element_kind, element, definition): one row per column and key that a create
    statement defines; each statement is cut once."""
    return tables.select(*scope, "table_name", F.inline(definition_lines(F.col("create_sql"))))


def with_definitions(diff: DataFrame, tables_a: DataFrame, tables_b: DataFrame,
                     scope: Sequence[str] = ()) -> DataFrame:
    """Add the defining lines of both create statements to column and index findings.

    A finding's element is its whole name if it is missing, else the name without the attribute
    behind its last dot (attributes have none); elements meet the definition index by kind and name.
    """
    keys = [*scope, "table_name", "element_kind", "element"]
    missing = F.col("kind").startswith("missing_")
    kind = F.when(F.col("kind").isin("column", "missing_column"), "column").when(
        F.col("kind").isin("index", "missing_index"), "index")
    element = F.when(missing, F.col("name")).otherwise(F.regexp_replace("name", r"\.[^.]*$", ""))
    told = diff.withColumn("element_kind", kind).withColumn("element", element)
    for tables, side in ((tables_a, "a"), (tables_b, "b")):
        told = told.join(definition_index(tables, scope).withColumnRenamed("definition", f"definition_{side}"),
                         keys, "left")
    return told.select(*diff.columns, "definition_a", "definition_b")


def config_drift(file_vars: DataFrame, live: DataFrame, dynamic: DataFrame,
                 scope: Sequence[str] = ()) -> DataFrame:
    """Dynamic variables whose value in the file differs from the running server's."""
    wanted = file_vars.withColumn("name", norm_name(F.col("name"))).join(
        dynamic, "name", "left_semi")
    return (wanted.select(*scope, "name", F.col("value").alias("file_value"))
            .join(live.select(*scope, "name", F.col("value").alias("live_value")),
                  [*scope, "name"])
            .filter(norm_value(F.col("file_value")) != norm_value(F.col("live_value"))))


def instance_drift(variables: DataFrame, pairs: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Dynamic variables that differ between the two instances of each (src, dest) pair."""
    wanted = variables.join(dynamic, "name", "left_semi")

    def side(role: str) -> DataFrame:
        return wanted.join(pairs.withColumnRenamed(role, "instance"), "instance").select(
            F.col("instance").alias("src") if role == "src" else "src",
            F.col("instance").alias("dest") if role == "dest" else "dest",
            "name", F.col("value").alias(f"{role}_value"),
            F.lit(True).alias(f"_{role}"))
    status = (F.when(F.col("_dest").isNull(), "only_src")
              .when(F.col("_src").isNull(), "only_dest").otherwise("differs"))
    return (side("src").join(side("dest"), ["src", "dest", "name"], "full")
            .filter(F.col("_src").isNull() | F.col("_dest").isNull()
                    | ~F.col("src_value").eqNullSafe(F.col("dest_value")))
            .withColumn("status", status).drop("_src", "_dest"))


def variable_changes(history: DataFrame, tie: str | None = None,
                     bucket: str = "day") -> DataFrame:
    """Changes of a variable between consecutive snapshots of an instance; ``tie`` is a
    column that orders rows of the same moment, which without it have no defined order: give one
    where a moment repeats. A busy variable is split by ``bucket``; no
    task sorts its whole history."""
    keyed = history.withColumn("_bucket", F.date_trunc(bucket, F.col("snapshot_ts"))
                               .cast("timestamp_ntz"))
    order = ["snapshot_ts", *([tie] if tie else [])]
    seen = keyed.withColumn("_here", F.lit(True))
    moved = bucketed_offset(seen, ["instance", "name"], "_bucket", order,
                            {"value": "old_value", "_here": "_before"})
    return (moved.filter(F.col("_before") & ~F.col("old_value").eqNullSafe(F.col("value")))
            .select("instance", "name", *order, "old_value",
                    F.col("value").alias("new_value")))


def render_schema_diff(diff: DataFrame) -> DataFrame:
    """One line of text per finding, for a text sink."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("-"))
    return diff.select(F.format_string(
        "[%s] table %s %s: A=%s B=%s", "kind", "table_name", shown("name"),
        shown("side_a"), shown("side_b")).alias("value"))
