"""Merkle manifest of a dataset: hash trees over its rows, with nested-interval labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stage

#: Children of a node.
FAN = 3
#: Levels that one pass builds. A block is what one node so many levels up covers, so it holds at
#: most ``FAN ** BAND`` nodes of the pass's lowest level, whatever the data.
BAND = 5
BLOCK = FAN ** BAND

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "struct<lo:bigint,hi:bigint,digest:string>"
_STEP = "struct<before:string,after:string,n:int>"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: tree, rank, digest, changed, doc_id, path, subroot, root; ``nodes``: tree, source,
    level, lo, hi, digest, of all trees; the tree of the subroots has tree NULL."""

    leaves: DataFrame
    nodes: DataFrame


def digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields one behind the other: ``-`` for NULL, else the UTF-8
    length, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")),
                        F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (0, 1, ... in ``order`` within a tree) and ``size`` (of the tree).

    Rows are dealt by ranges of (tree, order), so a tree that holds most rows is many tasks.
    Each range counts its own rows a tree; only these counts, one row per range and tree, are
    summed up across ranges.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    dealt = stage(dealt.withColumn("_row", F.monotonically_increasing_id()), "ranges").withColumn(
        "_part", F.shiftright("_row", 33))
    counts = dealt.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    along = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_at"),
                           (F.coalesce(F.sum("_n").over(along), F.lit(0)) - F.col("_first")).alias("_start"),
                           F.sum("_n").over(Window.partitionBy(tree)).alias("size"))
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_part") == F.col("_at"))
    return dealt.join(starts, same).select(
        *[F.col(c) for c in rows.columns], (F.col("_start") + F.col("_row")).alias("rank"), "size")


def _parents(nodes: str) -> str:
    """SQL: the level above an array of nodes; each covers its children's interval of ranks."""
    run = f"slice({nodes}, {FAN} * q + 1, {FAN})"
    return f"""transform(sequence(0, (size({nodes}) - 1) div {FAN}), q -> transform(array({run}), r ->
        struct(r[0].lo as lo, r[size(r) - 1].hi as hi,
               sha2(cast(array_join(transform(r, c -> c.digest), '') as binary), 256) as digest))[0])"""


def _levels(size: str) -> str:
    """SQL: a block's nodes level by level. A tree of one block ends at its single root; else all
    levels of the band are built, up to one node a block."""
    return f"""aggregate(sequence(1, {BAND}), array(base),
        (built, i) -> if({size} <= {BLOCK} and size(built[size(built) - 1]) = 1, built,
                         concat(built, array({_parents('built[size(built) - 1]')}))))"""


def _steps() -> str:
    """SQL: for a node's first rank ``lo``, its siblings at each level of the block. Each level is
    looked up by the bucket of its parent's interval; the children of this parent that end at
    or before ``lo``, or begin behind it, are what the own interval leaves of the parent's."""
    return f"""transform(sequence(1, size(levels) - 1), l -> transform(array(slice(levels[l - 1],
        cast({FAN} * ((at div cast(power({FAN}, l) as bigint))) as int) + 1, {FAN})), run -> struct(
            array_join(transform(filter(run, c -> c.hi <= lo), c -> c.digest), '') as before,
            array_join(transform(filter(run, c -> c.lo > lo), c -> c.digest), '') as after,
            cast(size(run) - 1 as int) as n))[0])"""


def _forest(leaves: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, roots, nodes) of trees over rows (tree, rank, size, digest, *keep).

    Leaves get ``path``: per level from the bottom up the siblings' digests to the left and to the
    right. Roots are (tree, digest). Nodes are (tree, level, lo, hi, digest), leaves left out.

    Upwards, each pass groups the nodes of a level into blocks and builds ``BAND`` levels in
    each; downwards, blocks meet the path of the ancestor that covers their interval by (tree,
    bucket of ranks at that ancestor's level). No key of either shuffle has more than
    ``BLOCK`` rows, so the number of rows a tree has makes no hot key.
    """
    passes, roots, nodes = [], [], []
    extra = ["lo", "hi", "digest", *keep]
    rows = leaves.select("tree", "size", F.col("rank").alias("at"), F.col("rank").alias("lo"),
                         (F.col("rank") + 1).alias("hi"), "digest", *keep)
    while True:
        block = F.struct("at", *extra)
        grouped = rows.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("tree", "size", "block").agg(
            F.sort_array(F.collect_list(block)).alias("rows"))
        based = grouped.withColumn("base", F.expr(f"transform(rows, c -> cast(struct(c.lo, c.hi, c.digest) as {_NODE}))"))
        built = stage(based.select("tree", "size", "block", "rows", F.expr(_levels("size")).alias("levels")), "blocks")
        level = BAND * len(passes)
        nodes.append(built.select("tree", F.posexplode("levels").alias("up", "own")).filter("up > 0").select(
            "tree", (F.col("up") + level).alias("level"), F.explode("own").alias("node")).select("tree", "level", "node.*"))
        passes.append(built)
        top = F.expr("levels[size(levels) - 1][0]")
        roots.append(built.filter(F.col("size") <= BLOCK).select("tree", top["digest"].alias("digest")))
        rows = built.filter(F.col("size") > BLOCK).select(
            "tree", F.ceil(F.col("size") / BLOCK).alias("size"), F.col("block").alias("at"),
            top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"))
        extra = ["lo", "hi", "digest"]
        if rows.isEmpty():
            break
    above = None
    for number in range(len(passes) - 1, -1, -1):
        built = passes[number]
        if above is None:
            met = built.withColumn("above", F.expr(f"cast(array() as array<{_STEP}>)"))
        else:
            up = above.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("path").alias("above"))
            met = built.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_at")), "left")
        each = met.select("tree", "levels", "above", F.explode("rows").alias("row")).select(
            "tree", "levels", "above", (F.col("row.at") % BLOCK).alias("at"), F.col("row.at").alias("place"),
            F.col("row.lo").alias("lo"), F.col("row.digest").alias("digest"),
            *[F.col(f"row.{c}").alias(c) for c in (keep if number == 0 else [])])
        own = F.when(F.size("levels") > 1, F.expr(_steps())).otherwise(F.expr(f"cast(array() as array<{_STEP}>)"))
        path = F.concat(own, F.coalesce("above", F.expr(f"cast(array() as array<{_STEP}>)"))).alias("path")
        if number:
            above = stage(each.select("tree", F.col("place").alias("at"), path), "paths")
        else:
            done = each.select("tree", F.col("place").alias("rank"), "digest", *keep, path)
    ends, all_nodes = roots[0], nodes[0]
    for more_roots, more_nodes in zip(roots[1:], nodes[1:]):
        ends, all_nodes = ends.union(more_roots), all_nodes.union(more_nodes)
    return done, ends, all_nodes


def fold(path: Column, start: Column) -> Column:
    """The root that a digest and the siblings along its path lead to."""
    return F.aggregate(path, start, lambda own, s: F.sha2(
        F.concat(s["before"], own, s["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All siblings' digests of a path, level by level from the bottom, left to right, in one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def merkle_manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Hash trees over the rows of ``docs``, one per source, and one over their roots.

    A leaf is the digest of (doc_id, source, lang, n_chars, text). Within a source leaves ascend by
    doc_id (NULL first; equal ids by digest); every three consecutive nodes become their digest
    until one is left. The subroots, ordered by source (NULL first, bytewise), do likewise.
    Every node carries the interval [lo, hi) of leaf ranks that it covers.

    ``changed`` is a text expression over the columns of ``docs``: the leaf that a row has with
    this text stands as ``changed`` beside its own, to be folded along the same path. Missing
    columns, NULLs and empty texts have defined leaves; rows equal in all fields have equal
    leaves at neighbouring ranks; an empty table has no rows and no root. Other columns play no
    part. Texts are read once, in one scan; only digests are shuffled.
    """
    column = {f: F.col(f) if f in docs.columns else F.lit(None) for f in FIELDS}
    text = changed if changed is not None else column["text"]
    rows = docs.select(
        column["doc_id"].cast("long").alias("doc_id"), column["source"].cast("string").alias("tree"),
        digest(*column.values()).alias("digest"),
        digest(*[column[f] for f in FIELDS[:-1]], text).alias("changed"))
    rows = stage(rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed"))), "leaves")
    leaves, roots, nodes = _forest(_ranked(rows, "tree", ["doc_id", "digest"]), ["doc_id", "changed"])
    lone = stage(roots.select("tree", "digest"), "subroots")
    upper = _ranked(lone.select(F.lit(0).alias("all"), F.col("tree").alias("source"), "digest"), "all", ["source"])
    tops, root, top_nodes = _forest(upper.withColumnRenamed("all", "tree"), ["source"])
    tops = stage(tops.join(root.select("tree", F.col("digest").alias("root")), "tree").select(
        F.col("source").alias("_source"), F.col("digest").alias("subroot"), F.col("path").alias("upper"), "root"), "tops")
    joined = leaves.join(tops, F.col("tree").eqNullSafe(F.col("_source"))).select(
        F.col("tree").alias("source"), "rank", "doc_id", "digest", "changed",
        F.concat("path", "upper").alias("path"), "subroot", "root")
    text_type = docs.schema["source"].dataType if "source" in docs.columns else "string"
    every = nodes.select(F.col("tree").cast(text_type).alias("source"), F.lit(False).alias("is_top"),
                         "level", "lo", "hi", "digest").union(
        top_nodes.select(F.lit(None).cast(text_type), F.lit(True), "level", "lo", "hi", "digest"))
    return Manifest(joined, every)
