"""Quality rules: fixed limits, and robust multivariate outliers by language and source.

DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stage

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Share of a group's documents that the minimum-covariance-determinant estimate rests on.
SUPPORT = 0.75
#: Documents that a language and source need for an estimate of their own; smaller ones share
#: that of their language, or else that of all documents.
MIN_GROUP = 60
#: Quantiles of the chi-squared distribution: for the reweighted estimate, and for rejection.
REWEIGHT, REJECT = 0.975, 0.99999
#: Statistics of a text are taken as if so many plain words of five characters stood in it too, so
#: that a share out of few words weighs less.
PRIOR_WORDS = 50
#: Least spread of each transformed statistic: differences below it are never remarkable.
SPREAD = (0.02, 0.05, 0.05, 0.05)
DIMENSIONS = len(SPREAD)
#: Transformed statistics are held as whole numbers of this part, so sums are exact and do not
#: depend on how rows are dealt out.
GRID = 1 << 12
#: Buckets of squared distances per factor e; a bucket is taken into a subset as one.
FINENESS = 32
#: Concentration steps at most, and the relative fall of the determinant that ends them.
ROUNDS, SETTLED = 20, 1e-3

_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]
_Z = [f"z{i}" for i in range(DIMENSIONS)]
_M = [f"m{i}" for i in range(DIMENSIONS)]
_L = [f"l{i}{j}" for i, j in _PAIRS]


def _chi2(x: float, dof: int) -> float:
    """Distribution function of chi-squared for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(share: float, dof: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, dof) < share else (low, middle)
    return (low + high) / 2


def consistency(share: float) -> float:
    """By how much the covariance of the innermost share of normal data is too small."""
    return share / _chi2(chi2_quantile(share), DIMENSIONS + 2)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column) -> Column:
    """Of an array of word hashes: words within windows of 8 that are found twice or more.

    Windows are hashed from pairs, fours and eights. Only a text with two equal windows is
    sorted: equal ones are neighbours then, and the words that their places cover are counted.
    """
    def paired(values: Column, step: int) -> Column:
        return F.zip_with(values, F.slice(values, step + 1, F.greatest(F.size(values), F.lit(1))),
                          lambda a, b: F.xxhash64(a, b))

    def covered(windows: Column) -> Column:
        places = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        equal = _bind(places, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(
            a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
        return F.aggregate(
            F.sort_array(F.array_distinct(F.flatten(equal))),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
            lambda a: a["n"])

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            covered(windows))

    eights = _bind(hashes, lambda one: _bind(paired(one, 1), lambda two: _bind(
        paired(two, 2), lambda four: paired(four, 4))))
    whole = F.slice(eights, 1, F.size(hashes) - (WINDOW - 1))
    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(_bind(whole, counted))


def statistics(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` and, per row: n_words, word_chars, n_symbols, n_lines (lines with a
    word), n_dup_lines, n_repeat_words, base_failed. NULL and empty texts have zeros and fail."""
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    stay = {f"keep_{i}": c for i, c in enumerate((keep or {}).values())}
    split = docs.select(*[c.alias(n) for n, c in stay.items()],
                        F.array_remove(F.split(column, SPACES), "").alias("words"),
                        F.filter(F.split(column, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
                        (F.size(F.split(column, SYMBOLS)) - 1).cast("long").alias("n_symbols"))
    counted = split.select(
        *stay, F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)).alias("word_chars"),
        "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _bind(F.transform("words", lambda w: F.xxhash64(w)), repeated_words).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select(*[F.col(n).alias(name) for n, name in zip(stay, keep or {})],
                          *counted.columns[len(stay):], failed.alias("base_failed"))


def _transformed() -> list[Column]:
    """Logarithm of the mean word length, and arcsine roots of the shares of symbols in characters, of
    repeated lines, and of words in repeated windows; whole numbers of 1/GRID."""
    words, chars = F.col("n_words") + PRIOR_WORDS, F.col("word_chars") + 5 * PRIOR_WORDS

    def root(part: str, of: Column) -> Column:
        return F.asin(F.sqrt(F.col(part) / of))
    values = [F.log(chars / words), root("n_symbols", chars), root("n_dup_lines", F.col("n_lines") + 10),
              root("n_repeat_words", words)]
    return [F.round(v * GRID).cast("long").alias(z) for v, z in zip(values, _Z)]


def _key(*parts: str) -> Column:
    """A group's key; NULL is a value of its own."""
    return F.to_json(F.array(*[F.col(p) for p in parts])) if parts else F.lit("[]")


def _groups(rows: DataFrame) -> DataFrame:
    """(lang, source, key, keys): where a group's documents are judged, and all estimates that are
    needed of groups they belong to."""
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    langs = own.groupBy("lang").agg(F.sum("n").alias("n_lang"), (F.min("n") < MIN_GROUP).alias("some_small"))
    langs = langs.withColumn("lang_small", F.col("n_lang") < MIN_GROUP).withColumnRenamed("lang", "_lang")
    all_needed = bool(langs.agg(F.max("lang_small")).first()[0])
    joined = own.join(langs, F.col("lang").eqNullSafe(F.col("_lang")))
    small = F.col("n") < MIN_GROUP
    key = F.when(~small, _key("lang", "source")).when(~F.col("lang_small"), _key("lang")).otherwise(_key())
    keys = F.array_compact(F.array(
        F.when(~small, _key("lang", "source")),
        F.when(F.col("some_small") & ~F.col("lang_small"), _key("lang")),
        F.when(F.lit(all_needed), _key())))
    return stage(joined.select("lang", "source", key.alias("key"), keys.alias("keys")), "groups")


def _factored(moments: DataFrame, by: list[str], factor: float) -> DataFrame:
    """(by, center m, Cholesky factor l, logdet) of sums: n, s0.. and the products c00..; the
    covariance is widened by ``factor`` and by the least spread."""
    cell: dict[tuple[int, int], Column] = {}
    df = moments.select(*by, *[(F.col(f"s{i}") / F.col("n")).alias(m) for i, m in enumerate(_M)], *[
        F.greatest(F.col(f"c{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n")),
                   F.lit(0.0 if i == j else -math.inf)).alias(f"v{i}{j}") for i, j in _PAIRS])
    for i, j in _PAIRS:
        value = F.col(f"v{i}{j}") * factor + (SPREAD[i] * GRID) ** 2 * (i == j)
        for k in range(j):
            value = value - cell[i, k] * cell[j, k]
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / cell[j, j])
        cell[i, j] = F.col(f"l{i}{j}")
    logdet = sum((F.log(cell[i, i]) for i in range(DIMENSIONS)), F.lit(0.0)) * 2
    return df.select(*by, *_M, *_L, logdet.alias("logdet"))


def distance() -> Column:
    """Squared Mahalanobis distance of z from m, with the Cholesky factor l."""
    solved: list[Column] = []
    for i in range(DIMENSIONS):
        value = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * solved[k]
        solved.append(value / F.col(f"l{i}{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _moments() -> list[Column]:
    return [F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col(z)).alias(f"s{i}") for i, z in enumerate(_Z)],
            *[F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}{j}") for i, j in _PAIRS]]


_SUMS = ["n", *[f"s{i}" for i in range(DIMENSIONS)], *[f"c{i}{j}" for i, j in _PAIRS]]


def _concentrated(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: the estimate of the documents that are nearest to the last one.

    Distances fall into fine buckets, and sums are kept per bucket; of the bucket in which the
    support ends all documents count in equal part. So no group is sorted, and a group is as
    many rows as it has buckets, wherever its documents are.
    """
    bucket = F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-9))) * FINENESS)
    near = points.join(estimates, "key").withColumn("d2", distance()).groupBy(
        "start", "key", bucket.alias("bucket")).agg(*_moments())
    whole = Window.partitionBy("start", "key")
    below = F.sum("n").over(whole.orderBy("bucket")) - F.col("n")
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("support") - F.col("below")) / F.col("n")))
    taken = near.withColumn("support", F.ceil(F.sum("n").over(whole) * SUPPORT)).withColumn("below", below).withColumn(
        "part", part)
    return _factored(taken.groupBy("start", "key").agg(*[F.sum(F.col(s) * F.col("part")).alias(s) for s in _SUMS]),
                     ["start", "key"], 1.0)


def _starts(points: DataFrame) -> DataFrame:
    """Two first estimates a group: mean and covariance of all, and medians with quartile spreads."""
    classical = _factored(points.groupBy("key").agg(*_moments()), ["key"], 1.0)
    quartiles = points.groupBy("key").agg(*[
        F.percentile_approx(z, [0.25, 0.5, 0.75], 1000, ).alias(z) for z in _Z])
    middle = quartiles.select(
        "key", *[F.col(z)[1].cast("double").alias(m) for z, m in zip(_Z, _M)],
        *[(F.sqrt(F.pow((F.col(f"z{i}")[2] - F.col(f"z{i}")[0]) / 1.349, 2.0) + (SPREAD[i] * GRID) ** 2)
           if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS], F.lit(None).cast("double").alias("logdet"))
    return classical.withColumn("start", F.lit(0)).unionByName(middle.withColumn("start", F.lit(1)))


def estimates(points: DataFrame) -> DataFrame:
    """(key, m.., l..): reweighted minimum-covariance-determinant estimate of each group of
    ``points`` (key, z.., w: number of documents).

    From two starts concentration steps lower the determinant until it settles for all groups;
    the lower one of the two is kept, made consistent with normal data, and taken once more
    over the documents within its 97.5 % ellipsoid.
    """
    now = stage(_starts(points), "starts")
    for _ in range(ROUNDS):
        then, now = now, stage(_concentrated(points, now), "step")
        moved = now.alias("a").join(then.alias("b"), ["start", "key"]).filter(
            "b.logdet is null or abs(a.logdet - b.logdet) > %r" % SETTLED)
        if moved.isEmpty():
            break
    best = now.groupBy("key").agg(F.min_by(F.struct(*_M, *_L), F.struct("logdet", "start")).alias("best")).select(
        "key", "best.*")
    raw = points.join(best, "key").filter(distance() <= chi2_quantile(REWEIGHT) * consistency(SUPPORT))
    kept = _factored(raw.groupBy("key").agg(*_moments()), ["key"], consistency(REWEIGHT))
    # An estimate whose own ellipsoid holds no document (far apart halves) stays as it is.
    return stage(best.select("key").join(kept, "key", "left").join(
        best.select("key", *[F.col(c).alias(f"old_{c}") for c in (*_M, *_L)]), "key").select(
        "key", *[F.coalesce(c, f"old_{c}").alias(c) for c in (*_M, *_L)]), "estimates")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, base_failed, distance, kept.

    The base rules fail texts of fewer than 20 words and those with over 30 % of their words in
    repeated windows of 8. Every other text is a point of four transformed statistics, and is
    rejected where its squared Mahalanobis distance (``distance``) from the robust estimate of
    its language and source is beyond the 99.999 % quantile. Estimates rest on all texts with a
    word, those that fail the base rules too. A language and source with fewer than 60 texts is
    judged by its language, or else by all.

    NULL and empty texts have no words and fail; their distance is NULL. NULL languages and
    sources are groups of their own. Rows with equal ids are judged each for itself; copies
    enter the estimates with their number. Missing ``lang`` or ``source`` columns count as NULL.
    Windows and words are told apart by 64-bit hashes. Texts are read once; what is staged and
    shuffled are the numbers.
    """
    keep = {"doc_id": F.col(doc_id)} | {name: (F.col(c) if c in docs.columns else F.lit(None)).cast("string")
                                        for name, c in (("lang", lang), ("source", source))}
    counted = statistics(docs, text, keep)
    worded = F.col("n_words") > 0
    rows = stage(counted.select("*", *[F.when(worded, z).alias(n) for z, n in zip(_transformed(), _Z)]), "statistics")
    with_words = rows.filter(worded)
    groups = _groups(with_words)
    same = [F.col("r.lang").eqNullSafe(F.col("g.lang")), F.col("r.source").eqNullSafe(F.col("g.source"))]
    cells = with_words.groupBy("lang", "source", *_Z).agg(F.count("*").alias("w"))
    points = stage(cells.alias("r").join(groups.alias("g"), same).select(
        F.explode("g.keys").alias("key"), *[f"r.{z}" for z in _Z], "r.w"), "points")
    found = estimates(points)
    limits = groups.join(found, "key").drop("key", "keys")
    judged = rows.alias("r").join(limits.alias("g"), same, "left").select(
        *[f"r.{c}" for c in rows.columns if c not in _Z], F.when(worded, distance()).alias("distance"))
    inside = F.col("distance") <= chi2_quantile(REJECT)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
