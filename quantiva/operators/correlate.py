"""Correlation (C1-C10): Pearson, Spearman, Kendall tau-b; pairs, matrix, summary.

Every pair is pairwise-complete: rows where either value is NULL are left
out of that pair only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import AnalysisError, ValidationError
from ..functions import labels
from ..functions.columns import as_double, check_columns, col, name_at
from . import gram, ranks
from .describe import resolve_numeric

METHODS = ("pearson", "spearman", "kendall")


def _pair_exprs(a, b, i: int):
    both = a.isNotNull() & b.isNotNull()
    a2, b2 = F.when(both, a), F.when(both, b)
    denom = F.stddev_pop(a2) * F.stddev_pop(b2)
    # zero variance gives NULL (plain corr would divide by zero under ANSI); merged deviations of a constant
    # may be above 0 by rounding
    varies = (F.min(a2) < F.max(a2)) & (F.min(b2) < F.max(b2))
    r = F.try_divide(F.covar_pop(a2, b2), F.when(varies & (denom > 0), denom))
    return [F.count_if(both).alias(f"n{i}"), r.alias(f"r{i}")]


def _pearson_pairs(df: DataFrame, exprs: dict[str, object], pairs: list[tuple[str, str]]) -> DataFrame:
    """One aggregate for all pairs; result long: column1, column2, n, correlation."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += _pair_exprs(exprs[a], exprs[b], i)
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.col(f"n{i}").cast("long").alias("n"),
                     F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    out = wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    # clamp rounding noise beyond +-1
    r = F.col("correlation")  # least/greatest skip NULLs, so clamp only defined values
    return out.withColumn("correlation", F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))))


def _centered_pairs(df: DataFrame, exprs: dict[str, object], means: dict[str, float], n: int,
                    pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson for null-free columns from centred sums (two-pass accuracy):
    r = S_ab / sqrt(S_aa S_bb), S = sum of products of deviations from the
    column means.  C + C(C-1)/2 plain sums in one aggregate."""
    cols = sorted({c for p in pairs for c in p})
    dev = {c: exprs[c] - F.lit(float(means[c])) for c in cols}
    aggs = [F.sum(dev[c] * dev[c]).alias(f"ss{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(dev[a] * dev[b]).alias(f"sp{k}") for k, (a, b) in enumerate(pairs)]
    wide = df.agg(*aggs)
    idx = {c: i for i, c in enumerate(cols)}
    rows = []
    for k, (a, b) in enumerate(pairs):
        den = F.sqrt(F.col(f"ss{idx[a]}") * F.col(f"ss{idx[b]}"))
        r = F.try_divide(F.col(f"sp{k}"), F.when(den > 0, den))
        rows.append(F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), F.lit(int(n)).cast("long").alias("n"),
                             r.alias("correlation")))
    out = wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")
    r = F.col("correlation")
    return out.withColumn("correlation", F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))))


def _column_facts(df: DataFrame, names: list[str]) -> tuple[int, set[str], dict[str, float]]:
    """(rows, null-free columns, means) from one aggregate (one row)."""
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(as_double(df, n)).alias(f"c{i}") for i, n in enumerate(names)],
                 *[F.avg(as_double(df, n)).alias(f"m{i}") for i, n in enumerate(names)]).collect()[0]
    complete = {n for i, n in enumerate(names) if row[f"c{i}"] == row["rows"]}
    return row["rows"], complete, {n: row[f"m{i}"] for i, n in enumerate(names)}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def correlation(df: DataFrame, columns=None, method: str = "pearson") -> DataFrame:
    """column1, column2, n, correlation, strength, direction
    for every pair (column order), undefined correlations kept as NULL."""
    if method not in METHODS:
        raise ValidationError(f"Unknown correlation method: {method}")
    names = resolve_numeric(df, columns)
    if len(names) < 2:
        raise AnalysisError("Need at least 2 numeric columns for correlation analysis")
    pairs = list(combinations(names, 2))
    if method == "pearson" and len(pairs) > PEARSON_PAIRS:
        res = _wide_pearson(df, names)
    elif method == "pearson":
        rows, complete, means = _column_facts(df, names)
        cheap = [(a, b) for a, b in pairs if a in complete and b in complete]
        rest = [p for p in pairs if p not in cheap]
        exprs = {n: as_double(df, n) for n in names}
        parts = []
        if not rows:
            cheap, rest = [], pairs
        if cheap:
            parts.append(_centered_pairs(df, exprs, means, rows, cheap))
        if rest:
            parts.append(_pearson_pairs(df, exprs, rest))
        res = _union(parts)
    elif method == "spearman":
        res = _spearman(df, names, pairs)
    else:
        from .kendall import kendall_pairs
        res = kendall_pairs(df, pairs).select("column1", "column2", "n", F.col("tau_b").alias("correlation"))
    r = F.col("correlation")
    return res.select("column1", "column2", "n", "correlation",
                      F.when(r.isNotNull(), labels.strength(F.abs(r))).alias("strength"),
                      F.when(r.isNotNull(), labels.direction(r)).alias("direction"))


PAIRS_AT_ONCE = 64       # of Spearman's points
PEARSON_PAIRS = 512      # most pairs of one aggregate; more are computed by ``gram``
SMALL_RANKS = 10_000     # distinct values of a column whose ranks are broadcast


def _blocks(pairs: list, size: int | None = None) -> list[list]:
    size = size or PEARSON_PAIRS
    return [pairs[a:a + size] for a in range(0, len(pairs), size)]


def _wide_pearson(df: DataFrame, names: list[str]) -> DataFrame:
    """All pairs in one scan by ``gram``.  Pairs in which a column hardly varies against its mean (constants
    above all) are decided by plain aggregates of their own."""
    got = ranks.stored_table(gram.pair_table(df, [as_double(df, n) for n in names]), "pairs")
    den = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    r = F.try_divide(F.col("xy"), F.when(den > 0, den))
    sure = got.where(~F.col("close") & (F.col("n") > 0)).select(
        name_at(names, F.col("i")).alias("column1"), name_at(names, F.col("j")).alias("column2"), "n",
        F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("correlation"))
    none = got.where(F.col("n") == 0).select(name_at(names, F.col("i")).alias("column1"), name_at(names, F.col("j")).alias("column2"),
                                             "n", F.lit(None).cast("double").alias("correlation"))
    close = [(names[x["i"]], names[x["j"]]) for x in got.where(F.col("close") & (F.col("n") > 0)).orderBy("i", "j").collect()]
    exprs = {n: as_double(df, n) for n in names}
    if not got.count():  # no rows
        return df.sparkSession.createDataFrame([(a, b, 0, None) for a, b in combinations(names, 2)],
                                               "column1 string, column2 string, n bigint, correlation double")
    return _union([sure, none] + [_pearson_pairs(df, exprs, b) for b in _blocks(close)])


def _null_patterns(df: DataFrame, names: list[str], pairs) -> tuple[dict, list]:
    """({rows' pattern: (columns that must be present, its pairs)}, pairs that share their rows with no other).

    Columns present in the same rows are one class; a pair's rows are those of its two classes, or of
    one of them if it lies inside the other."""
    here = {n: as_double(df, n).isNotNull() for n in names}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(here[n]).alias(f"n{i}") for i, n in enumerate(names)]).collect()[0]
    single = {n: row[f"n{i}"] for i, n in enumerate(names)}
    both = {}
    gaps = [p for p in pairs if single[p[0]] < row["rows"] and single[p[1]] < row["rows"]]
    for some in _blocks(gaps):
        got = df.agg(*[F.count_if(here[a] & here[b]).alias(f"b{k}") for k, (a, b) in enumerate(some)]).collect()[0]
        both |= {p: got[f"b{k}"] for k, p in enumerate(some)}
    first = {}  # the first column of each column's class
    for n in names:
        first[n] = next((m for m in first if first[m] == m and single[m] == single[n]
                         and both.get((m, n), single[n]) == single[n]), n)
    patterns: dict[tuple, tuple] = {}
    for a, b in pairs:
        n = both.get((a, b), min(single[a], single[b]))
        need = (a,) if n == single[a] else (b,) if n == single[b] else (a, b)
        key = tuple(sorted({first[x] for x in need}, key=names.index))
        patterns.setdefault(key, (need, []))[1].append((a, b))
    alone = [p for _, own in patterns.values() if len(own) == 1 for p in own]
    return {k: v for k, v in patterns.items() if len(v[1]) > 1}, alone


def _spearman_complete(df: DataFrame, pairs) -> DataFrame:
    """Spearman of pairs whose columns have no nulls in ``df``: each column is ranked once, its ranks are
    joined to the rows (broadcast where they are few), and all pairs are one aggregate of centred products."""
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    wide = df.select(*[as_double(df, c).alias(f"_v{i}") for i, c in enumerate(cols)])
    vc = ranks.value_counts(ranks.long_values(wide, [F.col(f"_v{i}") for i in range(len(cols))]), ["cid"])
    rk = ranks.stored_table(ranks.average_ranks(vc, ["cid"]), "ranks")
    sizes = {r["cid"]: (r["d"], r["n"]) for r in rk.groupBy("cid").agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("n")).collect()}
    if not sizes:
        return _pearson_pairs(df, {c: as_double(df, c) for c in cols}, pairs)
    n = sizes[0][1]
    for i in sorted(sizes, key=lambda c: sizes[c][0]):
        own = rk.where(F.col("cid") == i).select(F.col("value").alias(f"_v{i}"), F.col("rank").alias(f"_r{i}"))
        wide = wide.join(F.broadcast(own) if sizes[i][0] <= SMALL_RANKS else own, f"_v{i}").drop(f"_v{i}")
    exprs = {c: F.col(f"_r{i}") for i, c in enumerate(cols)}
    means = {c: (n + 1) / 2 for c in cols}
    return _union([_centered_pairs(wide, exprs, means, n, b) for b in _blocks(pairs)])


def _spearman(df: DataFrame, names: list[str], pairs) -> DataFrame:
    """Pearson of the average ranks of each pair's complete rows.

    Pairs with the same complete rows (without nulls: all) are ranked together, each column once
    (``_spearman_complete``).  For the others rows are collapsed to (pair, x, y, count) before anything else, ranks come from the value counts
    of each side of a pair, and these are joined to the collapsed rows, never to raw ones.
    """
    patterns, alone = _null_patterns(df, names, pairs)
    parts = []
    for need, own in patterns.values():
        rows = df
        for c in need:
            rows = rows.where(as_double(df, c).isNotNull())
        parts.append(_spearman_complete(rows, own))
    for some in _blocks(alone, PAIRS_AT_ONCE):
        cells = F.array(*[F.struct(F.lit(k).alias("pid"), as_double(df, x).alias("x"), as_double(df, y).alias("y"))
                          for k, (x, y) in enumerate(some)])
        cells = F.filter(cells, lambda c: c["x"].isNotNull() & c["y"].isNotNull())
        points = ranks.stored_table(df.select(F.explode(cells).alias("p")).select("p.*").groupBy("pid", "x", "y").agg(
            F.count(F.lit(1)).alias("w")), "pair-points")
        sides = points.select("pid", "w", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("value")),
                                                            F.struct(F.lit(1).alias("side"), F.col("y").alias("value")))).alias("s"))
        vc = sides.groupBy("pid", "s.side", "s.value").agg(F.sum("w").alias("cnt"))
        rk = ranks.average_ranks(vc, ["pid", "side"])
        of = lambda side, v: rk.where(F.col("side") == side).select("pid", F.col("value").alias(v), F.col("rank").alias(f"r{v}"), F.col("n").alias(f"n{v}"))
        ranked = points.join(of(0, "x"), ["pid", "x"]).join(of(1, "y"), ["pid", "y"])
        mean = (F.col("nx") + 1) / F.lit(2.0)
        dx, dy, w = F.col("rx") - mean, F.col("ry") - mean, F.col("w").cast("double")
        sums = ranked.groupBy("pid").agg(F.max("nx").alias("n"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"),
                                         F.sum(w * dx * dy).alias("xy"))
        den = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
        r = F.try_divide(F.col("xy"), F.when(den > 0, den))
        labels_ = df.sparkSession.createDataFrame([(k, x, y) for k, (x, y) in enumerate(some)], "pid int, column1 string, column2 string")
        parts.append(labels_.join(sums, "pid", "left").select(
            "column1", "column2", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("correlation")))
    return _union(parts)


def correlation_matrix(df: DataFrame, columns=None, method: str = "pearson") -> DataFrame:
    """C4: full matrix in long form (column1, column2, correlation), diagonal included:
    1.0, or NULL for a column without variance (pearson/spearman)."""
    names = resolve_numeric(df, columns)
    pairs = correlation(df, names, method).select("column1", "column2", "correlation")
    mirror = pairs.select(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "correlation")
    var = df.agg(*[F.stddev_pop(as_double(df, n)).alias(f"s{i}") for i, n in enumerate(names)])
    diag = var.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column1"), F.lit(n).alias("column2"),
                                                   F.when(F.col(f"s{i}") > 0, F.lit(1.0)).alias("correlation"))
                                         for i, n in enumerate(names)])).alias("d")).select("d.*")
    return pairs.unionByName(mirror).unionByName(diag)


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """Defined pairs sorted by |r| desc (ties: column1, column2), first k."""
    r = F.col("correlation")
    return pairs.where(r.isNotNull() & ~F.isnan(r)).orderBy(F.abs(r).desc(), "column1", "column2").limit(k)


def corr_summary(pairs: DataFrame) -> DataFrame:
    """total_pairs, strong (|r| >= .6), moderate (.4 <= |r| < .6), interpretation (one row)."""
    r = F.col("correlation")
    a = F.abs(r)
    defined = pairs.where(r.isNotNull() & ~F.isnan(r))
    s = defined.agg(
        F.count(F.lit(1)).cast("long").alias("total_pairs"),
        F.count_if(a >= 0.6).cast("long").alias("strong_correlations"),
        F.count_if((a >= 0.4) & (a < 0.6)).cast("long").alias("moderate_correlations"),
        # strongest pair; ties broken by (column1, column2) like the sorted pair list
        F.min_by(F.struct("column1", "column2", "correlation", "strength", "direction"),
                 F.struct(-a, F.col("column1"), F.col("column2"))).alias("_b"),
    )
    text = F.when(F.col("total_pairs") == 0, F.lit("No significant correlations found.")).otherwise(
        F.format_string("Strongest correlation is between %s and %s (r = %.3f, %s %s correlation).",
                        "_b.column1", "_b.column2", F.bround("_b.correlation", 3), "_b.strength", "_b.direction"))
    return s.select("total_pairs", "strong_correlations", "moderate_correlations", text.alias("interpretation"))
