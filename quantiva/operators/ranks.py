"""Exact order statistics without a single-task sort.

Quantiles (``exact_quantiles``) by selection, from a worklist of brackets, one
for each (key, column, probability).  A sketch brackets the wanted positions;
an exact count says how many rows lie below, at and between the bracket's two
ends.  A position that falls on the rows equal to an end is answered.  A
bracket that is left with more than ROWS_IN_BRACKET rows, and more distinct
values than that by its own sketch, stays on the list and is narrowed by
quantiles of the rows between its ends; the others leave it, each by itself.
At the end the rows inside the brackets that still have an open position are
counted by value, so the last window sorts at most ROWS_IN_BRACKET distinct
values of a bracket.  Nothing else is shuffled but sketches and counts.  The
sketches only choose the brackets: a bracket that misses its position is
opened to that side, and one of any size gives the exact answer.

Ranks (``positions``) need every value: the value counts are sorted by range
partitions, stored, and numbered with one offset per partition and key.

The most frequent value (``modes``): a mergeable heavy-hitter summary with a
known error gives candidates, which are counted exactly; only columns in which
its error leaves the answer open are grouped by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

ACCURACY = 10_000        # of the bracketing sketches: rank error at most rows / ACCURACY
MARGIN = 0.0005          # half width of a bracket, as a share of the rows it is cut from
ROWS_IN_BRACKET = 100_000  # brackets with more rows and more distinct values are narrowed before their rows are counted by value
DISTINCT_ERROR = 0.05    # relative standard deviation of the distinct sketches; three of it are added
TRACKED = 10_000         # values that the heavy-hitter summary keeps
TOP = 32                 # candidates it returns


def value_counts(long_df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., value, cnt) with NULL values removed."""
    return (
        long_df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def long_values(df: DataFrame, values: list[Column], keys: dict[str, Column] | None = None) -> DataFrame:
    """(keys..., cid, value): the non-null values of every column."""
    keys = keys or {}
    return df.select(*[k.alias(n) for n, k in keys.items()], F.explode(F.array(*[
        F.struct(F.lit(i).alias("cid"), v.alias("value")) for i, v in enumerate(values)])).alias("p")).select(
        *keys, "p.cid", "p.value").where(F.col("value").isNotNull())


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: fixes partition numbers and cuts lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------ selection
def _wanted(n: Column, p) -> tuple[Column, Column, Column]:
    """h = (n-1)p and the two positions (from 0) around it."""
    h = (n - F.lit(1)).cast("double") * (p if isinstance(p, Column) else F.lit(p))
    return h, F.floor(h).cast("long"), F.ceil(h).cast("long")


def sketch_aggs(values: list[Column], probs: dict[str, float]) -> list[Column]:
    """Count, extremes, distinct sketch and bracketing sketch of each column, as aggregates of one pass."""
    at = [x for p in probs.values() for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    out = []
    for i, v in enumerate(values):
        out += [F.count(v).alias(f"_n{i}"), F.approx_count_distinct(v, DISTINCT_ERROR).alias(f"_u{i}"),
                F.percentile_approx(v, at, ACCURACY).alias(f"_s{i}")]
    return out


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value's expression written once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _open_positions(s: Column, a: Column, z: Column) -> tuple[Column, Column]:
    """The smallest and the largest wanted position of a bracket with the answers a and z."""
    _, first, last = _wanted(s["n"], s["p"])
    return F.when(a.isNull(), first).otherwise(last), F.when(z.isNull(), last).otherwise(first)


def _at_most(distinct: Column) -> Column:
    return F.ceil(distinct * (1 + 3 * DISTINCT_ERROR))


class _Selection:
    """The worklist and the passes over the data.

    A bracket (a struct of the array ``cells``, one array per key) has the open ends ``lo`` and
    ``hi`` (null: unbounded), the number of rows up to lo (``b``) and below hi (``e``), a bound
    ``u`` of the distinct values in between, the answers ``a`` and ``z`` at its two positions as far
    as they are known, and, while new ends are not counted, the former ends ``l`` and ``h``, to
    which ``b`` and ``e`` then belong.  ``open``: a position is wanted; ``active``: to be narrowed.
    """

    FIELDS = ("cid", "j", "p", "n", "lo", "hi", "l", "h", "a", "z", "b", "e", "u", "open", "active")

    def __init__(self, base: DataFrame, k: int, keys: list[str], probs: dict[str, float]):
        self.base, self.k, self.keys, self.probs = base, k, keys, probs
        self.cells = [(i, j) for i in range(k) for j in range(len(probs))]
        self.active = self.open = list(range(len(self.cells)))

    def start(self, table: DataFrame) -> None:
        cells = []
        for i, j in self.cells:
            p, sketch = list(self.probs.values())[j], F.col(f"_s{i}")
            self.kind = table.schema[f"_s{i}"].dataType.elementType
            none, n = F.lit(None).cast(self.kind), F.col(f"_n{i}")
            field = {"cid": F.lit(i), "j": F.lit(j), "p": F.lit(p), "n": n,
                     "lo": none if p - MARGIN <= 0 else F.get(sketch, F.lit(2 * j)),
                     "hi": none if p + MARGIN >= 1 else F.get(sketch, F.lit(2 * j + 1)),
                     "l": none, "h": none, "a": none, "z": none, "b": F.lit(0).cast("long"), "e": n,
                     "u": _at_most(F.col(f"_u{i}")).cast("long"), "open": n > 0, "active": n > 0}
            cells.append(F.struct(*[field[x].alias(x) for x in self.FIELDS]))
        self.keep(table.select(*[F.col(f"`{x}`") for x in self.keys], F.array(*cells).alias("cells")))

    def keep(self, table: DataFrame) -> None:
        """Without keys the table is one row and becomes literals; with keys it is stored, and Spark
        broadcasts it or not by its size."""
        if self.keys:
            self.table = stored_table(table, "brackets")
            marks = [F.max(F.get("cells", F.lit(x))[f]).alias(f"{f}{x}") for x in range(len(self.cells)) for f in ("open", "active")]
            got = self.table.agg(*marks).collect()[0].asDict()
        else:
            row = table.collect()[0]["cells"]  # a few numbers for each column
            self.row, self.schema = row, table.schema
            got = {f"{f}{x}": row[x][f] for x in range(len(self.cells)) for f in ("open", "active")}
        self.open = [x for x in range(len(self.cells)) if got[f"open{x}"]]
        self.active = [x for x in range(len(self.cells)) if got[f"active{x}"]]

    def state(self) -> DataFrame:
        return self.table if self.keys else self.base.sparkSession.createDataFrame([(self.row,)], self.schema)

    def rows(self) -> DataFrame:
        """The data, with its brackets where there are keys."""
        return self.base.join(self.table, self.keys) if self.keys else self.base

    def field(self, x: int, name: str) -> Column:
        """Bracket ``x`` of a row of ``rows``."""
        if self.keys:
            return F.get("cells", F.lit(x))[name]
        kind = self.kind if name in ("lo", "hi", "l", "h", "a", "z") else self.schema["cells"].dataType.elementType[name].dataType
        return F.lit(self.row[x][name]).cast(kind)

    def value(self, x: int) -> Column:
        return F.col(f"_v{self.cells[x][0]}")

    def inside(self, x: int) -> Column:
        v, lo, hi = self.value(x), self.field(x, "lo"), self.field(x, "hi")
        return v.isNotNull() & (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))

    def update(self, aggs: dict[int, Column], change) -> None:
        """One pass: ``aggs`` gives a struct of aggregates for each active bracket, ``change(bracket, struct)`` the new bracket."""
        none = F.lit(None)
        got = F.array(*[aggs.get(x, none) for x in range(len(self.cells))]).alias("got")
        if self.keys:
            both = self.table.join(self.rows().groupBy(*self.keys).agg(got), self.keys)
        else:
            both = self.state().crossJoin(F.broadcast(self.rows().agg(got)))  # one row and one row
        cells = F.zip_with("cells", "got", lambda s, g: F.when(g.isNull(), s).otherwise(change(s, g)))
        self.keep(both.select(*[F.col(f"`{x}`") for x in self.keys], cells.alias("cells")))

    def changed(self, s: Column, **new: Column) -> Column:
        """The bracket with new fields, and what follows from them."""
        f = {x: new.get(x, s[x]) for x in self.FIELDS}
        f["open"] = (f["n"] > 0) & (f["a"].isNull() | f["z"].isNull())
        f["active"] = f["open"] & (f["e"] - f["b"] > ROWS_IN_BRACKET) & (f["u"] > ROWS_IN_BRACKET)
        return F.struct(*[f[x].alias(x) for x in self.FIELDS])

    def count(self) -> None:
        """Exact numbers of rows around the ends of the active brackets: answers at the ends, and the
        open interval that holds what is still wanted."""
        aggs = {}
        for x in self.active:
            v, lo, hi = self.value(x), self.field(x, "lo"), self.field(x, "hi")
            aggs[x] = F.struct(*[F.count_if(c).alias(f"c{k}") for k, c in enumerate((v < lo, v <= lo, v < hi, v <= hi))])

        def answered(s, g):
            _, first, last = _wanted(s["n"], s["p"])
            c2, c3 = (F.when(s["hi"].isNull(), s["n"]).otherwise(g[c]) for c in ("c2", "c3"))
            a, z = (F.coalesce(s[f], F.when((g["c0"] <= at) & (at < g["c1"]), s["lo"]).when((c2 <= at) & (at < c3), s["hi"]))
                    for f, at in (("a", first), ("z", last)))
            return F.struct(a.alias("a"), z.alias("z"), c2.alias("c2"), c3.alias("c3"))

        def change(s, g):
            def ends(w):
                least, most = _open_positions(s, w["a"], w["z"])
                early, late = (least < g["c0"], least >= w["c3"]), (most < g["c0"], most >= w["c3"])
                return self.changed(
                    s, a=w["a"], z=w["z"],
                    lo=F.when(early[0], s["l"]).when(early[1], s["hi"]).otherwise(s["lo"]),
                    b=F.when(early[0], s["b"]).when(early[1], w["c3"]).otherwise(g["c1"]),
                    hi=F.when(late[1], s["h"]).when(late[0], s["lo"]).otherwise(s["hi"]),
                    e=F.when(late[1], s["e"]).when(late[0], g["c0"]).otherwise(w["c2"]))

            return _let(answered(s, g), ends)

        self.update(aggs, change)

    def recount(self) -> None:
        """Counts after narrowing: of every bracket that has just been narrowed, active or not."""
        self.active = self.narrowed
        self.count()

    def narrow(self) -> None:
        """Quantiles of the rows inside each active bracket, around the wanted place, give its new ends."""
        steps, aggs, self.narrowed = [x / 200 for x in range(1, 200)], {}, self.active
        for x in self.active:
            v = F.when(self.inside(x) & self.field(x, "active"), self.value(x))
            aggs[x] = F.struct(F.percentile_approx(v, steps, ACCURACY).alias("q"), F.approx_count_distinct(v, DISTINCT_ERROR).alias("w"))

        def change(s, g):
            least, most = _open_positions(s, s["a"], s["z"])
            size = F.greatest(s["e"] - s["b"], F.lit(1)).cast("double")
            left = F.floor(200 * (least - s["b"]) / size).cast("int") - 2   # one step below the place, as an index of steps
            right = F.ceil(200 * (most + 1 - s["b"]) / size).cast("int")
            cut = (left >= 0) | (right < 199)
            return F.when(~s["active"], s).otherwise(self.changed(
                s, l=s["lo"], h=s["hi"],
                lo=F.when(left >= 0, F.coalesce(F.get(g["q"], left), s["lo"])).otherwise(s["lo"]),
                hi=F.when(right < 199, F.coalesce(F.get(g["q"], right), s["hi"])).otherwise(s["hi"]),
                u=F.when(cut, F.least(_at_most(g["w"]), s["u"])).otherwise(F.lit(0)).cast("long")))  # 0: leaves the list

        self.update(aggs, change)

    def _answers(self) -> DataFrame:
        """(keys..., cid, n, and the two answers of each probability) of columns with values."""
        m = len(self.probs)
        each = [F.struct(F.lit(i).alias("cid"), F.get("cells", F.lit(i * m))["n"].alias("n"), *[
            F.get("cells", F.lit(i * m + j))[x].alias(f"_{x}{j}") for j in range(m) for x in "az"]) for i in range(self.k)]
        return self.state().select(*[F.col(f"`{x}`") for x in self.keys], F.explode(F.array(*each)).alias("p")).select(
            *self.keys, "p.*").where("n > 0")

    def _counted(self) -> DataFrame:
        """(keys..., cid, and the open answers of each probability): rows inside the open brackets by value."""
        d = self.rows()
        cells = {x: self.field(x, "open") & self.inside(x) for x in self.open}
        hit = None
        for c in cells.values():
            hit = c if hit is None else hit | c
        inside = [F.when(c, F.struct(F.lit(self.cells[x][0]).alias("cid"), F.lit(self.cells[x][1]).alias("_j"), self.value(x).alias("value"),
                                     self.field(x, "b").alias("_below"), self.field(x, "n").alias("n"))) for x, c in cells.items()]
        some = d.where(hit).select(*[F.col(f"`{x}`") for x in self.keys], F.explode(F.array_compact(F.array(*inside))).alias("p"))
        by = [*self.keys, "cid", "_j"]
        vc = some.select(*self.keys, "p.*").groupBy(*by, "value", "_below", "n").agg(F.count(F.lit(1)).alias("cnt"))
        w = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pos = vc.withColumn("end", F.col("_below") + F.sum("cnt").over(w))
        aggs = []
        for j, p in enumerate(self.probs.values()):
            _, first, last = _wanted(F.col("n"), p)
            own = F.col("_j") == j
            aggs += [F.min(F.when(own & (F.col("_below") <= at) & (F.col("end") > at), F.col("value"))).alias(f"_{x}c{j}")
                     for x, at in (("a", first), ("z", last))]
        return pos.groupBy(*self.keys, "cid").agg(*aggs)

    def finish(self) -> DataFrame:
        """Interpolated quantiles from the answers at bracket ends and the counted values."""
        res = self._answers()
        if self.open:
            res = res.join(self._counted(), [*self.keys, "cid"], "left")
        out = [F.col(f"`{x}`") for x in self.keys] + [F.col("cid"), F.col("n")]
        for j, (name, p) in enumerate(self.probs.items()):
            h, first, _ = _wanted(F.col("n"), p)
            frac = h - first.cast("double")
            a, z = (F.coalesce(F.col(f"_{x}{j}"), F.col(f"_{x}c{j}")) if self.open else F.col(f"_{x}{j}") for x in "az")
            out.append(F.when(frac == 0, a).otherwise(a + (z - a) * frac).alias(name))
        return res.select(*out)


def exact_quantiles(df: DataFrame, values: list[Column], probs: dict[str, float], keys: dict[str, Column] | None = None,
                    sketch: DataFrame | None = None) -> DataFrame:
    """(keys..., cid, n, <name>...) with linear interpolation between order statistics; columns and keys
    without values have no row.

    Same definition as pandas ``quantile`` / numpy 'linear' / DuckDB ``quantile_cont``:
    h = (n-1)p, q = x[floor h] + (h - floor h)(x[ceil h] - x[floor h]).  ``sketch`` is the result of
    ``sketch_aggs`` over the same data, when the caller has it from another pass.
    """
    keys = keys or {}
    base = df.select(*[k.alias(n) for n, k in keys.items()], *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    own = [F.col(f"_v{i}") for i in range(len(values))]
    if sketch is None:
        sketch = base.groupBy(*keys).agg(*sketch_aggs(own, probs)) if keys else base.agg(*sketch_aggs(own, probs))
    s = _Selection(base, len(values), list(keys), probs)
    s.start(sketch)
    if s.active:
        s.count()
    while s.active:
        s.narrow()
        s.recount()
    return s.finish()


# ---------------------------------------------------------------------- ranks
def positions(vc: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., value, cnt, below, n) for every distinct value of every key; ``vc`` has value counts.

    Distinct rows are sorted into range partitions (so no key or value can fill one), stored with
    their partition number, and summed inside each (partition, key); offsets are one row per
    (partition, key).
    """
    s = vc.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id())
    s = stored_table(s.select(*keys, value, "cnt", "_part"), "sorted-values")
    seg = s.groupBy(*keys, "_part").agg(F.sum("cnt").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                     F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    w = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = s.withColumn("_in", F.sum("cnt").over(w) - F.col("cnt"))
    return inner.join(seg, [*keys, "_part"]).select(*keys, value, "cnt", (F.col("_off") + F.col("_in")).alias("below"), "n")


def average_ranks(vc: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., value, rank, n): 1-based average rank of ties, as pandas/scipy rank."""
    return positions(vc, keys, value).select(*keys, value, (F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)).alias("rank"), "n")


def mode_of(vc: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., mode): most frequent value, smallest on ties (bounded min_by buffer)."""
    return vc.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("cnt"), F.col(value))).alias("mode")
    )


def heavy_aggs(values: list[Column]) -> list[Column]:
    """A summary of the most frequent values of each column, as aggregates of one pass."""
    return [F.call_function("approx_top_k", v, F.lit(TOP), F.lit(TRACKED)).alias(f"_t{i}") for i, v in enumerate(values)]


def _summary_error() -> float:
    """Share of the rows by which an estimate may be too high: 3.5 over the summary's table size."""
    size = 8
    while size * 0.75 < TRACKED:
        size *= 2
    return 3.5 / size


def _candidates(items: list, n: int) -> tuple[list, float]:
    """(values that can be the mode, bound of the count of every value that is not among them)."""
    found = [(x["item"], x["count"]) for x in items or [] if x["item"] is not None]
    slack = _summary_error() * n
    bound = max([2 * slack] + ([found[-1][1]] if len(items or []) >= TOP else []))  # values that are not returned
    top = max((c for _, c in found), default=0)
    # an estimate is never too low and at most slack too high: values below top - slack are no modes
    return [v for v, c in found if c >= top - slack], bound


def modes(df: DataFrame, values: list[Column], heavy: list[list], counts: list[int]) -> DataFrame:
    """(cid, mode): most frequent value, smallest on ties, of each column with values.

    ``heavy`` are the results of ``heavy_aggs`` and ``counts`` the numbers of values.  The candidates
    are counted exactly in one pass; a column is settled if its best candidate is more frequent than
    anything the summary may have missed, else its values are grouped.
    """
    spark = df.sparkSession
    lists = [_candidates(h, n) if n else ([], 0.0) for h, n in zip(heavy, counts)]
    asked = [(i, v) for i, (some, _) in enumerate(lists) for v in some]
    settled = {}
    if asked:
        got = df.agg(*[F.count_if(values[i] == F.lit(v)).alias(f"c{k}") for k, (i, v) in enumerate(asked)]).collect()[0]
        for k, (i, v) in enumerate(asked):
            settled[i] = min(settled.get(i, (1, None)), (-got[k], v))
        settled = {i: v for i, (c, v) in settled.items() if -c > lists[i][1]}
    kind = df.select(values[0].alias("v")).schema["v"].dataType.simpleString()
    out = spark.createDataFrame(list(settled.items()), f"cid int, mode {kind}")
    left = [i for i, n in enumerate(counts) if n and i not in settled]
    if left:
        own = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("cid"), values[i].alias("value")) for i in left])).alias("p"))
        out = out.unionByName(mode_of(value_counts(own.select("p.*"), ["cid"]), ["cid"]))
    return out
