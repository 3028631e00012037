"""Joins that no equality of columns gives: spans that meet, and the last row before a time."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Rows of a bin of the finest level that it is cut again for, about.
HEAVY = 4096
#: Pairs that a task looks at, about.
CELL = 4_000_000
#: Spans in units of 2 to this power at least: doubles are no finer.
FINEST = -1000


def _number(c: Column, kind: T.DataType) -> Column:
    """A number or time as a double; the order of values stays, though near ones may become equal."""
    return (c if isinstance(kind, T.NumericType) else F.unix_micros(c.cast("timestamp"))).cast("double")


def range_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], on: Column | None = None) -> DataFrame:
    """The pairs of rows whose spans (from, to; both ends count) meet, and for which ``on`` holds.

    Ends are numbers or times; a point is a span of two equal ends, and an
    infinite end is open. Spans with a null or NaN end, or that end before they
    begin, meet nothing. Columns of the two sides have different names.

    The range of values is cut into bins at several levels, each of bins twice
    as wide. A span belongs to the level whose bins are as wide as it is long,
    so it touches three of them at most; at that level, spans of the other side
    that belong to it or to a finer one visit it. A pair counts in the first bin
    that both touch, so it comes once. The finest level is made finer where a
    bin of it holds many rows. The join is by level and bin: rows are dealt by
    both. The rows of a bin are cut so that the pairs of two cuts are about CELL
    at most; each such cell is a key of its own, and there are as many tasks as
    the pairs ask for, so that more pairs make more tasks and not longer ones.
    """
    sides, seen = [], []
    for df, span in ((left, left_span), (right, right_span)):
        wide = df.select("*", span[0].alias("__a"), span[1].alias("__b"))
        kinds = [wide.schema[c].dataType for c in ("__a", "__b")]
        whole = df.select("*", span[0].alias("__from"), span[1].alias("__to"), _number(span[0], kinds[0]).alias("__lo"), _number(span[1], kinds[1]).alias("__hi"))
        whole = whole.where("__lo IS NOT NULL AND __hi IS NOT NULL AND NOT isnan(__lo) AND NOT isnan(__hi)").where(F.col("__from") <= F.col("__to"))
        finite = [F.when(F.abs(c) != float("inf"), F.col(c)) for c in ("__lo", "__hi")]
        seen.append(whole.agg(F.min(F.least(*finite)), F.max(F.greatest(*finite)), F.count(F.lit(1))).first())
        sides.append(whole)
    ends = [x for row in seen for x in row[:2] if x is not None]
    low, high = (min(ends), max(ends)) if ends else (0.0, 0.0)
    cut = [df.withColumns({"__lo": F.greatest("__lo", F.lit(low)), "__hi": F.least("__hi", F.lit(high))}).where("__lo <= __hi") for df in sides]
    finest = _finest(cut, low, high, sum(row[2] for row in seen))
    levelled = [df.withColumn("__level", F.greatest(F.lit(finest), F.when(F.col("__hi") > F.col("__lo"), F.ceil(F.log2(F.col("__hi") - F.col("__lo")))).otherwise(finest)).cast("int")) for df in cut]
    present = [sorted(r[0] for r in df.select("__level").distinct().collect()) for df in levelled]  # exponents of doubles: a few at most
    own, visit = [[F.lit(m).cast("int") for m in ls] for ls in present], []
    # key: level, bin and whose level it is; the left side's level takes right spans of its own level and finer ones, the right side's only finer ones
    for k, df in enumerate(levelled):
        visits = F.filter(F.array(*own[1 - k]).cast("array<int>"), (lambda m: m > F.col("__level")) if k == 0 else (lambda m: m >= F.col("__level")))
        places = F.concat(F.array(F.struct(F.col("__level").alias("at"), F.lit(k).alias("whose"))), F.transform(visits, lambda m: F.struct(m.alias("at"), F.lit(1 - k).alias("whose"))))
        spread = df.withColumn("__place", F.explode(places)).withColumns({"__at": F.col("__place.at"), "__whose": F.col("__place.whose")})
        width = F.pow(F.lit(2.0), F.col("__at"))
        spread = spread.withColumn("__first", F.floor(F.col("__lo") / width)).withColumn("__bin", F.explode(F.sequence(F.col("__first"), F.floor(F.col("__hi") / width))))
        names = {c: f"{c}{k}" for c in ("__from", "__to", "__at", "__whose", "__first", "__bin")}
        visit.append(spread.drop("__lo", "__hi", "__level", "__place").withColumnsRenamed(names))
    meets = (F.col("__from0") <= F.col("__to1")) & (F.col("__from1") <= F.col("__to0"))
    once = F.col("__bin0") == F.greatest("__first0", "__first1")
    keys = (F.col("__at0") == F.col("__at1")) & (F.col("__whose0") == F.col("__whose1")) & (F.col("__bin0") == F.col("__bin1"))
    visit, cells = _cells(visit)
    keys = keys & (F.col("__row0") == F.col("__row1")) & (F.col("__column0") == F.col("__column1"))
    dealt = [df.repartition(cells, *[f"{c}{k}" for c in _KEY]) for k, df in enumerate(visit)]
    joined = dealt[0].hint("merge").join(dealt[1].hint("merge"), keys & once & meets if on is None else keys & once & meets & on)
    return joined.drop(*[f"{c}{k}" for k in (0, 1) for c in ("__from", "__to", "__first", *_KEY)])


_KEY = ("__at", "__whose", "__bin", "__row", "__column")


def _cells(visit: list[DataFrame]) -> tuple[list[DataFrame], int]:
    """The two sides with __row and __column of their cells, a row in each cell of its cut, and how many tasks the pairs ask for."""
    bins = [df.groupBy(*[F.col(f"{c}{k}").alias(f"{c}{k}_") for c in _KEY[:3]]).agg(F.count(F.lit(1)).alias(f"__n{k}")) for k, df in enumerate(visit)]
    met = bins[0].join(bins[1], reduce(lambda a, b: a & b, [F.col(f"{c}0_") == F.col(f"{c}1_") for c in _KEY[:3]]))
    side = int(CELL**0.5)
    cuts = [F.ceil(F.col(f"__n{k}") / F.greatest(F.lit(side), F.floor(F.lit(CELL) / F.col(f"__n{1 - k}")))) for k in (0, 1)]
    sized = stored(met.select(*[f"{c}{k}_" for k in (0, 1) for c in _KEY[:3]], (F.col("__n0") * F.col("__n1")).alias("__pairs"), cuts[0].cast("int").alias("__rows"), cuts[1].cast("int").alias("__columns")))
    pairs = sized.agg(F.sum(F.col("__pairs").cast("double"))).first()[0] or 0.0
    # a bin that only one side touches gives no pairs
    out = []
    for k, df in enumerate(visit):
        mine = sized.select(*[f"{c}{k}_" for c in _KEY[:3]], "__rows", "__columns")
        found = df.join(mine, reduce(lambda a, b: a & b, [F.col(f"{c}{k}") == F.col(f"{c}{k}_") for c in _KEY[:3]]))
        own, other = (("__rows", "__row"), ("__columns", "__column"))[:: 1 if k == 0 else -1]
        every = F.explode(F.sequence(F.lit(0), F.col(other[0]) - 1)).alias(f"{other[1]}{k}")
        cut = F.pmod(F.monotonically_increasing_id(), F.col(own[0])).cast("int").alias(f"{own[1]}{k}")
        out.append(found.select(*df.columns, other[0], cut).select(*df.columns, f"{own[1]}{k}", every))
    n = int(visit[0].sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return out, max(n, math.ceil(pairs / CELL))


def _finest(sides: list[DataFrame], low: float, high: float, n: int) -> int:
    """The exponent of the finest bins: few enough rows in each, if values were even; then finer until no bin of different values is heavy."""
    if not high > low:
        return 0
    at = max(FINEST, math.floor(math.log2((high - low) / max(1, n / HEAVY))))
    least = max(FINEST, math.floor(math.log2(high - low)) - 52)
    while at > least:
        place = F.floor(F.col("__lo") / F.lit(2.0**at))
        begun = sides[0].select("__lo").unionByName(sides[1].select("__lo"))
        worst = begun.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("__lo").alias("a"), F.max("__lo").alias("b")).where("a < b").agg(F.max("n")).first()[0]
        if worst is None or worst <= 4 * HEAVY:
            break
        at = max(least, at - max(1, math.ceil(math.log2(worst / HEAVY))))
    return at


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], prefix: str, outer: bool = False) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same ``by`` columns whose time is not after its own.

    The columns of ``right`` but ``by`` get ``prefix`` before their names. Of
    rows of one time the last by all its other columns counts. Rows with a null
    time have no match and are none; null ``by`` values match each other. With
    ``outer`` rows without a match stay.

    Both sides lie in one table, dealt by ranges of (by, time), so that a hot key
    is cut by time. Within a part the last right row is carried down; the few
    keys that go on over the end of a part have the last row before it from a
    table with a row for each such key and part.
    """
    spark = left.sparkSession
    names = [c for c in right.columns if c not in by]
    rest = [c for c in left.columns if c not in by]
    time = lambda df, c: F.col(c).cast("timestamp") if not isinstance(df.schema[c].dataType, T.NumericType) else F.col(c)
    payload = F.struct(*[F.col(c).alias(prefix + c) for c in names])
    a = left.select(*by, time(left, left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*rest).alias("__left"))
    b = right.where(F.col(right_time).isNotNull()).select(*by, time(right, right_time).alias("__t"), F.lit(0).alias("__side"), payload.alias("__right"))
    both = a.unionByName(b, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = stored(both.repartitionByRange(n, *by, "__t", "__side").withColumn("__part", F.spark_partition_id()))  # the ranges are a sample's, and have to stay
    order = [F.col("__t").asc_nulls_first(), F.col("__side"), F.col("__right")]
    within = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = dealt.withColumn("__found", F.last("__right", ignorenulls=True).over(within)).where("__side = 1")
    # keys of more than one part: as many rows as there are ends of parts
    last = F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__t", "__right")))
    ends = dealt.groupBy("__part", *by).agg(last.alias("__last"))
    many = dealt.select("__part", *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    spanning = _null_safe(ends, many, by, "left_semi")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spanning.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).where("__carried IS NOT NULL").drop("__last")
    found = _null_safe(near, carried, ["__part", *by], "left")
    timed = F.when(F.col("__t").isNotNull(), F.coalesce("__found", "__carried"))
    out = found.select(*by, "__left.*", timed.alias("__match"))
    out = out if outer else out.where("__match IS NOT NULL")
    return out.select(*by, *rest, *[F.col(f"__match.{prefix + c}").alias(prefix + c) for c in names])


def _null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """A join on equal columns, null to null; the right side's are dropped."""
    other = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by]
    joined = left.join(other, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"__r_{c}" for c in by])
