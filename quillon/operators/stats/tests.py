"""Analysis of variance and hypothesis tests; results are small records with p_value() and the like.

Samples come in long form, a group column and a value column; rows with a null in either are left out.
"""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import InvalidArgument, require
from quillon.functions.distributions import ChiSquared, FisherSnedecor, Normal, StudentT
from quillon.functions.sums import exact_sums
from quillon.iterate import settled
from quillon.operators.stats.ranks import midranks
from quillon.plans.prefix import running_extreme, running_total


class Alternative(enum.Enum):
    TWO_SIDED = "two-sided"
    LESS = "less"
    GREATER = "greater"


class Continuity(enum.Enum):
    CORRECTED = "corrected"
    UNCORRECTED = "uncorrected"


def _long(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).dropna()


@dataclass(frozen=True)
class OneWayAnova:
    between_ss: float
    within_ss: float
    between_df: int
    within_df: int

    @property
    def between_ms(self) -> float:
        return self.between_ss / self.between_df

    @property
    def within_ms(self) -> float:
        return self.within_ss / self.within_df

    @property
    def f(self) -> float:
        return math.inf if self.within_ms == 0 else self.between_ms / self.within_ms

    @property
    def r_squared(self) -> float:
        total = self.between_ss + self.within_ss
        return self.between_ss / total if total else 0.0

    @property
    def residual_sd(self) -> float:
        return math.sqrt(self.within_ms)

    def p_value(self) -> float:
        return FisherSnedecor(self.between_df, self.within_df).survival(self.f)


def anova(df: DataFrame, group: str, value: str) -> OneWayAnova:
    """Two passes: values are recentred on the grand mean, then on the means of their groups."""
    rows = _long(df, group, value)
    n, sums = exact_sums(rows, [F.col("v")], lambda v: [[v]])
    require(n > 0, "analysis of variance needs values")
    centred = rows.withColumn("v", F.col("v") - F.lit(sums[0] / n))
    means = centred.groupBy("g").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    k = means.count()
    require(k >= 2, "analysis of variance needs at least 2 groups that aren't empty")
    require(n > k, "analysis of variance needs more values than groups")
    d = F.col("v") - F.col("m")
    by_group = centred.join(means, "g").groupBy("g").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"))
    fine = F.col("m") + F.col("s") / F.col("n")
    r = by_group.agg(F.sum(F.col("n") * fine * fine).alias("b"), F.sum(F.col("n") * fine).alias("t"), F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("w")).first()
    return OneWayAnova(r["b"] - r["t"] ** 2 / n, max(0.0, r["w"]), k - 1, n - k)


@dataclass(frozen=True)
class ChiSquaredTest:
    statistic: float
    degrees_of_freedom: int
    rows: DataFrame = field(repr=False)
    columns: DataFrame = field(repr=False)
    total: float

    def p_value(self) -> float:
        return ChiSquared(self.degrees_of_freedom).survival(self.statistic)

    def expected(self) -> DataFrame:
        """r, c, expected of every cell of the table, made when it is asked for: as many rows as the table has cells."""
        return self.rows.crossJoin(self.columns).select("r", "c", (F.col("rn") * F.col("cn") / F.lit(self.total)).alias("expected"))


def _chi_squared(cells: DataFrame, continuity: Continuity) -> ChiSquaredTest:
    """cells: r, c, n; cells that are missing are observed zeros. Their share of the statistic is what they were expected to
    hold: the total less what the others were. So only the cells that are there are met, each with its two margins."""
    cells = settled(cells)
    low, total = cells.agg(F.min("n"), F.sum("n")).first()
    require(low is not None and low >= 0, "a contingency table needs counts that aren't negative")
    rows, columns = cells.groupBy("r").agg(F.sum("n").alias("rn")), cells.groupBy("c").agg(F.sum("n").alias("cn"))
    nr, nc = rows.agg(F.count("*"), F.min("rn")).first(), columns.agg(F.count("*"), F.min("cn")).first()
    require(nr[0] >= 2 and nc[0] >= 2, "a contingency table needs at least 2 rows and 2 columns")
    require(nr[1] > 0 and nc[1] > 0, "a contingency table must not have an empty row or column")
    df = (nr[0] - 1) * (nc[0] - 1)
    if df == 1:  # two by two
        held = {(r["r"], r["c"]): r["n"] for r in cells.collect()}
        rn, cn = {r["r"]: r["rn"] for r in rows.collect()}, {r["c"]: r["cn"] for r in columns.collect()}
        terms = []
        for r in rn:
            for c in cn:
                e = rn[r] * cn[c] / total
                d = abs(held.get((r, c), 0.0) - e)
                terms.append((d - min(0.5, d) if continuity is Continuity.CORRECTED else d) ** 2 / e)
        return ChiSquaredTest(math.fsum(terms), df, rows, columns, float(total))
    e = F.col("rn") * F.col("cn") / F.lit(float(total))
    met = cells.join(rows, "r").join(columns, "c").select(F.col("n").alias("n"), e.alias("e"))
    _, (x, seen) = exact_sums(met, [F.col("n"), F.col("e")], lambda n, e: [[(n - e) ** 2 / e], [e]])
    return ChiSquaredTest(x + max(0.0, total - seen), df, rows, columns, float(total))


def chi_squared(df: DataFrame, row: str, column: str, count: str | None = None, continuity: Continuity = Continuity.CORRECTED) -> ChiSquaredTest:
    """Independence of two columns, or of a table given as counts. Yates's correction only at one degree of freedom."""
    n = F.count("*") if count is None else F.sum(F.col(count).cast("double"))
    cells = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(n.cast("double").alias("n"))
    return _chi_squared(cells, continuity)


@dataclass(frozen=True)
class TTest:
    statistic: float
    degrees_of_freedom: float
    difference: float
    standard_error: float

    def p_value(self) -> float:
        if math.isnan(self.statistic):
            return math.nan
        return 1.0 if self.statistic == 0 else 2 * StudentT(self.degrees_of_freedom).survival(abs(self.statistic))

    def confidence_interval(self, level: float = 0.95) -> tuple[float, float]:
        require(0 < level < 1, "a confidence level must be between 0 and 1")
        half = StudentT(self.degrees_of_freedom).upper_quantile((1 - level) / 2) * self.standard_error
        return self.difference - half, self.difference + half


def _two(df: DataFrame, group: str, value: str, x: object, y: object) -> list[tuple[int, float, float]]:
    """(n, mean, sum of squared deviations) of the two groups, about their exact means."""
    out = []
    for g in (x, y):
        own = df.filter(F.col(group) == F.lit(g)).select(F.col(value).cast("double").alias("v")).dropna()
        n, sums = exact_sums(own, [F.col("v")], lambda v: [[v]])
        require(n >= 2, "a t test needs at least 2 values in each sample")
        m = sums[0] / n
        _, (s, ss) = exact_sums(own, [F.col("v")], lambda v, m=m: [[v - m], [(v - m) ** 2]])
        out.append((n, m + s / n, ss - s * s / n))
    return out


def _statistic(difference: float, se: float) -> float:
    return difference / se if se > 0 else math.nan if difference == 0 else math.copysign(math.inf, difference)


def t_student(df: DataFrame, group: str, value: str, x: object, y: object) -> TTest:
    (n1, m1, s1), (n2, m2, s2) = _two(df, group, value, x, y)
    se = math.sqrt((s1 + s2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))
    return TTest(_statistic(m1 - m2, se), n1 + n2 - 2, m1 - m2, se)


def t_welch(df: DataFrame, group: str, value: str, x: object, y: object) -> TTest:
    (n1, m1, s1), (n2, m2, s2) = _two(df, group, value, x, y)
    a, b = s1 / (n1 - 1) / n1, s2 / (n2 - 1) / n2
    dof = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if a + b > 0 else float(n1 + n2 - 2)
    return TTest(_statistic(m1 - m2, math.sqrt(a + b)), dof, m1 - m2, math.sqrt(a + b))


@dataclass(frozen=True)
class MannWhitneyU:
    statistic: float
    z: float
    alternative: Alternative

    def p_value(self) -> float:
        tail = Normal().survival(self.z)
        return min(1.0, 2 * tail) if self.alternative is Alternative.TWO_SIDED else tail


def _pooled(rows: DataFrame) -> tuple[int, DataFrame, float]:
    """Number of values, a frame of (g, n, rank sum r) and the sum of t**3 - t over ties."""
    sums = settled(midranks(rows, "v", "r").groupBy("g").agg(F.count("*").alias("n"), F.sum("r").alias("r")))
    t = F.col("t").cast("double")
    ties = rows.groupBy("v").agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(t * t * t - t), F.lit(0.0))).first()[0]
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], sums, ties


def mann_whitney(df: DataFrame, group: str, value: str, x: object, y: object, alternative: Alternative = Alternative.TWO_SIDED, continuity: Continuity = Continuity.CORRECTED) -> MannWhitneyU:
    rows = _long(df, group, value).filter(F.col("g").isin([x, y]))
    n, sums, ties = _pooled(rows)
    sizes = {r["g"]: r for r in sums.collect()}  # at most the two samples
    require(x in sizes and y in sizes, "both samples need values")
    n1, n2 = sizes[x]["n"], sizes[y]["n"]
    u = sizes[x]["r"] - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    require(var > 0, "all values are tied")
    d = u - n1 * n2 / 2
    d = {Alternative.TWO_SIDED: abs(d), Alternative.GREATER: d, Alternative.LESS: -d}[alternative]
    return MannWhitneyU(u, (d - (0.5 if continuity is Continuity.CORRECTED else 0.0)) / math.sqrt(var), alternative)


@dataclass(frozen=True)
class KruskalWallis:
    statistic: float
    uncorrected: float
    degrees_of_freedom: int

    def p_value(self) -> float:
        return ChiSquared(self.degrees_of_freedom).survival(self.statistic)


def kruskal_wallis(df: DataFrame, group: str, value: str) -> KruskalWallis:
    n, sums, ties = _pooled(_long(df, group, value))
    middle = (n + 1) / 2
    k, apart = exact_sums(sums, [F.col("n"), F.col("r")], lambda n, r: [[n * (r / n - middle) ** 2]])
    require(k >= 2, "the test needs at least 2 groups that aren't empty")
    h = 12 / (n * (n + 1)) * apart[0]
    factor = 1 - ties / (float(n) ** 3 - n)
    require(factor > 0, "all values are tied")
    return KruskalWallis(h / factor, h, k - 1)


# multiple testing


class Adjustment(enum.Enum):
    BONFERRONI = "bonferroni"
    HOLM = "holm"
    BENJAMINI_HOCHBERG = "benjamini-hochberg"


def adjust(df: DataFrame, p: str, method: Adjustment, by: list[str] | None = None, name: str = "adjusted") -> DataFrame:
    """df with the p-values adjusted within each family (`by`), or over the whole table as one family. A family of `by` is
    ranked by a window, in a task; the table as a whole by running totals over its distinct p-values."""
    bad = df.filter(F.col(p).isNull() | F.isnan(p) | ~F.col(p).between(0, 1)).limit(1)
    require(not bad.take(1), "p-values must be between 0 and 1")
    if not isinstance(method, Adjustment):
        raise InvalidArgument(f"no adjustment {method!r}")
    if not by:
        return _adjust_all(df, p, method, name)
    w = Window.partitionBy(*by)
    n = F.count("*").over(w).cast("double")
    value = F.col(p)
    if method is Adjustment.BONFERRONI:
        return df.withColumn(name, F.least(F.lit(1.0), value * n))
    up, rank = w.orderBy(p), F.row_number().over(w.orderBy(p))
    ranked = df.withColumns({"_n": n, "_rank": rank})
    if method is Adjustment.HOLM:
        step = (F.col("_n") - F.col("_rank") + 1) * value
        out = F.max("_step").over(up.rowsBetween(Window.unboundedPreceding, 0))
    else:
        step = value / (F.col("_rank") / F.col("_n"))
        out = F.min("_step").over(up.rowsBetween(0, Window.unboundedFollowing))
    # tied p-values share the extreme over their places
    ranked = ranked.withColumn("_step", step).withColumn("_out", out)
    tied = Window.partitionBy(*by, p)
    ranked = ranked.withColumn("_out", (F.max if method is Adjustment.HOLM else F.min)("_out").over(tied))
    return ranked.withColumn(name, F.least(F.lit(1.0), F.col("_out"))).drop("_n", "_rank", "_step", "_out")


def _adjust_all(df: DataFrame, p: str, method: Adjustment, name: str) -> DataFrame:
    """One family. Of equal p-values, which take the places upto - c + 1 to upto, Holm's largest step is that of the first place
    and Benjamini and Hochberg's smallest that of the last."""
    if method is Adjustment.BONFERRONI:
        n = float(df.count())
        return df.withColumn(name, F.least(F.lit(1.0), F.col(p) * n))
    placed = running_total(df.groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_c")), [F.col("_p")], F.col("_c"), "_upto")
    n = float(placed.agg(F.coalesce(F.max("_upto"), F.lit(0))).first()[0])
    if method is Adjustment.HOLM:
        found = running_extreme(placed, [F.col("_p")], (F.lit(n) - F.col("_upto") + F.col("_c")) * F.col("_p"), "_out", True)
    else:
        found = running_extreme(placed, [F.desc("_p")], F.col("_p") / (F.col("_upto") / F.lit(n)), "_out", False)
    return df.join(found.select("_p", "_out"), F.col(p) == F.col("_p")).withColumn(name, F.least(F.lit(1.0), F.col("_out"))).drop("_p", "_out")


def rejected(df: DataFrame, p: str, method: Adjustment, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    require(0 < alpha <= 1, "alpha must be above 0 and at most 1")
    return adjust(df, p, method, by, "_adjusted").withColumn("rejected", F.col("_adjusted") <= alpha).drop("_adjusted")
