"""Scoring of candidates, Pareto fronts, hypervolumes and batch selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as Q
from ..functions.arrays import dot, objective, weighted_sq_distance
from ..plans.ordered import join_on, order_columns, ordered
from ..plans.ranks import top_rows
from ..plans.stage import staged
from .metrics import anova_levene


def score_candidates(df: DataFrame, mu: str, sd: str, best, xi: float = 0.1, kappa: float = 2.576) -> DataFrame:
    """Expected improvement, probability of improvement, confidence bound and exceedance threshold.

    ``best`` is a number or the name of a column. One narrow projection.
    """
    s = F.col(sd)
    return df.withColumns(
        {
            "ei": Q.expected_improvement(mu, s * s, best, xi),
            "ei_certain_zero": Q.expected_improvement_or_zero(mu, sd, best, xi),
            "poi": Q.prob_improvement(mu, sd, best, xi),
            "ucb": Q.ucb(mu, sd, kappa),
            "exceedance": Q.exceedance_threshold(mu, sd, best),
        }
    )


def kernel(x: Column, y: Column, w: Column, v0: float, a0: float, a1: float) -> Column:
    """Squared-exponential plus linear covariance with inverse-scale weights."""
    return v0 * F.exp(-weighted_sq_distance(x, y, w)) + a0 + a1 * dot(x, y)


def noisy_ei(x, mu, var, x_best, mu_best, var_best, w, v0: float, a0: float, a1: float, jitter: float = 1e-9) -> Column:
    """Expected improvement over an incumbent that is itself uncertain."""
    cov = kernel(Q.col(x), Q.col(x_best), w, v0, a0, a1)
    spread = Q.col(var) + Q.col(var_best) - 2.0 * cov
    return Q.improvement(mu, F.sqrt(F.greatest(spread, F.lit(0.0))) + jitter, mu_best)


def current_best(observed: DataFrame, row: list[str], value: str, phi: float = 0.0) -> Column:
    """Largest mean over replicates, lowered by the share ``phi``; a scalar."""
    means = observed.groupBy(*row).agg(F.avg(value).alias("m"))
    return means.agg((F.max("m") * (1.0 - phi)).alias("best")).scalar()


def poe(
    df: DataFrame, by: list[str], row: str, mu: str, sigma: str, best: str, threshold: float, method: int = 1
) -> DataFrame:
    """Probability of exceeding ``best`` per unit, the decision to go on, and expected improvement.

    Method 1 averages mean and deviation over replicates of a row and then the row probabilities
    (to four digits, as reported); method 2 pools all cells with the root mean square deviation.
    """
    if method == 1:
        rows = df.groupBy(*by, row).agg(F.avg(mu).alias("__m"), F.avg(sigma).alias("__s"), F.max(best).alias("__b"))
        p = F.round(Q.prob_exceed("__m", "__s", "__b"), 4)
        ei = Q.expected_improvement_or_zero("__m", "__s", "__b")
        out = rows.groupBy(*by).agg(F.avg(p).alias("poe"), F.avg(ei).alias("ei"), F.max("__b").alias("best"))
    else:
        s = F.col(sigma)
        pooled = df.groupBy(*by).agg(
            F.avg(mu).alias("__m"), F.sqrt(F.sum(s * s) / F.count(F.lit(1))).alias("__s"), F.max(best).alias("best")
        )
        out = pooled.select(
            *by, Q.prob_exceed("__m", "__s", "best").alias("poe"),
            Q.expected_improvement_or_zero("__m", "__s", "best").alias("ei"), "best",
        )
    return out.withColumn("go_on", F.col("poe") >= threshold)


def auto_poe(df: DataFrame, by: list[str], row: str, mu: str, sigma: str, best: str, threshold: float) -> DataFrame:
    """The method chosen by the variance tests, and its probability."""
    choice = anova_levene(df, by, row, mu, sigma).select(*by, "method")
    both = join_on(
        poe(df, by, row, mu, sigma, best, threshold, 1).select(*by, F.col("poe").alias("__p1")),
        poe(df, by, row, mu, sigma, best, threshold, 2).select(*by, F.col("poe").alias("__p2")), by,
    )
    p = F.when(F.col("method") == "method1", F.col("__p1")).otherwise(F.col("__p2"))
    out = join_on(both, choice, by).withColumn("poe", p)
    return out.withColumn("go_on", F.col("poe") >= threshold).drop("__p1", "__p2")


def pareto_front(
    df: DataFrame, by: list[str], x: str, y: str, maximise: tuple[bool, bool] = (True, True), cap: int | None = None
) -> DataFrame:
    """Rows no other row of the group beats or equals in both objectives while beating it in one.

    Equal x values are merged before the shuffle; the rest is one running extreme in x order.
    """
    ok = df.filter(Q.finite(x) & Q.finite(y))
    sx, sy = (1.0 if m else -1.0 for m in maximise)
    points = ok.groupBy(*by, (F.col(x).cast("double") * sx).alias("__x")).agg(F.max(F.col(y).cast("double") * sy).alias("__y"))
    run = ordered(points, by, ["-__x"], cap).running(exclusive=True, __above=("max", F.col("__y"))).done()
    front = run.filter(F.col("__above").isNull() | (F.col("__y") > F.col("__above"))).select(*by, "__x", "__y")
    rows = ok.withColumns({"__x": F.col(x).cast("double") * sx, "__y": F.col(y).cast("double") * sy})
    return join_on(rows, front, [*by, "__x", "__y"], "left_semi").drop("__x", "__y")


def _meetings(df: DataFrame, place: str, levels: int, tag: int) -> tuple[DataFrame, list[str]]:
    """``df`` once per level, with ``__late``, and the columns of level and block: two rows with different places (from 0) share
    the block of exactly one level in which the earlier one is not late and the later one is."""
    level, block = f"__l{tag}", f"__b{tag}"
    out = df.withColumn(level, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    late = F.expr(f"shiftright({place}, {level}) & 1L") == 1
    return out.withColumns({block: F.expr(f"shiftright(shiftright({place}, {level}), 1)"), "__late": late}).drop(place), [level, block]


def _overtaken(df: DataFrame, by: list[str], dims: list[str], row: str, cap: int | None) -> DataFrame:
    """(row) of the late rows with an early row in their group that is at least as large in all ``dims``."""
    if len(dims) == 1:
        best = df.filter("NOT __late").groupBy(*by).agg(F.max(dims[0]).alias("__best"))
        return join_on(df.filter("__late"), best, by).filter(F.col("__best") >= F.col(dims[0])).select(row).distinct()
    first, rest = dims[0], dims[1:]
    o = ordered(df, by, [f"-{first}", "__late", row], cap)
    if len(rest) == 1:
        run = o.running(__best=("max", F.when(~F.col("__late"), F.col(rest[0])))).done()
        return run.filter(F.col("__late") & (F.col("__best") >= F.col(rest[0]))).select(row).distinct()
    # the early rows that are as large in the first objective stand before a late one: halving places leaves the others
    placed = staged(o.index("__place").done().withColumn("__place", F.col("__place") - 1).withColumn("__was", F.col("__late")), "places")
    levels = int(placed.agg(F.max("__place")).first()[0] or 0).bit_length()
    if not levels:
        return df.select(row).limit(0)
    met, keys = _meetings(placed, "__place", levels, len(dims))
    return _overtaken(met.filter(F.col("__late") == F.col("__was")).drop("__was"), [*by, *keys], rest, row, cap)


def pareto_front_nd(df: DataFrame, by: list[str], objectives: list[str], maximise: list[bool] | None = None, cap: int | None = None) -> DataFrame:
    """Rows no other row of the group equals or beats in all ``objectives`` while beating it in one, for any number of them.

    Rows with a value that is no finite number are left out. Points equal in all objectives are one point, so they stay or
    go together. First everything below its group's point of largest sum of scaled objectives goes. The points left get a
    place by the first objective (then the others); each halving of the places is a level, and a point's better ones in
    that objective lie before it in exactly one level, where one objective less decides. With the last two, it is a running
    maximum. For d objectives that makes n log(n)^(d-2) rows, in groups that may be of any size and are cut into ranges:
    never a pair of points and never a group in one task, even if all points are on the front.
    """
    signs = [1.0 if m else -1.0 for m in (maximise or [True] * len(objectives))]
    names = [f"__o{i}" for i in range(len(objectives))]
    ok = df.filter(reduce(lambda a, b: a & b, [Q.finite(c) for c in objectives]))
    ok = ok.withColumns({n: F.col(c).cast("double") * s + 0.0 for n, c, s in zip(names, objectives, signs, strict=True)})
    points = ok.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    if len(names) == 1:
        front = points.groupBy(*by).agg(F.max(names[0]).alias(names[0]))
        return join_on(ok, front, [*by, *names], "left_semi").drop(*names)
    points = staged(points, "points")
    spans = points.groupBy(*by).agg(*[F.min(n).alias(f"{n}_lo") for n in names], *[F.max(n).alias(f"{n}_hi") for n in names])
    scaled = reduce(lambda a, b: a + b, [F.when(F.col(f"{n}_hi") > F.col(f"{n}_lo"), (F.col(n) - F.col(f"{n}_lo")) / (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).otherwise(0.0) for n in names])
    lead = join_on(points, spans, by).groupBy(*by).agg(F.max_by(F.struct(*names), scaled).alias("__lead"))
    under = reduce(lambda a, b: a & b, [F.col(f"__lead.{n}") >= F.col(n) for n in names]) & reduce(lambda a, b: a | b, [F.col(f"__lead.{n}") > F.col(n) for n in names])
    left = join_on(points, lead, by).filter(~under).drop("__lead")
    placed = ordered(left, by, [f"-{n}" for n in names], cap).index("__place").done()
    placed = staged(placed.withColumns({"__place": F.col("__place") - 1, "__row": F.monotonically_increasing_id()}), "places")
    front = placed
    levels = int(placed.agg(F.max("__place")).first()[0] or 0).bit_length()
    if levels:
        met, keys = _meetings(placed, "__place", levels, len(names))
        beaten = _overtaken(met, [*by, *keys], names[1:], "__row", cap)
        front = placed.join(beaten, "__row", "left_anti")
    return join_on(ok, front.select(*by, *names), [*by, *names], "left_semi").drop(*names)


def hv_contribution(df: DataFrame, by: list[str], x: str, y: str, ident: str, cap: int | None = None) -> DataFrame:
    """What each point adds to the strip sum below (min x - 1, min y - 1), in closed form.

    In descending x, taking a point out changes the sum by (x_prev - x)(y_next - y), with the reference
    for the missing neighbour. The reference corner lies below the points, so strips have mixed sign;
    the true dominated area is ``hypervolume_2d``.
    """
    rows = df.filter(Q.finite(x) & Q.finite(y))
    o = ordered(rows, by, [f"-{x}", ident], cap)
    o = o.previous(__xp=F.col(x)).following(__yn=F.col(y)).total(__x0=("min", F.col(x)), __y0=("min", F.col(y)))
    left = F.coalesce("__xp", F.col("__x0") - 1.0) - F.col(x)
    down = F.coalesce("__yn", F.col("__y0") - 1.0) - F.col(y)
    return o.done().withColumn("hv_contribution", F.greatest(left * down, F.lit(0.0))).drop("__xp", "__yn", "__x0", "__y0")


def hypervolume_2d(df: DataFrame, by: list[str], generation: str, x: str, y: str, cap: int | None = None) -> DataFrame:
    """Area dominated per generation, both objectives minimised, one reference point per run.

    The reference is the run's maximum plus 5 % of its range (a range of 0 counts as 1).
    """
    def ref(c: str) -> Column:
        span = F.max(c) - F.min(c)
        return F.max(c) + 0.05 * F.when(span == 0, 1.0).otherwise(span)

    refs = df.groupBy(*by).agg(ref(x).alias("__rx"), ref(y).alias("__ry"))
    keys = [*by, generation]
    front = pareto_front(df.select(*keys, x, y).distinct(), keys, x, y, (False, False), cap)
    o = ordered(join_on(front, refs, by), keys, [x], cap).following(__xn=F.col(x))
    strip = (F.coalesce("__xn", "__rx") - F.col(x)) * (F.col("__ry") - F.col(y))
    return o.df.groupBy(*keys).agg(F.sum(strip).alias("hypervolume"), F.count(F.lit(1)).alias("front_size"))


def score_points(df: DataFrame, x: str, names: list[str], maximise: bool = True) -> DataFrame:
    """Benchmark objectives of a point table."""
    return df.withColumns({n: objective(n, F.col(x), maximise) for n in names})


def select_batch(
    df: DataFrame, strategy: str, total: int, ident: str, ei: str = "ei", mean: str = "mean", hv: str = "hv_contribution",
    k: int | None = None, seed: int = 0,
) -> DataFrame:
    """Pick the next experiments, with the list each comes from and its position.

    ``EI`` falls back to the mean where no expected improvement is positive; ``hybrid`` takes ``k`` by EI
    and the rest by hypervolume, and may name a point in both lists. Each list is a distributed top-k.
    """

    def by_ei(n: int) -> DataFrame:
        positive = df.agg((F.max(ei) > 0).alias("p")).scalar()
        key = F.when(F.coalesce(F.col("__pos"), F.lit(False)), F.col(ei)).otherwise(F.col(mean))
        scored = df.withColumn("__pos", positive).withColumn("__key", key)
        return top_rows(scored, [], ["-__key", ident], n, "position").drop("__pos", "__key").withColumn("list", F.lit("EI"))

    def by_hv(n: int) -> DataFrame:
        return top_rows(df, [], [f"-{hv}", ident], n, "position").withColumn("list", F.lit("HV"))

    if strategy == "EI":
        return by_ei(total)
    if strategy == "HV":
        return by_hv(total)
    if strategy == "random":
        mixed = df.withColumn("__h", hash_text(seed, F.col(ident)))
        return top_rows(mixed, [], ["__h", ident], total, "position").drop("__h").withColumn("list", F.lit("random"))
    if strategy == "hybrid":
        share = total // 2 if k is None else k
        return by_ei(share).unionByName(by_hv(total - share))
    raise ValueError(f"unknown strategy {strategy!r}")


def candidate_shortlist(df: DataFrame, metric: str, k: int, ident: str) -> DataFrame:
    """Best ``k`` by a training metric; failed evaluations count as infinite."""
    score = F.when(Q.finite(metric), F.col(metric)).otherwise(F.lit(float("inf")))
    return df.withColumn("score", score).orderBy(*order_columns(["score", ident])).limit(k)


def hash_text(seed: int, *cols: Column) -> Column:
    """A reproducible shuffle key that any engine with MD5 shares."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_number(text: Column, digits: int = 13) -> Column:
    """Whole number of the leading hexadecimal digits of a hash."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")
