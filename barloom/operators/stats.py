"""Statistics of trade and return series: moments, probabilistic and deflated Sharpe ratios, step-down correction,
effective numbers, forward returns and permutation p-values."""

from __future__ import annotations

from math import e, sqrt
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import BASE, ordered
from ..sources.tapes import daily_trades
from .bars import h1_of

EULER = 0.5772156649015329


def moments(d: DataFrame, by: list[str], x: str = "ret") -> DataFrame:
    """n, Sharpe ratio per observation (population), skewness and plain kurtosis; (0, 0, 3) for constant or short series."""
    m = d.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    ok = (F.col("n") >= 2) & (F.col("sd") > 0)
    return m.select(*by, "n", F.when(ok, F.col("mean") / F.col("sd")).otherwise(0.0).alias("sharpe"), F.when(ok, F.col("skew")).otherwise(0.0).alias("skew"), F.when(ok, F.col("kurt")).otherwise(3.0).alias("kurt"))


def psr_argument(reference=0.0):
    """What the probabilistic Sharpe ratio takes the normal distribution of, from the columns of ``moments``."""
    sr = F.col("sharpe")
    inner = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    return F.when((F.col("n") >= 2) & (inner > 0), (sr - reference) * F.sqrt(F.col("n") - 1) / F.sqrt(inner))


def probabilistic(reference=0.0):
    """The probabilistic Sharpe ratio of the columns of ``moments`` as a column; 0 where it has no argument."""
    return F.coalesce(normal_cdf(psr_argument(reference)), F.lit(0.0))


def probabilistic_sharpe(n: int, sharpe: float, skew: float, kurt: float, reference: float = 0.0) -> float:
    inner = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe
    return NormalDist().cdf((sharpe - reference) * sqrt(n - 1) / sqrt(inner)) if n >= 2 and inner > 0 else 0.0


def expected_max_sharpe(variance: float, trials: float) -> float:
    """Expected largest of so many independent Sharpe ratios without skill."""
    if trials <= 1:
        return 0.0
    q = NormalDist().inv_cdf
    return sqrt(variance) * ((1 - EULER) * q(1 - 1 / trials) + EULER * q(1 - 1 / (trials * e)))


def deflated_sharpe(n: int, sharpe: float, skew: float, kurt: float, variance: float, trials: float) -> float:
    return probabilistic_sharpe(n, sharpe, skew, kurt, expected_max_sharpe(variance, trials))


#: Fixed values of a rational form of the normal distribution (to a part in 10^8) and of its inverse (to a part in 10^9).
_TAIL = ((0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376), (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752))
_MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
_OUTER = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))


def _polynomial(x, terms):
    out = F.lit(terms[0])
    for c in terms[1:]:
        out = out * x + c
    return out


def _let(value, say):
    """``say`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), say), 1)


def normal_cdf(x):
    """The normal distribution of a column, as a column expression."""

    def of(v):
        a = F.abs(v)
        bell = F.exp(-a * a / 2)
        far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
        upper = F.when(a < 7.07106781186547, bell * _polynomial(a, _TAIL[0]) / _polynomial(a, _TAIL[1])).otherwise(bell / far / 2.506628274631)
        return F.when(v > 0, 1 - upper).otherwise(upper)

    return _let(x, of)


def normal_quantile(p):
    """Its inverse for probabilities between 0 and 1, else null."""

    def of(v):
        outer = _let(F.sqrt(-2 * F.log(F.least(v, 1 - v))), lambda low: _polynomial(low, _OUTER[0]) / _polynomial(low, _OUTER[1]))
        middle = _let((v - 0.5) * (v - 0.5), lambda r: _polynomial(r, _MIDDLE[0]) * (v - 0.5) / _polynomial(r, _MIDDLE[1]))
        x = F.when(v < 0.02425, outer).when(v > 1 - 0.02425, -outer).otherwise(middle)
        return F.when((v > 0) & (v < 1), x)

    return _let(p, of)


def expected_largest(variance, trials):
    """``expected_max_sharpe`` of columns; 0 for one trial or no variance."""
    z = (1 - EULER) * normal_quantile(1 - 1 / trials) + EULER * normal_quantile(1 - 1 / (trials * e))
    return F.when((trials > 1) & (variance > 0), F.sqrt(variance) * z).otherwise(0.0)


def effective_trials(daily: DataFrame, days: DataFrame, by: list[str], name: str = "strategy", day: str = "day_id", x: str = "ret") -> DataFrame:
    """by, series, rho, n_eff: how many independent trials the series of ``by`` are worth, rho + (1 - rho) N with their mean pairwise
    correlation rho. daily: returns other than 0 (by, name, day, x); days: by, n_days that every series covers.

    The sum of all correlations is the mean over days of the squared sum of standardised returns, so no pair is formed: a
    day's sum needs the returns that are there and one constant. Series without deviation count as none."""
    m = daily.groupBy(*by, name).agg(F.sum(x).alias("s1"), F.sum(F.col(x) * F.col(x)).alias("s2")).join(days, by)
    mean = F.col("s1") / F.col("n_days")
    m = m.withColumns({"mu": mean, "sd": F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n_days") - mean * mean))}).filter("sd > 1e-9")
    base = m.groupBy(*by).agg(F.count("*").alias("series"), F.sum(F.col("mu") / F.col("sd")).alias("still"), F.first("n_days").alias("n_days"))
    of_day = daily.join(m.select(*by, name, "sd"), [*by, name]).groupBy(*by, day).agg(F.sum(F.col(x) / F.col("sd")).alias("z"))
    moved = of_day.join(base, by).groupBy(*by, "series", "still", "n_days").agg(F.sum((F.col("z") - F.col("still")) * (F.col("z") - F.col("still"))).alias("sq"), F.count("*").alias("k"))
    total = (F.col("sq") + (F.col("n_days") - F.col("k")) * F.col("still") * F.col("still")) / F.col("n_days")
    rho = F.when(F.col("series") > 1, (total - F.col("series")) / (F.col("series") * (F.col("series") - 1)))
    return moved.select(*by, "series", rho.alias("rho")).withColumn("n_eff", F.coalesce(F.col("rho") + (1 - F.col("rho")) * F.col("series"), F.col("series").cast("double")))


def clusters(corr: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, series, clusters: average-linkage clusters of series at distances (1 - rho) up to ``threshold``. corr: by, a, b, rho of a
    bounded sample of series, every pair in both orders; the matrix of one ``by`` is one group, its size the sample's squared."""

    def merge(pdf):
        import numpy as np
        import pandas as pd

        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {n: i for i, n in enumerate(names)}
        dist = np.full((len(names), len(names)), np.inf)
        dist[[at[x] for x in pdf["a"]], [at[x] for x in pdf["b"]]] = np.clip(1 - pdf["rho"].to_numpy(), 0, 2)
        np.fill_diagonal(dist, np.inf)
        size, left = np.ones(len(names)), len(names)
        while left > 1:
            i, j = divmod(int(dist.argmin()), len(names))
            if dist[i, j] > threshold:
                break
            # the mean distance of a union is the mean of its parts' by size
            both = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
            both[[i, j]] = np.inf
            dist[i], dist[:, i] = both, both
            dist[j], dist[:, j] = np.inf, np.inf
            size[i], left = size[i] + size[j], left - 1
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), len(names), left]], columns=[*by, "series", "clusters"])

    schema = ", ".join(f"{c} {t}" for c, t in corr.select(*by).dtypes) + ", series long, clusters long"
    return corr.groupBy(*by).applyInPandas(merge, schema)


def holm(d: DataFrame, by: list[str], p: str = "p", name: str = "test") -> DataFrame:
    """Step-down adjusted p values within ``by``."""
    order = Window.partitionBy(*by).orderBy(p, name)
    m = F.count("*").over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return d.withColumn("step", step).withColumn("p_holm", F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def participation_ratio(d: DataFrame, key: str = "day", name: str = "symbol", x: str = "ret") -> DataFrame:
    """Effective number of series: k squared over the sum of squared correlations, which needs no eigenvalues. One
    self-join on the key gives all pairs of series, so rows grow with series squared, not with keys squared."""
    a, b = d.select(key, F.col(name).alias("a"), F.col(x).alias("xa")), d.select(key, F.col(name).alias("b"), F.col(x).alias("xb"))
    pair = a.join(b, key).groupBy("a", "b").agg(F.corr("xa", "xb").alias("rho"))
    return pair.agg(F.count_distinct("a").alias("k"), (F.count_distinct("a") * F.count_distinct("a") / F.sum(F.col("rho") * F.col("rho"))).alias("effective"), ((F.sum("rho") - F.count_distinct("a")) / (F.count_distinct("a") * (F.count_distinct("a") - 1))).alias("mean_rho"))


def forward_net(bars: DataFrame, direction, hold: int, cost: float) -> DataFrame:
    """Net move from the next open to the close ``hold`` bars on, in the direction; null where there is none."""
    move = direction * (F.lead("close", hold).over(ordered()) - F.lead("open", 1).over(ordered())) - cost
    return bars.withColumn("net", F.when(direction != 0, move))


def permutation_p(observed: DataFrame, nulls: DataFrame, by: list[str], x: str = "value") -> DataFrame:
    """(1 + number of null values at or above the observed one) / (1 + number of null values)."""
    j = nulls.withColumnRenamed(x, "null_value").join(observed, by)
    return j.groupBy(*by).agg(((1 + F.count_if(F.col("null_value") >= F.col(x))) / (1 + F.count("*"))).alias("p"))


def daily_returns(spark, sf_dir: str) -> DataFrame:
    """Relative change of the mean price of each day that trades."""
    d = daily_trades(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.round(F.avg("price"), 4).alias("close"))
    w = Window.partitionBy("symbol").orderBy("day")
    return d.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).filter("ret is not null")


def stats_moments(spark, sf_dir: str) -> DataFrame:
    d = moments(daily_returns(spark, sf_dir), ["symbol"]).withColumn("psr_argument", psr_argument())
    return d.select("symbol", "n", *[F.round(c, 6).alias(c) for c in ("sharpe", "skew", "kurt", "psr_argument")])


def _yearly(spark, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).groupBy("symbol", F.year("day").alias("test")).agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"))
    return r.withColumn("p", F.round(1 / (1 + F.exp(1.7 * F.col("m") / F.col("s") * F.sqrt("n"))), 9))


def stats_holm(spark, sf_dir: str) -> DataFrame:
    return holm(_yearly(spark, sf_dir), ["symbol"]).select("symbol", "test", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


def stats_effective(spark, sf_dir: str) -> DataFrame:
    d = participation_ratio(daily_returns(spark, sf_dir))
    return d.select("k", F.round("effective", 6).alias("effective"), F.round("mean_rho", 6).alias("mean_rho"))


def stats_forward_net(spark, sf_dir: str) -> DataFrame:
    b = h1_of(spark, sf_dir)
    side = F.signum(F.col("close") - F.lag("close").over(ordered()))
    out = None
    for hold in (1, 4, 12):
        d = forward_net(b, side, hold, 0.1).groupBy("symbol").agg(F.lit(hold).alias("hold"), F.count("net").alias("n"), F.round(F.avg("net"), 6).alias("mean_net"), F.round(F.expr("percentile(net, 0.95)"), 6).alias("p95"))
        out = d if out is None else out.unionByName(d)
    return out


def stats_grouping_sets(spark, sf_dir: str) -> DataFrame:
    """Pooled, per symbol, per year and per both in one pass."""
    d = daily_returns(spark, sf_dir).withColumn("year", F.year("day"))
    d = d.cube("symbol", "year").agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), F.grouping_id().alias("level"))
    return d.select("symbol", "year", "n", F.round(F.col("m") / F.col("s") * F.lit(260) ** 0.5, 6).alias("sharpe"), F.col("level").cast("int").alias("level"))


def stats_permutation(spark, sf_dir: str) -> DataFrame:
    """Whether a symbol's mean return is large against all its years' means."""
    r = daily_returns(spark, sf_dir)
    observed = r.groupBy("symbol").agg(F.round(F.avg("ret"), 9).alias("value"))
    nulls = r.groupBy("symbol", F.year("day").alias("year")).agg(F.round(F.avg("ret"), 9).alias("value")).drop("year")
    return permutation_p(observed, nulls, ["symbol"]).withColumn("p", F.round("p", 6))


QUERIES = {"stats_moments": stats_moments, "stats_holm": stats_holm, "stats_effective": stats_effective, "stats_forward_net": stats_forward_net, "stats_grouping_sets": stats_grouping_sets, "stats_permutation": stats_permutation}

def _poly_sql(x: str, terms) -> str:
    out = repr(terms[0]) + "::DOUBLE"
    for c in terms[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def normal_cdf_sql(x: str) -> str:
    """``normal_cdf`` of a column for DuckDB."""
    a = f"abs({x})"
    upper = f"CASE WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {_poly_sql(a, _TAIL[0])} / {_poly_sql(a, _TAIL[1])} ELSE exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / 2.506628274631 END"
    return f"CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END"


def normal_quantile_sql(p: str) -> str:
    q, low = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{_poly_sql(low, _OUTER[0])} / {_poly_sql(low, _OUTER[1])}"
    return f"CASE WHEN {p} < 0.02425 THEN {outer} WHEN {p} > 0.97575 THEN -({outer}) ELSE {_poly_sql(f'({q} * {q})', _MIDDLE[0])} * {q} / {_poly_sql(f'({q} * {q})', _MIDDLE[1])} END"


RET = """WITH d AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM d) WHERE ret IS NOT NULL)"""
ORACLE = {
    "stats_moments": f"""{RET}, m AS (SELECT symbol, count(*) AS n, avg(ret) AS mu, stddev_pop(ret) AS sd FROM r GROUP BY symbol),
k AS (SELECT symbol, m.n, mu / sd AS sr, avg(((ret - mu) / sd) ** 3) AS sk, avg(((ret - mu) / sd) ** 4) AS ku FROM r JOIN m USING (symbol) GROUP BY symbol, m.n, mu, sd)
SELECT symbol, n, round(sr, 6) AS sharpe, round(sk, 6) AS skew, round(ku, 6) AS kurt, round(CASE WHEN 1 - sk * sr + (ku - 1) / 4 * sr * sr > 0 THEN sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) END, 6) AS psr_argument FROM k""",
    "stats_holm": f"""{RET}, y AS (SELECT symbol, year(day) AS test, round(1 / (1 + exp(1.7 * avg(ret) / stddev_pop(ret) * sqrt(count(*)))), 9) AS p FROM r GROUP BY 1, 2),
s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY p, test) + 1) * p) AS step FROM y)
SELECT symbol, test, round(p, 6) AS p, round(max(step) OVER (PARTITION BY symbol ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""",
    "stats_effective": f"""{RET}, c AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS rho FROM r a JOIN r b USING (day) GROUP BY 1, 2)
SELECT count(DISTINCT a) AS k, round(count(DISTINCT a) ** 2 / sum(rho * rho), 6) AS effective, round((sum(rho) - count(DISTINCT a)) / (count(DISTINCT a) * (count(DISTINCT a) - 1)), 6) AS mean_rho FROM c""",
    "stats_forward_net": BASE.replace("RECURSIVE ", "")
    + ", f AS ("
    + " UNION ALL ".join(f"SELECT symbol, {h} AS hold, CASE WHEN sg <> 0 THEN sg * (c{h} - o1) - 0.1 END AS net FROM (SELECT symbol, sign(close - lag(close) OVER w) AS sg, lead(close, {h}) OVER w AS c{h}, lead(open) OVER w AS o1 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))" for h in (1, 4, 12))
    + ") SELECT symbol, hold, count(net) AS n, round(avg(net), 6) AS mean_net, round(quantile_cont(net, 0.95), 6) AS p95 FROM f GROUP BY 1, 2",
    "stats_grouping_sets": f"{RET} SELECT symbol, year(day) AS year, count(*) AS n, round(avg(ret) / stddev_pop(ret) * sqrt(260), 6) AS sharpe, grouping(symbol, year(day))::INT AS level FROM r GROUP BY CUBE (symbol, year(day))",
    "stats_permutation": f"""{RET}, o AS (SELECT symbol, round(avg(ret), 9) AS v FROM r GROUP BY 1), y AS (SELECT symbol, round(avg(ret), 9) AS nv FROM r GROUP BY symbol, year(day))
SELECT symbol, round((1 + count(*) FILTER (WHERE nv >= v)) / (1 + count(*)), 6) AS p FROM y JOIN o USING (symbol) GROUP BY symbol""",
}
