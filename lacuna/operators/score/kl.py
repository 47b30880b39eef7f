"""KL divergence of numeric columns via Gaussian KDE (M5, M6).

Per group (part, column, subgroup, scope): both series are scaled by the truth's
mean / population std; each side's KDE uses Scott's bandwidth
std_sample * n^(-1/5); densities are evaluated on a 1000-point linspace over
the joint range; zeros in q become 1e-9; KL = sum p' ln(p'/q') of the
normalised vectors.  Special cases: <= 2 truths -> NULL; both sides constant ->
0 (same value) or 100; one side constant -> 999 grid points plus that value as
a point mass.

Execution: group statistics are one small aggregate (one row per group, a
number bounded by the spec, so broadcasting it is safe).  The values of a group
are summed up in cells a 16th of the bandwidth wide: with z the value in
bandwidths, c the middle of its cell, e = z - c and y = x - c,
exp(-(x - z)^2 / 2) = exp(-y^2 / 2) * exp(-e^2 / 2) * sum of y^k e^k / k!, so the sums
of exp(-e^2 / 2) e^k / k! are all that the grid needs of a cell.  Where the density is
not zero in double precision |y| is below 39 and |y e| below 1.25; ``TERMS`` terms leave
a relative error of 1e-17, less than the rounding of a plain sum.  A group
thus has range / bandwidth x 16 cells (about n^(1/5)), one group-by makes them,
and only cells are evaluated on the grid, in ``mapInPandas``, whose sums
(1000 rows per group and batch) one group-by adds up.  The n x 1000 cross
product never exists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["part", "column", "subgroup"]
ABSENT = 1e-9
SQRT2PI = math.sqrt(2.0 * math.pi)
CELLS = 16  # cells per bandwidth
TERMS = 20  # of the series in a cell
FAR = 37.0  # bandwidths from which exp(-y^2 / 2) alone may underflow
CHUNK = 128  # cells per numpy block: CHUNK x grid doubles in memory


def _scoped(cells: DataFrame) -> DataFrame:
    return cells.select(*KEYS, "t", "p", F.explode(
        F.when(F.col("miss"), F.array(F.lit("pred"), F.lit("total"))).otherwise(F.array(F.lit("total")))
    ).alias("scope"))


def _group_stats(scoped: DataFrame, grid: int) -> DataFrame:
    st = scoped.groupBy(*KEYS, "scope").agg(
        F.count("t").alias("n"), F.avg("t").alias("mu"), F.stddev_pop("t").alias("sd"),
        F.count("p").alias("np"),
        F.min("t").alias("tmin"), F.max("t").alias("tmax"), F.min("p").alias("pmin"), F.max("p").alias("pmax"),
        F.stddev_samp("t").alias("sst"), F.stddev_samp("p").alias("ssp"),
        F.min("t").alias("t0"), F.min("p").alias("p0"))
    s = F.coalesce(F.nullif(F.col("sd"), F.lit(0.0)), F.lit(1.0))
    scale = lambda e: (e - F.col("mu")) / s
    one_p, one_t = F.col("pmin") == F.col("pmax"), F.col("tmin") == F.col("tmax")
    branch = (F.when(F.col("n") <= 2, F.lit("none"))
              .when(one_p & one_t, F.lit("const"))
              .when(one_p, F.lit("pred_point"))
              .when(one_t, F.lit("true_point"))
              .otherwise(F.lit("kde")))
    return st.select(
        *KEYS, "scope", "n", "np", branch.alias("branch"),
        F.least(scale(F.col("tmin")), scale(F.col("pmin"))).alias("lo"),
        F.greatest(scale(F.col("tmax")), scale(F.col("pmax"))).alias("hi"),
        "mu", s.alias("s"),
        ((F.col("sst") / s) * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("ht"),
        ((F.col("ssp") / s) * F.pow(F.col("np").cast("double"), F.lit(-0.2))).alias("hp"),
        scale(F.col("t0")).alias("tpt"), scale(F.col("p0")).alias("ppt"),
        F.when(F.col("t0") == F.col("p0"), F.lit(0.0)).otherwise(F.lit(100.0)).alias("const_kl"),
        F.lit(grid).alias("grid"),
        F.concat_ws("\u0001", *KEYS, "scope").alias("gid"))


def _points(p):
    if p["branch"] == "kde":
        return np.linspace(p["lo"], p["hi"], p["grid"])
    extra = p["ppt"] if p["branch"] == "pred_point" else p["tpt"]
    return np.append(np.linspace(p["lo"], p["hi"], p["grid"] - 1), extra)


def density_cells(scoped: DataFrame, stats: DataFrame) -> DataFrame:
    """(gid, side, cell, m0, m1, ...): the sums of a cell of each side that has a density,
    side 't' (truth) or 'p' (imputed)."""
    def bandwidths(v, width, other):
        return F.when(F.col("branch") != other, (F.col(v) - F.col("mu")) / F.col("s") / F.nullif(F.col(width), F.lit(0.0)))

    by = stats.where("branch IN ('kde', 'pred_point', 'true_point')").select(*KEYS, "scope", "gid", "branch", "mu", "s", "ht", "hp")
    sides = F.explode(F.array(F.struct(F.lit("t").alias("side"), bandwidths("t", "ht", "true_point").alias("z")),
                              F.struct(F.lit("p").alias("side"), bandwidths("p", "hp", "pred_point").alias("z"))))
    valued = scoped.join(F.broadcast(by), [*KEYS, "scope"]).select("gid", sides.alias("x")).select("gid", "x.*").where("z IS NOT NULL")
    placed = valued.withColumn("cell", F.floor(F.col("z") * CELLS + 0.5)).withColumn("e", F.col("z") - F.col("cell") / CELLS)
    e, power = F.col("e"), F.exp(-0.5 * F.col("e") * F.col("e"))
    sums = []
    for k in range(TERMS):
        power = power if k == 0 else power * (e / k)
        sums.append(F.sum(F.col(f"w{k}")).alias(f"m{k}"))
        placed = placed.withColumn(f"w{k}", power)
        power = F.col(f"w{k}")
    return placed.groupBy("gid", "side", "cell").agg(*sums)


def _density_sums_fn(params: dict):
    """Partial sums of exp(-d^2/2) per (group, grid point) for Arrow batches of cells."""
    moments = [f"m{k}" for k in range(TERMS)]

    def fn(batches):
        for pdf in batches:
            out = []
            for gid, g in pdf.groupby("gid", sort=False):
                p = params[gid]
                x = _points(p)
                sums = {}
                for side, width in (("t", "ht"), ("p", "hp")):
                    total = np.zeros(len(x))
                    h = g[g["side"] == side]
                    c, m = h["cell"].to_numpy(dtype=float) / CELLS, h[moments].to_numpy(dtype=float)
                    for i in range(0, len(c), CHUNK):
                        y = x[None, :] / p[width] - c[i:i + CHUNK, None]
                        series = np.repeat(m[i:i + CHUNK, -1:], len(x), axis=1)
                        for k in range(TERMS - 2, -1, -1):
                            series *= y
                            series += m[i:i + CHUNK, k:k + 1]
                        y *= y
                        y *= -0.5
                        part = np.exp(y)
                        part *= series
                        # as small as doubles are: in one exponent, as a single value has it
                        far = (y < -0.5 * FAR ** 2) & (y > -800.0)
                        part[far] = np.exp(y[far] + np.log(np.maximum(series[far], 1e-300)))
                        total += part.sum(axis=0)
                    sums[side] = total
                out.append(pd.DataFrame({"gid": gid, "j": np.arange(len(x), dtype=np.int32),
                                         "x": x, "st": sums["t"], "sp": sums["p"]}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return fn


def numeric_kl(cells: DataFrame, grid: int = 1000) -> DataFrame:
    """(part, column, subgroup, kl_divergence_pred, kl_divergence_total) for numeric cells."""
    scoped = _scoped(cells)
    stats = _group_stats(scoped, grid)
    # Group parameters: one row per (part, column, subgroup, scope) -- bounded by
    # the scenario spec, not by the data -- shipped to tasks in the closure.
    rows = stats.collect()
    stats = cells.sparkSession.createDataFrame(rows, stats.schema)
    params = {r["gid"]: r.asDict() for r in rows if r["branch"] in ("kde", "pred_point", "true_point")}
    if not params:
        dens = None
    else:
        # CPU-heavy per row (grid evaluations), so not coalesced by bytes
        work = density_cells(scoped, stats).repartition(
            int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gid", "side")
        dens = (work.mapInPandas(_density_sums_fn(params), "gid string, j int, x double, st double, sp double")
                .groupBy("gid", "j").agg(F.first("x").alias("x"), F.sum("st").alias("st"), F.sum("sp").alias("sp")))
    if dens is not None:
        d = dens.join(F.broadcast(stats.select("gid", "branch", "n", "np", "ht", "hp", "tpt", "ppt")), "gid")
        dens_t = F.col("st") / (F.col("n") * F.col("ht") * F.lit(SQRT2PI))
        dens_p = F.col("sp") / (F.col("np") * F.col("hp") * F.lit(SQRT2PI))
        P = (F.when(F.col("branch") == "true_point",
                    F.when(F.col("x") == F.col("tpt"), F.lit(1.0)).otherwise(F.lit(ABSENT)))
             .otherwise(dens_t))
        Q = (F.when(F.col("branch") == "pred_point",
                    F.when(F.col("x") == F.col("ppt"), F.lit(1.0)).otherwise(F.lit(ABSENT)))
             .when(F.col("branch") == "kde", F.when(dens_p == 0, F.lit(ABSENT)).otherwise(dens_p))
             .otherwise(dens_p))
        kl = (d.select("gid", P.alias("P"), Q.alias("Q"))
              .groupBy("gid").agg(F.sum("P").alias("SP"), F.sum("Q").alias("SQ"),
                                  F.sum(F.when(F.col("P") > 0, F.col("P") * F.log(F.col("P") / F.col("Q")))
                                        .otherwise(F.lit(0.0))).alias("SPL"))
              .select("gid", (F.col("SPL") / F.col("SP") + F.log(F.col("SQ") / F.col("SP"))).alias("kl")))
        per_group = stats.join(kl, "gid", "left")
    else:
        per_group = stats.withColumn("kl", F.lit(None).cast("double"))
    per_group = per_group.select(*KEYS, "scope", F.when(F.col("branch") == "none", F.lit(None).cast("double"))
                                 .when(F.col("branch") == "const", F.col("const_kl")).otherwise(F.col("kl")).alias("kl"))
    return (per_group.groupBy(*KEYS).pivot("scope", ["pred", "total"]).agg(F.first("kl"))
            .withColumnRenamed("pred", "kl_divergence_pred").withColumnRenamed("total", "kl_divergence_total"))


# ---- SQL twin (brute force: cells x grid join; fine at oracle sizes) ---------------

def sql_numeric_kl(cells_sql: str, grid: int = 1000) -> str:
    g1, g2 = grid - 1, grid - 2
    return f"""
WITH scoped AS (
  SELECT part, col, subgroup, 'pred' AS scope, t, p FROM ({cells_sql}) WHERE miss
  UNION ALL SELECT part, col, subgroup, 'total' AS scope, t, p FROM ({cells_sql})),
st AS (
  SELECT part, col, subgroup, scope, count(t) AS n, avg(t) AS mu, coalesce(nullif(stddev_pop(t), 0), 1) AS s,
    count(DISTINCT t) AS dt, count(DISTINCT p) AS dp, count(p) AS np, min(t) AS tmin, max(t) AS tmax,
    min(p) AS pmin, max(p) AS pmax, stddev_samp(t) AS sst, stddev_samp(p) AS ssp
  FROM scoped GROUP BY ALL),
g AS (
  SELECT *, CASE WHEN n <= 2 THEN 'none' WHEN dp = 1 AND dt = 1 THEN 'const' WHEN dp = 1 THEN 'pred_point'
                 WHEN dt = 1 THEN 'true_point' ELSE 'kde' END AS branch,
    least((tmin - mu) / s, (pmin - mu) / s) AS lo, greatest((tmax - mu) / s, (pmax - mu) / s) AS hi,
    (sst / s) * pow(CAST(n AS DOUBLE), -0.2) AS ht, (ssp / s) * pow(CAST(np AS DOUBLE), -0.2) AS hp,
    (tmin - mu) / s AS tpt, (pmin - mu) / s AS ppt,
    CASE WHEN tmin = pmin THEN 0.0 ELSE 100.0 END AS const_kl
  FROM st),
gr AS (
  SELECT g.part, g.col, g.subgroup, g.scope, g.branch, g.n, g.np, g.mu, g.s, g.ht, g.hp, g.tpt, g.ppt, r.j,
    CASE WHEN g.branch = 'kde' THEN (CASE WHEN r.j = {g1} THEN g.hi ELSE r.j * ((g.hi - g.lo) / {g1}.0) + g.lo END)
         ELSE (CASE WHEN r.j = {g1} THEN (CASE WHEN g.branch = 'pred_point' THEN g.ppt ELSE g.tpt END)
                    WHEN r.j = {g2} THEN g.hi ELSE r.j * ((g.hi - g.lo) / {g2}.0) + g.lo END) END AS x
  FROM g, range({grid}) r(j) WHERE g.branch IN ('kde', 'pred_point', 'true_point')),
dens AS (
  SELECT gr.part, gr.col, gr.subgroup, gr.scope, gr.j, any_value(gr.x) AS x, any_value(gr.branch) AS branch,
    any_value(gr.tpt) AS tpt, any_value(gr.ppt) AS ppt,
    sum(exp(-0.5 * power((gr.x - (sc.t - gr.mu) / gr.s) / gr.ht, 2))) / (any_value(gr.n) * any_value(gr.ht) * sqrt(2 * pi())) AS dt_,
    sum(exp(-0.5 * power((gr.x - (sc.p - gr.mu) / gr.s) / gr.hp, 2))) / (any_value(gr.np) * any_value(gr.hp) * sqrt(2 * pi())) AS dp_
  FROM gr JOIN scoped sc ON gr.part = sc.part AND gr.col = sc.col AND gr.subgroup = sc.subgroup AND gr.scope = sc.scope
  GROUP BY gr.part, gr.col, gr.subgroup, gr.scope, gr.j),
pq AS (
  SELECT part, col, subgroup, scope,
    CASE WHEN branch = 'true_point' THEN (CASE WHEN x = tpt THEN 1.0 ELSE {ABSENT} END) ELSE dt_ END AS P,
    CASE WHEN branch = 'pred_point' THEN (CASE WHEN x = ppt THEN 1.0 ELSE {ABSENT} END)
         WHEN branch = 'kde' THEN (CASE WHEN dp_ = 0 THEN {ABSENT} ELSE dp_ END) ELSE dp_ END AS Q
  FROM dens),
kl AS (
  SELECT part, col, subgroup, scope,
    sum(CASE WHEN P > 0 THEN P * ln(P / Q) ELSE 0.0 END) / sum(P) + ln(sum(Q) / sum(P)) AS kl
  FROM pq GROUP BY ALL),
per AS (
  SELECT g.part, g.col, g.subgroup, g.scope,
    CASE WHEN g.branch = 'none' THEN NULL WHEN g.branch = 'const' THEN g.const_kl ELSE kl.kl END AS kl
  FROM g LEFT JOIN kl USING (part, col, subgroup, scope))
SELECT part, col, subgroup,
  max(CASE WHEN scope = 'pred' THEN kl END) AS kl_divergence_pred,
  max(CASE WHEN scope = 'total' THEN kl END) AS kl_divergence_total
FROM per GROUP BY ALL"""
