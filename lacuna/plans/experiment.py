"""Experiment runner (J8, J9, I32, I33, M12): split -> inject train and every test
scenario -> impute -> score, as one long DataFrame with a ``part`` column.

The N test parts are copies of the same base test rows (one ``explode``, not N
scans); each part gets its own injection chain; the imputer is fitted on the
train part only and applied to all parts by one projection; scoring is one
group-by plan.  Every function has a SQL twin building the same rows in DuckDB.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.impute.simple import IMPUTERS, sql_stats
from ..operators.inject import inject, sql_inject
from ..operators.score.cells import MISS, REAL, score, sql_score, with_missing_flags, with_truth
from ..operators.split import TEST, TRAIN, sql_train_test_split, train_test_split
from ..session import drop_path, spread, write_barrier
from ..sources.tables import TableSpec, base_sql
from .scenarios import injection_scenarios, scenario_steps, test_part


def part_plans(dataset: str, evaluation_scenario: str) -> dict:
    train_s, tests = injection_scenarios(evaluation_scenario)
    plans = {TRAIN: scenario_steps(dataset, train_s)}
    for s in tests:
        plans[test_part(s)] = scenario_steps(dataset, s)
    return plans


def prepare_parts(spec: TableSpec, evaluation_scenario: str, seed: int, n: int | None = None) -> DataFrame:
    """Long table: part, row_id, corrupted features, __real_*, __miss_*, sensitive, label."""
    plans = part_plans(spec.name, evaluation_scenario)
    tests = [p for p in plans if p != TRAIN]
    base = spec.df.persist(StorageLevel.MEMORY_AND_DISK)  # split count + threshold jobs share one scan/join
    split = train_test_split(base, seed, spec.test_fraction, n=n)
    long = split.withColumn("part", F.explode(
        F.when(F.col("part") == TEST, F.array(*[F.lit(p) for p in tests])).otherwise(F.array(F.lit(TRAIN)))))
    long = spread(with_truth(long, spec.features), "row_id")
    out = with_missing_flags(inject(long, plans, seed), spec.features)
    base.unpersist()  # the injected long table holds its own cache from here on
    return out


def make_imputer(spec: TableSpec, name: str):
    return IMPUTERS[name](spec.lower_bounds) if name == "min-mode" else IMPUTERS[name]()


def impute(spec: TableSpec, parts: DataFrame, imputer_name: str):
    """Fit on the train part (after injection) and transform every part, lazily; minutes
    of the fit alone (:func:`timed_impute` times the whole imputation)."""
    t0 = time.time()
    model = make_imputer(spec, imputer_name).fit(parts.where(F.col("part") == TRAIN), spec.numeric, spec.categorical)
    return model.transform(parts), model, (time.time() - t0) / 60.0


def timed_impute(spec: TableSpec, parts: DataFrame, imputer_name: str):
    """I32: the imputed parts, written in the shared folder, their path, and the minutes
    from the start of the fit to the end of the write."""
    t0 = time.time()
    imputed, path = write_barrier(impute(spec, parts, imputer_name)[0], "imputed")
    return imputed, path, (time.time() - t0) / 60.0


def drop_sensitive(spec: TableSpec, parts: DataFrame) -> tuple[DataFrame, list, list]:
    """The parts without their sensitive columns, and the numeric and categorical lists
    without them: what models are trained on."""
    gone = set(spec.sensitive_attrs)
    return parts.drop(*gone), [c for c in spec.numeric if c not in gone], [c for c in spec.categorical if c not in gone]


def imputation_metrics(spec: TableSpec, imputer_name: str, evaluation_scenario: str, seed: int,
                       numeric_kl: bool = True, parts: DataFrame | None = None) -> DataFrame:
    parts = prepare_parts(spec, evaluation_scenario, seed) if parts is None else parts
    imputed, _, _ = impute(spec, parts, imputer_name)
    m = score(imputed, spec.numeric, spec.categorical, spec.sensitive, numeric_kl=numeric_kl)
    return m.select(F.lit(spec.name).alias("dataset_name"), F.lit(imputer_name).alias("null_imputer_name"),
                    F.lit(evaluation_scenario).alias("evaluation_scenario"),
                    F.lit(seed).alias("experiment_seed"), *m.columns)


# ---- SQL twins -------------------------------------------------------------------

def sql_prepare_parts(dataset: str, features, evaluation_scenario: str, seed: int, test_fraction: float,
                      subsample=None) -> str:
    plans = part_plans(dataset, evaluation_scenario)
    tests = [p for p in plans if p != TRAIN]
    split = sql_train_test_split(base_sql(dataset, subsample), seed, test_fraction)
    truth = ", ".join(f"{c} AS {REAL}{c}" for c in features)
    long_arms = [f"SELECT * EXCLUDE (part), '{TRAIN}' AS part, {truth} FROM ({split}) WHERE part = '{TRAIN}'"]
    long_arms += [f"SELECT * EXCLUDE (part), '{p}' AS part, {truth} FROM ({split}) WHERE part = '{TEST}'" for p in tests]
    injected = " UNION ALL BY NAME ".join(
        f"({sql_inject(arm, plans[p], seed)})" for p, arm in zip([TRAIN] + tests, long_arms))
    flags = ", ".join(f"({c} IS NULL AND {REAL}{c} IS NOT NULL) AS {MISS}{c}" for c in features)
    return f"SELECT *, {flags} FROM ({injected})"


def sql_impute(parts_sql: str, imputer: str, numeric, categorical, bounds: dict | None = None) -> str:
    train = f"SELECT * FROM ({parts_sql}) WHERE part = '{TRAIN}'"
    stats = sql_stats(imputer, numeric, categorical, train, bounds)
    repl = ", ".join(f"coalesce({c}, {v}) AS {c}" for c, v in stats.items())
    where = ""
    if imputer == "deletion":
        feats = list(numeric) + list(categorical)
        where = f" WHERE part <> '{TRAIN}' OR (" + " AND ".join(f"{c} IS NOT NULL" for c in feats) + ")"
    return f"SELECT * REPLACE ({repl}) FROM ({parts_sql}){where}"


def sql_imputation_metrics(spec_name: str, numeric, categorical, sensitive, test_fraction, imputer: str,
                           evaluation_scenario: str, seed: int, numeric_kl_sql=None) -> str:
    feats = list(numeric) + list(categorical)
    parts = sql_prepare_parts(spec_name, feats, evaluation_scenario, seed, test_fraction)
    imputed = sql_impute("SELECT * FROM parts", imputer, numeric, categorical)
    body = sql_score("SELECT * FROM imputed", numeric, categorical, sensitive, numeric_kl_sql)
    return (f"WITH parts AS MATERIALIZED ({parts}), imputed AS MATERIALIZED ({imputed}) "
            f"SELECT '{spec_name}' AS dataset_name, '{imputer}' AS null_imputer_name, "
            f"'{evaluation_scenario}' AS evaluation_scenario, {seed} AS experiment_seed, * FROM ({body})")


RUN = "\u0001"  # between imputer and part, while the runs of a grid are scored together


def run_grid(spec: TableSpec, imputers, scenarios, seeds, store=None, numeric_kl: bool = True,
             save_imputed: bool = False) -> DataFrame:
    """Imputers x evaluation scenarios x seeds.  The injected parts of a
    (scenario, seed) are built once and shared by every imputer, and one plan scores
    all imputers there; each run's metric
    rows carry guids, runtime and session (M12) and are appended to ``store``
    (S8) when given, with the imputed parts saved (S5) on request.  Returns the
    union of all metric rows (read back from the store when one is used)."""
    from functools import reduce

    from ..sources.store import with_metric_keys
    frames = []
    for scenario in scenarios:
        for seed in seeds:
            parts = prepare_parts(spec, scenario, seed)
            runs, paths, minutes = [], [], []
            for imp in imputers:
                imputed, path, took = timed_impute(spec, parts, imp)
                if store is not None and save_imputed:
                    store.save_imputed(imputed.select("part", "row_id", *spec.features), spec.name, imp,
                                       scenario, seed)
                runs.append(imputed.withColumn("part", F.concat_ws(RUN, F.lit(imp), "part")))
                paths.append(path)
                minutes += [F.lit(imp), F.lit(took)]
            m = score(reduce(lambda a, b: a.unionByName(b), runs), spec.numeric, spec.categorical, spec.sensitive,
                      numeric_kl=numeric_kl)
            run = F.split("dataset_part", RUN)
            m = m.select(F.lit(spec.name).alias("dataset_name"), run[0].alias("null_imputer_name"),
                         F.lit(scenario).alias("evaluation_scenario"), F.lit(seed).alias("experiment_seed"),
                         run[1].alias("dataset_part"), *[c for c in m.columns if c != "dataset_part"])
            m = with_metric_keys(m, F.create_map(*minutes)[F.col("null_imputer_name")], store.session_uuid if store else None)
            if store is None:
                frames.append(m)
                continue
            store.append("imputation_metrics", m)
            for path in paths:
                drop_path(parts.sparkSession, path)
    if store is None:
        return reduce(lambda a, b: a.unionByName(b), frames)
    return store.read("imputation_metrics", dataset_name=spec.name)
