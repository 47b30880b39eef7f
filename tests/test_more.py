"""Encoders, repairs, neighbours, clusters, chained imputers, graph prep,
acquisition, store and streaming on small fixtures (brute force where exact)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from lacuna.sources.tables import load, read


@pytest.fixture(scope="module")
def orders(spark):
    return load(spark, SF_SMALL, "orders")


def test_ordinal_codes_round_trip(spark, orders):
    from lacuna.operators.encode import OrdinalCodes
    codes = OrdinalCodes.fit(orders.df, list(orders.categorical))
    enc = codes.encode(orders.df.select("row_id", *orders.categorical))
    back = codes.decode(enc)
    assert back.join(orders.df.select("row_id", *[F.col(c).alias(f"o_{c}") for c in orders.categorical]), "row_id") \
        .where(" OR ".join(f"{c} <> o_{c}" for c in orders.categorical)).count() == 0
    assert codes.labels["o_orderpriority"] == sorted(codes.labels["o_orderpriority"])


def test_zscore_inverse(spark, orders):
    from lacuna.operators.encode import ColumnScaler
    sc = ColumnScaler.fit(orders.df, ["o_totalprice"])
    r = sc.inverse(sc.transform(orders.df.select("row_id", "o_totalprice").withColumnRenamed("o_totalprice", "x")
                                .withColumnRenamed("x", "o_totalprice")))
    diff = r.join(orders.df.select("row_id", F.col("o_totalprice").alias("t")), "row_id").select(
        F.max(F.abs(F.col("o_totalprice") - F.col("t")))).first()[0]
    assert diff < 1e-6


def test_thermometer(spark):
    from lacuna.operators.encode import thermometer, thermometer_inverse
    df = spark.createDataFrame([(0,), (2,)], "x int")
    t = thermometer(df, "x", 4)
    assert [r.x_thermo for r in t.collect()] == [[1, 0, 0, 0], [1, 1, 1, 0]]
    assert [r.x for r in thermometer_inverse(t.drop("x"), "x_thermo").collect()] == [0, 2]


def test_repair_table_keeps_observed(spark, orders):
    from lacuna.operators.impute.repairs import fit_repairs, repair_table
    from lacuna.operators.inject import inject
    from lacuna.plans.scenarios import scenario_steps
    df = inject(orders.df.withColumn("part", F.lit("all")), {"all": scenario_steps("orders", "MCAR3")}, 1)
    reps = fit_repairs(df, orders.numeric, orders.categorical)
    rt = repair_table(df, reps, orders.features)
    n_incomplete = df.where(" OR ".join(f"{c} IS NULL" for c in orders.features)).count()
    assert rt.count() == n_incomplete * len(reps)
    assert rt.where(" OR ".join(f"{c} IS NULL" for c in orders.features)).count() == 0


def test_knn_topk_matches_brute_force(spark):
    from lacuna.operators.impute.neighbour import knn_topk
    rng = np.random.default_rng(3)
    q = rng.normal(size=(20, 3))
    d = rng.normal(size=(300, 3))
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, v array<double>")
    ddf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(d)], "did long, v array<double>").repartition(5)
    got = knn_topk(qdf, ddf, 4, "qid", "did", ["v"], metric="euclidean").collect()
    for i in range(20):
        want = list(np.argsort(np.sqrt(((d - q[i]) ** 2).sum(1)), kind="stable")[:4])
        assert [r.did for r in sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])] == want


def test_cluster_and_chained_fill_missing_only(spark):
    from lacuna.operators.impute.chained import ChainedImputer
    from lacuna.operators.impute.cluster import cluster_impute
    from lacuna.plans.experiment import prepare_parts
    spec = load(spark, SF_SMALL, "lineitem")
    parts = prepare_parts(spec, "exp1_mnar3", 100).select("part", "row_id", *spec.features)
    out, model = cluster_impute(parts, "X_train_val", spec.numeric, spec.categorical, 3, 7)
    assert out.where(" OR ".join(f"{c} IS NULL" for c in spec.features)).count() == 0
    assert abs(sum(model.shares.values()) - 1) < 1e-9
    kept = out.alias("o").join(parts.alias("p"), ["part", "row_id"]).where(
        " OR ".join(f"(p.{c} IS NOT NULL AND p.{c} <> o.{c})" for c in spec.features)).count()
    assert kept == 0
    ch, hist = ChainedImputer("tree", max_iter=2, stop="missforest", seed=1, params={"maxDepth": 4},
                              checkpoint=True).fit_transform(parts, "X_train_val", spec.numeric, spec.categorical)
    assert ch.where(" OR ".join(f"{c} IS NULL" for c in spec.features)).count() == 0


def test_dense_index_and_edges(spark):
    from lacuna.operators.graphprep import bipartite_edges, dense_index
    ev = read(spark, SF_SMALL, "events")
    idx = dense_index(ev, "user_id")
    vals = sorted(r.idx for r in idx.collect())
    assert vals == list(range(len(vals)))
    e = bipartite_edges(ev, "user_id", "event_type")
    assert e.where("kind = 'row_item'").count() == e.where("kind = 'item_row'").count()


def test_acquisition_never_picks_observed(spark):
    from lacuna.operators import acquire as Q
    from lacuna.operators.split import element_split
    ev = read(spark, SF_SMALL, "events")
    cells = ev.groupBy(F.col("user_id").alias("row_id"), F.col("event_type").alias("col_id")).agg(F.avg("value").alias("value"))
    obs = element_split(cells, 1, 0.5, "row_id", "col_id", "o").where("o").drop("o")
    pick = Q.next_random(Q.observable(cells, obs), 2, 1)
    assert pick.join(obs, ["row_id", "col_id"], "left_semi").count() == 0
    assert pick.groupBy("row_id").count().where("count > 2").count() == 0


def test_metric_store_round_trip(spark, tmp_path):
    from lacuna.sources.store import MetricStore
    st = MetricStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("orders", "m", "s", 1, 0.5)],
                               "Dataset_Name string, null_imputer_name string, evaluation_scenario string, "
                               "experiment_seed int, rmse double")
    assert st.append("imputation_metrics", df, runtime_in_mins=1.0)
    assert not st.append("imputation_metrics", df.limit(0))
    r = st.read("imputation_metrics", capitalise_names=True, dataset_name="orders").first()
    assert r.Tag == "OK" and r.Rmse == 0.5


def test_streaming_imputer(spark, tmp_path):
    from lacuna.operators.impute.simple import SimpleImputer
    from lacuna.streaming.impute_stream import impute_stream, run_available
    ev = read(spark, SF_SMALL, "events").select("event_id", "user_id", "event_type", "value")
    src = str(tmp_path / "src")
    ev.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value"))) \
        .write.parquet(src)
    model = SimpleImputer("median", "most_frequent").fit(ev, ["value"], [])
    stream = spark.readStream.schema("event_id long, user_id long, event_type string, value double").parquet(src)
    run_available(impute_stream(stream, model), str(tmp_path / "ck"), path=str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("value IS NULL").count() == 0
    assert out.count() == ev.count()
    with pytest.raises(ValueError):
        run_available(stream, str(tmp_path / "ck2"))


def test_run_grid_store_and_imputed_sets(spark, tmp_path):
    from lacuna.plans.experiment import run_grid
    from lacuna.sources.store import MetricStore
    spec = load(spark, SF_SMALL, "orders")
    st = MetricStore(spark, str(tmp_path / "grid"))
    m = run_grid(spec, ["median-mode", "deletion"], ["exp1_mcar3"], [100], st, numeric_kl=False, save_imputed=True)
    got = {(r.null_imputer_name, r.dataset_part) for r in m.select("null_imputer_name", "dataset_part").distinct().collect()}
    assert ("median-mode", "X_train_val") in got and ("deletion", "X_test_MAR3") in got
    assert ("deletion", "X_train_val") not in got  # deletion leaves no nulled train cell to score
    assert m.groupBy("imputation_guid").count().where("count > 1").count() == 0
    back = st.load_imputed("orders", "median-mode", "exp1_mcar3", 100, categorical=orders_cats(spec))
    assert back.where(" OR ".join(f"{c} IS NULL" for c in spec.features)).count() == 0
    assert {r.imputer for r in st.repaired_train_sets("orders", "exp1_mcar3", 100).select("imputer").distinct().collect()} \
        == {"median-mode"}


def orders_cats(spec):
    return list(spec.categorical)


def test_weighted_neighbours_never_nan(spark):
    from lacuna.operators.impute.neighbour import weighted_neighbour_impute
    df = spark.createDataFrame(
        [("X_train_val", i, float(i), float(2 * i)) for i in range(1, 30)] +
        [("X_test", 100, None, None), ("X_test", 101, 3.0, None), ("X_test", 102, 5.0, 10.0)],
        "part string, row_id long, a double, b double")
    out = {r.row_id: r for r in weighted_neighbour_impute(df, "X_train_val", ["a", "b"], k=3).collect()}
    assert out[100].a == pytest.approx(15.0) and out[100].b == pytest.approx(30.0)  # train mean fallback
    assert out[101].b == pytest.approx(6.0)  # exact neighbour on a takes all the weight
