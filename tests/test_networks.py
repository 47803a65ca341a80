"""The network: gradients by differences, sums that don't depend on how rows are dealt, epochs chosen, a bundle served."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import networks as N
from plumbline.plans import models, protocol
from plumbline.plans.training import execute, write_bundle
from tests.test_training import config


def drawn(n=30, width=5, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, width))
    return x, (x[:, 0] - x[:, 1] > 0).astype(float), r.integers(-(2**62), 2**62, n)


def whole_gradient(p, x, y, keys, draw):
    """The passes of a step over rows in one place."""
    stats, layers = [], sum(k.startswith("g") for k in p)
    for _ in range(layers):
        s = N.statistics_sums(p, stats, x, keys, draw)
        stats.append((s["sum"] / len(x), s["squares"] / len(x) - (s["sum"] / len(x)) ** 2))
    gradient, back = {}, {}
    for l in range(layers - 1, -2, -1):
        part = N.gradient_sums(p, stats, back, float(len(x)), x, y, keys, draw)
        gradient |= part
        if l >= 0:
            back[l] = part[f"g{l}"], part[f"o{l}"]
    return gradient


@pytest.mark.parametrize("hidden,dropout", [((7, 4), 0.25), ((6,), 0.0), ((4, 5, 3), 0.5)])
def test_gradients_are_differences(hidden, dropout):
    x, y, keys = drawn()
    p, draw, e = N.first_params(5, hidden, 1), (3, 0, dropout), 1e-6
    loss = lambda q: whole_gradient(q, x, y, keys, draw)["loss"][0] / len(x)
    got = whole_gradient(p, x, y, keys, draw)
    for k in p:
        for i in np.ndindex(p[k].shape):
            low, high = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            low[k][i] -= e
            high[k][i] += e
            assert got[k][i] == pytest.approx((loss(high) - loss(low)) / (2 * e), abs=1e-7)


def test_dropout_is_drawn_from_keys():
    keys = np.arange(4000)
    stay = N.kept(keys, 8, 0, 5, 1, 0.25)
    assert abs((stay > 0).mean() - 0.75) < 0.02 and set(np.unique(stay)) == {0, 1 / 0.75}
    assert np.array_equal(N.kept(keys[::-1], 8, 0, 5, 1, 0.25)[::-1], stay) and not np.array_equal(N.kept(keys, 8, 0, 6, 1, 0.25), stay)
    assert all(abs(np.corrcoef(stay[:, 0], o)[0, 1]) < 0.06 for o in (stay[:, 1], N.kept(keys, 8, 1, 5, 1, 0.25)[:, 0]))


def table(spark, n, seed):
    x, y, _ = drawn(n, 4, seed)
    return spark.createDataFrame([(i, a.tolist(), int(t)) for i, (a, t) in enumerate(zip(x, y))], "id long, x array<double>, y int")


def test_a_step_is_the_same_however_rows_are_dealt(spark):
    rows = table(spark, 120, 2).select("x", "y", F.xxhash64("id").alias("key"))
    p, draw = N.first_params(4, (6, 3), 0), (1, 7, 0.3)
    found = [N.batch_gradient(rows.repartition(k), p, 2, draw) for k in (1, 7)]
    x, y, keys = (np.array([r[i] for r in rows.collect()]) for i in range(3))
    want = whole_gradient(p, x, y.astype(float), keys, draw)
    for gradient, stats, n, loss in found:
        assert n == 120 and loss == pytest.approx(want["loss"][0] / 120) and all(gradient[k] == pytest.approx(want[k], abs=1e-12) for k in p)


@pytest.mark.parametrize("metric", N.SELECTION)
def test_training_learns_and_chooses_an_epoch(spark, metric):
    train, validation = table(spark, 160, 3), table(spark, 80, 4).withColumn("id", F.col("id") + 1000)
    s = N.Settings(epochs=7, batch_size=80, learning_rate=0.05, hidden=(6,), dropout=0.1, patience=3, selection_metric=metric)
    network, record = N.fit_network(train.repartition(2), validation, s)
    again, _ = N.fit_network(train.repartition(5), validation.repartition(3), s)
    assert all(again.params[k] == pytest.approx(v, abs=1e-6) for k, v in network.params.items())
    h = record["history"]
    assert h[-1]["train_loss"] < h[0]["train_loss"] and record["validation_roc_auc"] > 0.9
    objective = [r[metric] if metric == "validation_loss" else -r[metric] for r in h]
    assert record["selected_epoch"] == int(np.argmin(objective)) + 1 and record["epochs_run"] == len(h)
    scored = network.scored(validation, "x").collect()
    area = np.mean([(a.score > b.score) + 0.5 * (a.score == b.score) for a in scored if a.y for b in scored if not b.y])
    assert area == pytest.approx(record["validation_roc_auc"])


def test_gaps_and_settings(spark):
    rows = table(spark, 40, 5)
    gaps = rows.unionByName(spark.createDataFrame([(None, None, 1), (77, [0.0] * 4, None)], rows.schema))
    s = N.Settings(epochs=2, batch_size=64, hidden=(3,))
    a, b = (N.fit_network(t, rows, s)[0] for t in (rows, gaps))
    assert all(b.params[k] == pytest.approx(v, abs=1e-9) for k, v in a.params.items())
    assert a.scored(gaps, "x").filter("x is null and score is null").count() == 1
    with pytest.raises(ValueError, match="need rows"):
        N.fit_network(rows.limit(0), rows)
    for wrong in ({"epochs": 0}, {"hidden": []}, {"dropout": 1.0}, {"scheduler_factor": 1}, {"learning_rate": 0}, {"patience": True}, {"selection_metric": "mae"}, {"hidden": [4, "a"]}):
        with pytest.raises(ValueError):
            N.settings_of(wrong)
    assert N.settings_of({}) == N.Settings() and N.settings_of({"hidden": [3]}).hidden == (3,)


def test_a_run_is_saved_and_served(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(f"s{i:03d}", float(a), float(b), "yes" if a + b > 0 else "no") for i, (a, b) in enumerate(r.standard_normal((150, 2)))]
    samples = spark.createDataFrame(rows, "sample_id string, x1 double, x2 double, target string")
    text = config("a.b.mlp.drawn.v1", "mlp_head", "classification", ["roc_auc", "accuracy"], 'positive = "yes"', "epochs = 4\nbatch_size = 30\nhidden = [4]\nlearning_rate = 0.05\nselection_metric = \"validation_loss\"")
    run = execute(protocol.parse(text), samples)
    found = {(m.source, m.split): m for m in run.metrics.collect()}
    assert found["model", "train"].roc_auc > 0.9
    write_bundle(run, str(tmp_path / "m"), "one")
    loaded = models.load_model(spark, str(tmp_path / "m"))
    a, b = (sorted((x.sample_id, x.score) for x in m.apply(samples).collect()) for m in (run.model, loaded))
    assert a == b and models.read_record(spark, str(tmp_path / "m"))["model"]["training"]["selected_epoch"] >= 1
    with pytest.raises(protocol.ConfigError, match="hidden"):
        protocol.parse(text.replace("hidden = [4]", "hidden = [0]"))
