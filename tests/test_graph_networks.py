"""Gated graph layers: forward as written out, gradients by differences of it, training on drawn graphs."""

import numpy as np
import pytest

from plumbline.operators import graph_networks as G
from plumbline.operators.networks import Settings
from plumbline.sources.shared import Held

from .test_structures import shuffled

SHAPE = G.Shape(width=3, bins=4, layers=2, dense=4, dense_layers=1)


def drawn(graphs=6, seed=0):
    """Graphs of a few nodes with two numbers each, some edges, and a class that their first number tells."""
    r = np.random.default_rng(seed)
    nodes, edges, labels = [], [], []
    for g in range(graphs):
        n, y = int(r.integers(2, 5)), int(g % 2)
        nodes += [(g, i, [float(r.normal(2 * y - 1, 0.7)), float(r.normal())]) for i in range(n)]
        edges += [(g, int(i), int(r.integers(n)), float(r.uniform(0.5, 6))) for i in range(n - 1) for _ in range(2)]
        labels.append((g, y))
    return nodes, edges, labels


def frames(spark, nodes, edges, labels):
    return (
        spark.createDataFrame(nodes, "graph long, node int, x array<double>"), spark.createDataFrame(edges, "graph long, src int, dst int, distance double"),
        spark.createDataFrame(labels, "graph long, y int"),
    )


def naive(p, s, nodes, edges, labels):
    """(logits by graph, mean loss): one node and one edge at a time."""
    soft = lambda v: np.log1p(np.exp(v))
    h = {(g, i): p["w_in"] @ np.array(x) + p["b_in"] for g, i, x in nodes}
    for l in range(s.layers):
        total = {k: v.copy() for k, v in h.items()}
        for g, a, b, distance in edges:
            centres = np.linspace(0, 8, s.bins)
            z = np.concatenate([h[g, b], h[g, a], np.exp(-(((distance - centres) / (centres[1] - centres[0])) ** 2))])
            total[g, b] += 1 / (1 + np.exp(-(p[f"w_gate{l}"] @ z + p[f"b_gate{l}"]))) * soft(p[f"w_core{l}"] @ z + p[f"b_core{l}"])
        every = np.array(list(total.values()))
        mean, variance = every.mean(axis=0), every.var(axis=0)
        h = {k: (v - mean) / np.sqrt(variance + 1e-5) * p[f"g{l}"] + p[f"o{l}"] for k, v in total.items()}
    out, losses = {}, []
    for g, y in labels:
        x = soft(np.mean([v for (k, _), v in h.items() if k == g], axis=0))
        for k in range(s.dense_layers):
            x = soft(p[f"w_dense{k}"] @ x + p[f"b_dense{k}"])
        out[g] = float(p["w_out"][0] @ x + p["b_out"][0])
        losses.append(np.log1p(np.exp(-out[g] if y else out[g])))
    return out, float(np.mean(losses))


def test_forward_and_gradients(spark):
    data = drawn()
    p = G.first_weights(2, SHAPE, 1)
    p = {k: v + np.random.default_rng(len(k)).normal(0, 0.3, v.shape) for k, v in p.items()}
    logits, loss = naive(p, SHAPE, *data)
    given = frames(spark, *data)
    run = G._Pass(*given, p, SHAPE)
    assert {r.graph: r.logit for r in run.logits().collect()} == pytest.approx(logits)
    run.close()
    found = [G.batch_gradient(*(f.repartition(k) for f in given), p, SHAPE) for k in (1, 3)]
    for gradient, _, n, mean_loss in found:
        assert n == 6 and mean_loss == pytest.approx(loss) and gradient.keys() == p.keys()
    assert all(found[0][0][k] == pytest.approx(found[1][0][k], abs=1e-10) for k in p)
    e = 1e-6
    for k in p:
        for i in np.ndindex(p[k].shape):
            low, high = ({n: v.copy() for n, v in p.items()} for _ in range(2))
            low[k][i] -= e
            high[k][i] += e
            assert found[0][0][k][i] == pytest.approx((naive(high, SHAPE, *data)[1] - naive(low, SHAPE, *data)[1]) / (2 * e), abs=2e-7), (k, i)


def test_training_lowers_the_loss(spark):
    nodes, edges, labels = drawn(24, 3)
    n, e, y = (f.cache() for f in frames(spark, nodes, edges, labels))
    shape = G.Shape(width=3, bins=3, layers=1, dense=3, dense_layers=1)
    network, record = G.fit_graph_network(n, e, y.filter("graph < 16"), y.filter("graph >= 16"), shape, Settings(epochs=4, batch_size=64, learning_rate=0.1, selection_metric="validation_loss"))
    h = record["history"]
    assert h[-1]["train_loss"] < h[0]["train_loss"] and record["validation_loss"] == min(r["validation_loss"] for r in h)
    scored = network.scored(n, e, y).collect()
    assert len(scored) == 24 and all(0 <= r.score <= 1 for r in scored)


def test_lone_nodes_and_lost_edges(spark):
    """A graph without edges keeps its nodes' own numbers; edges of nodes that aren't there hand on nothing."""
    nodes, labels = [(g, i, [float(g), 1.0]) for g in range(4) for i in range(2)], [(g, g % 2) for g in range(4)]
    p = G.first_weights(2, SHAPE, 2)
    lost = frames(spark, nodes, [(0, 0, 7, 1.0), (9, 0, 1, 1.0)], [*labels, (77, 1)])
    run = G._Pass(*lost, p, SHAPE)
    assert {r.graph: r.logit for r in run.logits().collect()} == pytest.approx(naive(p, SHAPE, nodes, [], labels)[0])
    run.close()
    gradient, *_ = G.batch_gradient(lost[0], lost[1].limit(0), lost[2].filter("graph < 9"), p, SHAPE)
    assert not gradient["w_gate0"].any() and gradient["w_in"].any()
    with pytest.raises(ValueError, match="no nodes"):
        G.fit_graph_network(lost[0].limit(0), lost[1], lost[2], lost[2])


@pytest.mark.parametrize("nodes,edges,at_once", [(1024, 1 << 14, 1 << 21), (1024, 1 << 14, 1), (3, 5, 1), (1024, 4, 1 << 21)])
def test_gathered_graphs_and_larger_ones_have_the_same_gradients(spark, monkeypatch, nodes, edges, at_once):
    monkeypatch.setattr(G, "WHOLE", nodes)
    monkeypatch.setattr(G, "EDGES", edges)
    monkeypatch.setattr(G, "AT_ONCE", at_once)
    data = drawn(8, 2)
    p = G.first_weights(2, SHAPE, 1)
    logits, loss = naive(p, SHAPE, *data)
    lost = [(0, 0, 7, 1.0), (9, 0, 1, 1.0), (3, 99, 0, 1.0), (None, 0, 0, 1.0), (2, None, 0, 2.0)]
    given = [f.repartition(3) for f in frames(spark, data[0], data[1] + lost, [*data[2], (77, 1)])]
    held = Held(spark)
    whole, *rest = G.gathered(*given, held)
    small = {g for g in range(8) if sum(x[0] == g for x in data[0]) <= nodes and sum(x[0] == g for x in data[1]) <= edges - any(x[0] == g and x[1] is not None for x in lost)}
    assert {r.graph for r in whole.collect()} == small and (rest == [None, None]) == (len(small) == 8)
    run = G._Pass(*rest, given[2], p, SHAPE, whole=whole)
    assert {r.graph: r.logit for r in run.logits().collect()} == pytest.approx(logits)
    run.close()
    there = given[2].filter("graph < 70")
    want, moments, *_ = G.batch_gradient(*given[:2], there, p, SHAPE)
    gradient, found, n, mean_loss = G.batch_gradient(*rest, there, p, SHAPE, whole)
    assert n == 8 and mean_loss == pytest.approx(loss) and gradient.keys() == p.keys()
    assert all(gradient[k] == pytest.approx(want[k], abs=1e-10) for k in p) and all(a == pytest.approx(b) for x, y in zip(found, moments) for a, b in zip(x, y))
    held.close()


def test_training_of_gathered_graphs(spark, monkeypatch):
    """Weights and scores are the same whatever is gathered: nothing, some graphs, all."""
    nodes, edges, labels = drawn(12, 5)
    n = spark.createDataFrame([(f"g{g}", f"n{i}", x) for g, i, x in nodes], "graph string, node string, x array<double>")
    e = spark.createDataFrame([(f"g{g}", f"n{a}", f"n{b}", d) for g, a, b, d in edges], "graph string, src string, dst string, distance double")
    y = spark.createDataFrame([(f"g{g}", y) for g, y in labels], "graph string, y int")
    shape, settings, found = G.Shape(width=3, bins=3, layers=2, dense=3, dense_layers=1), Settings(epochs=1, batch_size=4, learning_rate=0.1), []
    for most in (0, 3, 1024):
        monkeypatch.setattr(G, "WHOLE", most)
        network, record = G.fit_graph_network(n, e, y.filter("graph < 'g5'"), y.filter("graph >= 'g5'"), shape, settings)
        found.append((network.params, record["history"][0], {r.graph: r.score for r in network.scored(n, e, y).collect()}))
    (want, history, scores), *others = found
    assert len(scores) == 12
    for p, h, s in others:
        assert all(p[k] == pytest.approx(want[k], abs=1e-9) for k in want) and h == pytest.approx(history) and s == pytest.approx(scores)


def test_edges_are_shuffled_once(spark):
    """A step's messages, some hundred bytes an edge each time, go through no shuffle where graphs are small."""
    r = np.random.default_rng(4)
    nodes = [(g, i, [float(g % 2), 1.0]) for g in range(150) for i in range(20)]
    edges = [(g, int(i), int(j), float(d)) for g in range(150) for i, j, d in zip(r.integers(0, 20, 80), r.integers(0, 20, 80), r.random(80) * 3)]
    n, e, y = frames(spark, nodes, edges, [(g, g % 2) for g in range(150)])
    shape, before = G.Shape(width=4, bins=4, layers=1, dense=4, dense_layers=1), shuffled(spark)
    # so few rows would be broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        network, _ = G.fit_graph_network(n, e, y.filter("graph < 100"), y.filter("graph >= 100"), shape, Settings(epochs=1, batch_size=1000))
        assert network.scored(n, e, y).count() == 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 60 * len(edges)
