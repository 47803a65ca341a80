"""Gated layers on graphs in tables: messages go along a join of edges, gradients back along the same one.

Graphs are nodes (graph, node, x), x an array, edges (graph, src, dst, distance), and labels (graph, y). A layer adds to each node
what its incoming edges hand on, a gate times a core of both ends and the expanded distance, and norms the sum over all nodes; on top
nodes are averaged by graph and a few dense layers give a logit. A graph of up to `WHOLE` nodes and `EDGES` edges is gathered once, as a
row of arrays, and every pass works it out from that row: nothing of it is shuffled or written again. A larger graph stands in no task:
edges meet the numbers of their ends by joins, sums by node are aggregations. The driver sees only weights, their gradients and a
layer's statistics, of both kinds together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Held
from . import ranking
from .networks import EPS, Params, Settings, added, in_batch, loss_of, train_epochs

#: The distance up to which the centres of the expansion are spread.
FARTHEST = 8.0
NODE, KEYS = ["graph", "node"], ["graph", "src", "dst", "distance"]
#: Nodes and edges of a graph up to which it is gathered in a row, and numbers that are worked on at once.
WHOLE, EDGES, AT_ONCE = 1 << 10, 1 << 14, 1 << 21
#: What a gathered graph's row holds.
ROW = "_n int, _x array<double>, _src array<int>, _dst array<int>, _distance array<double>"


@dataclass(frozen=True)
class Shape:
    """Widths of nodes, of the expansion of distances and of the dense layers, and how many layers of each."""

    width: int = 64
    bins: int = 64
    layers: int = 3
    dense: int = 128
    dense_layers: int = 3


def expanded(distance: np.ndarray, bins: int) -> np.ndarray:
    """Gaussians around centres spread evenly, as wide as the centres are apart."""
    centres = np.linspace(0, FARTHEST, bins)
    gap = centres[1] - centres[0] if bins > 1 else FARTHEST
    return np.exp(-(((distance[:, None] - centres) / gap) ** 2))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def first_weights(features: int, s: Shape, seed: int) -> Params:
    draw, out = np.random.default_rng(seed), {}

    def linear(name: str, a: int, b: int) -> None:
        out.update({f"w_{name}": draw.uniform(-1, 1, (b, a)) / math.sqrt(a), f"b_{name}": draw.uniform(-1, 1, b) / math.sqrt(a)})

    linear("in", features, s.width)
    for l in range(s.layers):
        linear(f"gate{l}", 2 * s.width + s.bins, s.width)
        linear(f"core{l}", 2 * s.width + s.bins, s.width)
        out |= {f"g{l}": np.ones(s.width), f"o{l}": np.zeros(s.width)}
    for k in range(s.dense_layers):
        linear(f"dense{k}", s.dense if k else s.width, s.dense)
    linear("out", s.dense if s.dense_layers else s.width, 1)
    return out


def messages(p: Params, l: int, to: np.ndarray, source: np.ndarray, distance: np.ndarray, bins: int) -> tuple:
    """(inputs, gate, core before its softplus) of edges."""
    z = np.concatenate([to, source, expanded(distance, bins)], axis=1)
    return z, sigmoid(z @ p[f"w_gate{l}"].T + p[f"b_gate{l}"]), z @ p[f"w_core{l}"].T + p[f"b_core{l}"]


def message_gradients(p: Params, l: int, z: np.ndarray, gate: np.ndarray, core: np.ndarray, d: np.ndarray, width: int) -> tuple[Params, np.ndarray, np.ndarray]:
    """(gradients of the layer's weights, of the target's and of the source's numbers) from those of the messages."""
    d_gate, d_core = d * softplus(core) * gate * (1 - gate), d * gate * sigmoid(core)
    back = d_gate @ p[f"w_gate{l}"] + d_core @ p[f"w_core{l}"]
    weights = {f"w_gate{l}": d_gate.T @ z, f"b_gate{l}": d_gate.sum(axis=0), f"w_core{l}": d_core.T @ z, f"b_core{l}": d_core.sum(axis=0)}
    return weights, back[:, :width], back[:, width : 2 * width]


def dense_forward(p: Params, pooled: np.ndarray, layers: int) -> tuple[np.ndarray, list, list]:
    """(logits, inputs of each dense layer, values before each softplus): softplus first, then a softplus after each layer."""
    before, inputs = [pooled], []
    x = softplus(pooled)
    for k in range(layers):
        inputs.append(x)
        before.append(x @ p[f"w_dense{k}"].T + p[f"b_dense{k}"])
        x = softplus(before[-1])
    inputs.append(x)
    return x @ p["w_out"][0] + p["b_out"][0], inputs, before


def dense_gradients(p: Params, pooled: np.ndarray, y: np.ndarray, n: float, layers: int) -> tuple[Params, np.ndarray]:
    """(gradients of the dense weights with the loss, gradients of the averages) of some graphs of a batch of n."""
    logit, inputs, before = dense_forward(p, pooled, layers)
    d = (sigmoid(logit) - y)[:, None] / n
    out = {"loss": np.array([loss_of(logit, y).sum()]), "w_out": d.T @ inputs[-1], "b_out": d.sum(axis=0)}
    d = d @ p["w_out"]
    for k in range(layers - 1, -1, -1):
        d = d * sigmoid(before[k + 1])
        out |= {f"w_dense{k}": d.T @ inputs[k], f"b_dense{k}": d.sum(axis=0)}
        d = d @ p[f"w_dense{k}"]
    return out, d * sigmoid(before[0])


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width))


def _sum_arrays(rows: DataFrame, by: Sequence[str], width: int, name: str) -> DataFrame:
    """Arrays of a group added up place by place, with partial sums."""
    found = rows.groupBy(*by).agg(*(F.sum(F.get(name, i)).alias(f"_{i}") for i in range(width)))
    return found.select(*by, F.array(*(f"_{i}" for i in range(width))).alias(name))


def _total(parts: DataFrame) -> Params:
    """Sums of named arrays (name, i, v) over all tasks, as flat arrays."""
    out: dict[str, dict[int, float]] = {}
    for r in parts.groupBy("name", "i").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["name"], {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


NAMED = "name string, i int, v double"


def _rows_of(total: Params) -> pd.DataFrame:
    names = [k for k, v in total.items() for _ in range(v.size)]
    return pd.DataFrame({"name": names, "i": np.concatenate([np.arange(v.size) for v in total.values()]), "v": np.concatenate([v.ravel() for v in total.values()])})


def _mapped(rows: DataFrame, of, schema: str) -> DataFrame:
    """`of` of each batch that isn't empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield of(b)

    return rows.mapInPandas(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one graph that come one after the other, as one row of arrays; no row is longer than a batch."""
    for batch in batches:
        graph = batch.column(0)
        if len(graph):
            new = pc.fill_null(pc.not_equal(graph.slice(1), graph.slice(0, len(graph) - 1)), True).to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.flatnonzero(new) + 1))
            offsets = pa.array(np.append(first, len(graph)), pa.int32())
            yield pa.RecordBatch.from_arrays([graph.take(pa.array(first)), *(pa.ListArray.from_arrays(offsets, c) for c in batch.columns[1:])], batch.schema.names)


def _counts(column: pa.ListArray) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def _numbers(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _resolved(names: list[str]):
    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gathered graphs with their edges' ends as places among their nodes; edges without both ends go."""
        for batch in batches:
            n, m = _counts(batch.column("node")), _counts(batch.column("src"))
            first, of_node, of_edge = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
            code, known = pd.factorize(np.concatenate([_numbers(batch.column(c)) for c in ("node", "src", "dst")]))
            # a null has the code -1
            code = code + 1 + np.concatenate([of_node, of_edge, of_edge]) * (len(known) + 1)
            order = np.argsort(code[: len(of_node)], kind="stable")
            have, ends = code[order], code[len(of_node) :]
            at = np.minimum(np.searchsorted(have, ends), max(len(have) - 1, 0))
            there, place = (have[at] == ends).reshape(2, -1).all(axis=0), order[at].reshape(2, -1) - first[of_edge]
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of_edge[there], minlength=len(n))))), pa.int32())
            x = batch.column("x").flatten()
            width = np.concatenate(([0], np.cumsum(_counts(x))))
            rows = [
                pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(width[np.append(first, n.sum())], pa.int32()), x.flatten()),
                *(pa.ListArray.from_arrays(offsets, pa.array(e[there], pa.int32())) for e in place),
                pa.ListArray.from_arrays(offsets, pa.array(_numbers(batch.column("distance")).astype(np.float64)[there])),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *rows], [*names, *(c.split()[0] for c in ROW.split(", "))])

    return resolved


def gathered(nodes: DataFrame, edges: DataFrame, labels: DataFrame, held: Held) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(whole, nodes, edges): a row (labels' columns, `ROW`) for each labelled graph that is small enough; nodes and edges of all larger
    graphs, None if there are none.

    Nodes and edges are gathered where they come, in rows of a batch at most, then sizes are known and small graphs' rows are put together."""
    own = Held(nodes.sparkSession)
    try:
        kinds = dict(nodes.dtypes)
        one = nodes.filter("graph is not null").select(*NODE, F.col("x").cast("array<double>"))
        one = one.mapInArrow(_runs, f"graph {kinds['graph']}, node array<{kinds['node']}>, x array<array<double>>")
        two = edges.select("graph", *(F.col(c).try_cast(kinds["node"]).alias(c) for c in ("src", "dst")), F.col("distance").cast("double")).dropna(subset=["graph", "src", "dst"])
        two = two.mapInArrow(_runs, f"graph {dict(edges.dtypes)['graph']}, src array<{kinds['node']}>, dst array<{kinds['node']}>, distance array<double>")
        parts = own.written(one.unionByName(two, allowMissingColumns=True))
        length = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0))
        sizes = own.written(parts.groupBy("graph").agg(length("node").alias("n"), length("src").alias("m")).filter("n > 0"))
        small = (F.col("n") <= WHOLE) & (F.col("m") <= EDGES)
        together = lambda c: F.flatten(F.collect_list(c)).alias(c)
        rows = parts.join(sizes.filter(small).select("graph"), "graph", "left_semi").groupBy("graph").agg(*(together(c) for c in ("node", "x", "src", "dst", "distance")))
        schema = ", ".join([*(f"`{n}` {t}" for n, t in labels.dtypes), ROW])
        whole = held.written(rows.join(labels, "graph").mapInArrow(_resolved(labels.columns), schema))
        large = sizes.filter(~small).select("graph")
        if large.isEmpty():
            return whole, None, None
        some = parts.join(large, "graph", "left_semi")
        out = []
        for names in (["node", "x"], ["src", "dst", "distance"]):
            spread = some.filter(F.col(names[0]).isNotNull()).select("graph", F.explode(F.arrays_zip(*names)).alias("_r"))
            out.append(held.written(spread.select("graph", *(F.col(f"_r.{n}").alias(n) for n in names))))
        return whole, *out
    finally:
        own.close()


class _Arrays:
    """Some gathered graphs: their nodes and edges one after the other, and what a pass makes of them."""

    def __init__(self, batch: pa.RecordBatch, p: Params, s: Shape, stats: list) -> None:
        self.p, self.s, self.stats = p, s, stats
        self.n, m = batch.column("_n").to_numpy().astype(np.int64), _counts(batch.column("_src"))
        first = np.cumsum(self.n) - self.n
        self.x = _numbers(batch.column("_x")).astype(np.float64).reshape(int(self.n.sum()), -1)
        self.src, self.dst = (_numbers(batch.column(c)) + np.repeat(first, m) for c in ("_src", "_dst"))
        self.distance = _numbers(batch.column("_distance")).astype(np.float64)
        self.first = first

    def by_node(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, v, len(self.x)) for v in values.T], axis=1)

    def even(self, l: int, t: np.ndarray) -> np.ndarray:
        mean, variance = self.stats[l]
        return (t - mean) / np.sqrt(variance + EPS)

    def forward(self) -> tuple[list[tuple], np.ndarray]:
        """(of each layer its edges' inputs, gates and cores and the sums by node, the nodes' numbers after the last). It ends at
        the first layer whose statistics aren't known, with the numbers before it."""
        p, done = self.p, []
        h = self.x @ p["w_in"].T + p["b_in"]
        for l in range(self.s.layers):
            z, gate, core = messages(p, l, h[self.dst], h[self.src], self.distance, self.s.bins)
            t = h + self.by_node(self.dst, gate * softplus(core))
            done.append((z, gate, core, t))
            if l == len(self.stats):
                break
            h = self.even(l, t) * p[f"g{l}"] + p[f"o{l}"]
        return done, h

    def pooled(self, h: np.ndarray) -> np.ndarray:
        return np.add.reduceat(h, self.first, axis=0) / self.n[:, None]

    def backward(self, y: np.ndarray, n: float, known: list[tuple[Params, float]]) -> Params:
        """What comes next once the sums of norms are known, from the last layer down: at first the dense weights' gradients, then those
        of the last layer known, with the sums of the one below; of the first weights if there is none."""
        p, s = self.p, self.s
        layers, h = self.forward()
        dense, d = dense_gradients(p, self.pooled(h), y, n, s.dense_layers)
        out, d = {} if known else dense, np.repeat(d / self.n[:, None], self.n, axis=0)
        for k, l in enumerate(range(s.layers - 1, -1, -1)):
            z, gate, core, t = layers[l]
            x = self.even(l, t)
            if k == len(known):
                return out | {f"g{l}": (d * x).sum(axis=0), f"o{l}": d.sum(axis=0), "n": np.array([float(len(x))])}
            norms, m = known[k]
            d = p[f"g{l}"] / np.sqrt(self.stats[l][1] + EPS) * (d - norms[f"o{l}"] / m - x * norms[f"g{l}"] / m)
            weights, to, source = message_gradients(p, l, z, gate, core, d[self.dst], s.width)
            if k == len(known) - 1:
                out |= weights
            d = d + self.by_node(self.dst, to) + self.by_node(self.src, source)
        return out | {"w_in": d.T @ self.x, "b_in": d.sum(axis=0)}


def _merged(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Counts, means and sums of squares around them, of several parts together."""
    n, mean, squares = parts[0]
    for m, other, more in parts[1:]:
        gap = other - mean
        n, mean, squares = n + m, mean + gap * m / (n + m), squares + more + gap * gap * n * m / (n + m)
    return n, mean, squares


class _Whole:
    """Gathered graphs: each pass works them out from their rows, as far as statistics are known."""

    def __init__(self, rows: DataFrame, p: Params, s: Shape) -> None:
        self.rows, self.p, self.s = rows, p, s

    def _each(self, stats: list):
        """Batches of rows, and the same as `_Arrays`: as many graphs as are worked on at once."""
        p, s, known = self.p, self.s, list(stats)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Arrays]]:
            for batch in batches:
                size = np.cumsum(_counts(batch.column("_src")) * (2 * s.width + s.bins) + batch.column("_n").to_numpy() * s.width)
                ends = np.searchsorted(size, np.arange(AT_ONCE, size[-1], AT_ONCE)) if len(size) else []
                for some in np.split(np.arange(len(size)), np.unique(ends)):
                    if len(some):
                        part = batch.slice(int(some[0]), len(some))
                        yield part, _Arrays(part, p, s, known)

        return each

    def moments(self, stats: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of the first layer whose statistics aren't known, by task."""
        each = self._each(stats)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = []
            for _, graphs in each(batches):
                t = graphs.forward()[0][-1][3]
                mean = t.mean(axis=0)
                parts.append((float(len(t)), mean, ((t - mean) ** 2).sum(axis=0)))
                parts = [_merged(parts)]
            for n, mean, squares in parts:
                yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "squares": [squares.tolist()]})

        found = self.rows.mapInArrow(run, "n double, mean array<double>, squares array<double>").collect()
        return [(r.n, np.array(r.mean), np.array(r.squares)) for r in found]

    def backward(self, stats: list, n: float, known: list) -> Params:
        each = self._each(stats)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = added(graphs.backward(rows.column("y").to_numpy(zero_copy_only=False).astype(np.float64), n, known) for rows, graphs in each(batches))
            if total:
                yield pa.RecordBatch.from_pandas(_rows_of(total).astype({"i": "int32"}), preserve_index=False)

        return _total(self.rows.mapInArrow(run, NAMED))

    def logits(self, stats: list, names: list[str]) -> DataFrame:
        p, s, each = self.p, self.s, self._each(stats)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, graphs in each(batches):
                logit = dense_forward(p, graphs.pooled(graphs.forward()[1]), s.dense_layers)[0]
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(logit)], [*names, "logit"])

        return self.rows.mapInArrow(run, ", ".join([*(f"`{n}` {dict(self.rows.dtypes)[n]}" for n in names), "logit double"]))


class _Pass:
    """One batch of graphs with the weights as they are: forward layer by layer, then back. Graphs are in `whole`, labelled, or in nodes
    and edges, which are None if all are there."""

    def __init__(self, nodes: DataFrame | None, edges: DataFrame | None, labels: DataFrame, p: Params, s: Shape, given: list | None = None, whole: DataFrame | None = None) -> None:
        self.p, self.s, self.edges, self.labels, self.given = p, s, edges, labels, given
        self.stats: list[tuple[np.ndarray, np.ndarray]] = []
        # each layer joins the one before with itself: without a cut plans would double and double again
        self.held = Held(labels.sparkSession)
        self.nodes, self.count = nodes, 0.0
        self.whole = None if whole is None else _Whole(whole, p, s)
        if nodes is not None:
            self.kinds = ", ".join(f"{n} {dict(nodes.dtypes)[n]}" for n in NODE)
            self.states, self.sums = [self._kept(self._embedded(nodes))], []
        for l in range(s.layers):
            self._forward(l)

    def _kept(self, df: DataFrame) -> DataFrame:
        return self.held.written(df)

    def close(self) -> None:
        self.held.close()

    def _embedded(self, nodes: DataFrame) -> DataFrame:
        p = self.p
        return _mapped(nodes, lambda b: b[NODE].assign(h=list(_matrix(b["x"], 0) @ p["w_in"].T + p["b_in"])), f"{self.kinds}, h array<double>")

    def _ends(self, l: int) -> DataFrame:
        """Edges with the numbers of their ends."""
        h = self.states[l]
        to, source = (h.select("graph", F.col("node").alias(n), F.col("h").alias(f"h_{n}")) for n in ("dst", "src"))
        return self.edges.select(*KEYS).join(to, ["graph", "dst"]).join(source, ["graph", "src"])

    def _forward(self, l: int) -> None:
        p, s = self.p, self.s
        before = None if self.nodes is None else self._summed(l)
        mean, variance = self.given[l] if self.given else self._moments(before)
        self.stats.append((mean, variance))
        if before is None:
            return

        def normed(b: pd.DataFrame) -> pd.DataFrame:
            return b[NODE].assign(h=list((_matrix(b["t"], s.width) - mean) / np.sqrt(variance + EPS) * p[f"g{l}"] + p[f"o{l}"]))

        self.states.append(self._kept(_mapped(before, normed, f"{self.kinds}, h array<double>")))

    def _summed(self, l: int) -> DataFrame:
        """A layer's sums by node."""
        p, s = self.p, self.s

        def handed(b: pd.DataFrame) -> pd.DataFrame:
            _, gate, core = messages(p, l, _matrix(b["h_dst"], s.width), _matrix(b["h_src"], s.width), b["distance"].to_numpy(np.float64), s.bins)
            return pd.DataFrame({"graph": b["graph"], "node": b["dst"], "m": list(gate * softplus(core))})

        got = _sum_arrays(_mapped(self._ends(l), handed, f"{self.kinds}, m array<double>"), NODE, s.width, "m")
        added_up = F.when(F.col("m").isNull(), F.col("h")).otherwise(F.zip_with("h", "m", lambda a, b: a + b))
        before = self._kept(self.states[l].join(got, NODE, "left").select(*NODE, added_up.alias("t")))
        self.sums.append(before)
        return before

    def _moments(self, before: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances over all nodes."""
        width, parts = self.s.width, [] if self.whole is None else self.whole.moments(self.stats)
        if before is not None:
            n, *row = before.agg(F.count("*"), *(F.avg(F.get("t", i)) for i in range(width)), *(F.var_pop(F.get("t", i)) for i in range(width))).first()
            if n or not parts:
                parts.append((float(n), np.array(row[:width], float), n * np.array(row[width:], float)))
        self.count, mean, squares = _merged(parts)
        return mean, squares / max(self.count, 1.0)

    def pooled(self) -> DataFrame:
        """(graph, n, pool, y): the mean of each labelled graph's nodes."""
        h, width = self.states[-1], self.s.width
        found = h.groupBy("graph").agg(F.count("*").alias("n"), *(F.avg(F.get("h", i)).alias(f"_{i}") for i in range(width)))
        return found.select("graph", "n", F.array(*(f"_{i}" for i in range(width))).alias("pool")).join(self.labels, "graph")

    def logits(self) -> DataFrame:
        p, s = self.p, self.s
        kinds = ", ".join(f"`{n}` {t}" for n, t in self.labels.dtypes)
        names = self.labels.columns
        found = [] if self.whole is None else [self.whole.logits(self.stats, names)]
        if self.nodes is not None:
            found.append(_mapped(self.pooled(), lambda b: b[names].assign(logit=dense_forward(p, _matrix(b["pool"], s.width), s.dense_layers)[0]), f"{kinds}, logit double"))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def gradient(self, n: float) -> tuple[Params, float]:
        """(gradients, loss added up) over the batch's n graphs."""
        p, s = self.p, self.s
        total, d = {}, None
        if self.nodes is not None:
            total, d = self._top(n)
        known: list[tuple[Params, float]] = []
        for l in range(s.layers - 1, -1, -1):
            norms, both = {}, None
            if self.nodes is not None:
                both = self.sums[l].join(d, NODE)
                norms = self._norms(l, both)
            if self.whole is not None:
                found = self.whole.backward(self.stats, n, known)
                norms = added(iter([norms, {k: found.pop(k) for k in (f"g{l}", f"o{l}", "n") if k in found}]))
                total = added(iter([total, found]))
            known.append((norms, float(norms.pop("n")[0])))
            total |= norms
            if self.nodes is not None:
                d, found = self._back(l, d, both, *known[-1])
                total |= found
        if self.nodes is not None:
            rows = self.nodes.select(*NODE, "x").join(d, NODE)
            found = _total(_mapped(rows, lambda b: _rows_of({"w_in": _matrix(b["d"], s.width).T @ _matrix(b["x"], 0), "b_in": _matrix(b["d"], s.width).sum(axis=0)}), NAMED))
            total = added(iter([total, found]))
        if self.whole is not None:
            total = added(iter([total, self.whole.backward(self.stats, n, known)]))
        loss = float(total.pop("loss")[0])
        return {k: total[k].reshape(v.shape) for k, v in p.items()}, loss

    def _top(self, n: float) -> tuple[Params, DataFrame]:
        """(gradients of the dense weights with the loss, gradients of the nodes' numbers below them)."""
        p, s, graph = self.p, self.s, self.kinds.split(", ")[0]
        pool = self._kept(self.pooled())
        total = _total(_mapped(pool, lambda b: _rows_of(dense_gradients(p, _matrix(b["pool"], s.width), b["y"].to_numpy(np.float64), n, s.dense_layers)[0]), NAMED))
        down = _mapped(pool, lambda b: b[["graph", "n"]].assign(d=list(dense_gradients(p, _matrix(b["pool"], s.width), b["y"].to_numpy(np.float64), n, s.dense_layers)[1])), f"{graph}, n long, d array<double>")
        return total, self._kept(self.states[-1].select(*NODE).join(down, "graph").select(*NODE, F.transform("d", lambda x: x / F.col("n")).alias("d")))

    def _even(self, l: int):
        s, (mean, variance) = self.s, self.stats[l]
        return lambda b: (_matrix(b["t"], s.width) - mean) / np.sqrt(variance + EPS)

    def _norms(self, l: int, both: DataFrame) -> Params:
        """Gradients of a layer's norm, and how many nodes."""
        s, even = self.s, self._even(l)
        return _total(_mapped(both, lambda b: _rows_of({f"g{l}": (_matrix(b["d"], s.width) * even(b)).sum(axis=0), f"o{l}": _matrix(b["d"], s.width).sum(axis=0), "n": np.array([float(len(b))])}), NAMED))

    def _back(self, l: int, d: DataFrame, both: DataFrame, norms: Params, n: float) -> tuple[DataFrame, Params]:
        """(gradients of the numbers below a layer, gradients of its messages' weights)."""
        p, s, (_, variance), even = self.p, self.s, self.stats[l], self._even(l)

        def before(b: pd.DataFrame) -> pd.DataFrame:
            x = even(b)
            return b[NODE].assign(d=list(p[f"g{l}"] / np.sqrt(variance + EPS) * (_matrix(b["d"], s.width) - norms[f"o{l}"] / n - x * norms[f"g{l}"] / n)))

        d = self._kept(_mapped(both, before, f"{self.kinds}, d array<double>"))
        met = self._kept(self._ends(l).join(d.select("graph", F.col("node").alias("dst"), "d"), ["graph", "dst"]))

        def gradients(b: pd.DataFrame) -> tuple:
            found = messages(p, l, _matrix(b["h_dst"], s.width), _matrix(b["h_src"], s.width), b["distance"].to_numpy(np.float64), s.bins)
            return message_gradients(p, l, *found, _matrix(b["d"], s.width), s.width)

        def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = added(gradients(b)[0] for b in batches if len(b))
            if total:
                yield _rows_of(total)

        def ends(b: pd.DataFrame) -> pd.DataFrame:
            _, to, source = gradients(b)
            return pd.concat([pd.DataFrame({"graph": b["graph"], "node": b[n], "d": list(v)}) for n, v in (("dst", to), ("src", source))])

        found = _total(met.mapInPandas(weights, NAMED))
        if not found:  # no edges: the layer's weights do nothing
            found = {k: np.zeros(p[k].size) for k in (f"w_gate{l}", f"b_gate{l}", f"w_core{l}", f"b_core{l}")}
        # a node's own number went on as it was too
        below = d.unionByName(_mapped(met, ends, f"{self.kinds}, d array<double>"))
        return self._kept(_sum_arrays(below, NODE, s.width, "d")), found


@dataclass(frozen=True)
class GraphNetwork:
    """Weights and running statistics."""

    params: Params
    stats: list
    shape: Shape

    def scored(self, nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
        """`graphs` (graph, ...) that have nodes, with the probability of the positive class."""
        held = Held(nodes.sparkSession)
        try:
            whole, *rest = gathered(nodes, edges, graphs, held)
            return self.scored_rows(whole, *rest, graphs)
        finally:
            held.close()

    def scored_rows(self, whole: DataFrame, nodes: DataFrame | None, edges: DataFrame | None, graphs: DataFrame) -> DataFrame:
        """The same, of graphs as `gathered` gives them."""
        run = _Pass(nodes, edges, graphs, self.params, self.shape, self.stats, whole)
        found = Held(graphs.sparkSession).written(run.logits())
        run.close()
        return found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("logit")))))).drop("logit")


def batch_gradient(nodes: DataFrame | None, edges: DataFrame | None, labels: DataFrame, p: Params, s: Shape, whole: DataFrame | None = None) -> tuple[Params, list, float, float]:
    """(gradient of the mean loss, (mean, sample variance) of each layer, graphs, mean loss) of a batch of graphs."""
    n = float(labels.count())
    if n < 2:
        return {}, [], n, 0.0
    run = _Pass(nodes, edges, labels, p, s, whole=whole)
    try:
        gradient, loss = run.gradient(n)
        m = run.count
    finally:
        run.close()
    return gradient, [(a, v * m / max(m - 1, 1)) for a, v in run.stats], n, loss / n


def fit_graph_network(nodes: DataFrame, edges: DataFrame, train: DataFrame, validation: DataFrame, shape: Shape = Shape(), s: Settings = Settings()) -> tuple[GraphNetwork, dict]:
    """(network, record) from graphs whose labels (graph, y), y 0 or 1, are in `train`; an epoch is chosen on `validation`.

    Batches are drawn by a hash of seed, epoch and graph. Only graphs with nodes count; edges from or to nodes that aren't there
    are left out; a node without edges keeps its own numbers. Nodes of one graph must not repeat."""
    # read in every pass
    held, sides = Held(nodes.sparkSession), []
    try:
        given = [r.filter("y is not null").select("graph", "y", F.xxhash64("graph").alias("key"), F.lit(i).alias("side")) for i, r in enumerate((train, validation))]
        whole, *rest = gathered(nodes, edges, given[0].unionByName(given[1]), held)
        for i, labels in enumerate(given):
            own = whole.filter(F.col("side") == i).select("graph", "y", "key")
            larger = [labels.join(r.select("graph").distinct(), "graph", "left_semi").select(*own.columns) for r in rest[:1] if r is not None]
            sides.append((own.unionByName(larger[0]) if larger else own).persist())
        found = (rows.select(n.cast("int")).first() for rows, n in ((whole, F.size("_x") / F.col("_n")), (rest[0], F.size("x")), (nodes, F.size("x"))) if rows is not None)
        if (x := next((r for r in found if r is not None), None)) is None:
            raise ValueError("there are no nodes")
        return _fitted(whole, rest, sides, x[0], shape, s)
    finally:
        for side in sides:
            side.unpersist()
        held.close()


def _fitted(whole: DataFrame, rest: list, sides: list[DataFrame], features: int, shape: Shape, s: Settings) -> tuple[GraphNetwork, dict]:
    """`fit_graph_network` of gathered graphs."""
    batches = max(1, math.ceil(sides[0].count() / s.batch_size))

    def parts(side: int, some=F.lit(True)) -> tuple:
        """(nodes, edges, labels, whole) of some of a side's graphs."""
        labels = sides[side].filter(some).select("graph", "y")
        larger = (r if r is None else r.join(labels.select("graph"), "graph", "left_semi") for r in rest)
        return *larger, labels, whole.filter((F.col("side") == side) & some)

    def gradients(epoch: int, batch: int, p: Params, step: int):
        *graphs, own = parts(0, in_batch(s.seed, epoch, batch, batches))
        return batch_gradient(*graphs, p, shape, own)

    def judged(p: Params, running: list) -> tuple[float, float]:
        *larger, labels, own = parts(1)
        rows = GraphNetwork(p, running, shape).scored_rows(own, *larger, labels).persist()
        try:
            e = F.when(F.col("y") > 0, F.col("score")).otherwise(1 - F.col("score"))
            loss = rows.agg(F.avg(-F.log(F.greatest(e, F.lit(1e-300))))).first()[0]
            return loss, ranking.roc_auc(rows, [], "score", F.col("y") > 0).first()["roc_auc"]
        finally:
            rows.unpersist()

    running = [(np.zeros(shape.width), np.ones(shape.width)) for _ in range(shape.layers)]
    p, running, record = train_epochs(first_weights(features, shape, s.seed), running, batches, gradients, judged, s)
    return GraphNetwork(p, running, shape), record
