"""Graphs in mapped rows: as much work as there is to do, not a pass over all rows a round."""

import numpy as np
import pytest

from lattigraph.operators import csr, graph, ppr, push, walks
from lattigraph.plans.loop import settle

from .graphs import edges_df, exact_ppr, random_edges

N = 60


@pytest.fixture(scope="module")
def arcs(spark):
    return settle(graph.symmetric(edges_df(spark, random_edges(N))))


def counted(monkeypatch):
    """How often all rows are read."""
    calls, rows = [], csr.Mapped._rows

    def once(self, *args):
        calls.append(1)
        return rows(self, *args)

    monkeypatch.setattr(csr.Mapped, "_rows", once)
    return calls


def test_exact_values_take_few_passes(arcs, monkeypatch):
    """Before: a pass for each of 100 and more power steps."""
    g, calls = csr.compact(arcs, 10).value, counted(monkeypatch)
    x = np.zeros(g.n)
    x[3] = g.deg[3]
    got = ppr.ALPHA * ppr.solved(g, x, 1e-9, ppr.steps_for(1e-9, g.deg[3]))
    assert np.allclose(got, g.deg[3] * exact_ppr(random_edges(N), N)[3], atol=1e-9) and len(calls) < 40


def test_exact_values_reach_all_nodes(spark):
    """A chain that is longer than the steps of the solver: what power steps reach, is reached."""
    a = settle(graph.symmetric(edges_df(spark, [(i, i + 1) for i in range(300)])))
    g = csr.compact(a, 10).value
    x = np.zeros(g.n)
    x[0] = 1.0
    want, now, steps = x.copy(), x, ppr.steps_for(1e-9)
    for _ in range(steps):
        now = 0.8 * g.forward(now)
        want += now
    got = ppr.solved(g, x, 1e-9, steps)
    assert (got[want > 0] > 0).all() and np.abs(got - want).sum() <= 2e-8


def test_few_nodes_are_pushed_by_their_arcs(arcs, monkeypatch):
    """Before: all rows were read."""
    g, calls = csr.compact(arcs, 10).value, counted(monkeypatch)
    one = np.zeros(g.n)
    one[[4, 9]] = 1.0, 2.0
    got, reached = g.forward(one), g.reached(one > 0)
    assert not calls
    whole = csr._compact(arcs, csr.LIMIT).value
    assert np.allclose(got, whole.forward(one)) and (reached == whole.reached(one > 0)).all()


def test_accumulation_follows_the_ball(arcs, monkeypatch):
    """Before: each of its rounds went over the whole graph."""
    g = csr.compact(arcs, 10).value
    moved, forward = [], csr.Mapped.forward
    monkeypatch.setattr(csr.Mapped, "forward", lambda self, x: moved.append(1) or forward(self, x))
    x = np.zeros(g.n)
    x[5] = 2.0
    reserve, residue = push.accumulated_residue(g, x)
    assert len(moved) == 2 and reserve.sum() + residue.sum() == pytest.approx(2.0)


def test_size_and_degrees_are_found_once(arcs, monkeypatch):
    """Before: both were counted again over all arcs."""
    want = sorted(graph.weighted_degree(arcs.select("*")).collect()), tuple(graph.stats(arcs.select("*")).first())
    a = arcs.select("*")
    csr.compact(a, 10)
    assert "size" in graph.known(a)
    assert (sorted(graph.weighted_degree(a).collect()), tuple(graph.stats(a).first())) == want
    assert walks.walk_index(a, 0.1, 10.0).count() > 0


def test_ids_far_apart(spark):
    """Places by search where a table of ids would be large, by table where it is not."""
    edges = random_edges(20, 26)
    near, far = (settle(graph.symmetric(edges_df(spark, [(a * k - 7, b * k - 7) for a, b in edges]))) for k in (1, 10**12))
    g, h = (csr.compact(a, 10).value for a in (near, far))
    assert g.table is not None and h.table is None and (g.dst == h.dst).all()
    for x in (g, h):
        assert (x.index([*x.ids, -100, 3 * 10**15]) == [*range(x.n), -1, -1]).all()
