"""The recall audit of op8 and copies of a vector."""

import numpy as np
import pytest
from tarnweave.llm import vector_graph
from tarnweave.llm.common import materialise


class Narrow:
    """A graph that finds nothing but the query itself until its beam is wide."""

    def __init__(self, points):
        self.points = points

    def search(self, queries, beam, known=None):
        sims = queries @ self.points.T
        ids = np.argsort(-sims, axis=1, kind="stable")[:, : 1 if beam < 90 else beam]
        return ids, np.take_along_axis(sims, ids, 1)


def test_links_with_itself_do_not_hide_a_miss():
    v = np.random.default_rng(3).normal(size=(300, 64))
    v[1] = v[0] + 0.01 * v[2]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    root, recall = vector_graph.linked(Narrow(v.astype(np.float32)), v, v, True, 0.98)
    assert root[1] == root[0] == 0 and recall == 1 and (root[2:] == np.arange(2, 300)).all()


def test_groups_of_copies_join(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 16))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    near = a + 0.17 * (b - (a @ b) * a) / np.linalg.norm(b - (a @ b) * a)
    rows = [(i, 1, (a if i < 60 else near if i < 120 else rng.normal(size=16)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(df).collect()}
    assert {found[i].component_id for i in range(120)} == {0} and {found[i].n_links for i in range(120)} == {119}


def test_exact_beyond_a_share_of_the_shard():
    v = np.random.default_rng(5).normal(size=(90, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    root, recall = vector_graph.linked(Narrow(v.astype(np.float32)), v, v, True, 0.6)
    assert recall == 1 and (root == vector_graph.roots_of(*np.nonzero(v @ v.T >= 0.6), 90)).all()


@pytest.mark.parametrize("same", [True, False])
def test_blocks_of_few_links_are_compared_exactly(same, monkeypatch):
    """The audited vectors have no links, others have, and the graph finds none of them."""
    monkeypatch.setattr(vector_graph, "AUDIT_MOST", 128)
    v = np.random.default_rng(7).normal(size=(600, 64))
    free = np.random.default_rng(600).permutation(600)[128:]  # as linked() draws: not audited
    for a, b in zip(free[:3], free[3:6]):
        v[b] = v[a] + 0.001 * v[b]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    w = v if same else v[free[:3]]
    root, recall = vector_graph.linked(Narrow(w.astype(np.float32)), w, v, same, 0.98)
    a, b = np.nonzero(v @ w.T >= 0.98)
    assert recall == 1 and (root == vector_graph.roots_of(a, b if same else b + 600, len(root))).all()
    assert len(set(root)) == 597


def test_recall_is_written_for_each_block(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 16))
    v[200:300] = v[:100] + 0.01 * rng.normal(size=(100, 16))
    rows = materialise(spark.createDataFrame([(i, 1 if i < 300 else 2, 16, x.tolist()) for i, x in enumerate(v)], "uid long, label int, dim int, vector array<double>"), "v")
    found = vector_graph.audit_of(vector_graph.vector_links(rows, shard_rows=150)).collect()
    assert sorted((r.label, r.shard, r.block) for r in found) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (2, 0, 0)]
    assert all(r.recall is None if r.label == 2 else r.recall >= 0.9 for r in found)
