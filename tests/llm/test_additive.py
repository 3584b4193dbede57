import numpy as np
import pytest
from __spark_entry__ import queries

from vecloom.llm.additive import BOOKS, Block, encode, train
from vecloom.llm.neighbours import logged_queries
from vecloom.llm.vectors import latest_vectors

DATA = "/root/testdata/sf0.001"


def best(x, ids, q, k, metric):
    x, q = x.astype(np.float64), q.astype(np.float64)
    if metric == 0:
        s = -((x - q) ** 2).sum(axis=1)
    else:
        s = (x * q).sum(axis=1)
        if metric == 2:
            s = s / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    return ids[np.lexsort((ids, -s))[:k]].tolist()


@pytest.mark.parametrize("metric", [0, 1, 2])
@pytest.mark.parametrize("trained", [True, False])
def test_exact_whatever_the_codebooks(metric, trained):
    """Codebooks of other vectors, or of zeros, leave much over, and the queries lie in what is left."""
    rng = np.random.default_rng(2)
    x = ((rng.normal(size=(3000, 64)) + 2) * rng.uniform(0.3, 3, (3000, 1))).astype(np.float32)
    books = train(rng.normal(size=(500, 64)).astype(np.float32) + np.eye(64, dtype=np.float32)[0] * 5) if trained else np.zeros((BOOKS, 1, 64), np.float32)
    codes, left = encode(x, books)
    ids = rng.permutation(3000).astype(np.int64)
    block = Block(ids.tobytes(), x.tobytes(), codes.tobytes(), left.tobytes(), books.tobytes(), *x.shape)
    q = np.concatenate([x[:60], rng.normal(size=(20, 64)).astype(np.float32)])
    got = list(block.search(q, np.full(80, 10), np.full(80, metric)))
    assert [i.tolist() for _, i, _ in got] == [best(x, ids, v, 10, metric) for v in q]


def stored(spark):
    by = {}
    for r in latest_vectors(spark, DATA).collect():
        by.setdefault(r["grp"], []).append((r["id"], r["vec"]))
    return {g: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32)) for g, rows in by.items()}


def test_p5_found_recall_of_logged_queries(spark):
    held = stored(spark)
    want = [(r["qid"], r["sub"], i) for r in logged_queries(spark, DATA).collect() if r["grp"] in held for i in best(held[r["grp"]][1], held[r["grp"]][0], np.array(r["q"], np.float32), r["k"], r["metric"])]
    got = set(map(tuple, queries()["p5_found"](spark, DATA).collect()))
    assert len(got) == len(want) and got == set(want)


def test_p5_neighbours_leave_out_the_vector_itself(spark):
    want = set()
    for ids, x in stored(spark).values():
        for i in np.flatnonzero(ids % 20 == 0):
            rest = ids != ids[i]
            want |= {(int(ids[i]), n, r + 1) for r, n in enumerate(best(x[rest], ids[rest], x[i], 10, 2))}
    assert set(map(tuple, queries()["p5_neighbours"](spark, DATA).collect())) == want
