"""Operators on small inputs: nulls, ties, repeated rows, empty tables, clashing names; and against brute force."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions import vectors as m
from vecloom.operators import documents, exact, ivf, kv, maintenance, selectors, statistics, topk, training
from vecloom.operators.ivf import Params
from vecloom.sources import checkpoints

VEC = "id bigint, vec array<double>"


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], VEC)


def brute(q, x, k, metric):
    out = set()
    for i, a in enumerate(q):
        s = {"ip": -(x @ a), "l2": ((x - a) ** 2).sum(axis=1), "l1": np.abs(x - a).sum(axis=1), "linf": np.abs(x - a).max(axis=1)}[metric]
        out |= {(i, int(j)) for j in np.lexsort((np.arange(len(x)), np.round(s, 12)))[:k]}
    return out


@pytest.mark.parametrize("metric", ["ip", "l2", "l1", "linf"])
@pytest.mark.parametrize("sent", [1 << 20, 2000, 0])
def test_search_is_the_same_whichever_side_is_sent(spark, metric, sent):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(5, 8))
    x[10] = x[3]  # a copy, so a tie
    got = exact.knn(frame(spark, q).withColumnsRenamed({"id": "qid", "vec": "q"}), frame(spark, x), 7, metric, sent=sent)
    assert {(a, b) for a, b in rows_of(got, "qid", "id")} == brute(q, x, 7, metric)


def test_search_leaves_out_what_cannot_be_compared(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, None, 5), (None, [1.0, 0.0], 5), (3, [float("nan"), 1.0], 5), (4, [1.0, None], 5), (5, [1.0], 5), (6, [], 5), (7, [1.0, 0.0], 5)], VEC + ", score int")
    q = spark.createDataFrame([(0, [2.0, 0.0])], "qid bigint, q array<double>")
    assert rows_of(exact.knn(q, base, 10), "id", "score", "rank") == [(1, 2.0, 1), (7, 2.0, 2)]
    assert exact.knn(q, base, 0).count() == 0 == exact.knn(q.limit(0), base, 3).count() == exact.knn(q, base.limit(0), 3).count()
    assert rows_of(exact.range_search(q, base, 2.0, "ip"), "id") == []  # the bound is exclusive
    assert rows_of(exact.range_search(q, base, 1.5, "ip"), "id") == [(1,), (7,)]


def test_merge_of_partial_lists(spark):
    a = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.5), (1, -1, 0.0)], "qid bigint, id bigint, score double")
    b = spark.createDataFrame([(1, 6, 0.7), (1, 7, -0.2), (1, 8, None)], "qid bigint, id bigint, score double")
    assert [(r["id"], r["rank"]) for r in topk.merge([a, b], 5, "ip").orderBy("rank").collect()] == [(6, 1), (5, 2), (7, 3)]


@pytest.mark.parametrize("kind", ["flat", "pq", "sq8"])
def test_all_lists_probed_give_the_exact_answer(spark, kind):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(400, 16)), rng.normal(size=(6, 16))
    base = frame(spark, x)
    p = Params("l2", 16, kind, training.train_pq(x, 8) if kind == "pq" else None, x.min(axis=0), x.max(axis=0) - x.min(axis=0))
    c = training.vectors_frame(spark, x[:7])
    asked = frame(spark, q).withColumnsRenamed({"id": "qid", "vec": "q"})
    index = ivf.build(base, c, p, rows=50)
    assert index.filter("block > 0").count() > 0
    found = ivf.two_phase(index, base, asked, c, p, 5, 100, 80)
    assert {(a, b) for a, b in rows_of(found, "qid", "id")} == brute(q, x, 5, "l2")
    gone = base.filter("id % 2 = 0").select("id")
    left = ivf.two_phase(index, base, asked, c, p, 5, 100, 80, gone)
    assert all(r["id"] % 2 for r in left.collect()) and left.count() == 30
    with pytest.raises(ValueError):
        ivf.two_phase(index, base, asked, c, p, 0, 1, 1)


def test_hot_list_and_hot_queries_are_parted(spark):
    x = np.random.default_rng(3).normal(size=(200, 4))
    base, p = frame(spark, x), Params("ip", 4)
    one = base.select("id", F.lit(0).alias("list_no"))
    index = ivf.build(base, training.vectors_frame(spark, x[:1]), p, one, rows=20)
    asked = base.withColumnsRenamed({"id": "qid", "vec": "q"})
    found = topk.top_k(ivf.scan(index, asked, asked.select("qid", F.lit(0).alias("list_no")), p, 3, asked=16), 3)
    assert {(a, b) for a, b in rows_of(found, "qid", "id")} == brute(x, x, 3, "ip")


def test_means_and_weights(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [3.0, 4.0], 3), (2, [5.0, 5.0], 0), (None, [1.0, 1.0], 1), (1, None, 1), (3, [7.0, 7.0], None)], "k bigint, v array<double>, w int")
    assert rows_of(statistics.means(df, "k", "v", "w"), "k", "n", "mean") == [(1, 2, [2.5, 3.5])]
    assert rows_of(statistics.means(df, "k", "v"), "k", "n", "mean") == [(1, 2, [2.0, 3.0]), (2, 1, [5.0, 5.0]), (3, 1, [7.0, 7.0])]
    assert statistics.means(df.limit(0), "k", "v").count() == 0


def test_line_kmeans_is_optimal(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.random() * 10, rng.randrange(10)]) for _ in range(12)]
    got, cost = training.kmeans_line(spark.createDataFrame([(v,) for v in [*map(float, values), None]], "x double"), "x", 3)
    s = sorted(map(float, values))
    sse = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) if v else 0.0
    best = min(sse(s[:i]) + sse(s[i:j]) + sse(s[j:]) for i in range(len(s) + 1) for j in range(i, len(s) + 1))
    assert abs(cost - best) < 1e-9 and len(got) == 3


def test_empty_clusters_take_half_of_the_largest():
    c = training.split_empty(np.array([[1.0, 1.0], [5.0, 5.0]]), np.array([10, 0]))
    assert np.allclose(c.mean(axis=0), [1, 1]) and not np.array_equal(c[0], c[1])


def test_selectors(spark):
    df = spark.createDataFrame([(i, i) for i in (-1, 0, 3, 8, 12, 40)] + [(None, 0)], "id bigint, bits int")
    bits = F.unhex(F.lit("09FF"))
    assert rows_of(df.filter(selectors.bitmap(bits)), "id") == [(0,), (3,), (8,), (12,)]
    assert rows_of(df.filter(selectors.neither(selectors.id_range(0, 10))), "id") == [(-1,), (12,), (40,)]
    assert df.filter(selectors.id_list([])).count() == 0
    assert rows_of(df.filter(selectors.owned(3, 2)), "id") == [(-1,), (8,)]


def test_expressions_on_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0]), (None, [1.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.0, None], [1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(m.dot("a", "b").alias("d"), m.linf("a", "b").alias("m"), m.cosine("a", "b").alias("c"), m.renormalised("a").alias("n")).collect()
    assert [(r["d"], r["m"]) for r in got] == [(None, None), (None, None), (0.0, 0.0), (None, None)]
    assert got[2]["c"] == 0.0 and got[2]["n"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        m.reverse_linear(F.col("a"), [[1.0, 0.0], [1.0, 0.0]])


def test_newest_of_add_and_delete_wins(spark):
    added = spark.createDataFrame([(1, [1.0], 1), (1, [2.0], 3), (2, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1), (None, [1.0], 9), (4, [4.0], None)], VEC + ", seq bigint")
    gone = spark.createDataFrame([(1, 2), (2, 2), (9, 1)], "id bigint, seq bigint")
    assert rows_of(maintenance.alive(added, gone), "id", "vec") == [(1, [2.0]), (3, [1.0]), (4, [4.0])]
    assert maintenance.alive(added.limit(0), gone).count() == 0
    with pytest.raises(ValueError):
        maintenance.check_compatible({"d": 1}, {"d": 2})


OPS = st.lists(st.tuples(st.sampled_from(["put", "ttl", "del", "only"]), st.sampled_from("abcd"), st.integers(0, 30)), max_size=25)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS, st.integers(0, 30), st.randoms())
def test_kv_against_a_dictionary(spark, ops, at, rnd):
    """Random writes in any order of arrival, read as of a version; compaction up to it changes no later read."""
    entries, held = [], {}
    for version, (op, key, n) in enumerate(ops):
        meta = {"del": kv.DELETED, "only": kv.DISCARD_EARLIER}.get(op, 0)
        entries.append((key, version, None if op == "del" else f"v{n}", meta, 0, 100 + n if op == "ttl" else 0))
        if version <= at:
            held[key] = entries[-1]
    now = 115
    want = sorted((k, e[2]) for k, e in held.items() if not (e[3] & 1 or 0 < e[5] <= now))
    rnd.shuffle(entries)
    df = spark.createDataFrame(entries + entries[:3], kv.LOG)
    assert rows_of(kv.visible(df, now, read_ts=at), "key", "value") == want
    small = kv.compacted(df, now, discard_ts=at)
    assert rows_of(kv.visible(small, now, read_ts=at), "key", "value") == want
    assert rows_of(kv.visible(small, now), "key", "value") == rows_of(kv.visible(df, now), "key", "value")


def test_documents_are_numbered_without_gaps(spark):
    batch = spark.createDataFrame([(f"k{i:02d}", f"v{i}", i) for i in range(40)] + [("k05", "later", 99), (None, "x", 1)], "key string, value string, seq int")
    store = documents.put(spark.createDataFrame([("k03", 7, "old")], "key string, xid bigint, value string"), batch)
    got = rows_of(store, "xid", "key", "value")
    assert [g[0] for g in got] == list(range(7, 47)) and got[0][1:] == ("k03", "v3") and ("k05", "later") in [g[1:] for g in got]
    asked = spark.createDataFrame([(0, 7), (1, 999), (2, None)], "pos int, xid bigint")
    assert [r["value"] for r in documents.fetch(asked, store).orderBy("pos").collect()] == ["v3", "", ""]


def test_checkpoints(spark, tmp_path):
    root = str(tmp_path)
    assert checkpoints.latest(spark, f"{root}/c") is None and checkpoints.collections(spark, root).count() == 0
    for n in range(2):
        assert checkpoints.write(spark, f"{root}/c", {"vectors": spark.range(n + 3)}) == n
    (tmp_path / "c" / "checkpoint_x").mkdir()
    (tmp_path / "none").mkdir()
    assert checkpoints.read(spark, f"{root}/c")["vectors"].count() == 4
    assert rows_of(checkpoints.collections(spark, root), "collection_name", "version") == [("c", 1)]
    with pytest.raises(FileNotFoundError):
        checkpoints.read(spark, f"{root}/none")


def test_other_query_parameters_need_the_same_shape(spark):
    p = spark.createDataFrame([(r, "centroids", i, [1.0, 2.0]) for r in ("insert", "query") for i in range(2)], "role string, name string, no int, value array<double>")
    new = spark.createDataFrame([("centroids", i, [3.0, 4.0]) for i in range(2)], "name string, no int, value array<double>")
    assert rows_of(maintenance.installed(p, new), "role", "value") == [("insert", [1.0, 2.0])] * 2 + [("query", [3.0, 4.0])] * 2
    with pytest.raises(ValueError):
        maintenance.installed(p, new.limit(1))
