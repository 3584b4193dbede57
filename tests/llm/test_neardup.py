from itertools import combinations

from vecloom.llm.neardup import NearDuplicates, shingles


def by_brute_force(rows, words, similarity):
    sets = {i: set(shingles(t, words).tolist()) for i, t in rows}
    return sorted((a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]))


def test_all_pairs_of_large_classes(spark):
    """65 different texts of one set of runs, 66 equal ones, and one that is similar to each of the first."""
    words = [f"w{i}x" for i in range(40)]
    other = " ".join(f"v{i}y" for i in range(30))
    rows = [(i, " ".join(w.upper() if i >> k & 1 else w for k, w in enumerate(words)) + "!" * (i % 3)) for i in range(65)]
    rows += [(100 + i, other) for i in range(66)] + [(90, " ".join([*words, "more", "words"])), (91, "too short"), (92, None)]
    got = NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", words=3, similarity=0.7).id_pairs().collect()
    assert sorted(map(tuple, got)) == by_brute_force(rows, 3, 0.7)


def test_links_of_classes(spark):
    """p3_classes has no SQL; its operator against brute force."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join([*base, "end"])), (4, " ".join(f"q{i}" for i in range(20)))]
    got = NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").links().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)]


def test_registers_estimate_similarity():
    """Agreement of registers over many pairs: right on average and as scattered as independent registers would be."""
    import numpy as np

    from vecloom.llm.neardup import REGISTERS, registers

    rng = np.random.default_rng(3)
    shares = []
    for _ in range(150):
        v = rng.integers(0, 1 << 63, 260, dtype=np.uint64)
        shares.append(float((registers(np.sort(v[:200])) == registers(np.sort(v[60:]))).mean()))
    want = 140 / 260
    assert abs(np.mean(shares) - want) < 0.01 and np.std(shares) < 1.3 * (want * (1 - want) / REGISTERS) ** 0.5


def test_hot_buckets_lose_no_pair(spark):
    """Buckets of any size: with a small bound for what is hot, all levels of division and the grid come into play."""
    import random

    rng = random.Random(1)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common[:50] + [f"u{i}x{k}" for k in range(rng.randrange(12))] + common[50:])) for i in range(90)]
    rows += [(200 + i, " ".join(rng.sample(common, 20))) for i in range(30)] + [(5, rows[5][1]), (None, "a b c d")]
    got = NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", words=3, similarity=0.7, hot=4).id_pairs().collect()
    assert sorted(map(tuple, got)) == by_brute_force(dict(r for r in rows if r[0] is not None).items(), 3, 0.7)


def test_nothing_comes_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, text string, key int, a int")
    found = NearDuplicates(empty, "id", "text")
    assert found.id_pairs().count() == 0 == found.links().count()
