import numpy as np
import pytest
from __spark_entry__ import oracle_sql, queries

from vecloom.llm.peaks import density_peaks

DATA = "/root/testdata/sf0.01"


def planted(rng):
    """Rows of two collections with groups of 1 to 30 vectors, some of them copies of others; ids shuffled."""
    rows, truth, ids = [], {}, iter(rng.permutation(400).tolist())
    for grp in ("a", "b"):
        for size in (1, 1, 2, 5, 30, 17):
            centre = rng.normal(size=48)
            members = []
            for k in range(size):
                v = centre if k % 5 == 4 else centre + rng.normal(size=48) * 0.25
                members.append(next(ids))
                rows.append((grp, members[-1], [float(x) for x in np.float32(v)]))
            truth |= {m: (min(members), size) for m in members}
    return rows, truth


@pytest.mark.parametrize("block", [4096, 7])
def test_groups_in_any_number_of_blocks(spark, block):
    rows, truth = planted(np.random.default_rng(1))
    got = density_peaks(spark.createDataFrame(rows, "grp string, id bigint, vec array<float>"), block=block).collect()
    assert {r["id"]: (r["cluster_id"], r["size"]) for r in got} == truth
    assert all(r["density"] == r["size"] - 1 for r in got)


def test_pointers_lead_to_denser_neighbours(spark):
    """A chain that is no clique, against pointers by brute force."""
    angles = np.deg2rad([0, 30, 60, 90, 100, 240])
    rows = [("a", 10 + i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angles)]
    x = np.array([r[2] for r in rows])
    cos = x @ x.T
    near = (cos >= 0.7) & ~np.eye(len(x), dtype=bool)
    n = near.sum(axis=1)
    want = {}
    for i in range(len(x)):
        up = [(-round(cos[i, j], 5), j) for j in range(len(x)) if near[i, j] and (n[j], -j) > (n[i], -i)]
        want[10 + i] = (n[i], 10 + (min(up)[1] if up else i))
    got = density_peaks(spark.createDataFrame(rows, "grp string, id bigint, vec array<float>")).collect()
    assert {r["id"]: (r["density"], r["parent"]) for r in got} == want


def test_p2_found_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("collection_info", "add_request"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(oracle_sql()["p2_found"]).fetchall()
    assert sorted(map(tuple, queries()["p2_found"](spark, DATA).collect())) == sorted(want) and want
