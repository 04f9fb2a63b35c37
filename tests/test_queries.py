"""Every query of the catalog against its SQL, at the smallest scale."""

import math

import pytest

from geoweft.plans import catalog
from geoweft.plans.inputs import points
from tests.conftest import SMALL


def rows(names, records):
    return sorted((tuple("" if x is None or isinstance(x, float) and math.isnan(x) else x for x in r) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(name, spark, duck):
    got = catalog.QUERIES[name](spark, SMALL)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want, have = rows(names, cur.fetchall()), rows(names, map(tuple, got.select(*names).collect()))
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert a == pytest.approx(b, abs=1e-6) if all(isinstance(x, (int, float)) for x in a) else all(x == y or isinstance(x, float) and abs(x - y) < 1e-6 for x, y in zip(a, b, strict=True))


def test_rays_of_every_part(spark):
    sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    got = sorted(map(tuple, catalog.QUERIES["xy_ray_grid_all"](spark, SMALL).select("id", "x", "y").collect()))
    side = lambda length: range(max(1, math.ceil(round(length / 0.5, 9))))
    assert got == sorted((k, i * 0.5, j * 0.5) for k, n in sizes.items() for i in side(n / 10) for j in side(n / 20))


def test_dbscan_of_every_point(spark):
    pts = {r.id: (r.x, r.y, r.z) for r in points(spark, SMALL).collect()}
    near = {k: [o for o, q in pts.items() if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= 0.05 * 0.05] for k, p in pts.items()}
    core = {k for k, others in near.items() if len(others) >= 4}
    cluster = {}
    for k in sorted(core):
        reached = [] if k in cluster else [k]
        while reached:
            if (at := reached.pop()) not in cluster:
                cluster[at] = k
                reached += [o for o in near[at] if o in core]
    border = {k: min(cluster[o] for o in others if o in core) for k, others in near.items() if k not in core and core & set(others)}
    got = catalog.QUERIES["dbscan_all"](spark, SMALL).collect()
    assert sorted((r.id, r.cluster, r.core) for r in got) == sorted([(k, c, True) for k, c in cluster.items()] + [(k, c, False) for k, c in border.items()])


def test_label_transfer_covers_the_table(spark):
    pts = points(spark, SMALL).collect()
    got = {r.id: r.label for r in catalog.QUERIES["label_transfer_all"](spark, SMALL).collect()}
    assert set(got) == {r.id for r in pts if r.label <= 2} and any(r.label == 0 for r in pts)


def test_literal_list_of_every_document(spark, tmp_path):
    docs = [(1, "[a, b c]"), (2, None), (3, "None"), (4, "says None here"), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.n for r in catalog.QUERIES["literal_list_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 3, 2: None, 3: None, 4: None, 5: 0}


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_rays_at_edges_of_boxes_equal_sql(spark, duck, tmp_path):
    # a ray that grazes an edge, one from inside, one along a side, one without a direction, parts without a size or a price, one turned inside out
    spark.createDataFrame([(1243,), (154,), (0,), (77,), (None,), *((k,) for k in range(2000, 2200))], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    parts = [(154, 12, 915.4), (155, 0, 900.0), (156, None, 910.0), (157, 7, None), (158, -20, 950.0), (None, 20, 930.0), *((k, k % 50 + 1, 900.0 + k % 100) for k in range(3000, 3300))]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    sql = catalog.ORACLES["ray_cast_by_element"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'").replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")
    got = catalog.QUERIES["ray_cast_by_element"](spark, str(tmp_path)).select("ray_id", "subject", "t").collect()
    assert rows(["ray_id", "subject", "t"], map(tuple, got)) == rows(["ray_id", "subject", "t"], duck.execute(sql).fetchall())


def test_rays_on_boxes_shuffle_no_pairs(spark):
    plan = catalog.QUERIES["ray_cast_by_element"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.partition("SortMergeJoin")[0]


def test_completion_of_odd_lines_equals_sql(spark, duck, tmp_path):
    # elements without a number, lines without a tax or a discount, depths beyond what a scanner would report
    lines = [(None, 5.0, 0.02, 0.04), (None, 7.0, 0.1, 0.01), (1, 5.0, None, 0.04), (1, 5.0, 0.03, 0.08), (2, 5.0, 0.03, None), (2, 6.0, 0.03, 0.01), (3, 2000.0, 0.05, 0.02), (3, 5.0, 0.01, 0.02), (4, 20000.0, 0.05, 0.02), (5, None, 0.05, 0.02)]
    spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = catalog.ORACLES["completion"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES["completion"](spark, str(tmp_path)).select("element", "completion", "color").collect()
    assert rows(["element", "completion", "color"], map(tuple, got)) == rows(["element", "completion", "color"], duck.execute(sql).fetchall())
