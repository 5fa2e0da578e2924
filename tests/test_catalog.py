"""All queries of the raster engine against their SQL twins on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

import verify
from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in verify.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert verify.rows_of(df.columns, df.collect()) == verify.rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def mirrored(i, n):
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def smaller_line(line, factor):
    """Gaussian smoothing of a line (deviation (f - 1) / 2), then linear reading at the targets' centres, cell by cell."""
    n = len(line)
    m = max(1, round(n / factor))
    f = n / m
    sigma, out = (f - 1) / 2, []
    reach = int(np.ceil(4 * sigma)) + 1
    for k in range(m):
        centre = (k + 0.5) * f - 0.5
        base = int(np.floor(centre))
        total = weights = 0.0
        for i in range(base - reach, base + reach + 2):
            g = [np.exp(-0.5 * ((i - base - side) / sigma) ** 2) if sigma else float(i == base + side) for side in (0, 1)]
            w = (1 - centre + base) * g[0] + (centre - base) * g[1]
            total, weights = total + w * line[mirrored(i, n)], weights + w
        out.append(total / weights)
    return out


def test_stored_pyramid_has_the_cells_of_all_levels(spark, duck):
    base = np.zeros(duck.execute("SELECT max(vec_id) + 1, 64 FROM embeddings").fetchone())
    for y, x, v in duck.execute(f"WITH {catalog.EMB} SELECT y, x, intensity FROM emb").fetchall():
        base[y, x] = v
    rows = catalog.queries()["stored_pyramid"](spark, SF).toPandas()
    for level, factor in enumerate((1.0, 2.0, 4.0)):
        down = np.array([smaller_line(c, factor) for c in base.T]).T if level else base
        want = np.array([smaller_line(r, factor) for r in down]) if level else base
        own = rows[rows["level"] == level]
        assert len(own) == want.size
        got = np.full(want.shape, -1.0)
        got[own["y"], own["x"]] = own["intensity"]
        assert np.abs(got - want).max() <= 0.5 + 1e-6
    assert set(rows["level"]) == {0, 1, 2}
