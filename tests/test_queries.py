"""Each registered query gives the rows of its SQL."""

import pytest

from photark.plans import images, registry


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(map(tuple, pdf.astype(object).where(pdf.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # both as the driver reads them: numbers by value
        if want[c].dtype != got[c].dtype and want[c].dtype.kind in "iuf":
            want[c] = want[c].astype(got[c].dtype) if got[c].notna().all() and want[c].notna().all() else want[c].astype(float)
            got[c] = got[c].astype(want[c].dtype)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(images.QUERIES) - set(images.SQL)))
def test_query_without_sql_keeps_every_pixel(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) == duck.execute("SELECT count(*) FROM orders").fetchone()[0] == len(got.drop_duplicates(["x", "y"]))
    assert got[["r", "g", "b"]].notna().all().all()
