import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameloom.operators import blocks


@pytest.mark.parametrize("most", [2, 32])
def test_every_pair_meets_once(spark, monkeypatch, most):
    monkeypatch.setattr(blocks, "MOST_BLOCKS", most)
    keys = list(range(100))
    rows = spark.createDataFrame([(k,) for k in keys], "k long")

    def kernel(_, one, two, diagonal):
        assert len(one) <= 10 and len(two) <= 10
        a, b = one["k"].tolist(), two["k"].tolist()
        met = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if not diagonal or i < j]
        return pd.DataFrame({"a": [min(p) for p in met], "b": [max(p) for p in met], "two": [two["k"].min()] * len(met)}, columns=["a", "b", "two"])

    met = [(r.a, r.b) for r in blocks.per_cell(rows, [], "k", [], kernel, "a long, b long, two long", 10).collect()]
    assert sorted(met) == [(a, b) for a in keys for b in keys if a < b]


def test_copies_of_a_row_stop_growing_with_its_group(spark):
    copies = {n: blocks.in_cells(spark.range(n).withColumn("g", F.lit(0)), ["g"], "id", 10).count() / n for n in (100, 1_000, 3_000)}
    assert copies == {100: 10, 1_000: 32, 3_000: 32}


def test_found_rows_leave_a_cell_in_parts(spark, monkeypatch):
    """Whatever the size of the parts, all rows arrive, and none holds more than the bound and one tile."""
    monkeypatch.setattr(blocks, "MOST_BLOCKS", 1)
    rows = spark.range(100).withColumnRenamed("id", "k")

    def kernel(_, one, two, diagonal):
        return pd.DataFrame([(a, b) for a in one["k"] for b in two["k"] if not diagonal or a < b], columns=["a", "b"])

    told = []
    for most in (1, 150, 1_000_000):
        monkeypatch.setattr(blocks, "FOUND_ROWS", most)
        told.append(sorted((min(r), max(r)) for r in blocks.per_cell(rows, [], "k", [], kernel, "a long, b long", 10).collect()))
    assert told[0] == told[1] == told[2] == [(a, b) for a in range(100) for b in range(a + 1, 100)]
