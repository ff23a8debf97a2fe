"""What the plans of registered queries move and compute, on the smallest given tables."""

import pytest

from frameloom.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan(spark):
    def text(name):
        return QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()

    return text


def test_hero_pick_moves_only_what_decides(plan):
    assert "dup_group" not in plan("W13_hero_pick")


def test_third_rule_crop_is_computed_once(plan):
    filters = [line for line in plan("P21_third_rule_crop").splitlines() if "Filter (" in line]
    assert filters and not any("0.35" in line for line in filters)


def test_a_file_of_many_row_groups_is_not_dealt(spark, tmp_path):
    """F13 to F15, F20, F22, F25, F28: one file was dealt anew for every reading, also where Spark can split it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from frameloom.plans.registry import dealt

    rows = pa.table({"k": np.random.default_rng(1).permutation(8_000_000)})
    for name, size in (("many", 100_000), ("one", 8_000_000)):
        pq.write_table(rows, tmp_path / f"{name}.parquet", row_group_size=size, compression="none", use_dictionary=False)
    moved = {n: "repartition" in dealt(spark.read.parquet(str(tmp_path / f"{n}.parquet")), "k")._jdf.queryExecution().logical().toString().lower() for n in ("many", "one")}
    assert moved == {"many": False, "one": True}


def test_only_what_is_asked_for_is_selected(spark):
    """every column of a record went through the selection of a shoot."""
    text = QUERIES["W4_spread_selection_shoot"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "tier" not in text and "representative" not in text


def test_flags_of_all_lists_meet_the_paths_once(spark):
    """each of three lists ranked all photos again and was joined by itself."""
    text = QUERIES["J2_category_flags"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 1


def test_the_last_state_of_a_path_is_hashed(spark):
    """a text as the last state had all commands of a task sorted."""
    text = QUERIES["M2_set_retouch"](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_cosine_pairs_of_odd_rows_are_those_of_the_sql(spark, tmp_path):
    """pairs of copies, of repeated keys and of vectors with a null element were left out."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from frameloom.plans import ORACLES

    base = np.random.default_rng(4).normal(size=(12, 64)).astype("float32").tolist()
    rows = [(i, base[i % 12]) for i in range(60)] + [(i, base[i % 5]) for i in range(8)] + [(None, base[0]), (70, None), (71, [0.0] * 64)]
    rows += [(80 + i, [None if n == i else x for n, x in enumerate(base[i])]) for i in range(12)]
    ids, vectors = zip(*rows)
    kinds = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()}
    pq.write_table(pa.table([ids, vectors, [1] * len(rows)], schema=pa.schema(kinds)), tmp_path / "embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
        want = [(a, b, round(d, 5) + 0.0) for a, b, d in con.execute(ORACLES["J4_cosine_pairs"]).fetchall()]
    got = [(r.a, r.b, round(r.distance, 5) + 0.0) for r in QUERIES["J4_cosine_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len({a for a, _, _ in want if a >= 80}) + len({b for _, b, _ in want if b >= 80}) >= 12
