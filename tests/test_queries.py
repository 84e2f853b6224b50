"""Every query with SQL against DuckDB on the smallest tables, as the driver compares them."""

import importlib
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")
NAMES = ["net_dedup", "net_interior", "grf_turn_edges", "grf_components", "top_choice_r3", "flagship", "rank_spearman", "tile_stats", "set_edge_diff", "match_nearest", "match_dwithin", "transfer_streets", "export_delta"]
NAMES += ["match_lines", "match_agreement", "recall_curve", "offset_scan", "net_hull", "tile_land", "top_integration_rn", "choice_totals", "metric_closeness_r400", "s0_closeness_r400", "angular_rn"]
NAMES += ["end_directions", "stroke_pairs", "simplify_lines", "merge_parallels", "net_rebuilt", "window_stats", "labels_of_sites"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{t}'")
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    as_text = lambda df: sorted(tuple("" if v != v or v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df[cols].astype({c: float for c in cols if df[c].dtype.kind in "iuf"}).itertuples(index=False))
    assert as_text(got) == as_text(want)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
