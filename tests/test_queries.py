"""Registered queries next to their SQL on the smallest tables; the whole set runs in check_oracle.py."""
import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck, rows_of

SF = "/root/testdata/sf0.001"
PICK = ["make_bars", "upsert_bars", "clean_bars", "quality_report", "eda_stats", "ind_macd", "ind_adx", "preset_sma_cross", "preset_st_rsi", "signals_sl_tp", "dca_signals", "pla_signals", "trade_stats",
        "performance", "classify_regimes", "regime_drawdown", "assign_folds", "scenario_drift", "block_bootstrap", "sweep", "composite_score", "sweep_preset", "path_regimes", "plateau", "stream_bars", "stream_upsert", "append_outcomes", "scenario_gaps_outliers", "effective_pct"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", PICK)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert compare(rows_of(df.columns, got), rows_of(names, cur.fetchall())) == ""


def test_every_sql_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
