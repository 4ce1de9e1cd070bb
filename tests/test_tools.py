import json

import numpy as np
import pytest

from tidemark import cli, tools


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(80):
        x, noise = rng.normal(size=30), rng.normal(size=30)
        for a in range(30):
            rows.append((f"2020-{1 + d // 28:02d}-{1 + d % 28:02d}", a, float(x[a]), float(noise[a]), float(0.5 * x[a] + rng.normal())))
    path = str(tmp_path_factory.mktemp("p") / "panel.parquet")
    spark.createDataFrame(rows, "date string, asset long, good double, bad double, forward_return double").write.parquet(path)
    return path


def test_factory_and_ledger(spark, panel, tmp_path):
    ledger = str(tmp_path / "ledger.json")
    rows = tools.factory_and_register(spark, panel, ledger, hac_lags=2, dsr_threshold=0.7)
    assert {r["name"]: r["passed"] for r in rows} == {"good": True, "bad": False}
    assert [r["name"] for r in tools.list_discoveries(spark, ledger)] == ["good"]
    run = tools.list_manifests(spark, ledger)[0]["run_id"]
    assert tools.verify_discovery(spark, ledger, run, panel)["data"]
    tools.factory_and_register(spark, panel, ledger, hac_lags=2, dsr_threshold=0.7)
    assert len(tools.list_discoveries(spark, ledger)) == 1
    with pytest.raises(KeyError):
        tools.verify_discovery(spark, ledger, "none", panel)
    (tmp_path / "old.json").write_text(json.dumps([{"name": "x", "a": 1}, {"name": "x", "a": 2}]))
    assert tools.list_discoveries(spark, str(tmp_path / "old.json")) == [{"name": "x", "a": 2}]


def test_screen_file_and_commands(spark, panel, capsys):
    rows = tools.screen_file(spark, panel, hac_lags=2)
    assert [r["name"] for r in rows] == ["good", "bad"]
    assert cli.main(["factors", "spread"]) == 0 and "roll_spread" in capsys.readouterr().out
    assert cli.main(["describe", "momentum"]) == 0 and "momentum" in capsys.readouterr().out
    assert cli.main(["factors", "--json"]) == 0 and len(json.loads(capsys.readouterr().out)) == len(tools.list_factors())
    assert cli.main(["list", "bars_tick"]) == 0 and "bars_tick" in capsys.readouterr().out
    assert tools.list_categories() and tools.search_factors("trend") == ["momentum"]
