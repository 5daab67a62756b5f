"""bench.py prints exactly one JSON line with the agreed keys (run on sf0.001, one timed run)."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

from conftest import SF0001

ROOT = Path(__file__).resolve().parent.parent


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_RUNS="1", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, str(ROOT / "bench.py")], env=env, capture_output=True, text=True,
                         timeout=900, check=True).stdout.strip().splitlines()
    assert len(out) == 1
    d = json.loads(out[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= d.keys()
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["value"] > 0
    assert "m27_weekly_trend" in d["queries"] and "adapter_materialize" in d["queries"]
