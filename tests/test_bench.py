"""bench.py keeps its contract: one JSON line with the expected keys."""

import json
import os
import subprocess
import sys

from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": SF_SMALL, "BENCH_CPUS": "2"}
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, cwd="/tmp",
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["metric"] == "total_sec" and d["value"] > 0
    assert {"ingest_variant", "search_variant_q1", "count_all_pairwise", "report"} <= set(d["queries"])
    # every layout finds the same Q1/Q2/Q5/Q6 hits
    for q in ("q1", "q2", "q5", "q6"):
        assert len({v for k, v in d["hits"].items() if k.endswith(q)}) == 1, q
