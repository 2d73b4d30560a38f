"""Queries with Python functions run where only the driver can import the package, as on a cluster."""

import subprocess
import sys
from pathlib import Path



ROOT = Path(__file__).resolve().parents[1]
NAMES = ["counter_viterbi", "mask_boxes", "stream_open_hits", "detect_ocr_log", "windows_table_function", "fuzzy_needles", "clutch_fsm", "pcm_levels", "distinct_games", "shape_clusters", "stream_log_tracks", "stream_shapes", "choice_learner", "slot_plan", "merging_table_function", "log_folder", "learned_digits", "library_preference", "longest_streak"]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from momentis.plans import registry
from momentis.session import build_session
spark = build_session(2, "bare")
spark.sparkContext.setLogLevel("ERROR")
for name in {names!r}:
    print(name, registry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_executors_get_the_package(tmp_path):
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable}
    import os

    env |= {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "SPARK", "LD_", "PYENV"))}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), names=NAMES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500)
    rows = dict(line.rsplit(" ", 1) for line in done.stdout.splitlines() if line.split(" ")[0] in NAMES)
    assert set(rows) == set(NAMES), done.stderr[-3000:]
    assert all(int(n) > 0 for n in rows.values())
