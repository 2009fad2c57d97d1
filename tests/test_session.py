"""The shared folder of a session, with and without its setting."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: A session of its own in a process of its own: settings of the tests' session are fixed.
STASH = """
from quern.session import local_session, stash, work_dir, discard
spark = local_session(1, 1)
assert spark.conf.get("spark.checkpoint.dir", None) == {setting}, spark.conf.get("spark.checkpoint.dir", None)
kept = stash(spark.range(5), "numbers")
assert kept.count() == 5 and work_dir(spark) == work_dir(spark.newSession())
assert kept._stashed_at.startswith(work_dir(spark) + "/numbers-")
discard(kept)
print("at", work_dir(spark))
"""


@pytest.mark.parametrize("named", [False, True])
def test_stash_in_a_stock_session(tmp_path, named):
    (tmp_path / "conf").mkdir()
    shared = f"file://{tmp_path}/shared"
    if named:
        (tmp_path / "conf" / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {shared}\n")
    env = {k: v for k, v in os.environ.items() if k != "PYSPARK_SUBMIT_ARGS"} | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": ROOT}
    code = STASH.format(setting=repr(shared) if named else "None")
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1].startswith(f"at {shared}" if named else "at file:///")
