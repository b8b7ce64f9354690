"""A session whose cluster names no shared folder: the warehouse serves, and nothing is set afterwards."""

import os
import subprocess
import sys
import time
from pathlib import Path

CODE = """
from gleanmill.session import build_session, scratch_folder, shared_folder
spark = build_session("bare", "local[1]", spark__ui__enabled="false", spark__sql__warehouse__dir=%r)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark) and shared_folder(spark).endswith("gleanmill-shared")
place = scratch_folder(spark, "x")
spark.range(3).write.parquet(place)
assert spark.read.parquet(place).count() == 3
spark.stop()
"""


def test_without_spark_defaults(tmp_path):
    (tmp_path / "conf").mkdir()
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path / "conf")}
    subprocess.run([sys.executable, "-c", CODE % str(tmp_path / "house")], check=True, env=env, cwd=Path(__file__).resolve().parents[1], timeout=120)
    late = time.time() + 30  # the JVM ends a moment after Python
    while (left := list((tmp_path / "house" / "gleanmill-shared").glob("x-*"))) and time.time() < late:
        time.sleep(0.5)
    assert not left
