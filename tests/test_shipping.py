"""The package used from another folder: kernels need it on the workers."""

import os
import subprocess
import sys
import zipfile

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from lendframe.session import local_session, ship
spark = local_session(2)
archive = ship(spark)
sys.path.remove({root!r})
from pyspark.sql import functions as F
from lendframe.operators.bootstrap import bootstrap_ci
rows = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 17 / 17.0).alias("p"))
low_high = bootstrap_ci(rows, "id", "y", "p", n_boot=20).collect()
print("ROWS", len(low_high), archive)
"""


def test_a_session_started_elsewhere_ships_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    line = next(x for x in done.stdout.splitlines() if x.startswith("ROWS"))
    assert int(line.split()[1]) > 0
    names = zipfile.ZipFile(line.split()[2]).namelist()
    assert "lendframe/session.py" in names and "lendframe/operators/bootstrap.py" in names
