"""Run queries in a process of its own, from a folder that doesn't hold the package, so that workers find it only if it was sent to them."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import json, sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
q = e.queries()
print("GOT " + json.dumps({{n: len(q[n](spark, {sf!r}).collect()) for n in {names!r}}}))
"""


def counts(names: list[str], sf: str, folder: Path) -> dict[str, int]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=str(Path(__file__).resolve().parent.parent), sf=sf, names=names)
    out = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    said = [x for x in out.stdout.splitlines() if x.startswith("GOT ")]
    assert said, out.stderr[-3000:]
    return json.loads(said[0][4:])
