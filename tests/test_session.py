"""Intermediate data goes when the driver ends, also after a stop."""

import subprocess
import sys
from pathlib import Path

import pytest

DRIVER = """
from millrace.session import scratch, session, stored
from millrace.sources import files
spark = session("short", "local[1]", **{{"spark.checkpoint.dir": "{shared}", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": "{shared}-warehouse"}})
t = stored(spark.range(10))
files.write_bucketed(spark.range(10), ["id"], 2)
assert t.count() == 10 and "{shared}/millrace-" in t.inputFiles()[0]
{end}
"""


@pytest.mark.parametrize("end", ["spark.stop()", "", "import os; os._exit(1)"])
def test_nothing_stays_behind(tmp_path, end):
    shared = tmp_path / "shared"
    shared.mkdir()
    code = subprocess.run([sys.executable, "-c", DRIVER.format(shared=shared, end=end)], cwd=Path(__file__).parents[1], timeout=120, capture_output=True)
    assert code.returncode == (1 if "_exit" in end else 0), code.stderr[-500:]
    for _ in range(60):  # the JVM ends after the driver's Python
        if not [f for f in shared.rglob("*") if f.is_file()]:
            break
        __import__("time").sleep(0.5)
    assert [f for f in shared.rglob("*") if f.is_file()] == []
