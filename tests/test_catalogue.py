"""The catalogue loads without any file or JVM access."""

import subprocess
import sys

from data_paths import ROOT

CODE = """
import builtins, io, pathlib, zipfile
import pyspark.sql, pyspark.sql.functions, pyspark.sql.types

def refuse(*a, **k):
    raise OSError("no I/O while the catalogue loads")

zipfile.ZipFile = refuse
pathlib.Path.glob = refuse
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert len(q) >= 100 and set(s) <= set(q), (len(q), len(s))
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
print("loaded", len(q))
"""


def test_catalogue_needs_no_jar_and_no_jvm():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "loaded" in done.stdout
