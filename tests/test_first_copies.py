"""First copies of ids that two folders have."""

import gzip
from pathlib import Path

from pyspark.sql import functions as F

from tillhouse.fixtures.views import Views


def test_first_copies_come_from_packed_files(spark, tmp_path):
    views = Views(spark, "/root/testdata/sf0.001")
    rows = views.first_copies(2)
    files = {f.removeprefix("file://").removeprefix("file:") for f in rows.inputFiles()}
    assert files and all(f.endswith(".csv.gz") and gzip.open(f).readline() for f in files)
    assert {Path(f).parent.name for f in files} == {"day=1", "day=2"}
    n = views.keys.select("transaction_id").distinct().count()
    assert rows.count() == 3 * n and rows.filter(F.col("customer_id") == "DAY-1").count() == n
