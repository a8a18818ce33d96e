"""Files that tasks write: few folders, one file for each row, also where rows share an id."""

import os

from duck import connect, same
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spindrift.plans import sources
from spindrift.sources import scan

D = "/root/testdata/sf0.001"


def test_rows_that_share_an_id(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in os.listdir(D):
        if t.endswith(".parquet") and t != "documents.parquet":
            os.symlink(f"{D}/{t}", f"{tmp_path}/{t}")
    same(entry.queries()["src_01_09_scan"](spark, str(tmp_path)), connect(str(tmp_path)), entry.oracle_sql()["src_01_09_scan"])


def test_no_folder_for_each_file(spark, monkeypatch):
    roots = []
    monkeypatch.setattr(scan, "scan", lambda s, root, f=scan.scan: roots.append(root) or f(s, root))
    n = entry.queries()["src_01_09_scan"](spark, D).count()
    folders = [x for x in os.listdir(roots[0].removeprefix("file:")) if not x.startswith((".", "_"))]
    assert n == spark.read.parquet(f"{D}/documents.parquet").count()
    assert len(folders) <= n // sources.FILES + spark.sparkContext.defaultParallelism
