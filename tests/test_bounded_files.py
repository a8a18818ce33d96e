"""Source files of the code queries are bounded, batches are small, and what spans files of a brand is still found."""

import pytest
from duck import connect, same

import __spark_entry__ as entry
from spindrift.plans import code
from spindrift.sources.parsers import table

D = "/root/testdata/sf0.001"
QUERIES = "hlp_08_parse_summary par_01_08_symbols udf_01_parse_code par_01_08_calls par_04_receiver_calls par_10_java_outline par_11_12_symbol_edges par_13_imported_files par_14_imported_names".split()


def test_files_hold_a_bounded_number_of_parts(spark, tmp_path):
    """Ten times the parts give more files, no longer ones."""
    parts = spark.range(20_000).selectExpr("id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'ECONOMY' AS p_type", "1 AS p_size")
    for n in (2_000, 20_000):
        parts.where(f"p_partkey < {n}").write.parquet(f"{tmp_path}/{n}/part.parquet")
        spark.read.parquet(f"{D}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
    longest = [code._sources(spark, f"{tmp_path}/{n}").selectExpr("max(length(content))").first()[0] for n in (2_000, 20_000)]
    assert longest[1] < 3 * longest[0]


@pytest.mark.parametrize("name", QUERIES)
def test_many_files_of_a_brand(spark, monkeypatch, name):
    monkeypatch.setattr(code, "PARTS", 40)
    same(entry.queries()[name](spark, D), connect(D), entry.oracle_sql()[name])


def test_batches_are_bounded(spark):
    """Rows of a long file come in slices."""
    rows = ({"record": "symbol", "path": "a", "source_code": "x" * 1000} for _ in range(10_000))
    batches = list(table._in_slices(rows, table.SCHEMA))
    assert sum(b.num_rows for b in batches) == 10_000
    assert max(b.num_rows for b in batches) <= table.ROWS_AT_ONCE


def test_sites_meet_the_innermost_scope(spark):
    """As the plain join of all scopes of a name around a site gives it."""
    row = "record string, path string, language string, pos int, caller string, callee string, name string, line_start int, is_resolved boolean, scope_start int, scope_end int"
    scopes = [("variable", "p", "java", None, None, f"T{s}_{e}", "h", None, None, s, e) for s, e in ((0, 100), (5, 20), (7, 8), (8, 16), (30, 64), (31, 63), (64, 65), (70, 70))]
    sites = [("site", "p", "java", at, "c", "h", "m", 1, False, None, None) for at in range(110)]
    got = {r["at"]: r["type"] for r in table.receiver_types(spark.createDataFrame(scopes + sites, row)).collect()}
    want = {}
    for at in range(110):
        around = [(v[9], v[5]) for v in scopes if v[9] <= at < v[10]]
        if around:
            want[at] = max(around)[1]
    assert got == want
