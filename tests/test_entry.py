import __spark_entry__ as entry


def test_names_and_smoke(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(entry.entry(spark).collect()) == 1


def test_library_does_not_import_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "spindrift"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "spindrift.llm" not in path.read_text(), path
