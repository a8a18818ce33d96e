"""Queries without SQL read their whole input."""

from spindrift.plans import catalogue, views

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def test_dependency_first_order_on_all_calls(spark):
    """Each node of the calls once, in one group a component, after all that it calls and that does not lead back to it."""
    calls = {(r["src"], r["dst"]) for r in views.calls(spark, SF).collect()}
    nodes = {n for e in calls for n in e}

    def closure(edges):
        after = {n: set() for n in nodes}
        for a, b in edges:
            after[a].add(b)
        out = {}
        for n in nodes:
            seen, todo = {n}, [n]
            while todo:
                new = after[todo.pop()] - seen
                seen |= new
                todo += new
            out[n] = seen
        return out

    reach, around = closure(calls), closure(calls | {(b, a) for a, b in calls})
    rows = QUERIES["grf_04_dependency_first_order"](spark, SF).collect()
    assert sorted(r["node"] for r in rows) == sorted(nodes)
    assert all(r["graph"] == min(around[r["node"]]) for r in rows)
    place = {r["node"]: r["position"] for r in rows}
    assert all(place[b] < place[a] for a, b in calls if a not in reach[b] or a < b)


def test_expand_view_reads_every_document(spark, tmp_path):
    rows = [(i, "\n".join(f"line {k} of {i}" for k in range(12))) for i in range(1, 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["win_10_expand_view"](spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(range(1, 8))
