import hashlib
import re

import numpy as np
from conftest_llm import in_order, pairs, prose
from test_exact_dedup import brute as exact
from test_near_dedup import brute as near

import corpus_pipeline
from spindrift.llm import decontaminate, toxicity
from spindrift.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage keeps what a plain version of its contract keeps of its own input; the last one tokenises it."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SF).toPandas(), before.schema if name != "bpe" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        if name == "bpe":
            break
        assert docs.columns == columns
        kept = sorted(r["doc_id"] for r in docs.collect())
        rows = pairs(before)
        if name == "toxicity":
            machine = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = [i for i, t in rows if machine.score(t.encode()) < 0.3]
        elif name == "exact_dedup":
            want = [r[0] for r in exact(rows) if r[3]]
        elif name == "near_dedup":
            want = [r[0] for r in near(rows) if r[3]]
        else:
            windows = set()
            for r in items.collect():
                w = decontaminate.words(r["text"].encode())
                windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
            want = []
            for i, t in rows:
                w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
                hit = {k for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for k in range(s, s + n)}
                if not hit or 20 * len(hit) < len(w):
                    want.append(i)
        assert kept == sorted(want), name
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer_path())
    want = [(i, hashlib.sha256(np.array(known.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t in pairs(before)]
    assert in_order((r["doc_id"], r["ids_sha256"]) for r in docs.collect()) == in_order(want)


def test_odd_and_empty_inputs(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count()
        if name != "bpe":
            assert out.columns == odd.columns
        assert stage(spark, empty, SF).count() == 0


def test_null_and_shared_ids_drop_only_the_bad_row(spark):
    """One copy, near copy or contaminated text among clean rows with its id, or without one, takes none of them along."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]
    base = prose(1, 120)
    near = " ".join([*base.split(" ")[:-1], "changed"])
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = lambda df: in_order((r["doc_id"], r["text"]) for r in df.collect())
    for i in (None, 7):
        clean = [(i, prose(20 + k, 80), "en") for k in range(4)]
        one = [(1, base, "en")]
        for stage, bad in ((corpus_pipeline.drop_exact_copies, base), (corpus_pipeline.drop_near_copies, near), (corpus_pipeline.drop_contaminated, item)):
            out = stage(spark, docs([*one, *clean, (i, bad, "en")]), SF)
            assert out.columns == ["doc_id", "text", "lang"]
            assert kept(out) == in_order(r[:2] for r in [*one, *clean]), (i, stage.__name__)
        # Copies of each other that share an id or have none: one stays.
        twice = docs([*clean, (i, base, "en"), (i, base, "en")])
        assert kept(corpus_pipeline.drop_exact_copies(spark, twice, SF)) == in_order([*(r[:2] for r in clean), (i, base)])
        assert len(kept(corpus_pipeline.drop_near_copies(spark, docs([*clean, (i, base, "en"), (i, near, "en")]), SF))) == 5


def test_columns_with_the_names_that_stages_use(spark):
    """Columns that are called as the stages call their own come through, values and all."""
    text = prose(1, 60)
    rows = [(1, text, 5, "a", 0.5, "x"), (2, text, 6, "b", 1.5, "y"), (None, prose(2, 60), 7, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long, `row` string, `group` double, `_ROW_` string")
    for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_contaminated):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        want = rows if stage is corpus_pipeline.drop_contaminated else [rows[0], rows[2]]
        assert in_order(tuple(r) for r in out.collect()) == in_order(want)
