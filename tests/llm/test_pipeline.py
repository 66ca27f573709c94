import os
import sys

import numpy as np

import corpus_pipeline as pipeline
from keelstone.llm import quality_model, queries, secrets
from keelstone.llm.pii import mask
from keelstone.llm.tokens import Encoder
from tests.llm.test_licenses_warc_decontaminate import brute_hits
from tests.llm.test_packing_chat import best_fit
from tests.llm.test_similar import brute_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_equals_brute_force(spark, sf, docs):
    rows = {r.doc_id: r for r in docs.collect()}
    table = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {i for i, r in rows.items() if quality_model.score(table, [r.text])[0] >= 0.5}
    single = brute_kept([(i, rows[i].text) for i in sorted(good)])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in single if not brute_hits(rows[i].text, items)[1]}
    net = secrets.trained()
    texts = {i: mask(rows[i].text, [s[:3] for s in secrets.find_all(net, [rows[i].text])[0]], "[SECRET]") for i in clean}
    encode = Encoder(queries.vocabulary())
    sizes = {i: len(encode(t)) + 1 for i, t in texts.items()}
    got = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == clean and len(rows) > len(good) > len(single) > len(clean)
    total: dict[int, int] = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes
    assert len({r.sequence_id for r in got}) == len(best_fit([r.length for r in got], 2048))


def test_stages_keep_columns_and_take_edges(spark, sf, edge, none, docs):
    for table in (edge, none):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, table, sf).columns == table.columns
        assert pipeline.STAGES[-1][1](spark, table, sf).count() >= table.count()
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == COLUMNS


def core_only(entry):
    names = set(entry.queries())
    return names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)


def test_the_rest_does_without(monkeypatch):
    """The entry module adds the optional parts only if they can be imported: not without them, and
    not where something that they need is missing."""
    import __spark_entry__ as entry

    assert {"pipeline", "op5_simhash_near_dedup"} <= set(entry.queries())
    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("keelstone.llm") or k == "corpus_pipeline"}
    try:
        for absent in ("keelstone.llm", "public_tokenizers"):
            with monkeypatch.context() as m:
                m.setitem(sys.modules, absent, None)
                assert core_only(entry) and set(entry.oracle_sql()) <= set(entry.queries())
            for k in [k for k in sys.modules if k.startswith("keelstone.llm") or k == "corpus_pipeline"]:
                del sys.modules[k]
    finally:
        sys.modules.update(held)


def test_stages_leave_only_their_last_result(spark, sf):
    """run() deletes what its stages stored, but for what the last one still reads."""
    from keelstone.session import clean, shared_dir

    there = lambda: set(os.listdir(shared_dir(spark).removeprefix("file:")))
    before = there()
    assert pipeline.run(spark, sf).count()
    names = {n.rsplit("-", 1)[0] for n in there() - before}
    assert {n for n in names if n.startswith("stage-")} == {"stage-secrets"} and "sketches" not in names
    clean(spark)
    assert not there() - before


def test_scores_are_chances():
    assert np.all((0 <= quality_model.score(np.ones(quality_model.BUCKETS, np.float32), ["", None, "x y"])) <= 1)
