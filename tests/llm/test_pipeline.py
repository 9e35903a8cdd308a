"""The corpus pipeline stage by stage against plain Python, and the corpus queries' registration."""

from __future__ import annotations

import __spark_entry__
import corpus_pipeline
from llm.helpers import documents, edge_documents
from loomgrad.llm import decontamination, language_id, mixing, registry, simhash


def test_every_operator_is_registered():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert {"pipeline", *names} <= set(__spark_entry__.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stages_keep_the_columns_and_work_on_what_is_left(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(documents(spark, sf_dir))
    ids = set(texts)
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        rows = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(rows) == len(set(rows)) and set(rows) <= ids
        sizes[name] = len(rows)
        if name == "sharding":
            assert set(rows) == ids and {r["shard"] for r in out.select("shard").distinct().collect()} == set(range(40))
            break
        assert out.columns == docs.columns
        if name == "language_id":
            assert ids - set(rows) == {d for d in ids if not any(c.isalpha() for c in texts[d])}
        if name == "near_dedup":
            kept_texts = [texts[d].split() for d in rows]
            assert len({tuple(t) for t in kept_texts}) == len(kept_texts)  # no exact copies are left
            by_text = {}
            for d in sorted(ids):
                by_text.setdefault(tuple(texts[d].split()), d)
            assert all(by_text[tuple(texts[d].split())] == d for d in rows)
        if name == "decontamination":
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            holds = lambda d: any(item in " ".join(texts[d].split()) for item in items)
            assert not any(holds(d) for d in rows) and not any(not holds(d) for d in ids - set(rows))
        docs, ids = out, set(rows)
    assert sizes["mixing"] > 0.3 * sizes["decontamination"]


def test_run_gives_what_the_stages_give(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    again = {r["doc_id"]: r["shard"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {r["doc_id"]: r["shard"] for r in rows.collect()} == again


def test_filters_keep_extra_columns_with_the_names_that_they_use(spark, sf_dir):
    docs = edge_documents(spark)
    for column in ("_language", "_kept_id", "_contaminated_id", "_mix_source", "h", "shard"):
        docs = docs.withColumn(column, docs["n_chars"])
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for out in (
        language_id.reject_undetermined(docs, {"en": ["th", "e"]}),
        simhash.keep_one_per_component(docs),
        decontamination.drop_contaminated(docs, items),
        mixing.sample_to_targets(docs),
    ):
        assert out.columns == docs.columns
        out.collect()
