from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import edge_documents, empty_documents
from loomgrad.llm import decontamination, mixing
from oracle import differences

# --- op8 --------------------------------------------------------------------------------------


def test_mixture_equals_sql(spark, sf_dir):
    assert not differences(mixing.op8_raked_mixture(spark, sf_dir), sf_dir, mixing.OP8_SQL)


@pytest.mark.parametrize("one_partition_cells", [100_000, 0])
def test_expected_tokens_meet_given_targets(spark, sf_dir, monkeypatch, one_partition_cells):
    monkeypatch.setattr(mixing, "ONE_PARTITION_CELLS", one_partition_cells)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("source") == "src0", "a").otherwise("b"))
    targets = {"source": {"a": 3, "b": 1}, "language": {"en": 2, "de": 1, "fr": 1, "es": 1}, "topic": {"prose": 5, "noisy": 1, "loud": 1, "tabular": 1}}
    sweeps = 8 if one_partition_cells else 2
    rows = mixing.mixture(docs, targets, sweeps=sweeps).collect()
    total = sum(r["tokens"] * r["probability"] for r in rows)
    assert max(r["probability"] for r in rows) == pytest.approx(1.0)
    for margin, weights in list(targets.items())[0 if one_partition_cells else 2 :]:
        got = Counter()
        for r in rows:
            got[r[margin]] += r["tokens"] * r["probability"] / total
        for value, weight in weights.items():
            assert got[value] == pytest.approx(weight / sum(weights.values()), abs=1e-3)


def test_raking_has_converged_on_the_table(spark, sf_dir):
    """Expected tokens of the registered query meet the tempered shares of every margin."""
    rows = mixing.op8_raked_mixture(spark, sf_dir).collect()
    total = sum(r["tokens"] * r["probability"] for r in rows)
    for margin in mixing.MARGINS:
        held, got = Counter(), Counter()
        for r in rows:
            held[r[margin]] += r["tokens"]
            got[r[margin]] += r["tokens"] * r["probability"] / total
        tempered = {k: v**mixing.TEMPERATURE for k, v in held.items() if v}
        for k, v in tempered.items():
            assert got[k] == pytest.approx(v / sum(tempered.values()), abs=1e-3)


def test_values_without_a_target_are_not_sampled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixture(docs, {"language": {"en": 1}}).collect()
    assert {r["language"] for r in rows if r["sampled"]} == {"en"}


def test_mixture_edges(spark):
    docs = edge_documents(spark)
    rows = mixing.mixture(docs).collect()
    assert len(rows) == 14
    assert all(not r["sampled"] for r in rows if r["tokens"] == 0 and r["language"] == "(none)" and r["source"] == "(none)")
    assert mixing.mixture(empty_documents(spark)).count() == 0
    kept = mixing.sample_to_targets(docs)
    assert kept.columns == docs.columns and kept.count() <= 14


def test_a_rare_cell_does_not_set_the_total(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stray = docs.limit(1).select(
        *[F.lit(v).cast(docs.schema[c].dataType).alias(c) if (v := {"doc_id": -1, "text": "five words of a stray", "lang": "xx", "source": "stray"}.get(c)) else c for c in docs.columns]
    )
    tokens = lambda df: df.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    for temperature in (0.9, 0.7):
        for table in (docs, docs.unionByName(stray)):
            kept = mixing.sample_to_targets(table, temperature)
            assert tokens(kept) == pytest.approx(0.6 * tokens(table), rel=0.1)
    rows = docs.unionByName(stray).select(
        F.col("source"), F.col("lang").alias("language"), mixing.style_topic(F.col("text")).alias("topic"), mixing.word_count(F.col("text")).alias("tokens")
    ).fillna("(none)", ["source", "language"])
    cells = mixing.cell_probabilities(rows, temperature=0.7, kept_share=0.6).collect()
    whole = sum(c["cell_tokens"] for c in cells)
    assert sum(c["cell_tokens"] * c["probability"] for c in cells) == pytest.approx(0.6 * whole)
    assert [c["probability"] for c in cells if c["source"] == "stray"] == [1.0]
    assert all(c["unmet_tokens"] > 0 for c in cells if c["source"] == "stray")


# --- op9 --------------------------------------------------------------------------------------


def plain_matches(docs: list[tuple], items: list[tuple]) -> dict[tuple, float]:
    """BM25 of every passage against every entry, then overlap: (doc, item) -> best score."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    entries = []
    for item, text in items:
        q, a = decontamination.split_question(text)
        joined, n_q = words(q) + words(a), len(words(q))
        for at in range(0, len(joined), 64):
            part = joined[at : at + 64]
            if len(joined) >= 5 and len(part) >= 5:
                entries.append((item, part, max(0, min(n_q - at, len(part)))))
    df = Counter(w for _, p, _ in entries for w in set(p))
    mean = sum(len(p) for _, p, _ in entries) / len(entries)
    weights = []
    for _, part, _ in entries:
        tf = Counter(part)
        w = {t: math.log(1 + (len(entries) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(part) / mean)) for t, c in tf.items()}
        weights.append({t: x / sum(w.values()) for t, x in w.items()})
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(max(0, len(w) - 2))} or ({tuple(w)} if w else set())
    share = lambda want, there: len(want & there) / len(want) if want else 1.0
    found = {}
    for d, text in docs:
        all_words = words(text)
        for at in range(0, max(1, len(all_words) - 64), 64):
            passage = all_words[at : at + 128]
            have, there = set(passage), grams(passage)
            for (item, part, n_q), w in zip(entries, weights):
                score = sum(x for t, x in w.items() if t in have)
                if score >= 0.5 - 1e-9 and share(grams(part[:n_q]), there) >= 0.6 and share(grams(part[n_q:]), there) >= 0.6:
                    found[d, item] = max(found.get((d, item), 0), round(score, 6))
    return found


def test_decontamination_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = decontamination.op9_bm25_decontamination(spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in rows} == pytest.approx(plain_matches(docs, items), abs=2e-6)


@pytest.mark.parametrize("index_entries", [20_000, 6])
def test_search_finds_all_above_the_threshold(spark, monkeypatch, index_entries):
    monkeypatch.setattr(decontamination, "INDEX_ENTRIES", index_entries)  # 6: several indexes
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choice(vocabulary, size=n, p=np.arange(80, 0, -1) / 3240))
    items = [(i, text(int(rng.integers(3, 150)))) for i in range(20)]
    docs = []
    for d in range(60):
        words = text(int(rng.integers(0, 400))).split()
        if d % 3 == 0:  # an item, some of its words changed, somewhere in the text
            planted = items[d % 20][1].split()
            planted = [w if rng.random() > 0.04 else "other" for w in planted]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = planted
        docs.append((d, " ".join(words)))
    got = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == pytest.approx(plain_matches(docs, items), abs=2e-6)
    assert len(got) >= 10


def test_decontamination_edges(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame(
        [(1, "Quick brown fox jumps over the lazy dog"), (1, "Quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "one"), (None, "x y z")],
        "item_id long, text string",
    )
    got = decontamination.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1)}
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 11
    assert decontamination.contaminated(empty_documents(spark), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_short_items_match_if_asked_for(spark):
    items = spark.createDataFrame([(4, "one"), (5, "runs away"), (6, "brown")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(edge_documents(spark), items, least_words=1).collect()}
    assert got == {(8, 4), (1, 5), (2, 5), (1, 6), (2, 6), (-11, 6)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(edge_documents(spark), items, least_words=2).collect()} == {(1, 5), (2, 5)}


def test_question_and_answer_columns(spark):
    docs = spark.createDataFrame([(1, "what is the capital of france it is called paris by all of us"), (2, "what is the capital of france nobody knows it")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "What is the capital of France?", "It is called Paris by all.")], "item_id string, q string, a string")
    got = decontamination.contaminated(docs, items, question_col="q", answer_col="a").collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, "a")]


def test_answers_of_one_or_two_words_match(spark):
    docs = [(1, "we ask what is the capital city of france and it is paris for all of us"), (2, "what is the capital city of france nobody knows it")]
    items = [("a", "What is the capital city of France?", "Paris."), ("b", "What is the capital city of France?", "Is Paris."), ("c", "What is the capital city of France?", "Is Rome.")]
    long = [f"w{i}" for i in range(63)]
    docs.append((3, " ".join([*long, "one two three four five"])))
    items.append(("d", " ".join(long), "one two three four five"))
    got = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, q string, a string"), question_col="q", answer_col="a"
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, "a"), (1, "b"), (3, "d")]


def test_quotes_over_the_boundary_of_entries_match_and_short_tails_alone_do_not(spark):
    item = [f"w{i}" for i in range(133)]  # entries of 64, 64 and 5 words
    other = [f"x{i}" for i in range(60)]
    quotes = [[*other, *item[at : at + 64], *other] for at in range(0, 70)]
    docs = [(at, " ".join(q)) for at, q in enumerate(quotes)] + [(100, " ".join([*other, *item[129:], *other])), (101, " ".join([*other, *item[128:], *other]))]
    lone = "The question goes on for some more words than five here. The answer has these six words."
    docs.append((102, " ".join(other) + " the question goes on for some more words than five here the answer has other words"))
    got = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, lone)], "item_id long, text string")
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [*((at, 1) for at in range(70)), (102, 2)]
