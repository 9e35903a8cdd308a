from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from llm.helpers import documents, edge_documents, empty_documents
from loomgrad.llm import licenses, token_counts

# --- op5 --------------------------------------------------------------------------------------


def test_length_query_equals_counting_each_text(spark, sf_dir):
    encoding = token_counts.load_encoding(token_counts.VOCABULARY)
    lengths = [len(encoding.encode_ordinary(t)) for _, t in documents(spark, sf_dir)]
    rows = {r["tokens"]: r for r in token_counts.op5_length_histogram(spark, sf_dir).collect()}
    assert {k: r["documents"] for k, r in rows.items()} == Counter(lengths)
    for limit, r in rows.items():
        assert r["documents_longer"] == sum(n > limit for n in lengths)
        assert r["tokens_longer"] == sum(n for n in lengths if n > limit)
        assert r["tokens_within"] == sum(n for n in lengths if n <= limit)
        assert r["tokens_truncated"] == sum(min(n, limit) for n in lengths)
        assert (r["documents_total"], r["tokens_total"]) == (len(lengths), sum(lengths))
        assert r["quantile"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))


def test_quantile_lengths(spark):
    report = token_counts.context_report(spark.createDataFrame([(n, 1) for n in range(1, 101)], "tokens long, documents long"))
    assert {r["share"]: r["tokens"] for r in token_counts.quantile_lengths(report, (0.01, 0.5, 0.95)).collect()} == {0.01: 1, 0.5: 50, 0.95: 95}


def test_parts_of_a_long_text_add_up(spark, sf_dir):
    encoding = token_counts.load_encoding(token_counts.VOCABULARY)
    for _, text in documents(spark, sf_dir)[:150]:
        parts = list(token_counts.chunks(text, 40))
        assert "".join(parts) == text
        assert sum(len(encoding.encode_ordinary(p)) for p in parts) == len(encoding.encode_ordinary(text))


def test_length_edges(spark):
    rows = {r["tokens"]: r["documents"] for r in token_counts.length_histogram(edge_documents(spark)).collect()}
    assert sum(rows.values()) == 14 and rows[0] == 3
    assert token_counts.context_report(token_counts.length_histogram(empty_documents(spark))).count() == 0


# --- op4 --------------------------------------------------------------------------------------


def plain_dice(a: list[str], b: list[str]) -> float:
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def plain_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def plain_scan(text: str, notices: dict[str, list[str]], least: float) -> dict[str, float]:
    """Matches chosen among all windows of words and all templates, the best first, without overlap."""
    grams = list(zip(plain_words(text), plain_words(text)[1:]))
    found, order = [], {(x.licence, x.number): k for k, x in enumerate(licenses.load_templates(notices))}
    for licence, texts in notices.items():
        for number, template in enumerate(map(plain_words, texts)):
            there = Counter(zip(template, template[1:]))
            for i in range(len(grams)):
                if grams[i] not in there:
                    continue
                seen, shared = Counter(), 0
                for j in range(i, min(len(grams), i + 3 * there.total())):
                    shared += seen[grams[j]] < there[grams[j]]
                    seen[grams[j]] += 1
                    score = 2 * shared / (j - i + 1 + there.total())
                    if score >= least - 1e-9:
                        found.append((-score, i, j - i + 1, number, order[licence, number], licence))
    taken, out = set(), {}
    for score, i, size, *_, licence in sorted(found):
        words = set(range(i, i + size + 1))
        if not words & taken:
            taken |= words
            out.setdefault(licence, -score)
    return out


def test_a_notice_beside_a_similar_one_is_found():
    templates, mit = licenses.load_templates(licenses.NOTICES), licenses.NOTICES["MIT"][-1]
    words = licenses.NOTICES["MIT-0"][-1].split()
    for k in range(len(words) // 9):
        words[9 * k + 4] = f"changed{k}"
    altered = " ".join(words)
    alone = licenses.best_matches(altered, templates, 0.7)["MIT-0"][0]
    for text in (mit + " and besides " + altered, altered + " and besides " + mit):
        got = licenses.best_matches(text, templates, 0.7)
        assert got["MIT"][0] > 0.99 and got["MIT-0"][0] == pytest.approx(alone, abs=0.02)
        assert {k: v[0] for k, v in got.items()} == pytest.approx(plain_scan(text, licenses.NOTICES, 0.7))


@pytest.mark.parametrize("seed", range(4))
def test_matches_of_crowded_texts_equal_brute_force(seed):
    """Few words, so that templates overlap each other at every place."""
    rng = np.random.default_rng(seed)
    words = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "e"], size=n))
    notices = {"x": [words(6), words(4)], "y": [words(7)], "z": [words(5)]}
    templates = licenses.load_templates(notices)
    for _ in range(60):
        text = words(40)
        got = {k: v[0] for k, v in licenses.best_matches(text, templates, 0.7).items()}
        assert got == pytest.approx(plain_scan(text, notices, 0.7))


def test_licence_query_equals_brute_force(spark, sf_dir):
    got = {(r["doc_id"], r["licence"]): r["dice"] for r in licenses.op4_dice_licences(spark, sf_dir).collect()}
    docs = [(d, t) for d, t in documents(spark, sf_dir) if len(t) < 30_000]
    ids = {d for d, _ in docs}
    want = {(d, k): v for d, t in docs for k, v in plain_scan(t, licenses.NOTICES, 0.8).items()}
    assert {k: v for k, v in got.items() if k[0] in ids} == pytest.approx(want, abs=1e-6) and want


@pytest.mark.parametrize("licence", sorted(licenses.NOTICES))
def test_every_template_is_found_inside_sentences_and_altered(licence):
    templates = licenses.load_templates(licenses.NOTICES)
    for text in licenses.NOTICES[licence]:
        words = text.split()
        for k in range(len(words) // 15):  # some words changed
            words[15 * k + 7] = "changed"
        around = "and so the author of this said to " + " ".join(words) + " which is to be read with what follows in the text"
        got = licenses.best_matches(around, templates, 0.8)
        assert {k: v[0] for k, v in got.items()} == pytest.approx(plain_scan(around, licenses.NOTICES, 0.8))
        assert licence in got or len(text.split()) < 20


def test_licence_lines_of_the_whole_table_are_found(spark, sf_dir):
    got = {(r["doc_id"], r["licence"]) for r in licenses.op4_dice_licences(spark, sf_dir).collect()}
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "All rights reserved.": "all-rights-reserved",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    }
    planted = {(d, name) for d, t in documents(spark, sf_dir) for line in t.split("\n") if (name := lines.get(line))}
    assert planted and planted <= got


def test_altered_and_wrapped_full_texts_are_found():
    text = licenses.NOTICES["MIT"][-1].replace("Software", "Program", 2)
    wrapped = "Preface of mine.\n" + re.sub(r"(.{60}\S*) ", r"\1\n", text) + "\nAnd an end of it."
    found = licenses.best_matches(wrapped, licenses.load_templates(licenses.NOTICES), 0.8)
    assert found["MIT"][0] > 0.9 and set(found) == {"MIT"}
    assert licenses.best_matches("the terms of this work are of the author", licenses.load_templates(licenses.NOTICES), 0.8) == {}


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_size_bounds_are_tight(least):
    for size in range(1, 60):
        low, high = licenses.size_bounds(size, least)
        for other in range(1, 250):
            reachable = 2 * min(size, other) / (size + other) >= least - 1e-12
            assert reachable == (low <= other <= high)


def test_licence_edges(spark):
    docs = edge_documents(spark)
    own = {"a": ["the quick brown fox jumps over the lazy dog and runs away", ""], "b": ["one"]}
    rows = licenses.scan_licences(docs, own).collect()
    assert sorted((r["doc_id"], r["licence"], r["dice"], r["start_word"], r["end_word"]) for r in rows) == [
        (1, "a", 1.0, 0, 12),
        (2, "a", 1.0, 0, 12),
        (2, "a", 1.0, 0, 12),
    ]
    assert licenses.scan_licences(docs, {"b": ["one"]}).count() == 0
    assert licenses.scan_licences(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licences(docs, own, 0.0)
