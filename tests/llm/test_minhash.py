"""MinHash near-duplicates against all pairs of full shingle sets."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.helpers import documents, edge_documents, empty_documents
from loomgrad.llm import exact_links, licenses, minhash, simhash, substring_dedup


def plain_set(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {" ".join(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {" ".join(words)} if words else set()


def plain_components(docs: list[tuple[int, str]]) -> dict[int, tuple[int, int, bool]]:
    """By all pairs that share a shingle."""
    sets, holders, parent = {d: plain_set(t) for d, t in docs}, defaultdict(list), {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared: Counter = Counter()
    for found in holders.values():
        shared.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def as_dict(df) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_all_pairs(spark, sf_dir):
    assert as_dict(minhash.op12_minhash_inverted_join(spark, sf_dir)) == plain_components(documents(spark, sf_dir))


def variants(seed: int, n: int, families: int) -> list[tuple[int, str]]:
    """Families of edited copies, most of whose pairs lie around the threshold, and lone texts."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(families):
        words = [f"w{i}" for i in rng.integers(0, 50_000, size=int(rng.integers(30, 200)))]
        for _ in range(n):
            b = list(words)
            for i in rng.choice(len(b), size=int(rng.integers(0, 5)), replace=False):
                b[i] = f"c{rng.integers(0, 50_000)}"
            out.append(" ".join(b))
    out += [" ".join(f"w{i}" for i in rng.integers(0, 50_000, size=50)) for _ in range(100)]
    return list(enumerate(out))


@pytest.mark.parametrize("anchor_rows,block_sets,block_members", [(4096, 1024, 500_000), (7, 9, 500_000), (7, 1024, 700)])
def test_families_equal_all_pairs(spark, monkeypatch, anchor_rows, block_sets, block_members):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", anchor_rows)  # 7: posting lists become grids
    monkeypatch.setattr(exact_links, "BLOCK_SETS", block_sets)  # 9: clusters too
    monkeypatch.setattr(exact_links, "BLOCK_MEMBERS", block_members)
    docs = variants(3, 40, 12)
    want = plain_components(docs)
    assert 20 < len({c for _, c, _ in want.values()}) < len(docs) - 50
    assert as_dict(minhash.minhash_components(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_pairs_at_the_threshold_meet(spark):
    """Pairs of exactly 0.8 share a posting list and enough coordinates."""
    rng, sets = np.random.default_rng(5), []
    for _ in range(3000):
        whole = rng.integers(0, 2**63, size=100, dtype=np.uint64)
        sets += [whole[:90], whole[10:]]
    values = np.stack([minhash.signature(s) for s in sets])
    low = (values & 255).astype(np.uint8).view(np.uint64)
    apart = minhash.mismatches(low[::2], low[1::2])
    assert (apart <= minhash.COORDINATES - minhash.LEAST_MATCHES).all()
    assert abs(apart.mean() / minhash.COORDINATES - 0.2) < 0.01
    heavy = np.sort(minhash._elements(values.view(np.int64))[:, 3])[:2000]
    lists, _, row = minhash.posting_entries(heavy)(values.view(np.int64))
    of = [set() for _ in sets]
    for x, r in zip(lists.tolist(), row.tolist(), strict=True):
        of[r].add(x)
    assert all(of[i] & of[i + 1] for i in range(0, len(sets), 2))


@pytest.mark.parametrize("sided", [False, True])
def test_forests_connect_what_all_pairs_connect(sided):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 400, size=(4, 60))
    sets = [np.unique(np.concatenate([b, rng.integers(0, 400, size=rng.integers(0, 12))])) for b in base for _ in range(30)]
    sets += [np.empty(0, dtype=np.int64)] * 2
    side = rng.integers(0, 2, size=len(sets)) if sided else None
    links = exact_links.similar_forest(sets, (4, 5), side)
    parts = [list(range(len(sets))) for _ in range(2)]
    every = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if (side is None or side[i] != side[j]) and (n := len(np.intersect1d(sets[i], sets[j]))) and 5 * n >= 4 * len(np.union1d(sets[i], sets[j]))
    ]
    for part, found in zip(parts, (links, every), strict=True):
        for a, b in found:
            x, y = part[a], part[b]
            part[:] = [min(x, y) if p in (x, y) else p for p in part]
    assert parts[0] == parts[1] and len(links) < len(sets) < len(every)


def test_edges(spark):
    got = minhash.minhash_components(edge_documents(spark)).collect()
    assert len(got) == 14
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == {(9, 1, True)} and by[2] == {(9, 1, False)}
    assert by[3] == {(0, 3, True)} and by[4] == {(0, 4, True)} and by[5] == {(0, 5, True)}
    assert by[6] == {(5, 6, True)} and by[7] == {(5, 6, False)} and by[8] == {(1, 8, True)}
    assert {(c, k) for _, c, k in by[None]} == {(None, True)}
    assert minhash.minhash_components(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        minhash.minhash_components(edge_documents(spark), share=(1, 2))


def test_very_long_texts(spark):
    """Texts of 4 MB: near copies are linked, and a passage that comes again in one is removed."""
    rng = np.random.default_rng(24)
    words = [f"w{i}" for i in rng.integers(0, 10**7, size=450_000)]
    other = list(words)
    for i in range(0, len(other), 400):
        other[i] = "changed"
    passage = [f"p{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(f"v{i}" for i in range(450_000))), (4, " ".join([*passage, *(f"u{i}" for i in range(400_000)), *passage]))]
    assert min(len(t) for _, t in docs) > 2_500_000
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {d: v[1:] for d, v in as_dict(minhash.minhash_components(table)).items()} == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
    assert {r["doc_id"] for r in simhash.keep_one_per_component(table).select("doc_id").collect()} == {1, 3, 4}
    removed = substring_dedup.remove_repeated_windows(table.filter("doc_id > 2")).select("doc_id", "n_words", "n_removed", "removed_spans").collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], [tuple(s) for s in r["removed_spans"]]) for r in removed} == {
        3: (450_000, 0, []),
        4: (400_120, 60, [(400_060, 400_120)]),
    }
    assert licenses.scan_licences(spark.createDataFrame([(1, docs[2][1] + " Released under the MIT License. " + docs[2][1])], "doc_id long, text string")).first()["licence"] == "MIT"
