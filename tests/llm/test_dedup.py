from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm.helpers import documents, edge_documents, empty_documents
from loomgrad.llm import common, components, exact_dedup, sharding, simhash, substring_dedup
from oracle import differences


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# --- op6 --------------------------------------------------------------------------------------


def test_exact_dedup_equals_sql(spark, sf_dir):
    assert not differences(exact_dedup.op6_exact_dedup(spark, sf_dir), sf_dir, exact_dedup.OP6_SQL)


def test_exact_dedup_with_colliding_hashes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weak = exact_dedup.exact_duplicates(docs, content_hash=lambda c: F.length(c) % 7)
    assert not differences(weak, sf_dir, exact_dedup.OP6_SQL)


def test_exact_dedup_edges(spark):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_duplicates(edge_documents(spark)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[3, empty]["group_size"] == 4
    assert got[4, empty]["keep_id"] == 5 and got[5, empty]["kept"]  # the longest original of the empty ones
    assert not got[None, empty]["kept"]
    assert [r["group_size"] for k, r in got.items() if k[0] in (6, 7)] == [2, 2]
    assert exact_dedup.exact_duplicates(empty_documents(spark)).count() == 0


# --- op1 --------------------------------------------------------------------------------------


def plain_longest_first(sizes: list[int], n: int) -> list[int]:
    heap = [(0, s) for s in range(n)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_exact_dedup_with_and_without_a_broadcast(spark, monkeypatch, rows):
    monkeypatch.setattr(exact_dedup, "broadcast_if_small", lambda df: common.broadcast_if_small(df, rows))
    docs = [(i, "same  text" if i % 3 else f"text {i // 2}", None) for i in range(50)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string, h string")).collect()}
    assert got == {i: (1, 33, i == 1) if i % 3 else (i, 1, True) for i in range(50)}


@pytest.mark.parametrize("seed", range(6))
def test_plan_has_the_loads_of_a_plain_heap(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(17, 60 if seed % 2 else 6000, size=3000).tolist() + ([200_000] if seed == 3 else [])
    classes = Counter(sizes)
    plan = sharding.plan_longest_first(np.array(list(classes)), np.array(list(classes.values())), 40)
    rows = list(zip(*(x.tolist() for x in plan)))
    loads = [0] * 40
    for at, (key, start, s) in enumerate(rows):
        end = rows[at + 1][1] if at + 1 < len(rows) and rows[at + 1][0] == key else classes[key]
        loads[s] += key * (end - start)
    assert sorted(loads) == plain_longest_first(sizes, 40)


def test_sharding_query(spark, sf_dir):
    texts = dict(documents(spark, sf_dir))
    rows = sharding.op1_lpt_sharding(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text, slots, loads, groups = defaultdict(set), defaultdict(list), Counter(), Counter()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        by_text[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        groups[texts[r["doc_id"]]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads.values()) == plain_longest_first(list(groups.values()), 40)


def test_sharding_edges(spark):
    rows = sharding.shard_by_size(edge_documents(spark), 3).collect()
    assert len(rows) == 14
    assert len({r["shard"] for r in rows if r["size"] == 16}) == 1
    assert sharding.shard_by_size(empty_documents(spark), 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_size(edge_documents(spark), 0)


def test_sharding_does_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (
        sorted(tuple(r) for r in sharding.shard_by_size(docs.repartition(n), 7).select("doc_id", "shard", "slot").collect())
        for n in (1, 13)
    )
    assert a == b


# --- op2 --------------------------------------------------------------------------------------


def plain_fingerprint(text: str, k: int) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_all_pairs(spark, sf_dir):
    prints = {d: plain_fingerprint(t, 4) for d, t in documents(spark, sf_dir)}
    distinct = np.array(sorted(set(prints.values())), dtype=np.uint64)
    parent = {int(x): int(x) for x in distinct}
    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :][np.bitwise_count(distinct[i + 1 :] ^ x) <= 4]:
            parent[find(parent, int(x))] = find(parent, int(y))
    least = {}
    for d, p in prints.items():
        root = find(parent, p)
        least[root] = min(least.get(root, d), d)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash_anchor_cover(spark, sf_dir).collect()}
    assert got == {d: (f"{p:016x}", least[find(parent, p)]) for d, p in prints.items()}


def planted_prints(seed: int, n: int) -> np.ndarray:
    """Random fingerprints, dense clumps and chains of small steps."""
    rng = np.random.default_rng(seed)
    out = [rng.integers(0, 2**64, size=n, dtype=np.uint64)]
    for centre in rng.integers(0, 2**64, size=4, dtype=np.uint64):
        for _ in range(n // 8):
            x = int(centre)
            for b in rng.choice(64, size=int(rng.integers(1, 7)), replace=False):
                x ^= 1 << int(b)
            out.append(np.array([x], dtype=np.uint64))
    return np.unique(np.concatenate(out))


def classes_of(links, nodes):
    parent = {int(x): int(x) for x in nodes}
    for u, v in links:
        parent[find(parent, u)] = find(parent, v)
    groups = defaultdict(set)
    for x in parent:
        groups[find(parent, x)].add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("anchor_rows,broadcast", [(4096, 100_000), (7, 100_000), (7, 0)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, anchor_rows, broadcast):
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", anchor_rows)  # 7: nearly every anchor becomes a grid
    monkeypatch.setattr(simhash, "HOT_BROADCAST", broadcast)  # 0: joined instead
    prints = planted_prints(1, 400)
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "f0 long")
    rows = simhash.fingerprint_links(table).collect()
    links = [(r["u"] & (2**64 - 1), r["v"] & (2**64 - 1)) for r in rows]
    assert all(bin(u ^ v).count("1") <= 4 for u, v in links)
    brute = [(int(x), int(y)) for i, x in enumerate(prints) for y in prints[i + 1 :][np.bitwise_count(prints[i + 1 :] ^ x) <= 4]]
    assert classes_of(links, prints) == classes_of(brute, prints)


def test_spanning_links_are_few_and_connect():
    prints = planted_prints(2, 600)
    nodes = prints.view(np.int64)
    links = [(u & (2**64 - 1), v & (2**64 - 1)) for u, v in simhash.spanning_links(prints[:, None], nodes, prints[:, None], nodes)]
    brute = [(int(x), int(y)) for i, x in enumerate(prints) for y in prints[i + 1 :][np.bitwise_count(prints[i + 1 :] ^ x) <= 4]]
    assert classes_of(links, prints) == classes_of(brute, prints)
    assert len(links) <= 2 * len(prints)


def test_simhash_edges(spark):
    got = simhash.simhash_components(edge_documents(spark)).collect()
    assert len(got) == 14
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert by[3] == by[4] == by[5] == {(0, 3)}
    assert by[1] == by[2] and by[6] == by[7]
    assert simhash.simhash_components(empty_documents(spark)).count() == 0
    kept = simhash.keep_one_per_component(edge_documents(spark))
    assert kept.columns == edge_documents(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 3, None, None, 6, 8, 9, 10, -11], key=str)


def test_similar_texts_are_found_and_others_left_alone(spark):
    """Copies of 150 words with some words changed: nearly all of those above 0.9 go, none of the unrelated."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 5000, size=n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    docs, similar, clean = [], [], []
    for k in range(120):
        a = words(150)
        b = list(a)
        for i in rng.choice(150, size=1 + k % 2, replace=False):
            b[i] = "changed"
        x, y = shingles(a), shingles(b)
        docs += [(3 * k, " ".join(a)), (3 * k + 1, " ".join(b)), (3 * k + 2, " ".join(words(150)))]
        clean += [3 * k, 3 * k + 2]
        if len(x & y) / len(x | y) >= 0.85:
            similar.append(3 * k + 1)
    kept = {r["doc_id"] for r in simhash.keep_one_per_component(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(clean) <= kept
    gone = [d for d in similar if d not in kept]
    assert len(similar) > 100 and len(gone) >= 0.9 * len(similar)


def edited_pairs(seed: int, n: int, low: float, high: float) -> list[tuple[str, str]]:
    """Unrelated pairs of texts whose five-word shingle sets have a similarity from ``low`` to under ``high``."""
    rng = np.random.default_rng(seed)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = []
    while len(out) < n:
        a = [f"w{i}" for i in rng.integers(0, 50_000, size=int(rng.integers(60, 300)))]
        b = list(a)
        for i in rng.choice(len(a), size=int(rng.integers(1, 10)), replace=False):
            b[i] = f"c{rng.integers(0, 50_000)}"
        x, y = shingles(a), shingles(b)
        if low <= len(x & y) / len(x | y) < high:
            out.append((" ".join(a), " ".join(b)))
    return out


def kept_of(spark, texts: list[str]) -> set[int]:
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.keep_one_per_component(table).collect()}


def test_isolated_pairs_just_above_the_threshold_meet(spark):
    texts = [t for pair in edited_pairs(11, 400, 0.80, 0.85) for t in pair]
    kept = kept_of(spark, texts)
    assert set(range(0, 800, 2)) <= kept
    assert len(set(range(1, 800, 2)) - kept) >= 0.985 * 400


def test_pairs_under_the_threshold_both_stay(spark):
    texts = [t for pair in edited_pairs(12, 200, 0.65, 0.80) for t in pair]
    assert kept_of(spark, texts) == set(range(400))


def test_weak_anchors_hold_the_own_value_and_all_flips():
    rng = np.random.default_rng(3)
    counts, n = rng.integers(0, 300, size=(20, simhash.SIMILAR_PRINTS, 64)), np.full(20, 300)
    rows = np.concatenate([simhash.majority(counts, n), simhash.weak_bits(counts, n)], axis=1).view(np.int64)
    anchors, homes, owner = simhash.weak_entries(rows)
    for t in range(20):
        want = set()
        for p in range(simhash.SIMILAR_PRINTS):
            for block in range(3):
                bits = range(20 * block, 20 * block + 20)
                weak = sorted(bits, key=lambda b: abs(2 * counts[t, p, b] - 300))[:3]
                own = sum(1 << (b - 20 * block) for b in bits if 2 * counts[t, p, b] > 300)
                for flips in range(8):
                    value = own
                    for k in range(3):
                        value ^= (flips >> k & 1) << (weak[k] - 20 * block)
                    want.add(value | (3 * p + block) << 32)
        assert set(anchors[owner == t].tolist()) == want and homes.all()


def test_the_table_loses_few_similar_pairs(spark, sf_dir):
    """Recall of links among all pairs of the documents table, by their similarity."""
    texts = documents(spark, sf_dir)
    sets = [np.sort(simhash.shingle_set(t, 5)) for _, t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s.tolist():
            holders[x].append(i)
    shared: Counter = Counter()
    for found in holders.values():
        shared.update((a, b) for k, a in enumerate(found) for b in found[k + 1 :])
    similar = [(a, b) for (a, b), n in shared.items() if n * 9 >= (len(sets[a]) + len(sets[b])) * 4]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    linked = sum(got[texts[a][0]] == got[texts[b][0]] for a, b in similar)
    assert len(similar) > 50 and linked >= 0.99 * len(similar)
    # No link joins what all similar pairs leave apart.
    parent = list(range(len(texts)))
    for a, b in similar:
        parent[find(parent, a)] = find(parent, b)
    by_set = {}
    for i, s in enumerate(sets):
        if s.tobytes() in by_set:
            parent[find(parent, i)] = find(parent, by_set[s.tobytes()])
        by_set[s.tobytes()] = i
    roots = defaultdict(set)
    for i, (d, _) in enumerate(texts):
        roots[got[d]].add(find(parent, i))
    assert all(len(r) == 1 for r in roots.values())


@pytest.mark.parametrize("anchor_rows", [4096, 7])
def test_template_families_fall_into_their_exact_components(spark, monkeypatch, anchor_rows):
    """Forests of dense cells, once verified, still connect what all similar pairs connect, and no more."""
    monkeypatch.setattr(simhash, "ANCHOR_ROWS", anchor_rows)
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in rng.integers(0, 50_000, size=120)]
    texts = []
    for _ in range(150):
        b = list(words)
        for i in rng.choice(120, size=int(rng.integers(1, 6)), replace=False):
            b[i] = f"c{rng.integers(0, 50_000)}"
        texts.append(" ".join(b))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    parent = {i: i for i in range(150)}
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    firsts = {find(parent, i) for i in range(150)}
    assert 1 < len(firsts) < 150
    assert kept_of(spark, texts) == firsts


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (1001, 1000)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain + hub, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- op10 -------------------------------------------------------------------------------------


def test_contracted_links_keep_their_components(spark):
    rng = np.random.default_rng(16)
    links = np.concatenate([rng.integers(0, 3000, size=(2500, 2)), np.column_stack([np.arange(4000, 6000), rng.integers(4000, 4010, size=2000)])] * 3)
    table = spark.createDataFrame([tuple(map(int, r)) for r in links], "u long, v long").repartition(6)
    few = [(r["u"], r["v"]) for r in components.contracted(table).collect()]
    nodes = sorted(set(links.ravel().tolist()))
    assert classes_of(few, nodes) == classes_of(links.tolist(), nodes) and len(few) < 5200
    assert components.contracted(table.limit(0)).count() == 0


def plain_removal(docs: list[tuple[int, str]], window: int) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for d, t in sorted(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_windows_query(spark, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.op10_repeated_substrings(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == plain_removal(documents(spark, sf_dir), 20)


@pytest.mark.parametrize("subtree_runs", [4096, 2, 0])
@pytest.mark.parametrize("window,prefix", [(4, 2), (5, 5), (3, 1)])
def test_repeated_windows_of_few_words(spark, monkeypatch, window, prefix, subtree_runs):
    monkeypatch.setattr(substring_dedup, "SUBTREE_RUNS", subtree_runs)  # few: prefixes are lengthened
    rng = np.random.default_rng(window)
    docs = [(int(i), " ".join(rng.choice(["a", "b", "c", "dd"], size=int(rng.integers(0, 40))))) for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = substring_dedup.remove_repeated_windows(table, window, prefix).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows}
    assert got == plain_removal(docs, window)
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["removed_spans"]) == r["n_removed"]


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 20])
def test_suffix_nodes_are_equal_words(depth):
    words = np.random.default_rng(depth).integers(0, 3, size=400)
    words[100:200] = words[:100]
    nodes = substring_dedup.suffix_nodes(words, depth)
    paths = [tuple(words[i : i + depth].tolist()) for i in range(len(words) - depth + 1)]
    assert len(nodes) == len(paths) and len(set(zip(nodes.tolist(), paths))) == len(set(paths)) == len(set(nodes.tolist()))


def test_a_crowded_prefix_and_a_common_passage(spark, monkeypatch):
    """A phrase in most documents, each time in other words, and a passage that most share."""
    monkeypatch.setattr(substring_dedup, "SUBTREE_RUNS", 20)
    monkeypatch.setattr(substring_dedup, "CHUNK_RUNS", 16)
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 300, size=n)]
    phrase, passage = words(8), words(45)
    docs = [(i, " ".join([*words(30), *phrase, *words(30), *(passage if i % 3 else []), *words(5)])) for i in range(150)]
    docs.append((200, docs[3][1]))
    lengths, emit = [], substring_dedup._emit_runs_of_runs
    monkeypatch.setattr(substring_dedup, "_emit_runs_of_runs", lambda *a: lengths.append(a[1]) or emit(*a))
    rows = substring_dedup.remove_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows}
    assert got == plain_removal(docs, 20)
    assert lengths == [12, 20]  # prefixes are lengthened until subtrees fit


def test_repeated_windows_edges(spark):
    got = substring_dedup.remove_repeated_windows(edge_documents(spark)).collect()
    assert len(got) == 14
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_words"] == 20000 and by[6]["n_removed"] == 20000 - 5  # all but the first period
    assert by[7]["n_removed"] == 20000 and by[7]["kept_text"] == ""
    assert by[4]["n_words"] == 0 and by[5]["kept_text"] == ""
    assert substring_dedup.remove_repeated_windows(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeated_windows(edge_documents(spark), 3, 4)


def test_many_repeated_rows_cost_no_more_than_distinct_ones(spark):
    """Rows with one id, or none, and one text are one document; each gets its result."""
    rng = np.random.default_rng(15)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50, size=400))
    n = 3000
    repeated = spark.createDataFrame([(None, text)] * n + [(7, text)] * n + [(8, "a " + text)], "doc_id long, text string").repartition(4)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeated_windows(repeated).collect())
    want = plain_removal([(-1, text), (7, text), (8, "a " + text)], 20)
    assert sum(got.values()) == 2 * n + 1 and len(got) == 3
    for (d, n_words, n_removed, kept), times in got.items():
        assert times == (1 if d == 8 else n)
        assert (n_words, n_removed) == want[-1 if d is None else d][:2] and n_words == 400 + (d == 8)


def test_rows_without_an_id_are_told_apart(spark):
    texts = [" ".join(f"{k}x{i}" for i in range(30)) for k in range(300)]
    rows = spark.createDataFrame([(None, t) for t in texts] + [(5, texts[3])], "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeated_windows(rows).collect()]
    assert sorted(got, key=str) == sorted([(None, 0)] * 300 + [(5, 30)], key=str)
