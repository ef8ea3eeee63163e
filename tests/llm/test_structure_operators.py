"""Clusters, prefix trie and shards against brute force, and their defined results for odd input."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentispark.llm import prefix_trie, sharding, walsh

# --- clusters ----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id string, cluster string"


def brute_clusters(rows, count, rounds, size=64, scale=64):
    kept = []
    for i, v in rows:
        if v is None or len(v) != size or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        whole = [floor(scale * float(np.float32(x))) for x in v]
        if max(map(abs, whole)) < walsh.largest(size):
            kept.append((i, whole))
    draw = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(kept, key=draw)[:count]]

    def assign():
        out = []
        for i, v in kept:
            gaps = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers]
            out.append((i, gaps.index(min(gaps)), min(gaps)))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, v), (_, c, _) in zip(kept, assign()):
            groups[c].append(v)
        for c, members in groups.items():
            centers[c] = [floor(Fraction(sum(x), len(members))) for x in zip(*members)]
    return assign(), centers


def vectors(seed, count, size=64):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    return [[x + rng.gauss(0, 0.2) for x in rng.choice(centers)] for _ in range(count)]


def test_transform_is_the_hadamard_matrix_and_comes_back():
    rng = np.random.default_rng(1)
    v = rng.integers(-1000, 1000, (7, 16))
    rows = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)])
    assert (walsh.transform(v) == (v @ rows.T)[:, walsh.pattern_order(16)]).all()
    changes = (rows[walsh.pattern_order(16)][:, 1:] != rows[walsh.pattern_order(16)][:, :-1]).sum(axis=1)
    assert changes.tolist() == list(range(16))
    assert (walsh.restored(walsh.transform(v)) == v).all()


def test_progressive_search_is_exact_and_looks_at_less():
    rng = np.random.default_rng(2)
    centers = rng.integers(-200, 200, (16, 64))
    found = centers[rng.integers(0, 16, 500)] + rng.integers(-20, 20, (500, 64))
    found[:50] = (centers[0] + centers[1]) // 2 + 0
    search = walsh.Search(walsh.transform(np.concatenate([centers, centers[3:4]])))
    number, distance = search.nearest(walsh.transform(found))
    gaps = ((found[:, None, :] - np.concatenate([centers, centers[3:4]])[None]) ** 2).sum(axis=2)
    assert (number == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()
    assert 16 not in number  # a copy of a centroid loses every tie
    assert search.looked < 0.5 * gaps.size * 64


def test_clusters_equal_brute_force(spark):
    rows = list(enumerate(vectors(1, 300)))
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    odd = [None, [], [0.0] * 63, [0.5] * 65, [None] + [0.0] * 63, [float("nan")] + [0.0] * 63, [float("-inf")] * 64, [3e38] * 64, [131072.0] + [0.0] * 63]
    rows += [(1000 + k, v) for k, v in enumerate(odd)] + [(2000 + k, [0.25] * 64) for k in range(40)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(5)
    found, centroids = walsh.cluster(frame, clusters=16, rounds=3)
    want, centers = brute_clusters(rows, 16, 3)
    got = [(r["id"], r["cluster"], r["distance"]) for r in found.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and centroids == centers
    table = walsh.with_inertia(found, centroids).collect()
    assert {r["inertia"] for r in table} == {sum(w[2] for w in want)}
    for r in table:
        assert r["cluster_inertia"] == sum(w[2] for w in want if w[1] == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


def test_clusters_with_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(5, [1.0] * 64, "x", "y"), (6, [1.0] * 64, "x", "y"), (8, None, "x", "y")], VECTORS)
    found, centroids = walsh.cluster(frame)
    assert len(centroids) == 2 and sorted((r["id"], r["cluster"], r["distance"]) for r in found.collect()) == [(5, 0, 0), (6, 0, 0)]
    for none in (frame.where("vec_id = 8"), frame.limit(0)):
        found, centroids = walsh.cluster(none)
        assert walsh.with_inertia(found, centroids).count() == 0 and centroids == []
    with pytest.raises(ValueError):
        walsh.cluster(frame, size=48)


# --- prefix trie ---------------------------------------------------------------------------------


def brute_trie(conversations):
    """Nodes from {id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, some in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        ends = sorted(c for c in some if len(conversations[c]) == len(node))
        out.append(
            (
                min(some),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(some),
                len(children),
                sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below) for m in below),
                sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out)


def nodes_of(trie):
    return sorted(tuple(r) for r in trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations(seed, count, kinds, longest):
    rng = random.Random(seed)
    turns = [(rng.choice(["user", "assistant", ""]), "é😀"[: rng.randint(0, 2)] * rng.randint(0, 4) + str(k)) for k in range(kinds)]
    return {rng.randint(-50, 10**6): [rng.choice(turns) for _ in range(rng.randint(0, longest))] for _ in range(count)}


def stored(spark, found):
    """(id, tokens) with the tokens of ``sequences``, which leaves out conversations without turns."""
    rows = [(c, k, r, t) for c, turns in found.items() for k, (r, t) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    empty = spark.createDataFrame([(c, b"") for c, turns in found.items() if not turns] or [], "id long, tokens binary")
    return prefix_trie.sequences(frame).unionByName(empty)


@pytest.mark.parametrize("block", [1, 3, 7, 20_000])
def test_trie_equals_brute_force_however_it_is_cut(spark, block, monkeypatch):
    found = conversations(1, 60, 3, 6)
    copied = [("user", "hello"), ("assistant", "you")]
    found |= {k: list(copied) for k in range(2_000_000, 2_000_030)}
    found |= {k: copied + [("user", str(k % 3))] for k in range(3_000_000, 3_000_012)}
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    assert nodes_of(prefix_trie.build_trie(stored(spark, found))) == brute_trie(found)


def test_trie_of_long_conversations_in_bands(spark, monkeypatch):
    found = conversations(2, 25, 2, 14) | {k: [("user", "a")] * (9 + k % 3) + [("user", str(k % 2))] * (k % 4) for k in range(40)}
    monkeypatch.setattr(prefix_trie, "BAND", 3)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 11)
    assert nodes_of(prefix_trie.build_trie(stored(spark, found))) == brute_trie(found)
    long = {1: [("user", str(k)) for k in range(700)], 2: [("user", str(k)) for k in range(650)], 3: [("user", "0")]}
    monkeypatch.setattr(prefix_trie, "BAND", 32)
    got = nodes_of(prefix_trie.build_trie(stored(spark, long)))
    assert len(got) == 701 and got == brute_trie(long)


def test_turns_are_ordered_and_grafted(spark):
    lost = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6)  # one turn, cut, and nothing before it
    rows = [
        (100, 1, "assistant", "b", "x"), (100, 0, "user", "a", "x"), (100, 2, "user", "c", "x"),
        (100, None, None, "first", "x"), (103, 5, "user", None, "x"), (103, 5, "user", "z", "x"), (103, 5, "assistant", "y", "x"), (103, 5, "user", None, "x"),
        (lost, 1, "user", "alone", "x"), (None, 1, "user", "nobody", "x"), (-7, 0, "user", "minus", "x"), (0, 3, "user", "zero", "x"), (0, 1, "u", "ser", "x"), (1, 1, "us", "er", "x"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")
    said = defaultdict(list)
    for c, t, r, x, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said[c].append((r or "", x or ""))
    assert nodes_of(prefix_trie.build_trie(prefix_trie.sequences(frame))) == brute_trie(said)
    grafted = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        grafted[c] = said.get(int(c / 100) * 100, [])[:h] + own[h:]
    assert [] in grafted.values()
    assert nodes_of(prefix_trie.build_trie(prefix_trie.grafted(prefix_trie.sequences(frame)))) == brute_trie(grafted)
    none = frame.limit(0)
    assert prefix_trie.build_trie(prefix_trie.grafted(prefix_trie.sequences(none))).count() == 0


# --- shards --------------------------------------------------------------------------------------


def brute_shards(rows, shards, seed=sharding.SEED):
    """{(id, text): [(shard, slot)]} from (id, text, source)."""
    groups = defaultdict(list)
    for i, t, s in rows:
        data = (t or "").encode()
        draw = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        groups[s].append((draw, zlib.crc32(data), len(data) + 1, i, t))
    line = []
    for s, some in groups.items():
        for rank, row in enumerate(sorted(some, key=lambda r: r[:3]), 1):
            line.append((Fraction(2 * rank - 1, 2 * len(some)), s is not None, s or "", rank, row))
    out, slots = defaultdict(list), defaultdict(int)
    for p, entry in enumerate(sorted(line, key=lambda e: e[:4])):
        shard = p * shards // len(line)
        out[entry[4][3], entry[4][2], entry[4][1]].append((shard, slots[shard]))
        slots[shard] += 1
    return {k: sorted(v) for k, v in out.items()}


def odd_documents(prose):
    rows = [(k, prose(k, 3), "web") for k in range(200)] + [(1000 + k, prose(k, 2), f"s{k % 7}") for k in range(60)]
    rows += [(3, prose(3, 3), "web"), (3, "other", "web"), (None, "no id", "web"), (None, "no id", "web"), (None, None, None), (5000, None, "s1"), (5001, "", None), (5002, "é😀", "lonely"), (5003, "long " * 20_000, "web")]
    return rows


@pytest.mark.parametrize("shards", [1, 7, 16, 1000])
def test_shards_equal_brute_force(spark, prose, shards):
    rows = odd_documents(prose)
    frame = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, source string, shard int, size string").repartition(4)
    found = defaultdict(list)
    for r in sharding.interleave(frame, shards).collect():
        found[r["id"], r["size"], r["checksum"]].append((r["shard"], r["slot"]))
    assert {k: sorted(v) for k, v in found.items()} == brute_shards(rows, shards)


def test_every_shard_has_the_mixture(spark):
    frame = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    counts, totals = defaultdict(int), defaultdict(int)
    for r in sharding.interleave(frame, 16).groupBy("shard", "source").count().collect():
        counts[r["shard"], r["source"]] += r["count"]
        totals[r["source"]] += r["count"]
    assert {sum(counts[s, x] for x in totals) for s in range(16)} <= {312, 313}
    assert all(abs(counts[s, x] - n / 16) <= 1.5 for x, n in totals.items() for s in range(16))


def test_written_shards_hold_all_rows_in_order(spark, prose, tmp_path):
    rows = odd_documents(prose)
    frame = spark.createDataFrame([(*r, k, "c") for k, r in enumerate(rows)], "doc_id long, text string, source string, shard int, size string")
    path = str(tmp_path / "shards")
    dealt = sharding.write_shards(frame, path, shards=4)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == ["doc_id", "docs_shard", "shard", "size", "slot", "source", "text"]
    assert {(r["shard"], r["slot"]) for r in back.collect()} == {(r["shard"], r["slot"]) for r in dealt.collect()}
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["source"], r["docs_shard"]) for r in back.collect()))) == sorted(map(repr, ((*r, k) for k, r in enumerate(rows))))


def test_no_rows_no_shards(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sharding.interleave(frame).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(frame, 0)
