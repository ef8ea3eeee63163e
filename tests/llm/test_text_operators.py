"""Operators on documents against brute force, and their defined results for odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentispark.llm import byte_bpe, decontaminate, jaccard_join, repeated, suffix_dedup, token_counts
from sentispark.llm import components as graph
from sentispark.llm.components import components

ODD = ["", None, " ", "a", "x y", "  two  spaces \n and lines\n\n", "tab\tand nbsp", "😀 日本 é́", "<|endoftext|> in text", "don't we'll 12 345"]


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(read("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def exact(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(docs, ranks, exact, prose):
    rows = list(enumerate([*ODD, prose(1, 30_000), "x" * 5000, " " * 3000])) + [(0, ""), (None, "no id")]
    found = byte_bpe.decode(byte_bpe.encode(docs(rows), ranks, public_tokenizers.PATTERN), ranks).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for row in found:
        text = texts[row["id"]] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == exact.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_bpe_empty_table(docs, ranks):
    assert byte_bpe.decode(byte_bpe.encode(docs([]), ranks, public_tokenizers.PATTERN), ranks).count() == 0


def test_bpe_cut_texts_like_whole_ones(ranks, exact):
    from tokenizers import Tokenizer

    encoder = byte_bpe.PieceEncoder(Tokenizer.from_str(byte_bpe.model_of_ranks(ranks, public_tokenizers.PATTERN)))
    rng = random.Random(5)
    letters = ["a", "aa", " ", "  ", "\n", "\t", "'s", "12", "é", "ß", "日", "😀", "-", "ha", " ", "\x1c", "\x00", "́"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    ids, ends = encoder.encode(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == exact.encode_ordinary(text), text
        begin = end


def test_bpe_offsets_cover_whole_characters(docs, ranks):
    text = "ab 日本😀 é"
    row = byte_bpe.encode_with_offsets(docs([(1, text), (2, None)]), ranks, public_tokenizers.PATTERN).where("id = 1").first()
    data = b"".join(byte_bpe._tokens_by_id(ranks)[i] for i in row["ids"])
    assert data.decode() == text
    spans = list(zip(row["starts"], row["ends"]))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b < e and b2 <= e for (b, e), (b2, _) in zip(spans, spans[1:]))


def test_decode_replaces_cut_characters(spark, ranks):
    part = ranks[b"\xf0"]
    rows = spark.createDataFrame([(1, np.array([ranks[b"a"], part], "<u4").tobytes()), (2, None)], "id long, ids binary")
    out = byte_bpe.decode(rows, ranks).withColumn("text", byte_bpe.decoded_text("decoded"))
    found = {r["id"]: r["text"] for r in out.collect()}
    assert found == {1: "a�", 2: None}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, docs, prose, tmp_path, name):
    kind, data = name.rsplit(".", 1)[1], read(name)
    rows = list(enumerate([*ODD, prose(2, 4000), *[prose(3, 50)] * 5]))
    cache = str(tmp_path / "cache")
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode())
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        count = lambda t: len(pieces.encode(t))
    want = sorted((i, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t in rows)
    assert sorted(map(tuple, token_counts.count_tokens(docs(rows), kind, data, cache, 100).collect())) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in rows})
    # A second call encodes only what is new.
    more = [*rows, (99, "something new")]
    found = token_counts.count_tokens(docs(more), kind, data, cache, 100)
    assert sorted(map(tuple, found.collect()))[:-1] == want
    assert spark.read.parquet(cache).count() == stored + 1
    assert token_counts.count_tokens(docs([]), kind, data, cache).count() == 0


def word_sets(rows, size=5):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k : k + size]) for k in range(len(w) - size + 1)])
    return out


def linked(sets):
    part = {i: i for i in sets}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                part[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("rounds", [6, 1])
def test_jaccard_join_equals_brute_force(docs, prose, rounds, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_ROUNDS", rounds)
    rng = random.Random(7)
    rows = list(enumerate(ODD))
    base = prose(11, 120).split()
    # Copies with so many changes that some pairs link and some only through others.
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{k}x{rng.randint(0, 3)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, prose(20, 40) + " " + prose(300 + k, 30)) for k in range(30)]  # a shared passage only
    rows += [(300 + k, prose(21, 60)) for k in range(25)]
    rows += [(400 + k, " ".join(base[: 60 + 5 * k])) for k in range(12)]
    rows += [(500, "one two three"), (501, "ONE  two three"), (502, "Été a b"), (503, "été a b")]
    sets = word_sets(rows)
    want = linked(sets)
    found = jaccard_join.near_duplicates(docs([*rows, (300, prose(21, 60)), (None, "no id")])).collect()
    assert {r["id"]: (r["n_shingles"], r["component"]) for r in found} == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(found) == len(sets)


def test_jaccard_join_without_rows(docs):
    assert jaccard_join.near_duplicates(docs([])).count() == 0
    assert [tuple(r) for r in jaccard_join.near_duplicates(docs([(3, None)])).collect()] == [(3, 0, 3)]


@pytest.mark.parametrize("one_task, held", [(1 << 20, 1 << 20), (0, 8), (0, 1 << 20), (10, 4)])
def test_components_of_chains_and_stars(spark, monkeypatch, one_task, held):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    monkeypatch.setattr(graph, "_HELD", held)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 199), (199, 200), (None, 1)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def cut_repeats(rows, span=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        mark = np.zeros(len(data), bool)
        for p in range(len(data) - span + 1):
            if first.setdefault(data[p : p + span], i) < i:
                mark[p : p + span] = True
        runs = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out[i] = (len(data), int(mark.sum()), runs, np.frombuffer(data, np.uint8)[~mark].tobytes())
    return out


def test_suffix_dedup_equals_brute_force(docs, prose):
    passage = prose(31, 30)
    rows = list(enumerate(ODD))
    rows += [(50 + k, prose(40 + k, 20 + k) + passage[k : 150 + k] + prose(90 + k, 25)) for k in range(30)]
    rows += [(90 + k, prose(41, 40)) for k in range(20)]
    rows += [(120, "ab" * 400), (121, "ba" * 300), (122, "x" * 49), (123, "x" * 50), (124, "x" * 51), (125, "x" * 120)]
    rows += [(130, "é日" * 60), (131, "日é" * 60), (140, prose(50, 20_000)), (141, prose(50, 20_000)[1000:3000]), (142, "\x00" * 200), (143, "a\x00" * 80 + "\x00" * 99)]
    want = cut_repeats(rows)
    found = suffix_dedup.remove_repeats(docs([*rows, (None, passage)])).collect()
    got = {r["id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]) // 16, bytes(r["kept"])) for r in found if r["id"] is not None}
    assert got == want
    assert next(r for r in found if r["id"] is None)["n_removed"] == 0
    assert found[0]["carried"]["lang"] == "en"


def test_suffix_dedup_spreads_ends_of_a_common_passage(docs, prose):
    passage = prose(31, 30)
    rows = [(k, prose(1000 + k, 8) + passage[k % 3 :] + prose(5000 + k, 8)) for k in range(300)]
    found = suffix_dedup.remove_repeats(docs(rows)).collect()
    assert {r["id"]: bytes(r["kept"]) for r in found} == {i: w[3] for i, w in cut_repeats(rows).items()}
    # No value, hence no part, is sent a segment of every document.
    texts = pa.array([t for _, t in rows])
    _, owner, _, _, value, _ = suffix_dedup._segments(texts, 50)
    held = Counter(v for _, v in set(zip(owner.tolist(), value.tolist())))
    keys = [np.array(sorted({v for o, v in zip(owner.tolist(), value.tolist()) if o == k and held[v] > 1}), np.uint64) for k in range(len(rows))]
    classes = [np.array([65535 if held[v] > 16 else held[v] for v in some.tolist()], np.uint16).tobytes() for some in keys]
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": texts, "keys": [k.tobytes() for k in keys], "classes": classes})
    sent = Counter()
    for out in suffix_dedup._sender(50, 24)(iter([batch])):
        sent.update(np.frombuffer(b"".join(out.column("values").to_pylist()), np.uint64).tolist() if out.num_rows else [])
        spans = [v for v, s in zip(out.column("values").to_pylist(), out.column("sizes").to_pylist()) if not s]
        for v in spans:
            sent.subtract(np.frombuffer(v, np.uint64).tolist())
    assert sum(sent.values()) > len(rows) and max(sent.values()) <= 16


def test_suffix_dedup_same_id_and_empty_table(docs, prose):
    twice = suffix_dedup.remove_repeats(docs([(1, prose(1, 40)), (1, prose(1, 40))])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def test_suffix_dedup_one_id_with_two_texts(docs, prose):
    """The text with the smaller digest stands for the id; the other stays whole, whatever the first loses."""
    a, b = sorted((prose(1, 40), prose(2, 40)), key=lambda t: hashlib.sha256(t.encode()).digest())
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b), (7, "start " + a), (8, prose(3, 20) + b), (9, a[10:]), (9, "short")]
    found = {(r["id"], r["kept"].decode(), r["n_removed"] > 0) for r in suffix_dedup.remove_repeats(docs(rows)).collect()}
    small = min((a[10:], "short"), key=lambda t: hashlib.sha256(t.encode()).digest())
    want = {(3, a, False), (5, "", True), (5, b, False), (6, b, False), (7, "start ", True), (8, prose(3, 20), True)}
    want |= {(9, "", True), (9, "short", False)} if small != "short" else {(9, a[10:], False), (9, "short", False)}
    assert found == want


def test_parts_of_window_minima_are_even(prose):
    """Minima crowd at zero; dealt by their distribution no part is much larger than the mean."""
    texts = pa.array([prose(k, 400) for k in range(300)])
    for span in (50, 80):
        values = np.unique(suffix_dedup._segments(texts, span)[4])
        for parts in (16, 102):
            sizes = np.bincount(repeated.part_by(suffix_dedup.minima_spread(span), values, parts), minlength=parts)
            assert sizes.max() < 2 * sizes.mean() and sizes.min() > 0
            assert (np.diff(repeated.part_by(suffix_dedup.minima_spread(span), values, parts)) >= 0).all()


def test_values_merged_a_few_at_a_time(docs, prose, monkeypatch):
    shared = prose(5, 40)
    rows = [(k, f"{prose(100 + k, 30)} {shared[k % 7 :]} {prose(200 + k, 30)}") for k in range(40)]
    want = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs(rows)).select("id", "n_removed", "spans", "kept").collect())
    monkeypatch.setattr(suffix_dedup, "_MERGED", 100)
    assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs(rows)).select("id", "n_removed", "spans", "kept").collect()) == want


def test_merged_transforms_give_order_and_prefixes():
    rng = random.Random(3)
    segments = [bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(40)]
    parts = [segments[k::4] for k in range(4)]
    done = [suffix_dedup.shard_transform(p, 8) for p in parts]
    rows, common = suffix_dedup.merged_blocks([d[0] for d in done], 8)
    suffixes = [p[o][f:] + b"\x00" for p, d in zip(parts, done) for o, f in zip(d[1].tolist(), d[2].tolist())]
    merged = [suffixes[r][:8] for r in rows.tolist()]
    full = [m for m in merged if b"\x00" not in m]
    assert full == sorted(full)
    for k in range(1, len(merged)):
        if b"\x00" not in merged[k] + merged[k - 1]:
            same = next((i for i in range(8) if merged[k][i] != merged[k - 1][i]), 8)
            assert common[k] == same


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark, docs, prose):
    rng = random.Random(9)
    items = [(k, prose(60 + k, 12)) for k in range(8)] + [(20, "Short one"), (21, ""), (22, None), (23, "tiny")]
    rows = list(enumerate(ODD))
    for k in range(60):
        letters = list(items[k % 8][1])
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(letters))
            letters[at] = rng.choice(["", "z", letters[at] + "q"])
        rows.append((100 + k, prose(700 + k, 15) + "\n " + "".join(letters).upper() + "  " + prose(800 + k, 10)))
    rows += [(200, "a short   ONE here"), (201, "shorter shorts one"), (202, "shortones"), (203, items[0][1] + " " + items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["id"], r["item"]): r["distance"] for r in decontaminate.find_leaks(docs(rows), benchmark).collect()}
    want = {}
    for i, text in rows:
        plain = decontaminate.normalized(text or "")
        for name, item in items[:8]:
            item = decontaminate.normalized(item)
            if (d := distance(item, plain)) <= decontaminate.budget(len(item), 0.1):
                want[i, name] = d
    want[200, 20] = 0
    assert found == want


def test_decontamination_in_blocks(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 300)
    items = [(k, prose(60 + k, 12)) for k in range(9)]
    found = decontaminate.find_leaks(docs([(k, t) for k, t in items]), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["id"], r["item"]) for r in found.collect()) == [(k, k) for k in range(9)]
    assert decontaminate.find_leaks(docs([]), spark.createDataFrame([], "item_id long, text string")).count() == 0


