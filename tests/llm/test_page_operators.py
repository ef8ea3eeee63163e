"""Operators on pages, conversations, vectors and labels, and their defined results for odd input."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentispark.llm import chat_format, cotrain, html_text, mtree, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="header-fixed">
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href="x">x</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to give you the best experience, with many words of text.</div>
<main><article><header><h1>Big &amp; title</h1></header><p>Short.</p><p>One <a href="x>y">link</a>, 1 &lt; 2 &copy;<br>next&nbsp;line</p>
<ul><li>one<li>two</ul><aside>side</aside><div class="ad">buy</div><form><label>Name</label></form><p>Last</article>
<section id="comments"><article><p>I think this is a long comment about the article, really.</p></article></section></main>
<div class="sidebar"><p>More text in the sidebar.</p></div><footer>&copy; x</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_html_article_text():
    tree = html_text.train_tree(*html_text.labelled_table())
    want = ["Big & title", "Short.", "One link, 1 < 2 © next line", "one", "two", "Last"]
    assert html_text.main_text(PAGE, tree).split("\n\n") == want


def test_html_without_article_element(prose):
    tree = html_text.train_tree(*html_text.labelled_table())
    a, b = prose(1, 50), prose(2, 60)
    page = f"<div id=menu><a href=1>a</a> <a href=2>b</a></div><h1>A heading</h1><div><p>{a}</p><p>{b}</div><div>Copyright 2020</div>"
    assert html_text.main_text(page, tree).split("\n\n") == ["A heading", a, b]


@pytest.mark.parametrize(
    "opened, closed",
    [
        ('<article class="post has-comments">', "</article>"),
        ('<article class="post comments" id="post-7">', "</article>"),
        ('<div class="content comments-open"><article>', "</article></div>"),
        ('<div class="main-content with-sidebar">', "</div>"),
        ('<div class="page hasComments"><main>', "</main></div>"),
    ],
)
def test_html_layout_names_are_no_evidence(opened, closed, prose):
    tree = html_text.train_tree(*html_text.labelled_table())
    body, more = prose(1, 60), prose(2, 50)
    comment = f'<section class="comments"><article class="comment"><p>{prose(3, 40)}</p></article></section>'
    page = f"<html><body>{opened}<p>{body}</p><p>{more}</p>{closed}{comment}</body></html>"
    assert html_text.main_text(page, tree) == f"{body}\n\n{more}"


def test_html_linked_article_blocks_stay(prose):
    tree = html_text.train_tree(*html_text.labelled_table())
    title, linked, body = prose(4, 5), prose(5, 40), prose(6, 60)
    page = f'<article><h1><a href="x">{title}</a></h1><p>{body}</p><p><a href="y">{linked}</a></p><p>{body}</p><p><a href="z">more here</a></p></article>'
    assert html_text.main_text(page, tree) == "\n\n".join([title, body, linked, body])


def test_tree_learns_its_table():
    rows, labels = html_text.labelled_table()
    assert (html_text.classify(html_text.train_tree(rows, labels), rows) == labels).mean() > 0.97


#: Pages the tree has not seen, in the notation of its table.
HELD_OUT = """
S2/2- S1/1- A9h+ A70+ A30/2+ A6+ A110+ S10- S4/4- S25-
N2/2- N1/1- N3/3- N7h+ N65+ N90/4+ N3+ N55+ N2/2- N1/1- N6-
N5h+ N30+ N42+ N7+ N38+
N24- N1/1- N2/2- N1/1- N50+ N85+ N70/3+ N2/2- N3/3-
A4h+ A15+ A2+ A2+ A33/5+ S60- S70- S9-
N3/3- N8- A6h+ A95+ A12+ N50- N9- N2/2-
S1/1- A7h+ A44+ A3/3+ A1/1+ A2/2+ A61+ S30-
N1/1- N1/1- N6h+ N28+ N77+ N31/30- N12/12- N5/5-
S12- S2/2- N9h+ N52+ N5+ N66+ S8- S44-
N60+
N4h+ N8+
"""


def test_tree_on_held_out_pages():
    tree = html_text.train_tree(*html_text.labelled_table())
    rows, labels = html_text.labelled_table(HELD_OUT)
    assert (html_text.classify(tree, rows) == labels).mean() > 0.93


def test_tree_decides_by_counts_and_densities_of_neighbours():
    def used(tree):
        return set() if "label" in tree else {html_text.FEATURES[tree["feature"]]} | used(tree["low"]) | used(tree["high"])

    found = used(html_text.train_tree(*html_text.labelled_table()))
    assert {"words", "links", "words_before", "words_after", "links_before", "links_after"} <= found


@pytest.mark.parametrize(
    "part", ['<section id="related-work">', '<section id="social-impact">', '<div class="section search-engines">', '<div class="tag-theory">']
)
def test_html_article_sections_named_like_surroundings_stay(part, prose):
    tree = html_text.train_tree(*html_text.labelled_table())
    a, b = prose(1, 40), prose(2, 30)
    page = f"<nav><a href=1>x</a></nav><article><p>{a}</p>{part}<h2>Title here</h2><p>{b}</p></section></div></article>"
    assert html_text.main_text(page, tree) == f"{a}\n\nTitle here\n\n{b}"


@pytest.mark.parametrize("part", ['<div class="related-posts">', '<div id="share-buttons">', '<section class="comment-list">', '<div class="ad-slot box">', '<div class="newsletter-signup-form">'])
def test_html_whole_names_inside_an_article_go(part, prose):
    tree = html_text.train_tree(*html_text.labelled_table())
    a, b = prose(1, 40), prose(2, 30)
    page = f"<article><p>{a}</p>{part}<p>{prose(3, 25)}</p></div></section><p>{b}</p></article>"
    assert html_text.main_text(page, tree) == f"{a}\n\n{b}"


def test_html_linked_names_and_short_pages_stay(prose):
    tree = html_text.train_tree(*html_text.labelled_table())
    a, b = prose(1, 40), prose(2, 30)
    names = '<ul><li><a href="1">Ann</a><li><a href="2">Bob Lee</a><li><a href="3">Cy</a></ul>'
    assert html_text.main_text(f"<article><h1>Names</h1><p>{a}</p>{names}<p>{b}</p></article>", tree).split("\n\n") == ["Names", a, "Ann", "Bob Lee", "Cy", b]
    assert html_text.main_text("<body><p>One short paragraph.</p>", tree) == "One short paragraph."
    assert html_text.main_text("<body><h1>A heading</h1><p>Short.</p>", tree).split("\n\n")[-1] == "Short."


def test_html_odd_pages(spark, prose):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>" * 3000), (4, "u", '<a b="' * 2000), (None, "u", "<!-- open"), (5, "u", "<article>" + prose(3, 20_000)), (6, "u", "<article><p>a<script>x"), (6, "u", "<article><p>a<script>x")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, source string")
    found = {(r["id"], r["url"]): r["text"] for r in html_text.extract(frame).collect()}
    assert found[1, "u"] == found[2, None] == found[3, "u"] == found[4, "u"] == found[None, "u"] == ""
    assert found[5, "u"] == prose(3, 20_000) and found[6, "u"] == "a"
    assert html_text.extract(frame.limit(0)).count() == 0


@pytest.fixture
def pages(spark, prose):
    texts = [prose(k % 7, 10 + 40 * (k % 7)) for k in range(60)] + ["", None, "tiny", "tiny", "é" * 50, "é" * 50, "x" * 99, "x" * 99, "x\r\n\r\nWARC/1.1\r\n" * 20, prose(9, 200_000)]
    rows = [(k, f"http://h/{k}\r\nX: y", t, "e") for k, t in enumerate(texts)] + [(7, "again", texts[7], "e"), (None, "u", "no id", "e")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_warc_round_trip(spark, pages, tmp_path):
    found = warc.lookup(spark, warc.write(pages, str(tmp_path / "w"))).collect()
    rows = [r for r in pages.collect() if r["page_id"] is not None]
    first = {}
    for r in rows:
        data = (r["html"] or "").encode()
        if len(data) >= 100:
            first[data] = min(first.get(data, r["page_id"]), r["page_id"])
    want = []
    for r in rows:
        data = (r["html"] or "").encode()
        again = first.get(data, r["page_id"]) != r["page_id"]
        want.append((r["page_id"], len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else -1))
    assert sorted((r["id"], r["length"], r["digest"], r["type"], -1 if r["refers"] is None else r["refers"]) for r in found) == sorted(want)
    texts = {r["page_id"]: (r["html"] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == (texts[r["id"]] if r["type"] == "response" else b"") for r in found)


def test_warc_index_finds_single_records(spark, pages, tmp_path):
    index = warc.write(pages, str(tmp_path / "w"))
    wanted = spark.createDataFrame([(3,), (64,), (999,)], "id long")
    assert sorted(r["id"] for r in warc.lookup(spark, index, wanted).collect()) == [3, 64]


def test_warc_bundle_is_seekable(spark, pages, tmp_path):
    import zstandard

    warc.write(pages, str(tmp_path / "w"))
    for path in (tmp_path / "w").glob("*.warc.zst"):
        data = path.read_bytes()
        assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
        # Any reader of Zstandard passes over the table and reads the frames one after the other.
        with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
            assert reader.read().startswith(b"WARC/1.1\r\n")


def test_warc_empty_table(spark, pages, tmp_path):
    assert warc.lookup(spark, warc.write(pages.limit(0), str(tmp_path / "w"))).count() == 0


def test_chat_round_trip(spark, prose):
    tricky = ["\\### Assistant: </turn> ok", "\\l \\\\ \\b#<:", "", None, "</turn>\n### user: ", "é😀\n"]
    rows = []
    for c in range(20):
        roles = ["system"] * (c % 2) + ["user", "assistant"] * (1 + c % 3)
        rows += [(c, t, r, tricky[(c + t) % 6], "x") for t, r in enumerate(roles)]
    rows += [(50, 0, "assistant", "first", "x"), (51, 0, "user", "a", "x"), (51, 1, "user", "b", "x"), (52, 0, None, None, "x"), (53, 0, "odd: </turn>", "c", "x")]
    rows += [(60, None, "user", "q", "x"), (60, 0, "assistant", "a", "x"), (60, 0, "assistant", "a", "x"), (70, 0, "user", prose(1, 50_000), "x")]
    # Rows without a conversation are left out.
    frame = spark.createDataFrame([*rows, (None, 0, "user", "no id", "x")], "conv_id long, turn long, role string, text string, id string")
    template = chat_format.Template()
    done = chat_format.read_back(chat_format.format_chats(frame, template), template).collect()
    by = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert {r["id"]: [tuple(t) for t in r["turns"]] for r in done} == by
    for r in done:
        assert r["learned"] == "".join(x for role, x in by[r["id"]] if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
    valid = {r["id"]: r["valid"] for r in done}
    assert all(valid[c] for c in range(20)) and not any(valid[c] for c in (50, 51, 52, 53))
    assert chat_format.format_chats(frame.limit(0), template).count() == 0


def test_chat_template_needs_escaped_marks():
    with pytest.raises(ValueError):
        chat_format.Template(opening="{role}: ")


def brute(rows, k, every):
    whole = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, v in whole.items():
        if q % every == 0:
            scores = sorted((-int(v @ x), i) for i, x in whole.items() if i != q and len(x) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("root_bytes", [mtree.ROOT_BYTES, 300])
def test_mtree_equals_brute_force(spark, root_bytes, monkeypatch):
    monkeypatch.setattr(mtree, "ROOT_BYTES", root_bytes)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(200)]  # equal vectors: ties
    rows += [(2000, None), (2001, [None] * 8), (2010, [float("nan")] * 8), (2020, [float("inf")] + [0.0] * 7), (2030, [0.1] * 3), (2040, [0.2] * 3), (None, [0.1] * 8)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    exact = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    pages = mtree.build_index(frame, shard=300)
    found = mtree.top_k(pages, frame.where("vec_id % 10 = 0"), 5).collect()
    assert sorted(map(tuple, found)) == brute(exact, 5, 10)
    none = frame.limit(0)
    assert mtree.top_k(mtree.build_index(none), none, 5).count() == 0
    assert mtree.top_k(pages, none, 5).count() == 0


def test_mtree_repeated_rows(spark):
    """A query id that comes twice is one query; a candidate id that comes twice is ranked twice."""
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.5, 0.5]), (4, [2.0, 1.0]), (4, [2.0, 1.0]), (5, [1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, mtree.top_k(mtree.build_index(frame), frame.where("vec_id % 10 = 0"), 3).collect()))
    unit = 256 * 256
    assert found == [(10, 1, 4, 2 * unit), (10, 2, 4, 2 * unit), (10, 3, 5, unit), (20, 1, 5, 3 * unit), (20, 2, 4, unit), (20, 3, 4, unit)]


def test_mtree_shards_are_regions_and_far_ones_are_passed_over(spark, monkeypatch):
    rng = random.Random(6)
    centers = [[10.0 * (k == d) for d in range(8)] for k in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centers[i % 8]]) for i in range(1600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    pages = mtree.build_index(frame, shard=100)
    chosen = []
    original = mtree._searched
    monkeypatch.setattr(mtree, "_searched", lambda pages, rows, k: chosen.append(rows.count()) or original(pages, rows, k))
    found = mtree.top_k(pages, frame.where("vec_id % 50 = 0"), 5).collect()
    assert len(found) == 32 * 5
    shards = pages.agg(F.max("shard")).first()[0] + 1
    assert shards >= 8 and sum(chosen) < 0.5 * 32 * shards


def test_mtree_passes_over_far_pages():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([np.floor(rng.normal(c, 2, (500, 4))) for c in (0, 200, 400, 600)])
    pages = {p["page"]: p for p in mtree.build_pages(np.arange(len(vectors)), vectors)}
    tree = mtree.Tree(pages)
    best = tree.search(-1, vectors[1999], 5)
    assert tree.computed < len(vectors) / 2
    scores = vectors @ vectors[1999]
    assert [s for s, _ in best] == sorted(scores.astype(int).tolist(), reverse=True)[:5]


@pytest.fixture(scope="module")
def corpus(spark):
    """Good texts, junk, and toxic texts; the source says something about quality too."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1500):
        text = " ".join(rng.choices(words, k=rng.randint(20, 120))) + "."
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            text = " | ".join(w.upper() + "!!" for w in text.split()[:30])
        if toxic:
            text += " you stupid idiot " + rng.choice(words)
        rows.append((i, text, "en", "junk" if bad and rng.random() < 0.8 else "fine", len(text), "x"))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cotraining_on_held_out_rows(corpus):
    docs, labels = corpus
    found = cotrain.score(docs, cotrain.train(docs, labels, 700, 500)).withColumn("keep", cotrain.accepted())
    rows = [r for r in found.collect() if r["doc_id"] % 2 == 0]
    right = sum(r["keep"] == (r["doc_id"] % 5 != 0 and r["doc_id"] % 7 != 0) for r in rows)
    assert right / len(rows) > 0.95
    assert found.columns[:6] == docs.columns


def test_cotraining_learns_from_all_rows(spark, corpus):
    docs, labels = corpus
    # A word only in unlabelled rows late in the order of hashes, and one only in labelled rows beyond the sample.
    more = docs.crossJoin(spark.range(4)).withColumn("doc_id", 10_000 + F.col("doc_id") * 20 + F.col("id") * 5).drop("id")
    far = more.orderBy(F.xxhash64("doc_id", F.lit(1)).desc()).limit(2000).select("doc_id", F.lit("farword").alias("extra"))
    bad = F.col("text").contains("!! |")
    beyond = labels.orderBy(F.xxhash64("doc_id").desc()).limit(250).select("doc_id", F.lit("restword").alias("extra"))
    rows = docs.union(more).join(far.union(beyond), "doc_id", "left")
    marked = rows.withColumn("text", F.when(bad == (F.col("extra") == "restword"), F.concat_ws(" ", "text", "extra")).otherwise(F.col("text"))).select(*docs.columns)
    model = cotrain.train(marked, labels, 500)
    for word, sign in (("restword", -1), ("farword", 1)):
        _, feature = cotrain.word_features(pa.array([word]))
        assert (model.quality.words[feature] * sign).max() > 0, word


def test_cotraining_odd_rows(spark, corpus):
    docs, labels = corpus
    model = cotrain.train(docs, labels, 700, 500)
    odd = [(None, None, None, None, None, None), (1, "", "", "", 0, ""), (2, " \n", None, "fine", -5, "x"), (3, "w " * 100_000, "en", "fine", 1, "x"), (3, "é|", "xx", "new", 2, "x")]
    frame = spark.createDataFrame(odd, docs.schema)
    scored = cotrain.score(frame, model).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    assert cotrain.score(frame.limit(0), model).count() == 0
    assert cotrain.score(frame.select("doc_id", "text"), model).count() == 5


def test_cotraining_without_labels(corpus):
    docs, labels = corpus
    for none in (labels.limit(0), labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})):
        model = cotrain.train(docs.limit(20), none)
        assert {r["score"] for r in cotrain.score(docs.limit(20), model).collect()} == {0.25}
