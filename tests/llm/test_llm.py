"""The training-data operators next to brute-force versions on small tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

from leadloom.llm import (  # noqa: E402
    collision_dedup,
    common,
    components,
    decontaminate,
    hpylm,
    html_extract,
    langid,
    queries,
    sentencepiece_codec,
    simhash,
    suffix_dedup,
    token_files,
    warc,
)

SF_DIR = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " \t\n", "a", "a b", "One two three four five.", "x" * 5000, "é😀ß 日本 ▁ \x00 z",
    "One two three four five.", "the quick brown fox " * 40, "the quick brown fox " * 40 + "end",
    "ONE TWO three\r\nfour  five.", "ing" * 60 + " tail", "q" + "ing" * 60,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Hostile rows, a null id among them, with columns named like those that operators add."""
    rows = [(i, t, "en", "s", 1, "x", 2) for i, t in enumerate(TEXTS)] + [(None, "a b", None, None,
                                                                          0, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, "
        "bits int"
    )


def joins(frame, key):
    """The kinds of the joins by `key` in the plan of `frame`."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(rf"(\w+Join) \[[^\]]*\b{key}#", plan)


def test_sentencepiece(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    found = sentencepiece_codec.encode_texts(docs, queries.PIECE_MODEL).collect()
    assert len(found) == len(TEXTS) + 1
    for row in found:
        ids = library.encode(row.text or "") + [2]
        assert row.ids == ids and row.decoded == library.decode(ids)


def test_encoder_on_random_text():
    with open(queries.PIECE_MODEL, "rb") as file:
        model = file.read()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.vocabulary(model))
    draw = random.Random(1)
    parts = [" ", "  ", "    ", "a", "th", "ing", "the", " the", "\n", "\t", "é", "日本", "😀", "\x00",
             "▁", ".", "A", "ation", "0", "aaa"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        assert encoder.ids(library.normalize(text)) == library.encode(text), repr(text)


def brute_repeats(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p] += 1
                gone[p + 50] -= 1
        mask = np.cumsum(gone)[: len(raw)] > 0
        left = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        runs = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        out[i] = len(raw), int(mask.sum()), runs, hashlib.sha256(left).hexdigest()
    return out


@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_suffix_dedup(spark, docs, size):
    found = suffix_dedup.digests(suffix_dedup.removed_bytes(
        docs, block_bytes=size, bucket_bytes=size
    )).collect()
    assert len(found) == len(TEXTS) + 1
    want = brute_repeats(list(enumerate(TEXTS)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in found if r.doc_id is not None}
    assert got == want and sum(w[1] for w in want.values())


def test_suffix_dedup_on_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    found = suffix_dedup.digests(
        suffix_dedup.removed_bytes(rows, block_bytes=50_000, bucket_bytes=50_000)
    ).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == brute_repeats([tuple(r) for r in rows.collect()])


def test_suffix_dedup_of_a_phrase_among_many_neighbours(spark):
    """A phrase shorter than a window, between ever new neighbours: no bucket gets all of it."""
    draw = random.Random(3)

    def noise(size):
        return "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=size))

    phrase = "All rights reserved to the author. "
    rows = [(i, noise(60) + phrase + noise(60)) for i in range(300)]
    rows += [(300 + i, noise(20) + rows[7 * i][1][40:130] + noise(9)) for i in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.digests(suffix_dedup.removed_bytes(
               spark.createDataFrame(rows, "doc_id long, text string"),
               block_bytes=9000, bucket_bytes=3000, wide_pieces=20,
           )).collect()}
    want = brute_repeats(rows)
    assert got == want and sum(w[1] for w in want.values()) > 1000

    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t) for _, t in rows)])
    ids = np.arange(len(rows))
    keys, several, pieces = suffix_dedup.block_anchors(ids, raw, starts)
    hot = keys[pieces > 20]
    assert len(hot) and several[pieces > 20].all()
    runs = suffix_dedup.anchor_runs(raw, starts)
    wide = np.isin(runs[0], hot)
    assert len(set(runs[0][wide])) < 40 < wide.sum()
    single = suffix_dedup.single_windows(raw, *runs, wide)
    assert single[2].sum() == runs[2].sum()
    fresh = np.sort(single[0][len(runs[0]) - wide.sum() :])
    cells = [part.stop - part.start for _, part in suffix_dedup.by_bucket(fresh, 16)]
    assert len(cells) == 16 and max(cells) < len(fresh) / 8


def test_suffix_order():
    draw = random.Random(3)
    for alphabet in ("ab", "aab \x00\xff"):
        raw = "".join(draw.choice(alphabet) for _ in range(900)).encode("latin-1")
        wanted = np.array([draw.random() < 0.5 for _ in raw])
        wanted[-60:] = False
        padded = raw + bytes(72)
        got = suffix_dedup.suffix_order(np.frombuffer(raw, np.uint8), wanted)
        keys = [padded[i : i + 56] for i in got]
        assert sorted(got) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)


def test_suffix_order_of_a_text_that_ends_in_one_letter():
    for raw in (b"a" * 200, b"xyz" * 30 + b"-" * 120, b"zb\x00" * 40 + b"\x00" * 80):
        wanted = np.arange(len(raw)) < len(raw) - 49
        got = suffix_dedup.suffix_order(np.frombuffer(raw, np.uint8), wanted)
        keys = [(raw + bytes(72))[i : i + 56] for i in got]
        assert sorted(got) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)


def test_suffix_dedup_looks_at_a_block_as_a_whole(spark):
    """The work of a block does not grow with the number of buckets, nor do its texts get copied."""
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefgh", k=7)) for _ in range(400)]
    rows = [(i, " ".join(draw.choices(words, k=60))) for i in range(60)]
    rows += [(60 + i, rows[i][1][50:300] + "-" * 60 + rows[2 * i][1][9:200]) for i in range(30)]
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    starts = np.cumsum([0, *(len(t) for _, t in rows)])
    keys, firsts, counts = suffix_dedup.anchor_runs(raw, starts)
    sizes = counts + 49
    marks = suffix_dedup.piece_hashes(raw, firsts, sizes)
    order = np.lexsort((marks, keys))
    parts = [c[order] for c in (keys, marks, firsts, sizes)]
    pieces = {raw[a : a + n].tobytes() for a, n in zip(firsts, sizes)}
    assert suffix_dedup.new_pieces(raw, *parts).sum() == len(pieces) < len(keys)
    # hashes that are all equal join no pieces of other bytes
    alike = np.zeros(len(keys), np.uint64)
    fresh = suffix_dedup.new_pieces(raw, alike, alike, *parts[2:])
    assert len(pieces) <= fresh.sum() <= len(keys)
    assert len({raw[a : a + n].tobytes() for a, n in zip(parts[2][fresh], parts[3][fresh])}) == len(pieces)

    for buckets in (300, 1 << 20):
        found = suffix_dedup.digests(suffix_dedup.removed_bytes(
            spark.createDataFrame(rows, "doc_id long, text string"),
            block_bytes=5000, bucket_bytes=buckets,
        )).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
        assert got == brute_repeats(rows)


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    pieces = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in pieces]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def test_simhash(docs):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(TEXTS) + 1
    prints = {i: fingerprint(t) for i, t in enumerate(TEXTS)}
    roots = {}
    for i in prints:  # few rows: walk the links
        reach, todo = {i}, [i]
        while todo:
            a = todo.pop()
            near = {b for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2} - reach
            reach |= near
            todo += near
        roots[i] = min(reach)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in found if r.doc_id is not None}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def test_simhash_links_are_complete(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 300, dtype=np.uint64)
    bits = [base]
    for flips in (1, 2, 3):
        near = base.copy()
        for row in range(len(near)):
            for bit in draw.choice(64, flips, replace=False):
                near[row] ^= np.uint64(1) << np.uint64(bit)
        bits.append(near)
    every = np.unique(np.concatenate(bits))
    frame = spark.createDataFrame([(int(b),) for b in every.view(np.int64)], "bits long")
    got = {(r.u, r.v) for r in simhash.links(frame).collect()}
    signed = every.view(np.int64)
    want = set()
    for i, b in enumerate(every):
        for j in np.flatnonzero(np.bitwise_count(every ^ b) <= 2):
            if signed[i] < signed[j]:
                want.add((int(signed[i]), int(signed[j])))
    assert got == want and len(want) >= 600


def test_simhash_guests_are_not_broadcast(spark, docs):
    """Each fingerprint goes to dozens of anchors, but Spark counts one row."""
    few = spark.range(100).select(F.xxhash64("id").alias("bits"))
    assert joins(simhash.links(few), "anchor") == ["SortMergeJoin"]
    assert joins(simhash.near_duplicates(docs), "bits") == ["SortMergeJoin"]


def test_pipeline_dedup_broadcasts_no_guests(spark, docs, monkeypatch):
    import corpus_pipeline

    found = simhash.near_duplicates(docs).collect()
    kinds = []

    def walked(links):
        kinds.extend(joins(links, "anchor"))
        return components.components(links)

    monkeypatch.setattr(simhash, "components", walked)
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF_DIR).collect()
    assert kinds == ["SortMergeJoin"]
    assert {r.doc_id for r in kept} == {
        r.doc_id for r in found if r.doc_id is None or r.doc_id == r.component_id
    }


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, n) for n in range(101, 300)]
    edges += [(draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(250)]
    rows = edges + edges[:5] + [(7, 7), (None, 3)]
    frame = spark.createDataFrame(rows, "u long, v long")
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(frame).collect()}
    ends = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in ends}
    assert components.components(frame.limit(0)).count() == 0


def test_warc(spark):
    big = "ö" * 600_000
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "u\nv", big), (4, "http://b/", big),
            (5, "http://b/", "x"), (None, "http://c/", big), (4, "http://b/", big), (6, "", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in warc.archive_round_trip(frame).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == big and page != 4
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(),
                     "revisit" if again else "response", 4 if again else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    empty = warc.archive_round_trip(frame.limit(0))
    assert empty.count() == 0


def test_warc_chunks_hold_the_payload(spark, tmp_path):
    html = "".join(chr(97 + i % 26) for i in range(700_000))
    frame = spark.createDataFrame([(9, "http://a/", html)], "page_id long, url string, html string")
    files = warc.write_archives(warc.payload_chunks(frame), f"file://{tmp_path}/warc")
    rows = sorted(warc.read_archives(files).collect(), key=lambda r: r.chunk_no)
    assert [r.chunk_no for r in rows] == [0, 1, 2]
    assert b"".join(bytes(r.body) for r in rows).decode() == html
    assert rows[0].payload_digest == hashlib.sha1(bytes(rows[0].body)).hexdigest()


@pytest.mark.parametrize("block, run", [(4 << 20, 4096), (64, 3)])
def test_token_counts(docs, monkeypatch, block, run):
    monkeypatch.setattr(token_files, "BLOCKS_TO_RUN", run)
    with open(queries.BYTE_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding(
        "own", pat_str=queries.byte_pattern(), mergeable_ranks=ranks, special_tokens={}
    )
    found = token_files.count_tokens(
        docs, queries.BYTE_RANKS, queries.byte_pattern(), queries.BYTE_END, block_bytes=block
    ).collect()
    want = Counter(
        (i, len(encoding.encode_ordinary(t or "")))
        for i, t in [*enumerate(TEXTS), (None, "a b")]
    )
    assert Counter(map(tuple, found)) == want
    assert token_files.count_tokens(
        docs.limit(0), queries.BYTE_RANKS, queries.byte_pattern(), queries.BYTE_END
    ).count() == 0


def test_documents_of_token_files_are_not_broadcast(docs):
    """Spark goes by the compressed files: in them a path, or a row of like gaps, takes a few bytes."""
    found = token_files.count_tokens(
        docs, queries.BYTE_RANKS, queries.byte_pattern(), queries.BYTE_END
    )
    assert joins(found, "number") == ["SortMergeJoin"]
    assert set(joins(found, "block")) == {"SortMergeJoin"}


def test_html():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>"
        "<nav><ul><li><a href=/x>menu</a></li></ul></nav><div class='ad'>buy</div>"
        "<article><h1>A  title</h1><p><b>First &amp; foremost, a longer line of text here.<br>"
        "<p>Yes.</p><p>Another long paragraph\nwith more than enough words in it.</p></article>"
        "<div id=comments><p>A reader comment that is quite long, too long even.</p></div>"
        "<footer>&copy; all</footer>"
    )
    assert html_extract.main_text(page) == (
        "A title First & foremost, a longer line of text here. Yes. "
        "Another long paragraph with more than enough words in it."
    )
    for empty in (None, "", "   ", "<nav>only a menu</nav>", "<script>var a = '<p>x</p>'"):
        assert html_extract.main_text(empty) == ""


LONG = ["".join(f"word{i}{j} " for j in range(70)).strip() for i in range(6)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_html_parts_within_an_article():
    title, last = "A headline of thirty letters!!", "A last paragraph, forty letters long...."
    nav = "<nav><a href=/>home</a><a href=/x>more</a></nav>"
    page = f"{nav}<article><h1>{title}</h1><div class=share>Share it</div>{paragraphs(LONG[:4])}"
    assert html_extract.main_text(page + "</article>") == " ".join([title, *LONG[:4]])
    page = f"<article>{paragraphs(LONG[:5])}<div class=advert>Buy</div><p>{last}</p></article>"
    assert html_extract.main_text(page) == " ".join([*LONG[:5], last])
    page = f"<main><h1>{title}</h1><article>{paragraphs(LONG)}</article></main>"
    assert html_extract.main_text(page) == " ".join([title, *LONG])


def test_html_teasers_and_pages_without_article():
    teaser = "<article><h3><a href=/t>Another story</a></h3><p>A few words of it.</p></article>"
    page = f"<div><h1>Title</h1>{paragraphs(LONG)}</div><div class=ad>Buy</div>{teaser}"
    assert html_extract.main_text(page) == " ".join(["Title", *LONG])
    page = f"<h1>Title</h1><div class=share>Share</div>{paragraphs(LONG[:3])}<div class=ad>Buy" \
           f"</div><p>Short.</p><div class=ad>Buy</div>{paragraphs(LONG[3:])}"
    assert html_extract.main_text(page) == " ".join(["Title", *LONG[:3], "Short.", *LONG[3:]])


@pytest.mark.parametrize("name", [
    "content-sidebar-wrap", "no-sidebar", "elementor-widget", "post-header", "has-comments",
    "post category-social", "sidebar", "widget",
])
def test_html_wrappers_named_like_parts(name):
    body = paragraphs(LONG)
    for page in (f"<div class='{name}'><article>{body}</article></div>",
                 f"<article class='{name}'>{body}</article><p>Rest</p>",
                 f"<div id='{name}'>{body}</div><p>Rest</p>"):
        assert html_extract.main_text(page).startswith(" ".join(LONG)), page[:60]
    # parts beside the article still go
    for part in ("cookie-notice", "sidebar", "share-buttons", "comments", "ad"):
        page = f"<article>{body}</article><div class='{part}'>{paragraphs(LONG[:2])}</div>"
        assert html_extract.main_text(page) == " ".join(LONG)


def test_html_table(spark):
    frame = spark.createDataFrame(
        [(1, None, "old"), (2, "<p>A line of text.", None)], "page_id long, html string, text string"
    )
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert got == {1: "", 2: "A line of text."}


def test_language(spark, docs):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.col("doc_id") % 2 == 1
    model = langid.fit(documents.where(~held))
    found = langid.identify(documents.where(held), model, host=F.col("source"))
    total = found.count()
    right = found.where("language = lang").count()
    assert right >= 0.99 * total and found.where("accepted").count() >= 0.99 * total
    odd = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(odd) == len(TEXTS) + 1
    for i in (0, 1, 2):
        assert odd[i].language is None and not odd[i].accepted
    assert langid.identify(docs.limit(0), model).count() == 0
    assert odd[3].language
    none = langid.identify(docs, langid.fit(docs.limit(0)))
    assert none.where("accepted").count() == 0


def test_language_evidence(spark):
    """Short texts go with their host."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(documents)
    rows = documents.select(F.col("text"), F.col("lang").alias("host"))
    short = spark.createDataFrame([("on", "fr"), ("on", "en")], "text string, host string")
    both = rows.unionByName(short)
    found = langid.identify(both, model, host=F.col("host")).where("text = 'on'")
    assert {r.host: r.language for r in found.collect()} == {"fr": "fr", "en": "en"}


def test_decontamination(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    extra = spark.createDataFrame(
        [(900, None), (901, ""), (902, "one two"), (None, "x y z w v u")],
        "item_id long, text string",
    )
    more = spark.createDataFrame(
        [(90001, "ONE two!"), (90002, None), (None, "one two"), (90003, "")],
        "doc_id long, text string",
    )
    all_items = items.select("item_id", "text").unionByName(extra)
    all_docs = documents.select("doc_id", "text").unionByName(more)

    def pieces(text):
        words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    wanted = {r.item_id: pieces(r.text) for r in all_items.collect() if r.item_id is not None}
    want = {}
    for row in all_docs.collect():
        own = pieces(row.text)
        for item, parts in wanted.items():
            if row.doc_id is not None and parts and len(parts & own) >= 0.8 * len(parts):
                want[row.doc_id, item] = len(parts & own)
    found = decontaminate.contained_items(all_docs, all_items).collect()
    assert {(r.doc_id, r.item_id): r.n_shared for r in found} == want and len(want) > 10
    assert decontaminate.contained_items(all_docs, all_items.limit(0)).count() == 0


def test_embeddings(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((150, 32))
    rows = []
    for i, vector in enumerate(base):
        for _ in range(int(draw.integers(1, 5))):
            noise = draw.standard_normal(32) * draw.choice([0.0, 0.05, 0.2, 0.4])
            rows.append((len(rows), (vector + noise).astype(np.float32).tolist()))
    hub = draw.standard_normal(32)
    rows += [(len(rows) + k, (hub + draw.standard_normal(32) * 0.1).astype(np.float32).tolist())
             for k in range(60)]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [None] * 32),
           (9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, [float("inf")] * 32)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = {r.vec_id: r for r in collision_dedup.near_duplicates(frame, cell_vectors=16).collect()}
    assert len(found) == len(rows) + len(odd)
    units = np.array([v for _, v in rows], np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    linked = (units @ units.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    got = np.array([found[i].n_links for i, _ in rows])
    assert (got <= linked.sum(axis=1)).all() and got.sum() >= 0.9 * linked.sum()
    assert found[9005].n_links == 1 and found[9006].component_id == 9005
    for i in (9000, 9001, 9002, 9003, 9004, 9007):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)


def test_language_model(spark, docs):
    fold = F.coalesce(F.col("doc_id") % 3 != 2, F.lit(True))
    found = hpylm.score(docs, fold).collect()
    assert len(found) == len(TEXTS) + 1
    tokens = {i: (t or "").encode().lower().split() + [None]
              for i, t in [*enumerate(TEXTS), (None, "a b")]}
    counts = Counter(w for i, ws in tokens.items() if i is None or i % 3 != 2 for w in ws)
    total, words = sum(counts.values()), len(counts)
    for row in found:
        own = tokens[row.doc_id]
        assert row.n_tokens == len(own) and row.train_tokens == total
        assert row.n_known == sum(counts[w] > 0 for w in own)
        base = sum(np.log10((counts[w] + 1) / (total + words + 1)) for w in own)
        assert abs(row.base_score - base) < 1e-6 * abs(base) and row.score < 0
    assert hpylm.score(docs.limit(0), fold).count() == 0
    assert all(r.train_tokens == 0 for r in hpylm.score(docs, F.lit(False)).collect())


def test_language_model_keeps_no_rows_of_past_steps(spark, docs, tmp_path, monkeypatch):
    """What only earlier steps read is gone when the scores are asked for: rows and shuffle files."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, numbers, write, cleaned = spark.conf.get(setting), itertools.count(), common.stored, []
    monkeypatch.setattr(
        common, "shared_folder", lambda _, purpose: f"{tmp_path}/{purpose}-{next(numbers)}"
    )

    def watched(frame, purpose):
        cleaned.append(spark.conf.get(setting))
        return write(frame, purpose)

    monkeypatch.setattr(common, "stored", watched)
    scored = hpylm.score(docs, F.lit(True))
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert left == {"lm-blocks", "lm-words", "lm-entries"}
    assert scored.count() == scored.distinct().count() == len(TEXTS) + 1
    assert set(cleaned) == {"true"} and spark.conf.get(setting) == before


def test_language_model_is_a_distribution():
    """Over all words and one unseen, behind a context and without."""
    draw = np.random.default_rng(0)
    words = np.sort(draw.integers(0, 2**63, 50, dtype=np.uint64))
    home = np.repeat(np.arange(50), 3)
    context = np.tile([0, 1, 2], 50)
    customers = draw.integers(0, 40, 150) * (draw.random(150) < 0.7)
    customers[::3] += 1
    bucket = hpylm.Bucket(words, np.zeros(50), home, context, customers)
    followers = np.array([customers[context == 1].sum(), customers[context == 2].sum()])
    shared = hpylm.Restaurants(50, int(customers.sum()), words[:2], followers, (0.6, 0.4), [])
    seating = hpylm.Seating(bucket, shared, 0)
    for _ in range(4):
        history = seating.totals()
        root = seating.root_probability(history)
        unseen = seating.unseen_probability(history)
        assert abs(root.sum() + unseen - 1) < 1e-9
        for c in (1, 2):
            of = context == c
            own = np.maximum(customers[of] - 0.6 * seating.tables[of], 0)
            spare = hpylm.CONTEXT_STRENGTH + 0.6 * history[0][c]
            inner = (own + spare * root) / (hpylm.CONTEXT_STRENGTH + followers[c - 1])
            rest = spare * unseen / (hpylm.CONTEXT_STRENGTH + followers[c - 1])
            assert abs(inner.sum() + rest - 1) < 1e-9
        seating.sweep(history)


def test_language_model_beats_its_base(spark):
    found = queries.op1_pitman_yor(spark, "/root/testdata/sf0.01").where("held_out")
    better = found.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert better.s > better.b


def test_language_model_has_rare_contexts(spark):
    """Words far below one token in 4096 are contexts too, in one bucket as in many."""
    pairs = [(i, f"a{i} b{i}") for i in range(3000)] * 2
    asked = [(3000 + i, f"a{i} b{i if i % 2 else i + 10}") for i in range(100)]
    rows = spark.createDataFrame(pairs + asked, "doc_id long, text string")
    found = hpylm.score(rows, F.col("doc_id") < 3000).where("held_out").collect()
    assert all(r.n_known == 3 for r in found)
    seen = [r.score for r in found if r.doc_id % 2]
    unseen = [r.score for r in found if r.doc_id % 2 == 0]
    assert len(seen) == len(unseen) == 50 and min(seen) > max(unseen) + 1


def test_language_model_in_many_buckets():
    """Behind every context, over all words and one unseen, when cells and buckets share the work and
    hot words are dealt out."""
    cells, buckets = 5, 3
    draw = np.random.default_rng(1)
    vocabulary = hpylm.mix(np.arange(40, dtype=np.uint64))

    def block(number, texts, held):
        sizes = np.array([len(t) + 1 for t in texts])
        words, word = np.unique(
            np.concatenate([np.append(t, hpylm.END) for t in texts]), return_inverse=True
        )
        return {"block": number, "words": hpylm.pack_sorted(words), "tokens": hpylm._u32(word),
                "sizes": hpylm.pack(sizes), "held": hpylm.pack(np.full(len(sizes), held, np.uint8))}

    def step(rows, function):
        groups = {}
        for row in rows:
            groups.setdefault(row["place"], []).append(row)
        return [r for place, own in groups.items() for r in function(
            (hpylm.pa.scalar(place),), hpylm.pa.Table.from_pylist(own, hpylm._SCHEMA)
        ).to_pylist()]

    def kind(rows, *names):
        return [r for r in rows if r["kind"] in names]

    # the last word is never seen
    known = vocabulary[:-1]
    texts = [known[np.minimum(draw.zipf(1.3, draw.integers(0, 30)) - 1, 38)] for _ in range(200)]
    blocks = [block(i, texts[50 * i : 50 * i + 50], 0) for i in range(4)]
    blocks.append(block(9, [vocabulary[[u, w]] for u in range(40) for w in range(40)], 1))
    trained = Counter(w for t in texts for w in [*t.tolist(), int(hpylm.END)])
    hot = np.sort(np.array([w for w, n in trained.items() if n > 100], np.uint64))
    assert 0 < len(hot) < len(trained)
    asked = [r for b in blocks for r in hpylm.entry_rows(b, hot, cells)]
    merged = step(asked, hpylm.merge_cells(buckets))
    words = step(kind(merged, "busy"), hpylm.make_buckets(buckets))
    contexts = step(kind(merged, "single") + kind(words, "link"), hpylm.make_contexts)
    shared = hpylm.Restaurants(len(trained), sum(trained.values()), None, None, (0.6, 0.4))
    target = [{"kind": "target", "place": r["source"], "source": r["place"],
               "x": len(r["a"]) / 8} for r in kind(words, "link")]
    seats, sums = [], []
    for sweep in range(hpylm.BURN_IN + hpylm.SAMPLES + 1):
        before = kind(seats[-1], "seats") + kind(sums[-1], "sum") if sweep else []
        seats.append(step(kind(words, "bucket") + target + before,
                          hpylm.sweep_buckets(sweep, shared, buckets)))
        own = kind(seats[-1], "seats")
        shared.swept.append((None, sum(r["x"] for r in own), sum(r["y"] for r in own)))
        sums.append(step(contexts + kind(seats[-1], "tables"), hpylm.sum_contexts))

    def tagged(frames, name):
        return [r | {"source": i} for i, f in enumerate(frames[hpylm.BURN_IN + 1 :])
                for r in kind(f, name)]

    tables = step(kind(words, "seat") + tagged(seats, "seats"), hpylm.sampled_tables)
    answers = step(kind(merged, "index", "counts") + tables, hpylm.answer_entries(shared))
    answers += step(
        [r for b in blocks for r in hpylm.word_rows(b, buckets)] + kind(words, "bucket")
        + tagged(seats, "seats") + kind(contexts, "context") + tagged(sums, "total"),
        hpylm.answer_words(shared),
    )
    row = blocks[-1]
    every, word, sizes = hpylm._block(row)
    _, home, context, _ = hpylm.arrange(every, word, sizes, hot, cells)
    own = sorted((r for r in answers if r["source"] == 9), key=lambda r: r["place"])
    count, chance = hpylm.probabilities(
        {n: kind(own, n) for n in ("entries", "words")}, home, context, shared
    )
    assert count.tolist() == [trained[int(w)] for w in every]
    # each of the 40 words follows each, and the end follows each
    spread = np.bincount(context, chance, len(every))
    # an unseen word stands for all of them, as do known words that were not drawn
    missing = int((count == 0).sum())
    least = np.array([chance[(context == c) & (count[home] == 0)].min() for c in range(len(every))])
    behind = every != hpylm.END
    assert np.allclose((spread - (missing - 1) * least)[behind], 1, atol=1e-5)
    assert (chance > 0).all()


def test_registered_queries(spark):
    """Every query runs over its table; the pipeline keeps what is clean."""
    import corpus_pipeline

    count = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for name in ("op2_suffix_dedup", "op7_simhash", "op8_language_id", "op10_token_counts"):
        assert queries.QUERIES[name](spark, SF_DIR).count() == count
    out = corpus_pipeline.run(spark, SF_DIR)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert corpus_pipeline.language_id(spark, docs, SF_DIR).count() == count
    copies = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id <> component_id")
              .collect()}
    found = decontaminate.contained_items(
        suffix_dedup.without_repeats(docs.where(~F.col("doc_id").isin(list(copies)))),
        spark.read.parquet(f"{SF_DIR}/benchmark.parquet"),
    )
    leaks = {r.doc_id for r in found.collect()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept == every - copies - leaks
    assert out.where("text <> decoded").count() == 0


def test_rows_of_the_language_model_are_compressed_where_they_are_made(spark):
    """Blocks leave their task compressed and come back as they were."""
    rows = spark.createDataFrame(
        [(i, "one word after the other word " * 400, True) for i in range(50)],
        "doc_id long, text string, train boolean",
    )
    blocks = [r.asDict() for r in hpylm.block_rows(rows, "train").collect()]
    tokens = 50 * (6 * 400 + 1)
    assert sum(len(b["tokens"]) for b in blocks) < tokens
    whole = [{k: bytes(v) if isinstance(v, bytearray) else v for k, v in b.items()} for b in blocks]
    assert sum(len(hpylm.loosened(b)["tokens"]) for b in whole) == 4 * tokens
    row = {"block": 3, "a": b"", "b": bytes(9), "c": None}
    assert hpylm.loosened(hpylm.squeezed(row)) == row
