"""Fingerprints, BPE, HTML text and quality, each against a plain calculation."""

import hashlib
import random
import tracemalloc
import zlib

import public_tokenizers
import pytest
import tiktoken

from flowquarry.llm import bpe, fingerprints, html_text, quality
from helpers import documents, words

ODD = ["", None, "a", "é" * 3, "x " * 4000, "\n\n", "漢字🙂 mixed\ttext", "tie", "tie"]


def test_fingerprint_likeness():
    a, b = " ".join(words(400, 1)), " ".join(words(400, 2))
    fa, fb = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    fe = fingerprints.fingerprint(fingerprints.edited(a, b))
    assert fingerprints.likeness(fa, fa) == 1 and fingerprints.likeness(fa, fb) < 0.15 < 0.35 < fingerprints.likeness(fa, fe) < 0.7
    assert fingerprints.likeness(fa, fe) == fingerprints.likeness(fe, fa)
    assert fingerprints.fingerprint("") == fingerprints.fingerprint(None) and fingerprints.likeness("0:::", fa) == 0
    shifted = fingerprints.fingerprint("new words at the start " + a)
    assert fingerprints.likeness(fa, shifted) > 0.8


def test_common_subsequence():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints._common(a, b) == table[-1][-1]


def test_compare_with_next(spark):
    texts = [(i, " ".join(words(40 + i % 7, i))) for i in range(0, 180, 3)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    random.Random(1).shuffle(texts)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(documents(spark, texts).repartition(3)).collect()}
    order = sorted(texts, key=lambda x: -x[0])
    assert len(got) == len(texts)
    for (i, text), (_, nxt) in zip(order, order[1:] + order[:1]):
        text, nxt = text or "", nxt or ""
        half = len(text) // 2
        new = text[:len(text) - half] + nxt[:half]
        mark, new_mark = fingerprints.fingerprint(text), fingerprints.fingerprint(new)
        assert tuple(got[i])[1:] == (len(text), hashlib.sha256(new.encode()).hexdigest(), mark, new_mark,
                                     fingerprints.likeness(mark, new_mark),
                                     fingerprints.likeness(mark, fingerprints.fingerprint(nxt)))


def test_compare_with_next_edges(spark):
    assert fingerprints.compare_with_next(documents(spark, [])).count() == 0
    assert fingerprints.compare_with_next(documents(spark, ["only one"])).first().near_next == 1
    assert fingerprints.compare_with_next(documents(spark, [(None, "a"), (3, "b"), (3, "b"), (None, None)])).count() == 4


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.MergeReplay(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(coder):
    mine, library = coder
    r = random.Random(3)
    texts = ["".join(r.choice("aab  \n\t'st1½éß漢🙂́ \x1f\x85!?_-\r　") for _ in range(r.randrange(40))) for _ in range(1500)]
    texts += [" ".join(words(300, i)) for i in range(5)] + ["a" * 3000, " " * 50 + "x"]
    for text, ids in zip(texts, mine.encode(texts)):
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(text)
        assert mine.decode(ids).decode() == text


def test_bpe_earlier_merge_after_later_one():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 299, b"bcx": 301, b"bcbc": 298}
    mine = bpe.MergeReplay(ranks, r"\S+|\s+")
    library = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcbcx", "bcbcbc", "abcabcx", "xbcbcabcbc"):
        assert list(memoryview(mine.encode([text])[0]).cast("I")) == library.encode_ordinary(text)


def test_bpe_keeps_what_it_knows_in_columns(coder):
    """Words met before take about their own bytes and ids, not objects of their own."""
    mine = bpe.MergeReplay(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = [" ".join(f"{''.join(chr(97 + (i * 7919 + j * j * 31 + i // 26 ** j) % 26) for j in range(8))}" for i in range(k, k + 500)) for k in range(0, 60_000, 500)]
    tracemalloc.start()
    try:
        for at in range(0, len(texts), 10):
            for text, ids in zip(texts[at:at + 10], mine.encode(texts[at:at + 10])):
                assert at % 50 or list(memoryview(ids).cast("I")) == coder[1].encode_ordinary(text)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 12_000_000


def test_bpe_table(spark, coder):
    texts = [" ".join(words(50, i)) for i in range(20)] + ODD
    got = {r.doc_id: r for r in bpe.encode(documents(spark, texts), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                           public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = coder[1].encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode(documents(spark, []), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><header><h2>Site name</h2></header>
<div class="cookie-notice"><p>We use cookies, please agree to all of them now.</p></div>
<div class="post"><h1>Title &amp; more</h1><p><b>First   part<br>goes on for a while, with <a href=x>a link</a> in it.
<p title="x>y">Second part &lt;here&gt; is 5 < 6 and long enough to count.</p><form><input><button>Send</button></form></div>
<aside>Side text</aside><div id="comments"><p>I think this is a very good article, thank you!</p></div><footer>&copy; end</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == ("Title & more\nFirst part goes on for a while, with a link in it.\n"
                                         "Second part <here> is 5 < 6 and long enough to count.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<article></article>") == ""
    assert html_text.main_text("just words") == "just words"
    deep = "<div>" * 5000 + "deep words" + "</div>" * 5000
    assert html_text.main_text(deep) == "deep words"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "old"), (None, "u", "<p>x", "old")],
                                  "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {1: html_text.main_text(PAGE), 2: "", None: "x"}


def test_quality_held_out(spark):
    good = [" ".join(words(60, i)) for i in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in words(60, 1000 + i)) for i in range(300)]
    texts = [x for pair in zip(good, bad) for x in pair]
    docs = documents(spark, texts + ["", None])
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    rows = docs.select("doc_id", quality.held_out().alias("out"), quality.score(docs, model).alias("score")).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 602
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hits = [(r.score >= 0.3) == (r.doc_id % 2 == 0) for r in rows if r.out and r.doc_id < 600]
    assert len(hits) > 80 and sum(hits) >= 0.97 * len(hits)


def test_quality_without_labels(spark):
    docs = documents(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert [round(r[0], 6) for r in docs.select(quality.score(docs, model)).collect()] == [0.5, 0.5]
    only = quality.fit(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert docs.select(quality.score(docs, only)).first()[0] > 0.99
