"""Decontamination, near copies and line dedup, each against a plain calculation or the SQL twin."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from flowquarry.llm import common, decontaminate, line_dedup, minmax_dedup, oracles
from helpers import by_id, documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_contamination(spark):
    r = random.Random(4)
    items = [(i, " ".join(words(n, 500 + i, 60))) for i, n in enumerate([25, 12, 10, 4, 2, 1, 0, 10])]
    items += [(20, None), (21, items[0][1]), (None, items[1][1])]
    texts = []
    for i in range(60):
        w = words(80, i, 60)
        if i % 3 == 0:
            source = (items[r.randrange(5)][1] or "").split()
            w[30:30] = [x.upper() for x in source[r.randrange(2):]]
        texts.append(" ,".join(w) + ".")
    texts += ["", None, items[0][1], items[3][1], items[0][1], "w1", "É1 é1 " * 9]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.contamination(documents(spark, texts), bench))
    assert len(got) == len(texts)
    for d, text in enumerate(texts):
        w, hit, found = _split(text), set(), set()
        for item, passage in items:
            p = _split(passage)
            k = min(10, len(p))
            wins = {tuple(p[i:i + k]) for i in range(len(p) - k + 1)} if p else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wins:
                    hit.update(range(i, i + k))
                    found.add(item)
        listed = sorted(str(i) for i in found if i is not None)
        row = got[d]
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (len(w), len(hit), len(listed), bool(hit))
        assert row.items_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
    kept = {r.doc_id for r in decontaminate.without_contaminated(documents(spark, texts), bench).collect()}
    assert kept == {d for d in got if not got[d].contaminated}


def test_contamination_in_blocks_and_empty(spark, monkeypatch):
    docs = documents(spark, [" ".join(words(60, i, 30)) for i in range(20)])
    bench = spark.createDataFrame([(1, " ".join(words(60, 3, 30)))], "item_id long, text string")
    whole = sorted(decontaminate.contamination(docs, bench).drop("k1", "k2").collect())
    monkeypatch.setattr(decontaminate, "BLOCK_ROWS", 20)
    assert sorted(decontaminate.contamination(docs, bench).drop("k1", "k2").collect()) == whole
    assert sum(r.contaminated for r in whole) == 1
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def _components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_copies(spark):
    r, texts = random.Random(9), []
    base = words(150, 77)
    for i in range(60):  # a large group whose members differ from each other about as much as from the threshold
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"z{r.randrange(1000)}"
        texts.append(" ".join(w))
    chain = words(200, 78)
    for i in range(15):  # a chain: neighbours are linked, ends are not
        chain = chain[4:] + words(4, 600 + i)
        texts.append(" ".join(chain))
    texts += [" ".join(words(100, i)) for i in range(30)]
    texts += ["", None, "one", "One", "one two", "one two", "a b c", "a\tb\nc d", texts[0].upper()]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = by_id(minmax_dedup.components(documents(spark, rows), k=3, percent=85))
    want = _components(rows, 3, 85)
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == want
    assert all(g.kept == (i == g.component_id) for i, g in got.items())


def test_near_copies_in_rounds(spark, monkeypatch):
    """All documents in one bucket and few of a group compared in full: no link may be lost."""
    monkeypatch.setattr(minmax_dedup, "CLOSED", 4)
    monkeypatch.setattr(minmax_dedup, "LATER", 4)
    monkeypatch.setattr(minmax_dedup, "signatures", lambda d, k, b, f=minmax_dedup.signatures: f(d, k, b).withColumn(
        "buckets", F.array(F.lit(1).cast("long"))))
    base, texts = words(60, 5), []
    for i in range(14):
        texts.append(" ".join(base[:20 + 3 * i] + words(3, 100 + i)))
    got = by_id(minmax_dedup.components(documents(spark, texts), k=1, percent=85))
    want = _components(list(enumerate(texts)), 1, 85)
    assert 1 < len({c for _, c in want.values()}) < 14
    assert {i: g.component_id for i, g in got.items()} == {i: c for i, (_, c) in want.items()}
    r = random.Random(3)
    # variants of variants, of several sizes
    texts = [base]
    for i in range(30):
        w = list(texts[r.randrange(len(texts))])
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(len(w))
            w[at:at + r.randrange(3)] = words(r.randrange(3), 900 + r.randrange(6))
        texts.append(w)
    texts = [" ".join(w) for w in texts]
    got = by_id(minmax_dedup.components(documents(spark, texts), k=1, percent=85))
    want = _components(list(enumerate(texts)), 1, 85)
    assert 1 < len({c for _, c in want.values()})
    assert {i: g.component_id for i, g in got.items()} == {i: c for i, (_, c) in want.items()}


def test_near_copies_stage_and_edges(spark):
    texts = [" ".join(words(80, 1)), " ".join(words(80, 1)), "", None, " ".join(words(80, 2))]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])])
    assert sorted(r.doc_id for r in minmax_dedup.deduplicate(docs).collect()) == [0, 0, 2, 3, 4]
    assert minmax_dedup.deduplicate(docs).columns == docs.columns
    assert minmax_dedup.components(docs.limit(0)).count() == 0


def test_variants_of_one_text_take_few_turns(spark, monkeypatch):
    """300 variants, most of them not similar to each other: exact, and the number of turns does not follow the group's size."""
    turns, inner = [], minmax_dedup._pairs
    monkeypatch.setattr(minmax_dedup, "_pairs", lambda *a: (turns.append(1), inner(*a))[1])
    r, base, texts = random.Random(4), words(150, 3), []
    for _ in range(300):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    got = by_id(minmax_dedup.components(documents(spark, texts), k=3, percent=85))
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == _components(list(enumerate(texts)), 3, 85)
    assert len(turns) <= 3


def test_variants_far_from_each_other_are_not_compared(spark, monkeypatch):
    """Variants that lack the same few shingles of one text but can't be similar: a few pairs a variant, and no link lost."""
    compared, inner = [], minmax_dedup._pairs

    def counted(*a):
        pairs, stars = inner(*a)
        compared.append(pairs.where("NOT star").count())
        return pairs, stars
    monkeypatch.setattr(minmax_dedup, "_pairs", counted)
    r, base, texts = random.Random(8), words(150, 3), []
    for i in range(240):
        w = list(base)
        for at in r.sample(range(150), 2 if i % 6 == 0 else r.randrange(5, 9)):
            w[at] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(minmax_dedup, "signatures", lambda d, k, b, f=minmax_dedup.signatures: f(d, k, b).withColumn(
        "buckets", F.array(F.lit(1).cast("long"))))  # one bucket for all
    got = by_id(minmax_dedup.components(documents(spark, texts), k=3, percent=85))
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == _components(list(enumerate(texts)), 3, 85)
    assert len(compared) > 1 and sum(compared) < 10 * len(texts)


def test_connected(spark):
    edges = [(bytes([a]), bytes([b])) for a, b in [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]]
    got = {r.node[0]: r.root[0] for r in minmax_dedup.connected(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    minmax_dedup.FEW_EDGES, held = 0, minmax_dedup.FEW_EDGES  # the way for many edges gives the same
    try:
        assert got == {r.node[0]: r.root[0] for r in minmax_dedup.connected(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    finally:
        minmax_dedup.FEW_EDGES = held
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_minmax_bands_miss_bound():
    b = minmax_dedup.bands_for(0.85)
    assert (1 - 0.85**4)**b <= minmax_dedup.MISS
    h = minmax_dedup.MinMax(500, rows=1)
    a, b = minmax_dedup.shingle_set(" ".join(words(400, 1)), 1), minmax_dedup.shingle_set(" ".join(words(200, 1) + words(150, 2)), 1)
    j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((h.buckets(a) == h.buckets(b)).mean() - j) < 0.08


def _lines(n, seed, size=8):
    return [" ".join(words(size, seed * 1000 + i)) for i in range(n)]


def test_line_dedup_like_sql(spark):
    r, texts = random.Random(2), []
    passage, header, long = _lines(9, 1), "All rights reserved.", " ".join(words(70, 9))
    for i in range(40):
        lines = [header] + _lines(r.randrange(1, 12), 50 + i)
        if i % 3 == 0:
            at = r.randrange(1, len(lines) + 1)
            lines[at:at] = passage
        if i % 4 == 0:
            lines.append(long)
        texts.append("\n".join(lines))
    texts += [texts[1], texts[2].replace("w1", "v1"), "", "\n\n", "x", "x"]
    docs = documents(spark, texts)
    got = by_id(line_dedup.deduplicate(docs))
    want = _sql(texts)
    assert {i: (i, g.n_removed, hashlib.sha256(g.text.encode()).hexdigest()) for i, g in got.items()} == want
    for i in range(3, 40, 3):
        assert not any(line in got[i].text.split("\n") for line in passage), i
    assert all(line in got[0].text for line in passage)
    assert all(header in got[i].text for i in range(40)) and got[1].text == texts[1]
    assert sum(long in got[i].text for i in range(40)) == 1


def _sql(texts):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    return {r[0]: (r[0], r[1], r[3]) for r in db.execute(oracles.OP5).fetchall()}


def test_line_dedup_edges(spark):
    twice = "\n".join(_lines(6, 3))
    docs = documents(spark, [(None, twice), (4, twice), (4, twice), (5, None), (None, None), (6, "a\n\nb")])
    rows = line_dedup.deduplicate(docs).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in rows if r.text is not None) == [(-1, ""), (4, twice), (4, twice), (6, "a\n\nb")]
    assert len(rows) == 6 and line_dedup.deduplicate(docs).columns == docs.columns + ["n_removed"]
    assert line_dedup.deduplicate(docs.limit(0)).count() == 0


def test_variants_that_share_many_buckets_meet_one_centre(spark, monkeypatch):
    """A member of many large buckets is compared with about one centre, and only pairs that may be similar are fetched with their sets."""
    seen, inner, likely = [], minmax_dedup._pairs, minmax_dedup._likely

    def counted(*a):
        pairs, stars = inner(*a)
        seen.append((pairs.where("NOT star").count(), stars.count()))
        return pairs, stars
    fetched = []
    monkeypatch.setattr(minmax_dedup, "_pairs", counted)
    monkeypatch.setattr(minmax_dedup, "_likely", lambda *a: (lambda out: (fetched.append(out.where("NOT star").count()), out)[1])(likely(*a)))
    monkeypatch.setattr(minmax_dedup, "CLOSED", 8)
    r, base, texts = random.Random(6), words(150, 3), []
    for _ in range(200):
        w = list(base)
        for at in r.sample(range(150), r.randrange(4, 16)):
            w[at] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(w))
    got = by_id(minmax_dedup.components(documents(spark, texts), k=3, percent=80))
    want = _components(list(enumerate(texts)), 3, 80)
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == want
    assert 0 < seen[0][1] <= 1.5 * len(texts)
    assert fetched[0] < seen[0][0]


def test_rows_that_hit_no_key_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("k1"))
    keys = rows.where("id % 50 = 0").select("k1")
    hit = {r.id for r in common.some_hit(rows, keys, "k1").collect()}
    assert {i for i in range(5000) if i % 50 == 0} <= hit and len(hit) < 1000
    assert {r.id for r in common.some_hit(rows, keys, "k1", False).collect()} == set(range(5000)) - hit
    assert common.some_hit(rows, keys.limit(0), "k1").count() == 0 and common.some_hit(rows.limit(0), keys, "k1").count() == 0
    monkeypatch.setattr(common, "MOST_BITS", 64)  # fewer bits than keys: more rows get through, none is lost
    more = {r.id for r in common.some_hit(rows, keys, "k1").collect()}
    assert {i for i in range(5000) if i % 50 == 0} <= more and len(more) > len(hit)
    texts = [" ".join(words(90, i % 30)) if i < 60 else " ".join(words(90, i)) for i in range(90)]
    assert sorted(r.doc_id for r in minmax_dedup.deduplicate(documents(spark, texts)).collect()) == [*range(30), *range(60, 90)]
    texts = [" ".join(words(90, i % 4)) for i in range(40)]  # more are dropped than kept
    assert sorted(r.doc_id for r in minmax_dedup.deduplicate(documents(spark, texts)).collect()) == [0, 1, 2, 3]
