"""Spelling variants, the secret ledger and hard negatives, each against brute force or the SQL twin."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from flowquarry.llm import blob_ledger, hard_negatives, oracles, queries, spelling
from flowquarry.plans.storage import scratch_path
from helpers import by_id, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:] and len(a) + 1 == len(b))


def _variants(rows, one_in, least_length=6, least_count=5, times=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if one_in and h % one_in == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near = {w: [x for x in n if _one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    root = {}
    for w in n:
        root[w] = w
        while root[w] in form:
            root[w] = form[root[w]]
    return {(w, form.get(w), root[w], n[w], len(near[w]), n.get(form.get(w))) for w in n}


def _texts(r):
    letters = "abcàéÿ×"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 11))) for _ in range(12)]
    out = []
    for _ in range(150):
        words = []
        for _ in range(30):
            w = base[min(int(r.expovariate(0.4)), 11)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1:]])
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append(r.choice([" ", "-1", "\n"]).join(words))
    return out


def test_spelling_variants(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, t) for i, t in enumerate(_texts(r))] + [(None, "eringing " * 9), (3, None), (4, ""), (7, "x" * 100_000 + " "), (7, "Eringing " * 9), (7, "Eringing " * 9)]
    want = _variants(rows, 7)
    assert sum(f is not None for _, f, *_ in want) > 30 and any(f not in (None, root) for _, f, root, *_ in want)
    docs = documents(spark, rows)
    assert {tuple(x) for x in spelling.variants(docs, one_in=7).collect()} == want
    monkeypatch.setattr(spelling, "CLOSED", 2)  # nearly every group is divided
    assert {tuple(x) for x in spelling.variants(docs, one_in=7).collect()} == want
    assert {tuple(x) for x in spelling.variants(docs).collect()} == _variants(rows, None)
    assert spelling.variants(docs.limit(0), one_in=7).count() == 0


def test_no_table_of_spelling_variants_is_broadcast(spark, monkeypatch):
    """Their sizes follow the vocabulary, and Spark takes some of them for smaller than they are."""
    plans, inner = [], spelling.written
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "written", lambda df, label: (plans.append(plan(df)), inner(df, label))[1])
    monkeypatch.setattr(spelling, "CLOSED", 2)  # members of large groups come out of an explode
    plans.append(plan(spelling.variants(documents(spark, _texts(random.Random(5))), one_in=7)))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_signatures_meet():
    """Words one letter apart share a signature of fitting roles, for any number of parts."""
    r, sign = random.Random(8), spelling.PartEnum(4)
    for _ in range(300):
        w = "".join(r.choice("abcdé") for _ in range(r.randrange(1, 9)))
        i = r.randrange(len(w))
        x = r.choice([w[:i] + r.choice("abxyz") + w[i:], w[:i] + r.choice("xyz") + w[i + 1:]])
        sigs, roles = sign([w, x])
        mine, other = (spelling.SAME, spelling.SAME) if len(w) == len(x) else (spelling.SHORTER, spelling.LONGER)
        assert set(sigs[0][roles == mine]) & set(sigs[1][roles == other]), (w, x)


SECRETS = ["token = 'abcdef12'", "TOKEN:abc", "api_key=\"aaaaaa==\"", "apikey : x", "token: token:abcdefgh", "password=secret=abcdef", "AKIA" + "A" * 16, "AKIAAKIA" + "Z9" * 7,
           "AKIA12", "0123456789abcdef" * 2, "abcdef" * 3, "é" * 5 + "f" * 24 + "🙂" + "0" * 24, "-----BEGIN RSA PRIVATE KEY-----", "eyJa.b.c", "ftp://u:p@h", "secret \t= abcdefg",
           "paſſword=abcdefgh", "toKen=abcdefgh", "passwd=" + "x" * 50_000]


def _secret_texts(r):
    return [r.choice(["", "\n", "é "]).join(r.choice(SECRETS + ["plain words", "🙂", " "]) for _ in range(r.randrange(8))) for _ in range(80)] + ["", None, SECRETS[0], SECRETS[0]]


def _spans(text, rules):
    out = []
    for no, rule in enumerate(rules):
        out += [(m.start(), no, m.end(), rule.name) for m in re.finditer(rule.pattern, text or "") if len(m.group(rule.group)) >= rule.least]
    return sorted(out)


def test_ledger(spark, monkeypatch):
    texts = _secret_texts(random.Random(3))
    docs = documents(spark, texts).withColumnsRenamed({"lang": "blob", "source": "row", "k1": "findings"})
    rules, ledger = blob_ledger.BASE + blob_ledger.ADDED, scratch_path(spark, "ledger")
    read = []
    inner = blob_ledger.findings
    monkeypatch.setattr(blob_ledger, "findings", lambda t, r: (read.append(t.agg(F.sum(F.size("open"))).first()[0]), inner(t, r))[1])

    def scan(rows, using):
        return {r.doc_id: [tuple(f) for f in r.findings] for r in blob_ledger.scan(rows, using, ledger).collect()}
    want = lambda using: {i: _spans(t, using) for i, t in enumerate(texts)}
    assert scan(docs.where("doc_id < 60"), blob_ledger.BASE) == {i: s for i, s in want(blob_ledger.BASE).items() if i < 60}
    blobs = {t or "" for t in texts}
    assert read == [3 * len({t or "" for t in texts[:60]})]
    assert scan(docs, rules) == want(rules)
    assert sum(read) == len(rules) * len(blobs)  # every pair once
    assert scan(docs, rules) == want(rules) and len(read) == 2  # nothing is open any more
    newer = [blob_ledger.Rule("assign", 2, "token", 0, 1), *rules[1:]]
    assert scan(docs, newer) == want(newer) and read[2] == len(blobs)
    assert blob_ledger.scan(docs, rules, ledger).columns == ["doc_id", "blob", "row", "n_chars", "node", "_block", "findings"]
    assert scan(docs.limit(0), rules) == {} and blob_ledger.scan(docs.limit(0), rules, scratch_path(spark, "ledger")).count() == 0
    # a batch without its mark does not count
    fs, mark = blob_ledger._folder(spark, blob_ledger._batches(spark, ledger)[0] + "/" + blob_ledger._MARK)
    held = blob_ledger.scanned(spark, ledger).count()
    fs.delete(mark, False)
    assert blob_ledger.scanned(spark, ledger).count() < held
    assert scan(docs, rules) == want(rules)


def test_ledger_like_sql(spark, tmp_path):
    texts = _secret_texts(random.Random(4))
    rows = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_secret_ledger(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(queries.ORACLES["op12_secret_ledger"]).fetchall()
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert got.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert key(got.collect()) == key(want)
    base = _spans(texts[3], blob_ledger.BASE)
    one = [r for r in got.collect() if r.doc_id == 1 and r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()]
    assert one


def _mined(rows, positives=5, negatives=5, low=80, high=100):
    out = []
    last = 2**63
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    valid = [r for r in rows if r[1] is not None and r[2] is not None]
    for i, label, v in sorted({(i, label, tuple(v)) for i, label, v in valid if i is not None and i % 100 == 0}):
        others = sorted(((-dot(v, w), last if j is None else j, k) for j, k, w in valid if j != i), key=lambda x: x[:2])
        for s, j, _ in [x for x in others if x[2] == label][:positives]:
            fit = [x for x in others if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k, _) in enumerate(fit)]
    return sorted((tuple(None if x == last else x for x in r) for r in out), key=str)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


def _vectors(r, n, dim, spread):
    centres = [[r.gauss(0, 40) for _ in range(dim)] for _ in range(4)]
    return [(i, r.randrange(3), [round(x + r.gauss(0, spread)) for x in r.choice(centres)]) for i in range(n)]


def test_hard_negatives(spark, monkeypatch):
    r = random.Random(6)
    schema = "vec_id long, label int, vector array<long>, anchor string, slab int"
    for spread in (3, 60):
        rows = _vectors(r, 1500, 6, spread)
        rows += [(5000 + i, 1, rows[300][2]) for i in range(700)]  # a hot vector
        rows += [(None, 1, rows[200][2]), (100, None, [1] * 6), (900, 1, None), (1000, 2, []), (1100, 0, [0] * 6), (rows[0][0], 2, [9] * 6), (3000, 1, [-7, 5])]
        df = spark.createDataFrame([(*x, "x", 1) for x in rows], schema).repartition(5)
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2 * 8 * 6 * 8)
        assert _got(hard_negatives.mine(df, F.col("vec_id") % 100 == 0)) == _mined(rows)
    assert _got(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, 2, 3, 50, 90)) == _mined(rows, 2, 3, 50, 90)
    assert hard_negatives.mine(df, F.lit(False)).count() == 0 and hard_negatives.mine(df.limit(0), F.lit(True)).count() == 0


def test_shared_list_stops_early():
    """On tight clusters most of the list stays unread, and the bound holds for every pair."""
    r = np.random.default_rng(1)
    anchors = np.round(r.normal(0, 3, (20, 8)) + 100).astype(np.int64)
    rows = np.concatenate([np.round(r.normal(0, 3, (400, 8)) + 100), np.round(r.normal(0, 60, (4000, 8)))]).astype(np.int64)
    slab, norms = hard_negatives.Slab(rows), np.sqrt((anchors**2).sum(axis=1))
    order, bound = slab.shared_list(anchors, norms)
    assert (anchors @ rows[order].T <= norms[:, None] * bound[None, :]).all()
    read = []
    scores = slab.scores
    slab.scores = lambda a, at: (read.append(len(at)), scores(a, at))[1]
    ids, labels = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    best = hard_negatives.nearest_of_label(slab, ids, labels, anchors, np.full(20, -1), np.zeros(20, np.int64), 5)
    assert sum(read) < len(rows) / 2
    full = np.sort(anchors @ rows.T, axis=1)[:, ::-1][:, :5]
    assert (best.score.reshape(20, 5) == full).all()


def test_hard_negatives_like_sql(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, r.randrange(10), [r.gauss(0, 0.1) for _ in range(8)]) for i in range(600)]
    rows += [(700, 1, None), (701, None, [0.5] * 8), (702, 1, [0.5] * 7 + [None]), (703, 1, [0.5] * 7 + [float("nan")]), (704, 1, [float("inf")] + [0.5] * 7)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = _got(queries.op13_hard_negatives(spark, str(tmp_path)))
    assert got and got == sorted(db.execute(oracles.OP13).fetchall(), key=str)


def test_spelling_like_sql(spark, tmp_path):
    documents(spark, _texts(random.Random(9)) + [None, ""]).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r.word: tuple(r) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got and got == {r[0]: r for r in db.execute(oracles.OP11).fetchall()}
    assert by_id(spelling.variants(documents(spark, ["one two"])), "word") == {}
