"""Token files against the tokenizers library, single documents, damaged frames."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowquarry.llm import token_files
from flowquarry.plans.storage import scratch_path
from helpers import documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n\n", "a", "don't WE'LL I'd", "É é e\u0301 ǅ İstanbul", "漢字🙂 mixed\ttext", "x,y. (z)!  q;", "a\u00a0b\u2028c", "<|startoftext|> a<|endoftext|>b", "<|StartOfText|>",
       "word " * 60_000, "w" * 20_000, "12 345 ½ ١٢", "\u0301a \u0301", "tie", "tie", "\x0b\x0c\r\x1c\x85a"]


def _texts(r):
    letters = ["a", "B", "é", "'", "s", " ", "\n", ".", ",", "1", "ß", "İ", "\u0301", "🙂", "\u00a0", "-", "漢", "t", "ll"]
    return ODD + ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(1500)] + [" ".join(words(50, i)) for i in range(20)]


def _library(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ids_are_the_librarys():
    texts = _texts(random.Random(1))
    coder = token_files.WordEncoder(PATH)
    for _ in range(2):  # the second time from what is known
        ids, sizes = coder.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == _library(texts)
    assert coder.encode(pa.array([], pa.string()))[0].tolist() == []


def test_other_vocabularies_get_whole_texts():
    coder = token_files.WordEncoder(PATH)
    coder._by_word = False
    ids, sizes = coder.encode(pa.array(ODD))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == _library(ODD)


def test_marks_after_a_word_take_no_call_of_their_own(monkeypatch):
    """The library sees each word and each string of marks once, whatever stands together."""
    coder, seen = token_files.WordEncoder(PATH), []
    monkeypatch.setattr(coder, "_ids", lambda texts, f=coder._ids: (seen.extend(texts), f(texts))[1])
    marks = ["", ",", "%%%", "...", ")", "!?", "'", ".***", "-", '"']
    texts = [" ".join(f"{w}{m}" for m in marks) for w in dict.fromkeys("".join(x) for x in zip(*[iter("abcdefghijklmnopqrstuvwxyz" * 40)] * 5))]
    ids, sizes = coder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == _library(texts)
    assert len(seen) <= len(texts) + len(marks)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 500)
    texts = _texts(random.Random(2))
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(None, "no id"), (4, "again"), (4, "again")]
    random.Random(3).shuffle(rows)
    docs = documents(spark, rows)
    got = token_files.round_trip(docs, PATH, end_id=2).collect()
    assert len(got) == len(rows)
    ids = {i: x + [2] for i, x in zip(((3 * i + 1) for i in range(len(texts))), _library(texts))}
    at = 0
    for r in sorted(got, key=lambda r: (r.start, r.doc_id or 0)):
        assert r.start == at
        at += r.n_tokens
        if r.doc_id in ids and r.doc_id != 4:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.round_trip(docs.limit(0), PATH, 2).count() == 0


def test_single_documents_and_damage(spark):
    docs = documents(spark, [(i, " ".join(words(30, i))) for i in range(200)])
    manifest = token_files.write(docs, scratch_path(spark, "tokens"), PATH, 2).collect()
    name = manifest[len(manifest) // 2].file
    file = token_files.TokenFile(name)
    doc = file.doc_ids[0]
    assert file.find(doc)[0].tolist() == _library([" ".join(words(30, doc))])[0] + [2] and file.find(10**9) == []
    file.close()
    local = name.removeprefix("file:")
    data = bytearray(open(local, "rb").read())
    data[12] ^= 255
    open(local, "wb").write(data)
    with pytest.raises(Exception):
        file = token_files.TokenFile(name)
        [file.ids(i) for i in range(len(file))]
