"""Token ids in files of independent zstandard frames with a trailing seek table.

Documents stand in ascending doc_id (nulls first, equal ids by the hash of their texts), cut into blocks
of consecutive ids; every block is one file, written by one task:

    data frames   ids as little-endian unsigned 32-bit integers, whole documents, about ``FRAME_IDS`` a frame
    directory     one more frame: doc ids (int64), whether they are null (uint8), numbers of ids (int64)
    seek table    a skippable frame in the public seekable format: sizes of every frame before it and
                  after it, the low 32 bits of XXH64 over its plain bytes, number of frames, flags, magic

A reader takes the last bytes of a file, then the directory, and decompresses only the frames that hold the
documents asked for, each against its checksum. A file appears under its name when it is complete, so a
repeated task overwrites it with the same bytes. The manifest (one row a file) gives the number of ids before
each file, so positions are global without any global sort.

Nulls count as empty texts. Every document gets the end id, so none is without ids.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path
from .common import CommittedFile, KnownIds, id_blocks, in_blocks, locate, map_arrow, parallelism, slices, spans, written

FRAME_IDS, LEVEL = 1 << 16, 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the zstandard seekable format
_KNOWN_WORDS = 1_000_000
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class SeekableWriter:
    def __init__(self, uri: str):
        self._file = CommittedFile(uri)
        self._table: list[tuple[int, int, int]] = []
        self._packer = zstandard.ZstdCompressor(level=LEVEL)

    def frame(self, data: bytes) -> None:
        packed = self._packer.compress(data)
        self._file.write(packed)
        self._table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        entries = b"".join(struct.pack("<III", *e) for e in self._table)
        self._file.write(struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries
                         + struct.pack("<IBI", len(self._table), 0x80, _SEEKABLE))
        self._file.commit()


class SeekableReader:
    def __init__(self, uri: str):
        fs, path = locate(uri)
        self._in = fs.open_input_file(path)
        end = self._in.size()
        count, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        table = np.frombuffer(self._at(end - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.plain, self._sums = table[:, 1], table[:, 2]
        self._packed = np.concatenate([[0], np.cumsum(table[:, 0])])
        self._unpacker = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self._in.seek(start)
        return self._in.read(size)

    def __len__(self) -> int:
        return len(self.plain)

    def frame(self, i: int) -> bytes:
        data = self._unpacker.decompress(self._at(int(self._packed[i]), int(self._packed[i + 1] - self._packed[i])),
                                         max_output_size=int(self.plain[i]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self._sums[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return data

    def close(self) -> None:
        self._in.close()


class TokenFile:
    """Documents of one file; only the frames that are needed are decompressed."""

    def __init__(self, uri: str):
        self._frames = SeekableReader(uri)
        n = len(self._frames) - 1
        raw = self._frames.frame(n)
        count = len(raw) // 17
        ids, null = np.frombuffer(raw, "<i8", count), np.frombuffer(raw, np.uint8, count, 8 * count)
        self.sizes = np.frombuffer(raw[9 * count:], "<i8")
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._first = np.concatenate([[0], np.cumsum(self._frames.plain[:n] // 4)])
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def __len__(self) -> int:
        return len(self.sizes)

    def ids(self, row: int) -> np.ndarray:
        """Ids of the document in this row."""
        k = int(np.searchsorted(self._first, self.starts[row], "right")) - 1
        if self._held[0] != k:
            self._held = k, np.frombuffer(self._frames.frame(k), "<u4")
        start = int(self.starts[row] - self._first[k])
        return self._held[1][start:start + int(self.sizes[row])]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document with this id."""
        return [self.ids(i) for i, d in enumerate(self.doc_ids) if d == doc_id]

    def close(self) -> None:
        self._frames.close()


_BY_WORD = ([{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder:
    """The tokenizers library, called once for each distinct word; ids of whole columns of texts by look-up.

    That is right for a vocabulary that drops white space and splits at it, so that the ids of a text are those of its runs of
    other characters (ASCII white space is enough to part them). If it also parts letters from marks and lower-cases, a run
    of letters and ASCII marks after them has the ids of both, and ASCII letters those of their lower case. The file is looked at for these
    properties; with any other one, and for texts that hold the string of one of its special tokens, the library gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self._by_word = ((told["normalizer"] or {}).get("normalizers"), steps[0].get("pattern", {}).get("Regex")) == _BY_WORD and (
            steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        self._special = [t["content"] for t in told["added_tokens"]]
        self._known = KnownIds(_KNOWN_WORDS)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words by the library, and how many each has."""
        found = self._ids(words.to_pylist())
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs, one after the other, and how many each has."""
        body = pc.ascii_rtrim(runs, _MARKS)
        # what letters become must be letters too, else marks after them would be one word with the last of it
        plain = pc.utf8_is_alpha(pc.utf8_lower(pc.utf8_normalize(body, form="NFC")))
        word = pc.if_else(plain, pc.if_else(pc.string_is_ascii(body), pc.ascii_lower(body), body), runs)
        cut = np.flatnonzero((pc.binary_length(word).to_numpy() < pc.binary_length(runs).to_numpy()))
        mark = np.full(len(runs), "", object)
        mark[cut] = [r[len(w):] for r, w in zip(runs.take(pa.array(cut)).to_pylist(), word.take(pa.array(cut)).to_pylist())]
        mark = pa.array(mark, pa.large_string())
        parts = pa.concat_arrays([word, mark]).dictionary_encode()
        starts, sizes = self._known.look_up(parts.dictionary, self._of_words)
        at = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()  # word and mark of each run in turn
        return self._known.ids[spans(starts[at], sizes[at])], sizes[at].reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (little-endian unsigned 32-bit), one after the other, and how many each has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.full(len(texts), not self._by_word)
        for content in self._special:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts))
        flat = lists.flatten().dictionary_encode()
        at = flat.indices.to_numpy(zero_copy_only=False)
        every, size = self._of_runs(flat.dictionary)
        n = size[at]
        ids = every[spans((np.cumsum(size) - size)[at], n)]
        before = np.concatenate([[0], np.cumsum(n)])
        sizes = np.diff(before[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])])
        if whole.any():
            odd = np.flatnonzero(whole)
            found = self._ids(texts.take(pa.array(odd)).to_pylist())
            where = np.repeat(np.cumsum(sizes)[odd], [len(f) for f in found])
            ids = np.insert(ids, where, np.concatenate(found))
            sizes[odd] = [len(f) for f in found]
        return ids.astype("<u4", copy=False), sizes


_encoders: dict[str, WordEncoder] = {}
_SLICE, _SLICE_BYTES = 2000, 8 << 20


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write all documents below ``path``; the manifest (file, block, n_docs, n_ids, start), one row a file.

    An empty table gives no file and an empty manifest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = WordEncoder(vocabulary)
        coder = _encoders[vocabulary]
        out = None
        made: list[tuple] = []

        def flush():
            if pending:
                out.frame(b"".join(pending))
                pending.clear()

        def close():
            flush()
            out.frame(np.array(ids, "<i8").tobytes() + np.array(null, np.uint8).tobytes() + np.array(sizes, "<i8").tobytes())
            out.close()
            made.append((name, here, len(ids), sum(sizes)))

        here, pending, ids, null, sizes, name, held = None, [], [], [], [], "", 0
        for batch in batches:
            blocks, docs_ = (batch.column(c).to_pylist() for c in ("_block", "doc_id"))
            for at, to in slices(batch.column("text"), _SLICE_BYTES):
                coded, counts = coder.encode(batch.column("text").slice(at, to - at))
                ends = np.cumsum(counts)
                coded = np.insert(coded, ends, np.uint32(end_id))  # an end id after every document
                stops = (ends + np.arange(1, len(ends) + 1)).tolist()
                start = 0
                for block, doc, stop in zip(blocks[at:to], docs_[at:to], stops):
                    if block != here:
                        if out is not None:
                            close()
                        here, name = block, f"{path}/ids-{block:08d}.zst"
                        out, ids, null, sizes, held = SeekableWriter(name), [], [], [], 0
                    pending.append(coded[start:stop].tobytes())
                    held += stop - start
                    ids.append(doc or 0)
                    null.append(doc is None)
                    sizes.append(stop - start)
                    start = stop
                    if held >= FRAME_IDS:
                        flush()
                        held = 0
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
            names=["file", "block", "n_docs", "n_ids"])

    spark = docs.sparkSession
    blocks = id_blocks(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text"))
    files = map_arrow(in_blocks(blocks, F.col("_id"), F.xxhash64("text")).select("_block", "doc_id", "text"), run,
                      "file string, block long, n_docs long, n_ids long")
    rows = sorted(written(files, "token-manifest")[0].collect(), key=lambda r: r.block)  # one row a file
    total, listed = 0, []
    for r in rows:
        listed.append((r.file, r.block, r.n_docs, r.n_ids, total))
        total += r.n_ids
    return spark.createDataFrame(listed, "file string, block long, n_docs long, n_ids long, start long")


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of all files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                file = TokenFile(name)
                for at in range(0, len(file), 4 * _SLICE):
                    part = range(at, min(len(file), at + 4 * _SLICE))
                    data = [file.ids(i) for i in part]
                    cols = [pa.array([file.doc_ids[i] for i in part], pa.int64()),
                            pa.array([base + int(file.starts[i]) for i in part], pa.int64()),
                            pa.array([len(d) for d in data], pa.int64()),
                            pa.array([zlib.crc32(d.tobytes()) for d in data], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([d.astype(np.int32) for d in data], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(
                        cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])
                file.close()

    return map_arrow(manifest.select("file", "start").repartition(parallelism(spark)), run,
                     "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the documents to a new folder below the shared one and read the files back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch_path(spark, "token-files"), vocabulary, end_id))
