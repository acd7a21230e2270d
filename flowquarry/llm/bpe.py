"""Byte-level BPE encoding and decoding by replaying the merges over a whole batch of texts.

The texts of a batch are cut at single spaces between other characters, where no match of the pattern can
reach across; only pieces not met before are split by the pattern. Their distinct words form one corpus. All
words lie in one sequence of symbols, and an inverted index lists for every rank the positions whose pair has
it. Ranks are taken in ascending order from a heap; each applies its merge at all its positions, left to
right, and enters only the pairs with the touched neighbours anew. A word's ids do not depend on its batch, so
words and pieces stay known between the batches of a worker, as Arrow and numpy columns (about ``KNOWN`` entries each).

Nulls count as empty texts and have no ids. Every byte must have a rank, as in any byte-level vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import KnownIds, map_arrow, slices, spans

KNOWN, REPLAYED = 250_000, 1 << 17  # strings kept; bytes of words merged at a time
_WIDTH = 1 << 24  # a pair of ids as one number
_NONE = 1 << 62
_INNER_SPACE = re.compile(r" (?=\S)(?<=\S )")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks = ranks
        self._tokens = {rank: token for token, rank in ranks.items()}
        self._split = regex.compile(pattern).findall
        self._pairs: dict[int, int] = {}
        self._words, self._pieces = KnownIds(KNOWN), KnownIds(KNOWN)
        self._table = pa.array([self._tokens.get(i) for i in range(max(self._tokens) + 1)], pa.large_binary())
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)

    def _rank(self, pair: int) -> int:
        """Rank of the token that a pair makes, found for the first time."""
        left, right = divmod(pair, _WIDTH)
        found = self._pairs[pair] = self._ranks.get(self._tokens[left] + self._tokens[right], _NONE)
        return found

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        if len(self._pairs) > KNOWN:
            self._pairs.clear()
        data = [w.encode("utf-8", "surrogatepass") for w in words.to_pylist()]
        whole = np.fromiter((self._ranks.get(d, -1) for d in data), np.int64, len(data))
        rest = np.flatnonzero(whole < 0)
        found, starts, sizes = [whole[whole >= 0]], np.cumsum(whole >= 0) - 1, np.ones(len(data), np.int64)
        at, held, first = [], 0, len(found[0])
        for i in rest.tolist():
            at.append(i)
            held += len(data[i])
            if held > REPLAYED or i == rest[-1]:
                ids, counts = self._merged([data[j] for j in at])
                starts[at], sizes[at] = first + np.cumsum(counts) - counts, counts
                found.append(ids)
                at, held, first = [], 0, first + len(ids)
        return np.concatenate(found).astype("<u4")[spans(starts, sizes)], sizes

    def _merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are no token themselves, and how many each has."""
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes + 1) - 1  # a word's bytes, then a place that ends it
        data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        symbols = self._byte[data]
        symbols[ends] = -1
        firsts = self._first[data[:-1], data[1:]]
        firsts[(symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
        merged = np.array(self._replay(symbols.tolist(), firsts), np.int64)
        keep = merged >= 0
        return merged[keep], np.add.reduceat(keep, np.append(0, ends[:-1] + 1))

    def _replay(self, symbols: list[int], firsts: np.ndarray) -> list[int]:
        """Apply all merges: a merged pair stands at its first place, -2 at the others, -1 ends a word."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = np.flatnonzero(firsts >= 0)
        at = at[np.argsort(firsts[at], kind="stable")]
        values, cuts = np.unique(firsts[at], return_index=True)
        index = {int(v): p.tolist() for v, p in zip(values, np.split(at, cuts[1:]))} if len(values) else {}
        heap = list(index)
        heapq.heapify(heap)
        known, rank_of = self._pairs.get, self._rank
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            for i, at in enumerate(places):
                left = symbols[at]
                if left < 0:
                    continue
                nxt = after[at]
                right = symbols[nxt]
                if right < 0:
                    continue
                pair = left * _WIDTH + right
                if (known(pair) or rank_of(pair)) != rank:
                    continue
                symbols[at], symbols[nxt] = rank, -2
                follow = after[at] = after[nxt]
                before[follow] = at
                lowest = rank
                right = symbols[follow]
                if right >= 0:
                    pair = rank * _WIDTH + right
                    new = known(pair) or rank_of(pair)
                    if new is not _NONE:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(heap, new)
                        if new < lowest:
                            lowest = new
                prev = before[at]
                if prev >= 0 and (left := symbols[prev]) >= 0:
                    pair = left * _WIDTH + rank
                    new = known(pair) or rank_of(pair)
                    if new is not _NONE:
                        if new in index:
                            index[new].append(prev)
                        else:
                            index[new] = [prev]
                            heapq.heappush(heap, new)
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # an earlier merge became possible: it comes before the rest of this one
                    index[rank] = places[i + 1:]
                    heapq.heappush(heap, rank)
                    break
        return symbols

    def _split_piece(self, piece: str) -> list[str]:
        """Words of a piece; the common shapes (letters, letters and one mark) need no pattern."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in ".,!?;:" and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self._split(piece)

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and how many each has."""
        split = [self._split_piece(p[1:] if p[:1] == " " else " " + p) for p in pieces.to_pylist()]
        words = pa.array([word for parts in split for word in parts], pa.large_string()).dictionary_encode()
        starts, sizes = self._words.look_up(words.dictionary, self.encode_words)
        at = words.indices.to_numpy(zero_copy_only=False)
        n = np.append(0, np.cumsum(sizes[at]))
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return self._words.ids[spans(starts[at], sizes[at])], np.diff(n[np.append(0, ends)])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        kind = pa.large_list(pa.large_string())
        cut = pc.split_pattern(texts, " ").cast(kind)
        flat = cut.flatten().dictionary_encode()
        odd = pc.or_(pc.equal(pc.binary_length(flat.dictionary), 0),
                     pc.not_equal(pc.utf8_trim_whitespace(flat.dictionary), flat.dictionary)).to_numpy(zero_copy_only=False)
        row = np.arange(len(texts))
        if odd.any():  # texts with such pieces come last, cut by the exact rule
            count = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
            there = np.zeros(len(texts), bool)
            there[np.repeat(row, count)[odd[flat.indices.to_numpy(zero_copy_only=False)]]] = True
            row = np.concatenate([np.flatnonzero(~there), np.flatnonzero(there)])
            exact = pa.array([_INNER_SPACE.split(t) for t in texts.filter(pa.array(there)).to_pylist()], kind)
            cut = pa.concat_arrays([cut.filter(pa.array(~there)), exact])
            flat = cut.flatten().dictionary_encode()
        at = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        # pieces are kept without the space before them; heads, which have none, under a mark no text splits into
        first = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
        heads, which = np.unique(at[first], return_inverse=True)
        at[first] = len(flat.dictionary) + which
        marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), flat.dictionary.take(pa.array(heads)), pa.scalar("", pa.large_string()))
        starts, sizes = self._pieces.look_up(pa.concat_arrays([flat.dictionary, marked]), self._encode_pieces)
        ids = self._pieces.ids[spans(starts[at], sizes[at])]
        n = np.diff(np.append(0, np.cumsum(sizes[at]))[np.append(0, ends).astype(np.int64)])
        if not odd.any():
            return ids, n
        back = np.argsort(row)
        return ids[spans((np.cumsum(n) - n)[back], n[back])], n[back]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        ids, sizes = self.encode_column(pa.array(texts, pa.large_string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def decode_column(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Bytes of all ids, one after the other, and where those of each id start (and the last ones end)."""
        found = self._table.take(pa.array(ids))
        _, places, data = found.buffers()
        return memoryview(data or b""), np.frombuffer(places, np.int64, len(found) + 1)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self._tokens.__getitem__, memoryview(ids).cast("I")))


_SLICE_BYTES = 2 << 20
_loaded: dict[tuple[str, str], MergeReplay] = {}


def _encoder(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = MergeReplay(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int), one row for
    each row of ``docs``; other columns are not read. ``vocabulary`` is a path every executor has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary, pattern)
        for batch in batches:
            texts = batch.column("text")
            for start, end in slices(texts, _SLICE_BYTES):
                ids, sizes = coder.encode_column(texts.slice(start, end - start))
                ends = np.append(0, np.cumsum(sizes))
                data, places = coder.decode_column(ids)
                coded, decoded = memoryview(ids).cast("B"), places[ends].tolist()
                cols = [batch.column("doc_id").slice(start, end - start), pa.array(sizes, pa.int64()),
                        pa.array([hashlib.sha256(coded[a:b]).hexdigest() for a, b in pairwise((ends * 4).tolist())], pa.string()),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in pairwise(decoded)], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text"), run,
                     schema + ", ids array<int>" * with_ids)
