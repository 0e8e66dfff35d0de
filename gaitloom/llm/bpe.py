"""Byte-pair encoding of a whole corpus in numpy matrices (problem 7).

Method. Texts are cut into pieces by the tokenizer's own pattern. The distinct pieces of a batch are
bucketed by byte length and laid out as padded integer matrices, one piece a row. Each round, every row
merges its leftmost minimum-rank pair; pair ranks come from an open-addressing hash table, only the two
ranks beside a merge are looked up again, and finished rows are compacted away. A matrix costs the square of
its width, so a piece longer than the widest bucket (a run of letters of more than 1,024 bytes) is merged alone by
the same rule, leftmost minimum-rank pair first, kept in a heap over a linked list: its cost grows with n log n.

Defined results: null, and the empty text, give an empty list. Strings that look like special tokens
are ordinary text. Extra columns are ignored; only the id and text columns are read. Repeated rows give
repeated rows.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import spread

#: Upper bounds of the piece length buckets in bytes; longer pieces are merged one by one.
WIDTHS = (2, 3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024)
#: Pieces remembered by a worker between batches (bounds its memory, not its results).
REMEMBERED = 200_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer file; ``folder`` is a parameter, no file is kept here."""
    folder = folder or os.environ.get("PUBLIC_TOKENIZERS_DIR")
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """(left id, right id) -> rank, open addressing with linear probing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == -1
            first = np.unique(s[free], return_index=True)[1]
            at = todo[free][first]
            self.keys[slot[at]], self.ranks[slot[at]] = key[at], rank[at]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair never merges or a side is padding (-1)."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1) & (left >= 0) & (right >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class BytePairEncoder:
    """One vocabulary of ``base64(token) rank`` lines with its split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in vocabulary.items():
            for cut in range(1, len(token)):
                a, b = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right)), np.array(rank, np.int32))
        self._forget()
        self._scalar: dict[int, int] | None = None

    def _forget(self) -> None:
        #: Place of every known piece, and where its ids lie in one flat array.
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _merge_bucket(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        row = np.arange(len(pieces))
        ranks = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while len(row):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            ended = least == NONE
            if ended.any():
                for k in np.flatnonzero(ended):
                    out[row[k]] = ids[k][ids[k] >= 0]
                live = ~ended
                row, ids, ranks, at, least = row[live], ids[live], ranks[live], at[live], least[live]
                if not len(row):
                    break
            n, w = ids.shape
            every = np.arange(n)
            source = np.arange(w) + (np.arange(w) > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), source, 1)
            ids[every, at] = least
            source = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE), source, 1)
            following = np.where(at + 1 < w, ids[every, np.minimum(at + 1, w - 1)], -1)
            fit = at < w - 1
            ranks[every[fit], at[fit]] = self.pairs.lookup(ids[every, at], following)[fit]
            before = np.where(at > 0, ids[every, at - 1], -1)
            prior = self.pairs.lookup(before, ids[every, at])
            has = at > 0
            ranks[every[has], at[has] - 1] = prior[has]
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        if self._scalar is None:
            used = self.pairs.keys >= 0
            self._scalar = dict(zip(self.pairs.keys[used].tolist(), self.pairs.ranks[used].tolist()))
        rank_of = self._scalar.get
        start = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs.lookup(start[:-1], start[1:])
        ids, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = [*first.tolist(), int(NONE)]
        at = np.flatnonzero(first != NONE)
        heap = ((first[at].astype(np.int64) << 32) | at).tolist()
        heapq.heapify(heap)
        while heap:
            rank, k = divmod(heapq.heappop(heap), 1 << 32)
            if ranks[k] != rank:
                continue  # a neighbour has merged since
            gone = after[k]
            ids[k], ranks[gone] = rank, -1
            after[k] = beyond = after[gone]
            for left, right in ((before[k], k), (k, beyond)):
                if left < 0:
                    continue
                fresh = rank_of(ids[left] << 32 | ids[right]) if right < n else None
                ranks[left] = NONE if fresh is None else fresh
                if fresh is not None:
                    heapq.heappush(heap, fresh << 32 | left)
            if beyond < n:
                before[beyond] = k
        out, k = [], 0
        while k < n:
            out.append(ids[k])
            k = after[k]
        return np.array(out, np.int32)

    def encode_pieces(self, pieces: list[str]) -> None:
        """Encode distinct new pieces and remember them."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        made: list[np.ndarray] = [None] * len(raw)  # type: ignore[list-item]
        for k in np.flatnonzero(lengths == 1):
            made[k] = self.byte[list(raw[k])]
        low = 1
        for width in WIDTHS:
            group = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            # wide rows are few at a time, so that a matrix stays small
            most = max(1, (1 << 22) // width)
            for a in range(0, len(group), most):
                for k, ids in zip(group[a : a + most], self._merge_bucket([raw[k] for k in group[a : a + most]], width)):
                    made[k] = ids
        for k in np.flatnonzero(lengths > WIDTHS[-1]):
            made[k] = self._merge_long(raw[k])
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat, self.size = np.concatenate([self.flat, *made]), np.concatenate([self.size, sizes])

    def cut(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Pieces of all texts in order, and where each text begins among them."""
        split = [self.split(t) if t else [] for t in texts]
        return [p for pieces in split for p in pieces], np.concatenate(([0], np.cumsum([len(p) for p in split]))).astype(np.int64)

    def places(self, pieces: list[str]) -> np.ndarray:
        """Places of pieces among the known ones; new ones are encoded first."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = set(pieces) - self.known.keys()
        if new:
            self.encode_pieces(list(new))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, pieces: list[str], bounds: np.ndarray) -> np.ndarray:
        """Number of ids of each text whose pieces were cut."""
        at = self.places(pieces)
        ends = np.concatenate(([0], np.cumsum(self.size[at])))
        return np.diff(ends[bounds])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each text."""
        pieces, bounds = self.cut(texts)
        at = self.places(pieces)
        sizes = self.size[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.flat[np.repeat(self.start[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return flat, np.diff(ends[bounds])


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    """The worker's encoder for a file, built once per process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = BytePairEncoder(path, pattern)
    return _encoders[path, pattern]


def _blocks(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text, so that memory doesn't follow text length."""
    sizes = np.cumsum([0 if x is None else len(x) for x in batch.column(1).to_pylist()])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // most)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_corpus(documents: DataFrame, *, tokenizer: str = "byte_bpe_50k", folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids ARRAY<INT>)`` for every row; no shuffle, one pass over two columns."""
    path, pattern = tokenizer_path(f"{tokenizer}.tiktoken", folder), default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in _blocks(batch):
                flat, counts = own.encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    read = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(read).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, *, tokenizers: list[str], folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tokenizer, n_tokens)`` for byte-level BPE or sentencepiece vocabularies; null and empty give 0.

    All vocabularies count in one pass over the texts, and those of one pattern share the pieces it cuts.
    """
    pattern, files = default_pattern(), []
    for name in tokenizers:
        kinds = [kind for kind in (".tiktoken", ".model") if os.path.exists(tokenizer_path(name + kind, folder))]
        if not kinds:
            raise ValueError(f"no file of the tokenizer {name}")
        files.append((name, kinds[0] == ".tiktoken", tokenizer_path(name + kinds[0], folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for name, byte_level, path in files:
            if byte_level:
                own.append((name, encoder(path, pattern), None))
            else:
                import sentencepiece

                own.append((name, None, sentencepiece.SentencePieceProcessor(model_file=path)))
        for batch in batches:
            for part in _blocks(batch):
                texts, cut = part.column(1).to_pylist(), None
                for name, bpe, pieces in own:
                    if bpe is not None:
                        cut = cut or bpe.cut(texts)
                        counts = bpe.count(*cut)
                    else:
                        counts = [len(x) for x in pieces.encode([t or "" for t in texts], num_threads=1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.repeat(pa.scalar(name), part.num_rows), pa.array(counts, pa.int64())], names=["doc_id", "tokenizer", "n_tokens"])

    read = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(read).mapInArrow(run, "doc_id bigint, tokenizer string, n_tokens bigint")
