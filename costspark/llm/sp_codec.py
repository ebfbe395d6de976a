"""SentencePiece ids by suffix-array matching, and texts from ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costspark.llm.tokens import public_path

SPACE = "\u2581"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def suffix_order(codes: np.ndarray, length: int) -> np.ndarray:
    """Places of ``codes`` sorted by the ``length`` codes that begin there (prefix doubling)."""
    n = len(codes)
    rank, done = codes.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while done < length and n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - done)] = rank[done:]
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, (sorted_[1:] != sorted_[:-1]).astype(np.int64)])
        done *= 2
    return order


class PieceCodec:
    """Encoder and decoder of one BPE model with byte fallback, no normalisation and a dummy prefix.

    New words of a batch are joined and indexed by a suffix array; each piece finds its range
    of occurrences by binary search; the occurrences are edges between places.  Sorted by
    their end they are relaxed: an edge reaches its end if it begins a word, or if its piece may
    follow the last piece of its start.  In a BPE model that holds for one edge at each place:
    two pieces may stand side by side if their text alone encodes to just them.

    Words are cut first where no piece has the two characters side by side: no piece reaches
    over such a place.  Words and their segments are kept, ``most`` words and twice as many segments.
    """

    def __init__(self, path: str, most: int = 250_000, index_chars: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.index_chars = most, index_chars
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.pieces))]
        byte = [model.is_byte(i) for i in range(len(self.pieces))]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if byte[i]}
        own = [i for i in range(len(self.pieces)) if not special[i] and not byte[i]]
        self.ids = {self.pieces[i]: i for i in own}
        self.scores = {self.pieces[i]: model.get_score(i) for i in own}
        self.raw = [
            b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids):
            raise ValueError("pieces that reach over a space aren't supported")
        self.alphabet = {c: k for k, c in enumerate(sorted({c for p in self.ids if len(p) == 1 for c in p}), 1)}
        table = np.zeros(0x110000, np.int32)
        for c, k in self.alphabet.items():
            table[ord(c)] = k
        self.table = table
        longer = [p for p in self.ids if all(c in self.alphabet for c in p)]
        self.longest = max(map(len, longer), default=1)
        self.piece_ids = np.array([self.ids[p] for p in longer], np.int64)
        self.lengths = np.array([len(p) for p in longer], np.int64)
        self.codes = np.zeros((len(longer), self.longest), np.int32)
        for k, p in enumerate(longer):
            self.codes[k, : len(p)] = [self.alphabet[c] for c in p]
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        self.beside: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: the pair with the best score, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.beside.get(key)
        if known is None:
            left, right = self.pieces[a], self.pieces[b]
            known = self.beside[key] = self.merged(left + right) == [left, right]
        return known

    def _stands(self, a: int) -> bool:
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = self.merged(self.pieces[a]) == [self.pieces[a]]
        return known

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece id) of every occurrence of every piece, sorted by end, then start."""
        order = suffix_order(codes, self.longest)
        n = len(codes)
        padded = np.zeros(n + self.longest, np.int32)
        padded[:n] = codes
        low, high = np.zeros(len(self.lengths), np.int64), np.full(len(self.lengths), n, np.int64)
        for j in range(self.longest):
            act = np.flatnonzero((self.lengths > j) & (low < high))
            want = self.codes[act, j]
            for side in ("left", "right"):
                a, b = low[act].copy(), high[act].copy()
                while (open_ := a < b).any():
                    middle = (a + b) // 2
                    have = padded[order[np.minimum(middle, n - 1)] + j]
                    after = open_ & ((have < want) if side == "left" else (have <= want))
                    a = np.where(after, middle + 1, a)
                    b = np.where(open_ & ~after, middle, b)
                if side == "left":
                    first = a
            low[act], high[act] = first, a
        count = np.maximum(high - low, 0)
        total = int(count.sum())
        at = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
        start = order[at] if total else np.empty(0, np.int64)
        end = start + np.repeat(self.lengths, count)
        piece = np.repeat(self.piece_ids, count)
        sort = np.lexsort((start, end))
        return start[sort], end[sort], piece[sort]

    def _cut(self, word: str) -> list[str]:
        joined, begin, out = self.joined, 0, []
        for k, pair in enumerate(map(add, word, word[1:]), 1):
            if pair not in joined:
                out.append(word[begin:k])
                begin = k
        out.append(word[begin:])
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of segments, as little-endian numbers."""
        text = "\0".join(words) + "\0"
        codes = self.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        n = len(codes)
        start, end, piece = self.edges(codes)
        # A run of known characters is a line of places; what begins it may be any piece.
        begins = (np.r_[0, codes[:-1]] == 0).tolist()
        last, back = [-1] * (n + 1), [0] * (n + 1)
        follows, beside, stands = self._follows, self.beside, self._stands
        for k in range(0, len(start), 50_000):  # as Python numbers the edges take much memory
            part = (a[k : k + 50_000].tolist() for a in (start, end, piece))
            for s, e, p in zip(*part):
                if last[e] >= 0:
                    continue
                if begins[s]:
                    if stands(p):
                        last[e], back[e] = p, s
                elif (a := last[s]) >= 0:
                    known = beside.get(a << 32 | p)
                    if known if known is not None else follows(a, p):
                        last[e], back[e] = p, s
        out, at = {}, 0
        known_char = (codes > 0).tolist()
        for word in words:
            ids: list[int] = []
            e = at + len(word)
            while e > at:
                if known_char[e - 1]:
                    ids.append(last[e])
                    e = back[e]
                else:
                    ids += [self.byte_ids[b] for b in reversed(text[e - 1].encode())]
                    e -= 1
            out[word] = np.array(ids[::-1], "<u4").tobytes()
            at += len(word) + 1
        return out

    def words_of(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text, spaces marked; a text with runs of spaces or marks is cut by ``SEGMENT``."""
        odd = pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " "))
        for part in ("  ", SPACE, "\0"):
            odd = pc.or_(odd, pc.match_substring(texts, part))
        plain = pc.replace_substring(texts.filter(pc.invert(odd)), " ", f" {SPACE}")
        listed = pc.split_pattern(pc.binary_join_element_wise(SPACE, plain, ""), " ")
        rest = [SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.filter(odd).to_pylist()]
        if not rest:
            return listed
        is_odd = odd.to_numpy(zero_copy_only=False)
        place = np.where(is_odd, len(listed) + np.cumsum(is_odd) - 1, np.cumsum(~is_odd) - 1)
        return pa.concat_arrays([listed, pa.array(rest, listed.type)]).take(pa.array(place))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin and end there.

        Each different word is looked up once; Arrow puts the ids of the words in a row.
        """
        listed = self.words_of(texts)
        coded = listed.flatten().dictionary_encode()
        data = pa.array(self._ids(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        at = np.frombuffer(data.buffers()[1], "<i4", len(data) + 1) if len(data) else np.zeros(1, np.int32)
        flat = np.frombuffer(data.buffers()[2], "<i4", int(at[-1]) // 4) if at[-1] else np.empty(0, np.int32)
        return flat, at[listed.offsets.to_numpy()] // 4

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, ends = self.encode_column(pa.array(texts, pa.string()))
        return [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def _ids(self, own: list[str]) -> list[bytes]:
        """Ids of words, as little-endian numbers; words and segments that are new are learnt."""
        if len(self.words) > self.most:
            self.words = {}
        if len(self.segments) > 2 * self.most:
            self.segments = {}
        if len(self.beside) > 2 * self.most:
            self.beside = {}
        words, segments = self.words, self.segments
        cuts = {w: self._cut(w) for w in filterfalse(words.__contains__, own)}
        new = set().union(*cuts.values()).difference(segments)
        if "\0" in new:  # the separator of the index, a character without a piece of its own
            new.discard("\0")
            segments["\0"] = np.array([self.byte_ids[0]], "<u4").tobytes()
        part, size = [], 0
        for segment in new:  # an index, and the numbers of its edges, stay small
            part.append(segment)
            size += len(segment)
            if size > self.index_chars:
                segments.update(self._learn(part))
                part, size = [], 0
        if part:
            segments.update(self._learn(part))
        for w, parts in cuts.items():
            words[w] = segments[parts[0]] if len(parts) == 1 else b"".join(map(segments.__getitem__, parts))
        return list(map(words.__getitem__, own))

    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: bytes that are no UTF-8 become marks, one leading space is dropped."""
        ends = ids.offsets.to_numpy()
        pieces = pa.array(self.raw, pa.binary()).take(ids.flatten())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pieces), b"")
        try:
            texts = joined.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([raw.decode("utf-8", "replace") for raw in joined.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def sp_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, at_once: int = 1024) -> DataFrame:
    """``id_col`` and ``ids``, one row per row of ``docs``; a null or empty text has no ids."""
    path = model or public_path("piece_bpe_32k.model")
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                flat, ends = own.encode_column(part.column(1).cast(pa.string()))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encoded, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def sp_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` and ``text``: pieces joined, byte pieces read as UTF-8, one leading space dropped.

    Null ids count as none; a null id in the list and ids outside the vocabulary are left out.
    """
    path = model or public_path("piece_bpe_32k.model")
    kind = encoded.schema[id_col].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own.decode_column(b.column(1))], names=["id", "ids", "text"])

    size = len(codec(path).pieces)
    known = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: (i >= 0) & (i < size))
    rows = encoded.select(F.col(id_col).alias("id"), known.alias("ids"))
    return rows.mapInArrow(decoded, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)
