"""Token counts of a sentence-piece BPE model by rank-synchronous array merging.

A text is cut where no vocabulary piece can reach across: before each run of
spaces and around line feeds.  The distinct pre-tokens of a batch lie in one
ragged array of symbols; in each round every sequence merges its pair of lowest
rank (the leftmost of equals), all sequences at once, until none has a pair in
the vocabulary.  A surviving symbol is one token if it is a piece, else one
token for each of its UTF-8 bytes.  Sequences of more than LONG symbols take
the same merges one by one through a heap, which bounds the rounds of the rest.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
inside texts are ordinary text; repeated rows count alike; other columns are
not read.  Nothing is shuffled; memory is bounded by one piece of a batch.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged, work

LONG = 64
MARK = "▁"
LIMIT = 4096
_PIECES = re.compile("\n|▁*[^▁\n]*")


class Merger:
    """The merge table of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        ordinary = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ordinary}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece reaches across a cut between pre-tokens")
        if sp.normalize(probe := "ﬁ Å  　x  ") != MARK + probe.replace(" ", MARK):
            raise ValueError("only models with identity normalisation and a leading mark are supported")
        # Pieces of equal score share a rank.
        ranks = {s: r for r, s in enumerate(sorted({*self.score.values()}, reverse=True))}
        self.names = sorted(self.score)
        self.number = {p: i for i, p in enumerate(self.names)}
        pairs = [(self.number[p[:k]], self.number[p[k:]], ranks[self.score[p]], self.number[p]) for p in self.names for k in range(1, len(p)) if p[:k] in self.number and p[k:] in self.number]
        left, right, rank, made = np.array(pairs, dtype=np.int64).T
        self.key = left << 32 | right
        order = np.argsort(self.key)
        self.key, self.rank, self.made = self.key[order], rank[order], made[order]
        self.table = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        self.cache: dict[str, int] = {}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or the largest integer) and result of each pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], np.iinfo(np.int64).max), self.made[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), dtype=np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.one_by_one(w)
        if short:
            out[short] = self.together([words[i] for i in short])
        return out

    def together(self, words: list[str]) -> np.ndarray:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = "".join(words)
        number = self.number
        symbols = np.fromiter((number.get(c, -1) for c in flat), dtype=np.int64, count=len(flat))
        n_bytes = np.fromiter((1 if number.get(c) is not None else len(c.encode()) for c in flat), dtype=np.int64, count=len(flat))
        row = np.repeat(np.arange(len(words)), size)
        # Characters outside the vocabulary never merge: their tokens count now.
        out = np.bincount(row, np.where(symbols < 0, n_bytes, 0), minlength=len(words)).astype(np.int64)
        none = np.iinfo(np.int64).max
        while len(symbols):
            rank, made = np.full(len(symbols), none), np.zeros(len(symbols), dtype=np.int64)
            if len(symbols) > 1:
                rank[:-1], made[:-1] = self.find(symbols[:-1], symbols[1:])
                rank[:-1][row[:-1] != row[1:]] = none
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            # Finished sequences leave the array.
            per = np.repeat(best, np.diff(np.append(starts, len(row))))
            done = per == none
            out += np.bincount(row[done & (symbols >= 0)], minlength=len(words))
            hit = np.flatnonzero((rank == per) & ~done)
            if not len(hit):
                break
            first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
            symbols[first] = made[first]
            done[first + 1] = True
            symbols, row = symbols[~done], row[~done]
        return out

    def one_by_one(self, word: str) -> int:
        """The same merges with a heap, for long sequences."""
        symbols = [self.number.get(c, -1) for c in word]
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] >= 0 <= symbols[j] and (found := self.table.get(symbols[i] << 32 | symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return sum(1 if symbols[i] >= 0 else len(word[i].encode()) for i in range(n) if alive[i])

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        out = np.zeros(len(texts), dtype=np.int64)
        # Words with one space between them split inside Arrow; runs of spaces and marks take the pattern.
        plain = np.asarray(pc.invert(pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.starts_with(texts, " "))))
        ordinary = pc.if_else(pa.array(plain), texts, pa.scalar("", pa.large_string()))
        marked = pc.replace_substring(pc.replace_substring(ordinary, " ", f" {MARK}"), "\n", " \n ")
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
        encoded = pc.dictionary_encode(split.flatten())
        codes, offsets = np.asarray(encoded.indices, dtype=np.int64), np.asarray(split.offsets, dtype=np.int64)
        each = self.cached(encoded.dictionary.to_pylist())
        total = np.concatenate([[0], np.cumsum(each[codes])])
        out = total[offsets[1:]] - total[offsets[:-1]]
        out[np.asarray(pc.binary_length(texts)) == 0] = 0
        for i in np.flatnonzero(~plain):
            found = _PIECES.findall(MARK + texts[int(i)].as_py().replace(" ", MARK))
            distinct: dict[str, int] = {}
            codes = np.array([distinct.setdefault(w, len(distinct)) for w in found], dtype=np.int64)
            out[i] = self.cached(list(distinct))[codes].sum()
        return out

    def cached(self, words: list[str]) -> np.ndarray:
        """counts(), keeping those of up to a million short words between batches."""
        fresh = [w for w in words if w not in self.cache]
        if len(self.cache) + len(fresh) > 1_000_000:
            self.cache.clear()
            fresh = words
        self.cache.update(zip(fresh, self.counts(fresh).tolist(), strict=True))
        return np.fromiter((self.cache[w] for w in words), dtype=np.int64, count=len(words))


_MERGERS: dict[str, Merger] = {}


def count(docs: DataFrame, model_file: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _MERGERS.get(model_file) or _MERGERS.setdefault(model_file, Merger(model_file))
        for batch in batches:
            for piece in ragged.pieces(batch, limit=4_000_000):
                n = merger.of_texts(piece.column("text"))
                size = pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return work.map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
