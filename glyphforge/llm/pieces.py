"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch of texts are concatenated and indexed by a suffix array,
built by prefix doubling to the longest piece.  Every piece of the vocabulary is binary-
searched in it; the ranges it finds are the piece's occurrences, an edge of the lattice for
each.  Edges are dealt to their positions.  Where no edge crosses from one character to the
next, a word falls into segments that can be solved apart, so words of any length (unspaced
scripts, encoded blobs) take the same way.  Then edges are relaxed: for BPE models the
best-scored edge over two neighbouring symbols is contracted, leftmost first, which is the
model's own merge order (short segments of a batch all at once, long ones from a queue of
their edges); for unigram models best scores are carried from left to right.  Words are
solved once each and kept for later batches, up to KEPT words and KEPT_CHARACTERS.

A model file is read on the driver; its pieces (a fixed vocabulary) travel with the job.

Defined cases: null and empty texts have no ids and decode to the empty text; very long
texts are split at word starts, which no piece crosses, and very long words where no edge
crosses; repeated rows agree; an empty table gives no rows; further columns are ignored,
whatever their names.  A space and U+2581 are one symbol to the model,
so a text holding U+2581 decodes with a space there and `round_trip` is false.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

SPACE = "▁"
NONE = np.iinfo(np.int32).max
BATCH = 1 << 17  # characters of new words indexed together
QUEUED = 64  # characters from which a segment's edges are relaxed from a queue
KEPT = 200_000
KEPT_CHARACTERS = 8 << 20


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields: numbers, and bytes of strings and messages."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, message[at : at + size]
            at += size


def model_kind(model: bytes) -> tuple[str, str]:
    """A model file's kind, and how it rewrites text first ('' if it does not).

    Read from the file's public format: field 2 is the training's settings, whose field 3 is
    the kind; field 3 is the normaliser, with a character map (2), whether a space goes before
    the text (3) and whether repeated spaces go (4).
    """
    kind, charsmap, prefix, squeeze = 1, b"", 1, 1
    for number, value in fields(model):
        if number == 2:
            kind = dict(fields(value)).get(3, kind)
        elif number == 3:
            own = dict(fields(value))
            charsmap, prefix, squeeze = own.get(2, charsmap), own.get(3, prefix), own.get(4, squeeze)
    rewrites = "maps characters" if charsmap else "drops repeated spaces" if squeeze else "puts no space before a text" if not prefix else ""
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(kind, str(kind)), rewrites


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray  # 0 ordinary, 1 control, 2 unknown, 3 byte, 4 unused
    kind: str = "bpe"  # or "unigram"
    tables: Tables | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str, kind: str | None = None) -> Vocabulary:
        """From a SentencePiece model file, BPE or unigram as the file says.

        Models of other kinds, of another kind than `kind`, or that rewrite characters or
        spaces before they are cut are refused, since their ids would differ.
        """
        import sentencepiece

        with open(path, "rb") as f:
            found, rewrites = model_kind(f.read())
        if found not in ("bpe", "unigram") or kind not in (None, found):
            raise ValueError(f"{path}: a model of kind {found}, {kind or 'bpe or unigram'} wanted")
        if rewrites:
            raise ValueError(f"{path}: the model {rewrites}, which is not supported")
        kind = found

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        kinds = np.array([1 if p.is_control(i) else 2 if p.is_unknown(i) else 3 if p.is_byte(i) else 4 if p.is_unused(i) else 0 for i in range(n)], dtype=np.int8)
        return cls([p.id_to_piece(i) for i in range(n)], np.array([p.get_score(i) for i in range(n)]), kinds, kind)

    def __getstate__(self):
        return {**self.__dict__, "tables": None}

    def ready(self) -> Tables:
        if self.tables is None:
            self.tables = Tables(self)
        return self.tables


def code_points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Tables:
    """What a process derives from a vocabulary, and the words it has solved."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == 0}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another character: words can't be solved apart")
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(v.pieces):
            if v.kinds[i] == 3:
                self.byte_id[int(p[3:-1], 16)] = i
        self.has_bytes = bool((v.kinds == 3).any())
        self.unknown = int(np.flatnonzero(v.kinds == 2)[0]) if (v.kinds == 2).any() else 0
        # order of merging: higher scores first
        order = sorted(self.ids.values(), key=lambda i: (-v.scores[i], i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.by_rank = np.array(order, dtype=np.int32)
        # characters get dense codes; 0 is the gap between words, 1 any character outside the vocabulary
        alphabet = sorted({ord(c) for p in self.ids for c in p})
        if len(alphabet) > 65_000:
            raise ValueError("more than 65,000 different characters in the pieces")
        self.code = np.ones(0x110000, dtype=np.uint16)
        self.code[alphabet] = np.arange(2, len(alphabet) + 2, dtype=np.uint16)
        self.code[0] = 0 if 0 not in alphabet else self.code[0]
        self.single = np.full(len(alphabet) + 2, -1, dtype=np.int32)
        long = []
        for p, i in self.ids.items():
            if len(p) == 1:
                self.single[self.code[ord(p)]] = i
            else:
                long.append((len(p), i))
        self.longest = max((n for n, _ in long), default=1)
        long.sort()
        self.length = np.array([n for n, _ in long], dtype=np.int64)
        self.order_of = np.array([self.rank[i] for _, i in long], dtype=np.int32)
        spelled = np.zeros((len(long), max(16, self.longest)), dtype=np.uint16)
        for k, (n, i) in enumerate(long):
            spelled[k, :n] = self.code[code_points(v.pieces[i])]
        self.whole, self.spelled = spelled, spelled[:, :16].astype(np.uint64)
        # a column of the edge table for each length that pieces have; column 0 is always empty
        self.lengths = np.unique(self.length)
        self.column = np.zeros(self.longest + 1, dtype=np.int64)
        self.column[self.lengths] = np.arange(1, len(self.lengths) + 1)
        spell = [bytes([int(p[3:-1], 16)]) if v.kinds[i] == 3 else b"" if v.kinds[i] == 1 else p.encode("utf-8") for i, p in enumerate(v.pieces)]
        if (v.kinds == 2).any():
            spell[self.unknown] = " ⁇ ".encode()
        self.bytes_of = spell
        self.solved: dict[str, bytes] = {}
        self.characters = 0  # of the words in `solved`

    # ------------------------------------------------------------ the suffix array

    def edges(self, code: np.ndarray) -> np.ndarray:
        """ranks[p, column[n]]: the merge rank of the piece of n characters at position p, NONE where there is none."""
        n = len(code)
        ranks = np.full((n, len(self.lengths) + 1), NONE, dtype=np.int32)
        if not n or not len(self.length):
            return ranks
        wide = np.zeros(n + 16, dtype=np.uint64)
        wide[:n] = code
        key = np.zeros(n + 16, dtype=np.uint64)
        for k in range(4):
            key[:n] |= wide[k : n + k] << np.uint64(16 * (3 - k))
        low = lambda chars, k: (chars[:, k] << np.uint64(48)) | (chars[:, k + 1] << np.uint64(32)) | (chars[:, k + 2] << np.uint64(16)) | chars[:, k + 3]
        # suffixes ordered by their first 4, 8 and 16 characters; the piece's range narrows with each step
        stage, span = key[:n], 4
        pieces, lengths = np.arange(len(self.length)), self.length
        before: tuple | None = None
        while True:
            order = np.argsort(stage, kind="stable")
            ordered = stage[order]
            if span == 4:
                a = low(self.spelled, 0)
                room = np.clip(4 - lengths, 0, 4).astype(np.uint64)
                b = a + (np.uint64(1) << (np.uint64(16) * np.minimum(room, np.uint64(3)))) - np.uint64(1)
                lo, hi = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, b, "right")
            else:
                lo, hi = before
            mine = lengths <= span
            self._deal(ranks, order, lo[mine], hi[mine], pieces[mine])
            if span >= self.longest:
                return ranks
            if span == 16:
                present = (~mine) & (hi > lo)
                return self._beyond(ranks, code, ordered, order, pieces[present])
            # ranks of the suffixes by what is sorted so far, and the rank ranges of the pieces' halves
            new = np.ones(n, dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            dense = np.cumsum(new)
            rank = np.zeros(n + 16, dtype=np.uint64)
            rank[order] = dense.astype(np.uint64)
            present = (~mine) & (hi > lo)
            pieces, lengths = pieces[present], lengths[present]
            if not len(pieces):
                return ranks
            first = dense[lo[present]].astype(np.uint64)
            c, d = self._tail(ordered, dense, order, rank, pieces, lengths, span)
            stage = (rank[:n] << np.uint64(32)) | rank[span : n + span]
            some = d > c
            pieces, lengths, first, c, d = pieces[some], lengths[some], first[some], c[some], d[some]
            ordered = np.sort(stage)
            before = np.searchsorted(ordered, (first << np.uint64(32)) | c, "left"), np.searchsorted(ordered, (first << np.uint64(32)) | d, "left")
            span *= 2
            if not len(pieces):
                return ranks

    def _tail(self, ordered, dense, order, rank, pieces, lengths, span):
        """Rank ranges [c, d) of suffixes that start with what the pieces have beyond `span` characters."""
        spelled, left = self.spelled[pieces], np.minimum(lengths - span, span)
        top = np.uint64(int(dense[-1]) + 1)
        if span == 4:
            k = spelled[:, 4:8]
            a = (k[:, 0] << np.uint64(48)) | (k[:, 1] << np.uint64(32)) | (k[:, 2] << np.uint64(16)) | k[:, 3]
            b = a + (np.uint64(1) << (np.uint64(16) * (4 - left).astype(np.uint64))) - np.uint64(1)
            lo, hi = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, b, "right")
        else:  # 8: characters 8 to 16, by two blocks of four
            four = self._four
            k = spelled[:, 8:16]
            a = (k[:, 0] << np.uint64(48)) | (k[:, 1] << np.uint64(32)) | (k[:, 2] << np.uint64(16)) | k[:, 3]
            room = np.clip(4 - left, 0, 4).astype(np.uint64)
            b = a + (np.uint64(1) << (np.uint64(16) * np.minimum(room, np.uint64(3)))) - np.uint64(1)
            l4, h4 = np.searchsorted(four[0], a, "left"), np.searchsorted(four[0], b, "right")
            some = h4 > l4
            first = np.where(some, four[1][np.minimum(l4, len(four[1]) - 1)], 0).astype(np.uint64)
            last = np.where(some, four[1][np.maximum(h4 - 1, 0)], 0).astype(np.uint64)
            a2 = (k[:, 4] << np.uint64(48)) | (k[:, 5] << np.uint64(32)) | (k[:, 6] << np.uint64(16)) | k[:, 7]
            room = np.clip(8 - left, 0, 4).astype(np.uint64)
            b2 = np.where(room >= 4, np.uint64(0xFFFFFFFFFFFFFFFF), a2 + (np.uint64(1) << (np.uint64(16) * np.minimum(room, np.uint64(3)))) - np.uint64(1))
            l2, h2 = np.searchsorted(four[0], a2, "left"), np.searchsorted(four[0], b2, "right")
            inner = left > 4
            c2 = np.where(l2 < len(four[1]), four[1][np.minimum(l2, len(four[1]) - 1)], int(four[1][-1]) + 1).astype(np.uint64)
            d2 = np.where(h2 < len(four[1]), four[1][np.minimum(h2, len(four[1]) - 1)], int(four[1][-1]) + 1).astype(np.uint64)
            low = np.where(inner, (first << np.uint64(32)) | c2, first << np.uint64(32))
            high = np.where(inner, (first << np.uint64(32)) | d2, (last + np.uint64(1)) << np.uint64(32))
            lo, hi = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, high, "left")
            hi = np.where(some & (~inner | (h2 > l2)), hi, lo)
        if span == 4:
            self._four = (ordered, dense)
        size = len(dense)
        c = np.where(lo < size, dense[np.minimum(lo, size - 1)], int(top)).astype(np.uint64)
        d = np.where(hi < size, dense[np.minimum(hi, size - 1)], int(top)).astype(np.uint64)
        return c, np.where(hi > lo, d, c)

    def _beyond(self, ranks, code, ordered, order, pieces) -> np.ndarray:
        """Edges of pieces of more than 16 characters; doubling goes on until suffixes are ordered as far as they reach."""
        n, span = len(code), 16
        while len(pieces) and span < self.length[pieces].max():
            new = np.ones(n, dtype=bool)
            new[1:] = ordered[1:] != ordered[:-1]
            rank = np.zeros(n + span, dtype=np.uint64)
            rank[order] = np.cumsum(new).astype(np.uint64)
            stage = (rank[:n] << np.uint64(32)) | rank[span : n + span]
            order = np.argsort(stage, kind="stable")
            ordered, span = stage[order], span * 2
        if len(pieces):
            wide = np.concatenate((code, np.zeros(self.longest, dtype=code.dtype)))
            self._deal(ranks, order, *(self._bound(wide, order, pieces, right) for right in (False, True)), pieces)
        return ranks

    def _bound(self, wide, order, pieces, right: bool) -> np.ndarray:
        """The first place in the suffix array that does not come before each piece, or that comes after it."""
        lo, hi = np.zeros(len(pieces), dtype=np.int64), np.full(len(pieces), len(order))
        place = np.arange(int(self.length[pieces].max()))
        spelled, inside = self.whole[pieces][:, : len(place)], place < self.length[pieces][:, None]
        row = np.arange(len(pieces))
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            text = wide[order[np.minimum(mid, len(order) - 1)][:, None] + place]
            differ = (text != spelled) & inside
            at = differ.argmax(axis=1)
            sign = np.where(differ[row, at], np.sign(text[row, at].astype(np.int64) - spelled[row, at].astype(np.int64)), 0)
            later = open_ & ((sign <= 0) if right else (sign < 0))
            lo, hi = np.where(later, mid + 1, lo), np.where(open_ & ~later, mid, hi)
        return lo

    def _deal(self, ranks, order, lo, hi, pieces) -> None:
        """An edge for each occurrence of each piece, put at its position."""
        n = np.maximum(0, hi - lo)
        total = int(n.sum())
        if total:
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            ranks[order[at], np.repeat(self.column[self.length[pieces]], n)] = np.repeat(self.order_of[pieces], n)

    def crossed(self, ranks: np.ndarray) -> np.ndarray:
        """For each position whether an edge reaches over the border before it."""
        change = np.zeros(len(ranks) + self.longest + 1, dtype=np.int32)
        for k, n in enumerate(self.lengths.tolist(), 1):
            at = np.flatnonzero(ranks[:, k] != NONE)
            change[at + 1] += 1
            change[at + n] -= 1
        return np.cumsum(change)[: len(ranks)] > 0

    # ------------------------------------------------------------ relaxation

    def merge(self, code: np.ndarray, ranks: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the symbols left when no edge over two neighbours remains.

        `word` numbers the word of each position, -1 in gaps.  Words are merged by segments,
        between which no edge leads.  Each round contracts the best edge of every segment
        that still has one; long segments would need many rounds and take them from a queue.
        """
        fresh = np.ones(len(word), dtype=bool)
        fresh[1:] = (word[1:] != word[:-1]) | ~self.crossed(ranks)[1:]
        segment = np.cumsum(fresh)
        long = (np.bincount(segment) >= QUEUED)[segment] & (word >= 0)
        start = np.flatnonzero((word >= 0) & ~long)
        owner = segment[start]
        done_s, done_n = [], []
        if long.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], np.where(long, segment, 0), [0]))))
            for a, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if long[a]:
                    s, n = self.queued(ranks[a:e])
                    done_s.append(s + a)
                    done_n.append(n)
        size = np.ones(len(start), dtype=np.int64)
        while len(start):
            both = size[:-1] + size[1:]
            pair = np.full(len(start), NONE, dtype=np.int32)
            fits = np.flatnonzero((owner[1:] == owner[:-1]) & (both <= self.longest))
            pair[fits] = ranks[start[fits], self.column[both[fits]]]
            head = np.ones(len(start), dtype=bool)
            head[1:] = owner[1:] != owner[:-1]
            edge = np.flatnonzero(head)
            best = np.minimum.reduceat(pair, edge)
            count = np.diff(np.append(edge, len(start)))
            spread = np.repeat(best, count)
            over = spread == NONE
            done_s.append(start[over])
            done_n.append(size[over])
            hit = np.flatnonzero((pair == spread) & ~over)
            if not len(hit):
                break
            first = np.ones(len(hit), dtype=bool)
            first[1:] = owner[hit[1:]] != owner[hit[:-1]]
            hit = hit[first]
            size[hit] += size[hit + 1]
            keep = ~over
            keep[hit + 1] = False
            start, size, owner = start[keep], size[keep], owner[keep]
        s, n = np.concatenate(done_s), np.concatenate(done_n)
        order = np.argsort(s, kind="stable")
        return s[order], n[order]

    def queued(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `merge`, for one segment: edges wait in a queue by rank, then place."""
        n = len(ranks)
        size, after, prior = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        table, width, column, longest = memoryview(np.ascontiguousarray(ranks)).cast("B").cast("i"), ranks.shape[1], self.column.tolist(), self.longest

        def rank(i: int) -> int:
            """Of the edge over symbol i and the next."""
            both = size[i] + size[after[i]] if after[i] < n else longest + 1
            return table[i * width + column[both]] if both <= longest else NONE

        queue = [r * n + i for i in range(n) if (r := rank(i)) != NONE]
        heapq.heapify(queue)
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            # gone, or its neighbour has changed since
            if not size[i] or rank(i) != r:
                continue
            j = after[i]
            size[i] += size[j]
            size[j], after[i] = 0, after[j]
            if after[i] < n:
                prior[after[i]] = i
            for k in (i, prior[i]):
                if k >= 0 and (r := rank(k)) != NONE:
                    heapq.heappush(queue, r * n + k)
        left = np.asarray(size)
        return np.flatnonzero(left), left[left > 0]

    def shortest(self, code: np.ndarray, ranks: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the best-scored path over each word, relaxed from left to right."""
        score = self.v.scores
        least = float(score.min()) - 10
        best, back = np.full(len(code) + 1, -np.inf), np.zeros(len(code) + 1, dtype=np.int64)
        for p in range(len(code)):
            if word[p] < 0:
                continue
            if p == 0 or word[p - 1] != word[p]:
                best[p] = 0.0
            one = self.single[code[p]]
            steps = [(1, score[one] if one >= 0 else least)]
            steps += [(int(self.lengths[k - 1]), score[self.by_rank[ranks[p, k]]]) for k in np.flatnonzero(ranks[p] != NONE).tolist()]
            for n, value in steps:
                if best[p] + value > best[p + n]:
                    best[p + n], back[p + n] = best[p] + value, n
        starts, sizes = [], []
        for end in np.flatnonzero((word >= 0) & (np.append(word[1:], -1) != word)) + 1:
            at, own = int(end), word[end - 1]
            while at > 0 and word[at - 1] == own:
                sizes.append(int(back[at]))
                at -= int(back[at])
                starts.append(at)
        order = np.argsort(starts)
        return np.asarray(starts)[order], np.asarray(sizes)[order]

    def _fallback(self, s: str) -> list[int]:
        return self.byte_id[list(s.encode("utf-8", "surrogatepass"))].tolist() if self.has_bytes else [self.unknown]

    def _spell(self, w: str, starts, sizes) -> list[int]:
        out: list[int] = []
        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            s = w[a : a + n]
            out += [self.ids[s]] if s in self.ids else self._fallback(s)
        return out

    def solve(self, words: list[str]) -> None:
        """Put the ids of new words into `solved`, as bytes of int32."""
        some, n = [], 0
        for w in words:
            if len(w) > BATCH:
                parts = list(self._parts(w))
                if len(parts) == 1:
                    self._together(parts)
                    continue
                self.solve([p for p in dict.fromkeys(parts) if p not in self.solved])
                self.solved[w] = b"".join(map(self.solved.__getitem__, parts))
                continue
            some.append(w)
            n += len(w) + 1
            if n >= BATCH:
                self._together(some)
                some, n = [], 0
        if some:
            self._together(some)

    def _parts(self, w: str) -> Iterator[str]:
        """A very long word cut where no edge crosses, into parts of at most about BATCH characters if such places allow."""
        at, size = 0, BATCH // 2
        while at < len(w):
            near = w[at : at + size + self.longest]  # holds all edges that cross a border up to `size`
            free = np.flatnonzero(~self.crossed(self.edges(self.code[code_points(near)]))[1 : size + 1]) + 1
            if len(w) - at <= size or not len(free) and len(near) == len(w) - at:
                yield w[at:]
                return
            if len(free):
                yield w[at : at + int(free[-1])]
                at, size = at + int(free[-1]), BATCH // 2
            else:
                size *= 2

    def _together(self, words: list[str]) -> None:
        sizes = np.array([len(w) for w in words])
        edge = np.concatenate(([0], np.cumsum(sizes + 1)))
        code = self.code[code_points("\0".join(words) + "\0")].copy()
        word = np.repeat(np.arange(len(words)), sizes + 1)
        gaps = edge[1:] - 1
        code[gaps], word[gaps] = 0, -1
        ranks = self.edges(code)
        start, size = (self.merge if self.v.kind == "bpe" else self.shortest)(code, ranks, word)
        ids = np.where(size == 1, self.single[code[start]], self.by_rank[np.where(size == 1, 0, ranks[start, self.column[np.minimum(size, self.longest)]])])
        odd = np.zeros(len(words), dtype=bool)
        odd[word[start[ids < 0]]] = True
        cuts = np.searchsorted(start, edge) * 4
        data = ids.astype(np.int32).tobytes()
        at = cuts.tolist()
        solved = self.solved
        for i, w in enumerate(words):
            solved[w] = data[at[i] : at[i + 1]]
        for i in np.flatnonzero(odd).tolist():
            a, e = np.searchsorted(start, edge[i]), np.searchsorted(start, edge[i + 1])
            solved[words[i]] = np.asarray(self._spell(words[i], start[a:e] - edge[i], size[a:e]), dtype=np.int32).tobytes()

    # ------------------------------------------------------------ texts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, as bytes of int32."""
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.solved) > KEPT or self.characters > KEPT_CHARACTERS:
            self.solved.clear()
            self.characters = 0
        new: set[str] = set()
        for words in split:
            new.update(words)
        fresh = sorted(w for w in new if w not in self.solved)
        self.solve(fresh)
        self.characters += sum(map(len, fresh))
        find = self.solved.__getitem__
        return [b"".join(map(find, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _groups(texts: list[bytes | None], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at] or b"")
        while end < len(texts) and n + len(texts[end] or b"") <= limit:
            n += len(texts[end] or b"")
            end += 1
        yield at, end
        at = end


def _strings(texts: list[bytes | None]) -> list[str | None]:
    return [None if t is None else t.decode("utf-8", "replace") for t in texts]


def encode(docs: DataFrame, vocabulary: Vocabulary, columns: list[str], text: str = "text") -> DataFrame:
    """`columns` of docs and `ids`, array of int, for every row."""
    schema = docs.select(*columns).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.ready()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            for lo, hi in _groups(texts):
                coded = tables.encode(_strings(texts[lo:hi]))
                offsets = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)))
                kept = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, ids], names=[*batch.schema.names[:-1], "ids"])

    return docs.select(*columns, F.col(text).alias(fresh(columns, "text"))).mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: Vocabulary, columns: list[str], ids: str = "ids") -> DataFrame:
    """`columns` of coded and `text`, for every row; null ids decode to the empty text."""
    schema = coded.select(*columns).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.ready()
        for batch in batches:
            texts = [tables.decode(np.asarray(x or [], dtype=np.int32)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return coded.select(*columns, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian int32), decoded_sha256, round_trip for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.ready()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in _groups(texts):
                part = texts[lo:hi]
                coded = tables.encode(_strings(part))
                back = [tables.decode(np.frombuffer(c, dtype=np.int32)).encode("utf-8") for c in coded]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(lo, hi - lo),
                        "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                        "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
                        "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in back],
                        "round_trip": [t == (p or b"") for t, p in zip(back, part, strict=True)],
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
