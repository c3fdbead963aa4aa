"""Vector bin packing: examples into sequences under limits on tokens, segments and loss-bearing tokens.

An item is a run of tokens with the demand (tokens, 1 segment, loss-bearing tokens). The open sequence takes, among the
items that fit whole, the one whose demand has the largest dot product with what the sequence has left, both as shares of
the limits (the dot-product heuristic). Where items may be cut, the item with the largest such product gives its first
tokens to a sequence that no whole item fits any more, so sequences close full. Items longer than a sequence give whole
sequences first. A group's last sequence may be parted into powers of two, which need no padding.

Packing works on groups of bounded size within a task: no shuffle, nothing global. A sequence never crosses a task, so a
task that is run again after a loss gives whole sequences by itself.

Defined results: null text counts as empty; every document has at least its end id, so empty ones are pieces of one id;
equal texts are packed each for themselves, as are rows that share an id or have none; other columns are ignored; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.llm.bpe import WordBpe
from prismark.llm.common import CACHE_WORDS, CACHES, slices, texts

#: Ids of known words after which these become the older generation, as with half of ``CACHE_WORDS`` words.
CACHE_IDS = 1 << 20
#: Sequence ids: the task's number times this, plus the sequence's number in the task.
TASK_STRIDE = 1 << 40
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, sequence_length long, loss_length long"


@dataclass(frozen=True)
class Limits:
    """A sequence's limits: tokens, segments, loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


@dataclass
class Pool:
    """Items by demand: equal (tokens, loss) share a class, so a choice looks at classes, not items."""

    limits: Limits
    items: dict[tuple[int, int], list] = field(default_factory=dict)
    stale: bool = True

    def add(self, tokens: int, loss: int, item: object) -> None:
        known = self.items.setdefault((tokens, loss), [])
        self.stale |= not known
        known.append(item)

    def _refresh(self) -> None:
        self.keys = list(self.items)
        self.t, self.l = (np.array(x, dtype=np.int64) for x in zip(*self.keys, strict=True)) if self.keys else (np.zeros(0, np.int64),) * 2
        self.share = np.stack([self.t / self.limits.tokens, np.full(len(self.keys), 1 / self.limits.segments), self.l / max(self.limits.loss, 1)], axis=1)
        self.live = np.ones(len(self.keys), dtype=bool)
        self.left, self.stale = len(self.keys), False

    def take(self, tokens: int, segments: int, loss: int, whole: bool = True) -> tuple[int, int, object] | None:
        """The best item for what is left; with ``whole`` only among those that fit."""
        if self.stale or self.left < len(self.keys) // 2:
            self._refresh()
        if not self.left or segments < 1:
            return None
        score = self.share @ np.array([tokens / self.limits.tokens, segments / self.limits.segments, loss / max(self.limits.loss, 1)])
        score[~(self.live & (self.t <= tokens) & (self.l <= loss) if whole else self.live)] = -1
        best = int(score.argmax())
        if score[best] < 0:
            return None
        key = self.keys[best]
        item = self.items[key].pop()
        if not self.items[key]:
            del self.items[key]
            self.live[best] = False
            self.left -= 1
        return *key, item


def powers(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(items: list[tuple[object, np.ndarray]], limits: Limits, cut: bool = True, tail: bool = True) -> Iterator[list[tuple[object, int, int]]]:
    """Sequences as lists of (item, start, length). items: name and a flag for each token that bears loss.

    cut: items may be cut; without it an item beyond a limit is an error and sequences may close with room.
    tail: the last sequence is parted into powers of two.
    """
    pool = Pool(limits)
    sums: dict[object, np.ndarray] = {}

    def put(name: object, start: int, end: int) -> None:
        if end > start:
            pool.add(end - start, int(sums[name][end] - sums[name][start]), (name, start, end))

    for name, bears in items:
        sums[name] = np.concatenate([[0], np.cumsum(bears, dtype=np.int64)])
        put(name, 0, len(bears))
    if not cut and any(t > limits.tokens or l > limits.loss for t, l in pool.items):
        raise ValueError("an item is larger than a sequence and may not be cut")
    last: list[tuple[object, int, int]] = []
    while pool.items:
        left, loss, now = limits.tokens, limits.loss, []
        while left:
            got = pool.take(left, limits.segments - len(now), loss)
            if got is None and cut and (got := pool.take(left, limits.segments - len(now), loss, whole=False)):
                name, start, end = got[2]
                end_cut = min(start + left, int(np.searchsorted(sums[name], sums[name][start] + loss, side="right")) - 1, end)
                put(name, end_cut, end)
                if end_cut <= start:
                    break
                got = end_cut - start, int(sums[name][end_cut] - sums[name][start]), (name, start, end_cut)
            if got is None:
                break
            name, start, end = got[2]
            now.append((name, start, end - start))
            left, loss = left - got[0], loss - got[1]
        if pool.items or not (cut and tail):
            yield now
        else:
            last = now
    sizes = powers(sum(x[2] for x in last))
    while last:
        room, now = sizes.pop(0), []
        while room:
            name, start, length = last.pop(0)
            now.append((name, start, take := min(room, length)))
            room -= take
            if take < length:
                last.insert(0, (name, start + take, length - take))
        yield now


class Ids(defaultdict):
    """word -> its number, the next one if it is new; the ids of all known words lie in one array.

    Words are kept in two generations: a full one becomes the older one, of which words are taken over when they are met
    again, so words that occur once don't drive out frequent ones.
    """

    def __init__(self, path: str):
        super().__init__()
        self.bpe = WordBpe(path)
        self.ends = np.zeros(max(self.bpe.strings) + 1, dtype=bool)
        self.ends[[i for i, s in self.bpe.strings.items() if s.endswith(self.bpe.end)]] = True
        self.turn()

    def turn(self) -> None:
        """The words so far are the older generation from now on."""
        self.older = (dict(self), self.flat, self.starts, self.sizes) if self else ({},) + (np.zeros(0, np.int64),) * 3
        self.clear()
        self.default_factory, self.learned = count().__next__, 0
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.starts, self.sizes = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def learn(self) -> None:
        """Finds the ids of words met since, many in one text: a word's last id is the one with the end mark."""
        first, new = self.learned, list(islice(self, self.learned, None))
        self.learned = len(self)
        if len(self.starts) < len(self):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self)), np.resize(self.sizes, 2 * len(self))
        known, flat, starts, sizes = self.older
        before = np.fromiter(map(known.get, new, repeat(-1)), dtype=np.int64, count=len(new))
        again = np.flatnonzero(before >= 0)
        if len(again):
            n = sizes[before[again]]
            ends = np.cumsum(n)
            self.sizes[first + again], self.starts[first + again] = n, self.used + ends - n
            self.append(flat[np.repeat(starts[before[again]] - ends + n, n) + np.arange(int(ends[-1]))])
        unknown = np.flatnonzero(before < 0).tolist()
        apart = [k for k in unknown if new[k] in self.bpe.specials]
        joined = [k for k in unknown if new[k] not in self.bpe.specials] if apart else unknown
        for i in range(0, len(joined), 4096):
            some = joined[i : i + 4096]
            ids = np.array(self.bpe.merged([new[k] for k in some]), dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                at = np.array(some) + first
                self.sizes[at] = np.diff(cuts, prepend=0)
                self.starts[at] = self.used + cuts - self.sizes[at]
                self.append(ids)
            else:
                apart += some
        for k in apart:
            special = self.bpe.specials.get(new[k])
            ids = np.array(self.bpe.merged([new[k]]) if special is None else [special], dtype="<u4")
            self.starts[first + k], self.sizes[first + k] = self.used, len(ids)
            self.append(ids)

    def append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


worker = lru_cache(maxsize=2)(Ids)
CACHES.append(worker.cache_clear)


def numbered(rows: list[str], path: str) -> tuple[Ids, list[np.ndarray]]:
    """The known words, and the numbers of each text's words."""
    known = worker(path)
    if 2 * len(known) > CACHE_WORDS or known.used > CACHE_IDS:
        known.turn()
    numbers = [np.fromiter(map(known.__getitem__, w), dtype=np.int64, count=len(w)) for w in map(known.bpe.pieces, rows)]
    if len(known) > known.learned:
        known.learn()
    return known, numbers


def counts(rows: list[str], path: str) -> list[int]:
    """How many ids each text has."""
    known, numbers = numbered(rows, path)
    return [int(known.sizes[n].sum()) for n in numbers]


def tokens(rows: list[str], path: str, end_id: int) -> list[np.ndarray]:
    """Each text's ids with the end id."""
    out = []
    known, numbers = numbered(rows, path)
    for n in numbers:
        sizes = known.sizes[n]
        ends = np.cumsum(sizes)
        ids = np.full(int(ends[-1]) + 1 if len(n) else 1, end_id, dtype="<u4")
        if len(n):
            ids[:-1] = known.flat[np.repeat(known.starts[n] - ends + sizes, sizes) + np.arange(len(ids) - 1)]
        out.append(ids)
    return out


def packed(df: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, group_tokens: int = 1 << 21, key: str = "doc_id", text: str = "text", loss: Column | None = None) -> DataFrame:
    """Whole texts as ids, cut and packed; a row for each piece, with the CRC-32 of its ids.

    loss: whether a row's ids bear loss, as those of an assistant's turns do and those of a user's don't; null is false, and
    without the column all do. A task holds one group: the ends of texts, ``group_tokens`` ids, plus one slice of texts.
    Groups are filled in the order of the input's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray, int, int, bool]] = []  # id, ids, tokens before these, of all, bearing loss

        def rows(seqs) -> pa.RecordBatch:
            nonlocal n
            out = []
            for seq in seqs:
                at, total = 0, sum(x[2] for x in seq)
                for k, ((doc, ids, before, whole, bears), start, length) in enumerate(seq):
                    out.append((doc, before + start, length, zlib.crc32(ids[start : start + length].tobytes()), whole, task * TASK_STRIDE + n, at, k, total, length if bears else 0))
                    at += length
                n += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds], [x.split()[0] for x in PIECES.split(", ")])

        def close() -> pa.RecordBatch:
            whole = list(held)
            named = [[(whole[k], s, length) for k, s, length in seq] for seq in pack([(k, np.full(len(x[1]), x[4], np.int8)) for k, x in enumerate(whole)], limits)]
            held.clear()
            return rows(named)

        filled, step = 0, limits.tokens
        for b in slices(batches):
            full = []
            for doc, bears, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), tokens(texts(b.column(1)), path, end_id), strict=True):
                # A text longer than a sequence gives whole sequences, unless the limit on loss forbids that.
                cut = len(ids) // step * step if limits.loss >= step or not bears else 0
                full += [[((doc, ids, 0, len(ids), bears), s, step)] for s in range(0, cut, step)]
                if cut < len(ids):
                    held.append((doc, ids[cut:].copy(), cut, len(ids), bears))
                    filled += len(ids) - cut
            if full:
                yield rows(full)
            if filled >= group_tokens:
                yield close()
                filled = 0
        if held:
            yield close()

    bears = F.lit(True) if loss is None else F.coalesce(loss.cast("boolean"), F.lit(False))
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), bears.alias("bears")).mapInArrow(run, PIECES)
