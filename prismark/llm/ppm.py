"""Prediction by partial matching: a byte-context trie, learned from a corpus, gives each whole text's code length.

Texts are UTF-8 with A-Z lowered, then one end symbol. A symbol is predicted from the ``ORDER`` symbols before it; a text
begins after as many start symbols. Where the context has not seen the symbol, an escape goes to the next shorter one:
with T occurrences of d distinct symbols the escape has d / 2T and a symbol with n occurrences (2n - 1) / 2T. Symbols
that a longer context has seen can't come after an escape from it, so the shorter one's T and d leave them out; a context
without other symbols escapes for nothing. Below order 0 the symbols never seen share the rest evenly.

What a context has seen, its shorter ones have seen too, so the symbols left out are exactly those of the longer context,
and a symbol's probability depends only on the string of context and symbol. The trie is a set of tables of such strings
and their counts, one table an order. All of the corpus is counted; no count is dropped or capped.

Exchange: a task's documents lie in blocks of about ``BLOCK_BYTES``, in the order they are read, so no id decides where a
row goes. A block gives its distinct strings (and the hashes of its words, for the unigram base score) as sorted arrays,
dealt over at most ``FAN`` parts by a digit of the strings' hash. At each level up to ``FAN`` blocks, or groups of them,
are merged for each part and dealt on by the next digit, until one group is left, so a block and a level have at most
``FAN`` rows however many blocks there are. The merged counts become tables of probabilities by joins; the values go back
by the same levels, and each block scores its documents. So no model is broadcast or held whole by one task, and traffic
is in proportion to blocks' distinct strings, not to the text.

Defined results: null texts count as empty; an empty text has the end symbol only; equal texts have equal scores; rows
that share an id each get a row; a null id is in fold 0, which is learned from; with nothing learned, symbols are
uniform over 257; other columns are ignored. Words are told apart by 63 bits of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import fold, release, remove, shared_dir, slices, written
from prismark.llm.words import word_hashes

ORDER = 5
BITS = 9
START, END, SYMBOLS = 257, 256, 257
BLOCK_BYTES = 8 << 20
#: Blocks that are merged at a time, and parts that strings are dealt over at a time.
FAN = 128
#: Most tasks of an exchange; beyond, a task has several blocks or groups, one after another.
MOST_TASKS = 1 << 15
LEAST_PARTS = 16
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_symbols long"

def zipped(a: np.ndarray, level: int = 3) -> bytes:
    return np.int64(a.nbytes).tobytes() + pa.Codec("zstd", compression_level=level).compress(a.tobytes(), asbytes=True)


def unzipped(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int(np.frombuffer(b[:8], dtype=np.int64)[0]), codec="zstd", asbytes=True), dtype=dtype)


def zipped_floats(a: np.ndarray) -> bytes:
    """Bytes of one weight together: exponents are alike."""
    return zipped(np.ascontiguousarray(a.astype("<f8").view(np.uint8).reshape(-1, 8).T))


def unzipped_floats(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unzipped(b, "u1").reshape(8, -1).T).view("<f8").ravel()


def zipped_sorted(a: np.ndarray) -> bytes:
    return zipped(np.diff(a, prepend=np.int64(0)))


def unzipped_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unzipped(b, "<i8"))


def groups(sizes: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes, as (first, end): arrays over one stay in a processor's cache."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield first, end
        first = end


def strings(text: bytes, sizes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The number of each symbol's string in joined texts, a text's end symbol included."""
    n = sizes + 1 + order
    ends = np.cumsum(n)
    at = np.full(int(ends[-1]), START, dtype=np.int64)
    shift = ends - n + order - (np.cumsum(sizes) - sizes)
    at[np.arange(len(text)) + np.repeat(shift, sizes)] = np.frombuffer(text, dtype=np.uint8)
    at[ends - 1] = END
    out = at[: len(at) - order]
    for k in range(1, order + 1):
        out = (out << BITS) | at[k : len(at) - order + k]
    own = np.repeat(np.cumsum(n - order) - (n - order), n - order)
    return out[np.arange(len(own)) - own + np.repeat(ends - n, n - order)]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")  # runs in order are merged
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else [])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def distinct(text: bytes, sizes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings and words of joined texts, in order, and how often each occurs in texts that are not held out.

    By pieces of about a megabyte, which are merged: the array of all strings would be eight times the text.
    """
    parts, ends = [], np.concatenate([[0], np.cumsum(sizes)])
    for first, end in groups(sizes, 1 << 20):
        for out in (False, True):
            some = first + np.flatnonzero(held[first:end] == out)
            if len(some):
                data = b"".join([text[ends[k] : ends[k + 1]] for k in some])
                found, at = [words(data, sizes[some])[0]], 0
                for i, j in groups(sizes[some]):
                    size = int(sizes[some[i:j]].sum())
                    found.append(strings(data[at : at + size], sizes[some[i:j]]))
                    at += size
                keys = np.concatenate(found)
                keys.sort()
                here = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                parts.append((keys[here], np.zeros(len(here), np.int64) if out else np.diff(np.append(here, len(keys)))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def words(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of joined texts' words, and how many each text has. Words are negative numbers, strings of symbols are not."""
    ends, n, out = np.cumsum(sizes).tolist(), np.zeros(len(sizes), dtype=np.int64), []
    for first, end in groups(sizes):
        h, n[first:end] = word_hashes([text[ends[k - 1] if k else 0 : ends[k]] for k in range(first, end)])
        out.append((h | np.uint64(1 << 63)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64), n


class Values:
    """key -> value by open addressing over arrays; every key that is asked for must be there."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2.5 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.NONE), np.zeros(1 << self.bits)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            free = self.keys[slot] == self.NONE
            self.keys[slot[free]] = keys[left[free]]
            ok = self.keys[slot] == keys[left]
            self.values[slot[ok]] = values[left[ok]]
            left = left[~ok]
            at[left] = self._after(at[left])

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _after(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & (1 << self.bits) - 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        out, left = self.values[at], np.flatnonzero(self.keys[at] != keys)
        at = at[left]
        while len(left):
            at = self._after(at)
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left, at = left[~hit], at[~hit]
        return out


def placed(docs: DataFrame) -> DataFrame:
    """``block, ids, held, sizes, text``: a task's documents as they come, in blocks, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, block = 0, TaskContext.get().partitionId() << 32

        def give() -> pa.RecordBatch:
            ids, out, data = zip(*held, strict=True)
            row = block, list(ids), list(out), zipped(np.array([len(x) for x in data], dtype=np.int64)), zipped(np.frombuffer(b"".join(data), dtype=np.uint8), 6)
            held.clear()
            return pa.record_batch([pa.array([c], k) for c, k in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()), strict=True)], ["block", "ids", "held", "sizes", "text"])

        for b in slices(batches):
            for doc, out, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((doc, out, (data or b"").lower()))
                size += len(held[-1][2])
            if size >= BLOCK_BYTES:
                yield give()
                size, block = 0, block + 1
        if held:
            yield give()

    return docs.select("doc_id", "held_out", "data").mapInArrow(run, "block long, ids array<long>, held array<boolean>, sizes binary, text binary")


def opened(batch: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray, bytes]:
    """A block's documents: ids, held out or not, sizes, joined texts. batch has one row."""
    ids, held, sizes, text = (batch.column(batch.schema.names.index(c))[0] for c in ("ids", "held", "sizes", "text"))
    return ids.as_py(), np.array(held.as_py(), dtype=bool), unzipped(sizes.as_py(), "<i8"), unzipped(text.as_py(), "u1").tobytes()


def fans(blocks: int) -> list[int]:
    """How many parts strings are dealt over at each level: at most ``FAN``, together about one for each block."""
    out = []
    while blocks > FAN:
        out.append(FAN)
        blocks = -(-blocks // FAN)
    return [*out, max(LEAST_PARTS, blocks)]


def digit_of(keys: np.ndarray, fan: list[int], level: int) -> np.ndarray:
    """The part of each key at a level, by its hash."""
    rest = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    for f in fan[:level]:
        rest = rest // np.uint64(f)
    return (rest % np.uint64(fan[level])).astype(np.uint8)


def dealt(keys: np.ndarray, fan: list[int], level: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by part, stable, and where each part ends."""
    digit = digit_of(keys, fan, level)
    return np.argsort(digit, kind="stable"), np.cumsum(np.bincount(digit, minlength=fan[level]))


PARTS = "place long, prefix long, member long, keys binary, counts binary"


def parts_of(place: int, prefix: int, member: int, keys: np.ndarray, counts: np.ndarray, fan: list[int], level: int) -> pa.RecordBatch:
    """A row of ``PARTS`` for each part of the keys that has any."""
    order, ends = dealt(keys, fan, level)
    keys, counts = keys[order], counts[order]
    rows = [(place, prefix * fan[level] + k, member, zipped_sorted(keys[i:j]), zipped(counts[i:j])) for k, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if j > i]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in PARTS.split(", ")])


def counted(blocks: DataFrame, fan: list[int], places: int) -> DataFrame:
    """The strings and words of each block, dealt for the first level; counts are of learned documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            block = b.column(0)[0].as_py()
            _, held, sizes, text = opened(b)
            keys, counts = distinct(text, sizes, held)
            yield parts_of(xxhash.xxh3_64_intdigest(str(block)) % places, 0, block, keys, counts, fan, 0)

    return blocks.mapInArrow(run, PARTS)


def together(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """Dealt over a number of tasks that follows the blocks, not the session's settings."""
    return df.repartition(tasks, *keys)


def merged(parts: DataFrame, fan: list[int], level: int, tasks: int) -> DataFrame:
    """The sums of each place's parts, dealt on for the next level; at the last one ``bucket, key, n``."""
    last = level == len(fan)

    def run(table: pa.Table) -> pa.Table:
        place, prefix = (table.column(c)[0].as_py() for c in ("place", "prefix"))
        keys, counts = (np.concatenate([f(x.as_py()) for x in table.column(c)]) for c, f in (("keys", unzipped_sorted), ("counts", lambda x: unzipped(x, "<i8"))))
        keys, counts = summed(keys, counts)
        if last:
            return pa.table([pa.array(np.full(len(keys), prefix)), pa.array(keys), pa.array(counts)], names=["bucket", "key", "n"])
        return pa.Table.from_batches([parts_of(place // FAN, prefix, place, keys, counts, fan, level)])

    return together(parts, tasks, "place", "prefix").groupBy("place", "prefix").applyInArrow(run, "bucket long, key long, n long" if last else PARTS)


def probabilities(counts: DataFrame, path: str, order: int = ORDER) -> DataFrame:
    """``key, value``: log10 of each string's probability. counts: ``key, n`` for all strings, 0 for those not learned."""
    symbols = lambda c, n: F.col(c).bitwiseAND(F.lit((1 << BITS * n) - 1))
    # Strings of two symbols are 258 * 257 at most, so such a table may be broadcast; longer ones are not.
    side = lambda df, n: F.broadcast(df) if n <= 2 else df.hint("merge")
    nodes, contexts = {}, {}
    nodes[order] = counts.where("n > 0").select("key", "n")
    for o in range(order, -1, -1):
        if o < order:
            nodes[o] = written(nodes[o + 1].groupBy(symbols("key", o + 1).alias("key")).agg(F.sum("n").alias("n")), f"{path}/nodes-{o}")
        contexts[o] = nodes[o].groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    for o in range(order, 0, -1):  # what a context's own symbols amount to in the next shorter one
        shorter = nodes[o - 1].select(F.col("key").alias("short"), F.col("n").alias("short_n"))
        out = nodes[o].withColumn("short", symbols("key", o)).join(side(shorter, o), "short")
        out = out.groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("short_n").alias("left_out"))
        contexts[o] = written(contexts[o].join(side(out, o), "context"), f"{path}/contexts-{o}")

    def level(o: int, keys: DataFrame) -> DataFrame:
        """``key, value`` for strings whose symbol the context of order o + 1, if there is one, has not seen."""
        x = keys.select("key", symbols("key", o + 1).alias("node")).withColumn("context", F.shiftright("node", BITS))
        x = x.join(side(nodes[o].toDF("node", "n"), o + 1), "node", "left").join(side(contexts[o].select("context", "total", "kinds"), o), "context", "left")
        if o < order:
            longer = contexts[o + 1].select(F.col("context").alias("longer"), F.col("kinds").alias("longer_kinds"), "left_out")
            x = x.withColumn("longer", F.shiftright("key", BITS)).join(side(longer, o + 1), "longer", "left")
        else:
            x = x.withColumns({"longer_kinds": F.lit(0), "left_out": F.lit(0)})
        kinds = F.coalesce("kinds", F.lit(0)) - F.coalesce("longer_kinds", F.lit(0))
        total = F.coalesce("total", F.lit(0)) - F.coalesce("left_out", F.lit(0))
        x = written(x.select("key", "node", "n", kinds.alias("kinds"), (2 * total).alias("all"), F.coalesce("kinds", F.lit(0)).alias("seen")), f"{path}/level-{o}")
        hit = x.where("n is not null").select("key", F.log10((2 * F.col("n") - 1) / F.col("all")).alias("value"))
        escape = F.when(F.col("kinds") > 0, F.log10(F.col("kinds") / F.col("all"))).otherwise(0.0)
        miss = x.where("n is null")
        if o:
            lower = level(o - 1, miss.select(F.col("node").alias("key")).distinct())
            missed = miss.join(side(lower.toDF("node", "rest"), o + 1), "node").select("key", (escape + F.col("rest")).alias("value"))
        else:
            missed = miss.select("key", (escape - F.log10(F.lit(SYMBOLS) - F.col("seen"))).alias("value"))
        return hit.union(missed)

    return written(level(order, counts.select("key")), f"{path}/values")


VALUES = "place long, prefix long, digit int, values binary"


def valued(keys: np.ndarray, table: pa.Table, fan: list[int], level: int) -> np.ndarray:
    """The values of sorted keys from those of their parts."""
    order, ends = dealt(keys, fan, level)
    starts, out = np.concatenate([[0], ends[:-1]]), np.empty(len(keys))
    for k, part in zip(table.column("digit").to_pylist(), table.column("values"), strict=True):
        out[order[starts[k] : ends[k]]] = unzipped_floats(part.as_py())
    return out


def returned(parts: DataFrame, values: DataFrame, fan: list[int], level: int, tasks: int) -> DataFrame:
    """``VALUES`` for the members that gave ``parts`` to a level, in the order of each one's strings.

    A member knows its strings, so they don't travel back. values: of the level after this, at the last ``bucket, key, value``.
    """
    last, parts = level == len(fan), parts.select("place", "prefix", "member", "keys")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if last:
            keys, value = (right.column(c).to_numpy() for c in ("key", "value"))
            order = np.argsort(keys)
            keys, value = keys[order], value[order]
        else:
            keys = np.unique(np.concatenate([unzipped_sorted(x.as_py()) for x in left.column("keys")]))
            value = valued(keys, right, fan, level)
        prefix = left.column("prefix").to_numpy()
        found = [zipped_floats(value[np.searchsorted(keys, unzipped_sorted(k.as_py()))]) for k in left.column("keys")]
        return pa.table([left.column("member"), pa.array(prefix // fan[level - 1]), pa.array((prefix % fan[level - 1]).astype(np.int32)), pa.array(found, pa.binary())], names=[x.split()[0] for x in VALUES.split(", ")])

    if last:
        return together(parts, tasks, "prefix").groupBy("prefix").cogroup(together(values, tasks, "bucket").groupBy("bucket")).applyInArrow(run, VALUES)
    return together(parts, tasks, "place", "prefix").groupBy("place", "prefix").cogroup(together(values, tasks, "place", "prefix").groupBy("place", "prefix")).applyInArrow(run, VALUES)


def scored(df: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's log10 probability and unigram base score, learned from the documents that are not held out."""
    spark = df.sparkSession
    path = shared_dir(spark)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").cast("binary").alias("data"))
    size, ends = docs.agg(F.sum(F.coalesce(F.octet_length("data"), F.lit(0)) + 1), F.sum(F.when(F.col("held_out"), 0).otherwise(1))).first()
    # Many small partitions would be as many small blocks.
    few = max(-(-(size or 0) // BLOCK_BYTES), spark.sparkContext.defaultParallelism)
    laid = written(placed(docs.coalesce(few)), f"{path}/laid", compression="uncompressed")
    blocks = max(1, laid.count())
    fan, tasks, places = fans(blocks), min(MOST_TASKS, 2 * blocks), [-(-blocks // FAN)]
    parts = [written(counted(laid, fan, places[0]), f"{path}/parts-1", compression="uncompressed")]
    for level in range(1, len(fan)):
        parts.append(written(merged(parts[-1], fan, level, tasks), f"{path}/parts-{level + 1}", compression="uncompressed"))
    counts = written(merged(parts[-1], fan, len(fan), tasks), f"{path}/counts")
    release(spark)
    found, kinds = counts.where("key < 0 and n > 0").agg(F.sum("n"), F.count("*")).first()
    ends = ends or 0
    total, kinds = (found or 0) + ends, kinds + (1 if ends else 0)
    values = probabilities(counts.where("key >= 0"), f"{path}/trie").join(counts.where("key >= 0").select("key", "bucket"), "key").select("bucket", "key", "value")
    values = written(values.union(counts.where("key < 0").select("bucket", "key", F.col("n").cast("double"))), f"{path}/values")
    for done in ("trie", "counts"):
        remove(spark, f"{path}/{done}")
    release(spark)
    for level in range(len(fan), 0, -1):
        values = written(returned(parts[level - 1], values, fan, level, tasks), f"{path}/returned-{level}", compression="uncompressed")
        for done in (f"parts-{level}", f"returned-{level + 1}" if level < len(fan) else "values"):
            remove(spark, f"{path}/{done}")
        release(spark)
    share = total + kinds + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, sizes, data = opened(left.to_batches()[0])
        numbers, n = words(data, sizes)
        keys, _ = distinct(data, sizes, held)
        known_values = Values(keys, valued(keys, right, fan, 0))
        score, begin = np.zeros(len(ids)), 0
        for first, end in groups(sizes):
            size = sizes[first:end]
            found = known_values.of(strings(data[begin : begin + int(size.sum())], size))
            score[first:end] = np.add.reduceat(found, np.cumsum(size + 1) - size - 1)
            begin += int(size.sum())
        seen = known_values.of(numbers)
        owner = np.repeat(np.arange(len(ids)), n)
        base = np.bincount(owner, weights=np.log10((seen + 1) / share), minlength=len(ids)) + np.log10((ends + 1) / share)
        known = np.bincount(owner[seen > 0], minlength=len(ids)) + (1 if ends else 0)
        cols = [(ids, pa.int64()), (held, pa.bool_()), (n + 1, pa.int64()), (known, pa.int64()), (np.full(len(ids), total), pa.int64()), (base, pa.float64()), (score, pa.float64()), (sizes + 1, pa.int64())]
        return pa.table([pa.array(c, k) for c, k in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return together(laid, tasks, "block").groupBy("block").cogroup(together(values, tasks, "place").groupBy("place")).applyInArrow(run, SCHEMA)


def held_out_by(n: int = 7, rest: int = 2, key: str = "doc_id"):
    """Documents whose fold of ``n`` is ``rest``."""
    return fold(key, n) == rest
