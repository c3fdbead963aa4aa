"""Near duplicates by a multi-index Hamming join over b-bit MinHash signatures, links confirmed on full sets.

A signature has ``SYMBOLS`` symbols of 16 bits, one for each of as many hash functions' minima. Two sets with Jaccard
similarity J differ in a binomial number of symbols, each with probability 1 - J. The signature is split into m chunks,
and each chunk's index lists every key with one symbol left out, which enumerates all chunks at distance one or less. By
the pigeonhole principle two signatures at distance 2m - 1 or less share a key, so none of these pairs is lost. m is the
least number for which a pair at the threshold lies farther apart with probability ``miss`` or less.

Groups are never expanded into pairs. Equal sets are one vertex. In each key's bucket every member is first paired with
the bucket's smallest member, its pivot, only; pairs whose signatures are near enough are confirmed on the sets of both
texts. Components of these links follow. Then members of one pivot that are in different components are compared with
each other, in pairs of blocks of bounded size: by signature first, which leaves the members that have a near one in
another component, then by their full sets, as products of 0/1 matrices. A block tells no pairs, only enough links to
connect what is linked. That is exact for components: a pair at signature distance 2m - 1 or less is confirmed, rejected,
or connected already.

Defined results: a set is the distinct shingles of ``words`` words, or the whole sequence if it is shorter; null, empty
and blank texts have empty sets and link with nothing; rows that share an id are one document (a row each in the
result); rows with a null id are returned with a null component and kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import quoted, release, remove, shared_dir, slices, unused, written
from prismark.llm.components import components
from prismark.llm.words import mixed, word_hashes

SYMBOLS = 32
#: Members of a bucket that are compared in one block.
BLOCK = 512
#: Shingles of a block's members, all together.
BLOCK_SHINGLES = 1 << 20
#: Hash buckets of ids that a text must fall into to be sent to a confirmation: the broadcast's fixed bound.
ID_BUCKETS = 1 << 19
M64 = (1 << 64) - 1
SETS = "doc_id long, n_shingles long, set_key binary, signature binary"


def chunks_for(similarity: float, miss: float = 1e-4, symbols: int = SYMBOLS) -> int:
    """The least m for which a pair at the threshold differs in more than 2m - 1 symbols with probability <= miss."""
    p = 1 - similarity
    for m in range(1, symbols // 2 + 1):
        if sum(math.comb(symbols, k) * p**k * (1 - p) ** (symbols - k) for k in range(2 * m, symbols + 1)) <= miss:
            return m
    raise ValueError("no split of the signature reaches so low a similarity")


def numbers(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}") for i in range(n)], dtype=np.uint64)


FACTORS, SHIFTS = numbers(SYMBOLS, 1) | np.uint64(1), numbers(SYMBOLS, 2)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    h, sizes = word_hashes(texts)

    def joined(h: np.ndarray, width: int) -> np.ndarray:
        out = np.full(max(0, len(h) - width + 1), width, dtype=np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return mixed(out)

    every, out, at = joined(h, words), [], 0
    for n in sizes.tolist():
        out.append(np.unique(every[at : at + n - words + 1]) if n >= words else joined(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SYMBOLS) of 16 bits; sets are not empty."""
    out = np.zeros((len(sets), SYMBOLS), dtype="<u2")
    if sets:
        every, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
        for k in range(SYMBOLS):
            out[:, k] = (mixed(np.minimum.reduceat(every * FACTORS[k] + SHIFTS[k], starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def summarised(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, signature``; equal sets have equal keys, empty ones none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets([x or b"" for x in b.column(1).to_pylist()], words)
            full = iter(signatures([s for s in sets if len(s)]))
            yield pa.record_batch(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([next(full).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    return docs.mapInArrow(run, SETS)


def keyed(sets: DataFrame, m: int) -> DataFrame:
    """``key, id`` for ``id, signature``: each chunk's hash without each one of its symbols."""
    parts = np.array_split(np.arange(SYMBOLS), m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype="<u2").reshape(-1, SYMBOLS).astype(np.uint64)
            keys = []
            for c, part in enumerate(parts):
                for left_out in part:
                    h = np.full(len(s), (c << 16 | int(left_out)) + 1, dtype=np.uint64)
                    for k in part:
                        if k != left_out:
                            h = (h ^ s[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                            h ^= h >> np.uint64(32)
                    keys.append(mixed(h))
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(b.column(0).to_numpy(zero_copy_only=False), len(keys)), pa.int64())], ["key", "id"])

    return sets.select("id", "signature").mapInArrow(run, "key long, id long")


def near(pairs: DataFrame, sets: DataFrame, most: int, part: int, whole: int) -> DataFrame:
    """Pairs ``a, b`` whose set sizes allow the similarity and whose signatures differ in at most ``most`` symbols."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("signature").alias(f"{c}_sig"), F.col("n_shingles").alias(f"{c}_n"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(f"{whole} * least(a_n, b_n) >= {part} * greatest(a_n, b_n)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype="<u2").reshape(-1, SYMBOLS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= most))

    return both.select("a", "b", "a_sig", "b_sig").mapInArrow(run, "a long, b long").distinct()


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents that may be among ``id``, by hash bucket: a broadcast of at most ``ID_BUCKETS`` numbers.

    It only spares the shuffles that follow; with very many ids all texts pass, and the result is the same.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    wanted = ids.select(bucket("id").alias("bucket")).distinct()
    return docs.withColumn("bucket", bucket("doc_id")).join(F.broadcast(wanted), "bucket", "left_semi").drop("bucket")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """Pairs whose full sets have whole * intersection >= part * union. Texts travel, not sets: they are shorter."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("data").alias(f"{c}_data"))
    # Texts are dealt by id however few the pairs are, so a plan on little data is the plan on much.
    both = pairs.join(side("b").hint("merge"), "b").join(side("a").hint("merge"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            both = [[x or b"" for x in b.column(k).to_pylist()] for k in (2, 3)]
            texts = list({*both[0], *both[1]})
            of, keep = dict(zip(texts, shingle_sets(texts, words), strict=True)), []
            for x, y in zip(*both, strict=True):
                left, right = of[x], of[y]
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(whole * common >= part * (len(left) + len(right) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_data", "b_data").mapInArrow(run, "a long, b long").distinct()


def in_blocks(rows: DataFrame, carried: list[str]) -> DataFrame:
    """``pivot, i, j, own, id, component`` and the carried columns, a pivot's blocks in pairs, each pair together.

    rows: ``pivot, id, component, blocks``. A pivot's members are dealt over ``blocks`` blocks by a hash; a member goes to
    every pair of its own block, so a task's rows are bounded however many members a pivot has.
    """
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks"))
    spread = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", *carried)
    return spread.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "id")


def by_block(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first three columns."""
    held: list[tuple] = []
    for b in slices(batches, rows):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def rivals(block: list[tuple]) -> np.ndarray:
    """Which pairs of a block's rows are to be compared: of different components, and of both blocks."""
    own, component = (np.array([r[k] for r in block]) for k in (3, 5))
    out = component[:, None] != component[None, :]
    return out if block[0][1] == block[0][2] else out & (own[:, None] != own[None, :])


def close(rows: DataFrame, most: int) -> DataFrame:
    """``pivot, id`` of members that have one of another component within ``most`` symbols. rows carry ``signature``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_block(batches, 2048):
            s = np.frombuffer(b"".join([r[6] for r in block]), dtype="<u2").reshape(-1, SYMBOLS)
            apart = np.zeros((len(s), len(s)), dtype=np.uint8)
            for k in range(SYMBOLS):
                apart += s[:, k][:, None] != s[:, k][None, :]
            found = np.flatnonzero((rivals(block) & (apart <= most)).any(axis=1))
            yield pa.record_batch([pa.array([block[k][0] for k in found], pa.int64()), pa.array([block[k][4] for k in found], pa.int64())], ["pivot", "id"])

    return in_blocks(rows, ["signature"]).mapInArrow(run, "pivot long, id long").distinct()


def spanning(linked: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all components which the matrix of links connects; at most one for each row and round."""
    label, out = np.unique(component, return_inverse=True)[1], []
    linked = linked.copy()
    while linked.any():
        for x in np.flatnonzero(linked.any(axis=1)):
            y = int(linked[x].argmax())
            if label[x] != label[y]:
                out.append((int(x), y))
                label[label == label[y]] = label[x]
        linked &= label[:, None] != label[None, :]
    return out


def linked_sets(rows: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """Links ``a, b`` between members of different components, confirmed on full sets. rows carry ``data``, the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_block(batches, 64):
            sets = shingle_sets([r[6] or b"" for r in block], words)
            n = np.array([len(x) for x in sets], dtype=np.int64)
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            first = np.concatenate([[True], every[1:] != every[:-1]])
            column, uses = np.cumsum(first) - 1, np.diff(np.append(np.flatnonzero(first), len(every)))
            shared = uses[column] > 1  # what only one set has is in no intersection
            number = np.cumsum(uses > 1) - 1
            column, owner = number[column[shared]], owner[shared]
            common = np.zeros((len(sets), len(sets)), dtype=np.float32)
            for at in range(0, int(number[-1]) + 1 if len(number) else 0, 8192):
                inside = slice(*np.searchsorted(column, [at, at + 8192]))
                x = np.zeros((len(sets), 8192), dtype=np.float32)
                x[owner[inside], column[inside] - at] = 1
                common += x @ x.T
            together = common.astype(np.int64)
            ok = (whole * together >= part * (n[:, None] + n[None, :] - together)) & (together > 0) & rivals(block)
            links = spanning(ok, np.array([r[5] for r in block]))
            yield pa.record_batch([pa.array([block[k[c]][4] for k in links], pa.int64()) for c in (0, 1)], ["a", "b"])

    return in_blocks(rows, ["data"]).mapInArrow(run, "a long, b long")


def mixed_pivots(members: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """Members ``pivot, id, component`` of pivots that have several components, with the blocks to deal them over.

    The pivots are written first: a join with the sums as they come would keep a pivot's members together in one task.
    """
    sized = members.join(sets.groupBy("id").agg(F.max("n_shingles").alias("n")), "id")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    groups = sized.groupBy("pivot").agg(blocks.alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return members.join(written(groups.select("pivot", "blocks"), path), "pivot")


def near_duplicates(df: DataFrame, words: int = 5, part: int = 80, whole: int = 100, key: str = "doc_id", text: str = "text", miss: float = 1e-4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row; links have whole * intersection >= part * union."""
    path, m = shared_dir(df.sparkSession), chunks_for(part / whole, miss)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"))
    rows = written(summarised(docs, words), f"{path}/sets")
    linked = rows.where("doc_id is not null and set_key is not null")
    sets = written(linked.groupBy("set_key", "signature", "n_shingles").agg(F.min("doc_id").alias("id")), f"{path}/distinct")
    keys = keyed(sets, m)
    buckets = written(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), f"{path}/buckets")
    star = keys.join(buckets, "key").where("id <> pivot").select("pivot", "id").distinct()
    star = written(star, f"{path}/star")
    first = written(near(star.toDF("a", "b"), sets, 2 * m - 1, part, whole), f"{path}/near")
    links = written(confirmed(first, docs, words, part, whole), f"{path}/links")
    known = written(components(links, f"{path}/components-1"), f"{path}/known")
    # What a pivot's members have to say to each other, where they belong to more than one component.
    release(df.sparkSession)
    named = known.toDF("id", "found")
    members = written(star.join(named, "id", "left").select("pivot", "id", F.coalesce("found", "id").alias("component")), f"{path}/members")
    rivalling = mixed_pivots(members, sets, f"{path}/mixed-1").join(sets.select("id", "signature"), "id").select("pivot", "id", "component", "blocks", "signature")
    near_ones = written(members.join(close(rivalling, 2 * m - 1), ["pivot", "id"]), f"{path}/close")
    if not near_ones.isEmpty():
        texts = texts_of(near_ones.select("id"), docs).select(F.col("doc_id").alias("id"), "data")
        more = written(linked_sets(mixed_pivots(near_ones, sets, f"{path}/mixed-2").join(texts, "id"), words, part, whole), f"{path}/links-2")
        links = links.union(more)
    found = written(components(links, f"{path}/components-2"), f"{path}/found")
    for name in ("buckets", "star", "near", "members", "mixed-1", "mixed-2", "close", "links", "links-2", "known", "components-1", "components-2"):
        remove(df.sparkSession, f"{path}/{name}")
    release(df.sparkSession)
    # From sets to documents.
    of_set = sets.join(found, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("component_id"))
    whole_rows = rows.join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole_rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, **options) -> DataFrame:
    """One row of each class of near copies: that of the lowest id, null last, and of those the lowest hash of the text.

    Rows are told apart by a number of their own, so rows that share an id, or have none, are compared like others. Rows
    without shingles stay, but of those that share an id and a text one does.
    """
    key, text = options.pop("key", "doc_id"), options.pop("text", "text")
    path, number = shared_dir(df.sparkSession), unused(df, "__row")
    rows = written(df.withColumn(number, F.monotonically_increasing_id()), f"{path}/rows")
    found = near_duplicates(rows, key=number, text=text, **options).select(F.col("doc_id").alias("row"), "component_id", "n_shingles")
    named = rows.select(F.col(number).alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("h")).join(found, "row")
    bare = F.col("n_shingles") == 0
    own = F.when(~bare | F.col("id").isNull(), F.col("component_id"))
    classes = named.groupBy(own.alias("class"), F.when(bare, F.col("id")).alias("id"), F.when(bare, F.col("h")).alias("h"))
    kept = written(classes.agg(F.min(F.struct(F.col("id").isNull(), "id", "h", "row"))["row"].alias(number)).select(number), f"{path}/kept")
    # Rows are dealt by number however few stay, so that a plan on little data is the plan on much.
    return rows.join(kept.hint("merge"), number, "left_semi").select(*quoted(df.columns))
