"""Near duplicates among vectors: spherical k-means cells, blocked cosine products, one representative a group.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors, in the order of a hash of their bytes); every vector is then
assigned to the cell of its nearest centroid and compared, within its label, in blocks of at most about ``BLOCK`` vectors.
Within a cell all blocks are compared. Across cells i and j a vector x of cell i takes part only if some y with
cos(x, y) >= t could lie in cell j: with d = c_j - c_i, the largest value of <y, d> over all such y is
t <x, d> + sqrt(1 - t^2) |d - <x, d> x|, and y lies in cell j only if it is not negative. So cells prune work but lose no
pair, whatever the centroids are. Where vectors have no clusters the bound prunes little and the work is that of blocked
products of all pairs of one label; ``probes`` then limits each vector to its nearest cells, at a loss of pairs.

Pairs of blocks are dealt over tasks. A task tells no pairs: it returns link counts for its vectors, and enough links to
connect what is linked. Vectors of one label that are equal, but for a power of two, are one vector with a count, so copies
cost nothing.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label,
link with nothing; vectors of different lengths do not link; rows that share an id are one vertex, whose links are added up, and have
a row each; rows with a null id link with nothing and are kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm.common import shared_dir, slices, written
from prismark.llm.components import components
from prismark.llm.minhash import by_block, spanning

SAMPLE = 8192
BLOCK = 1024
MOST_CELLS = 4096
ROUNDS = 8


def vectors(df: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, data``: the scaled components as doubles in bytes, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            out: list[bytes | None] = [None] * b.num_rows
            lists = b.column(2)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten()  # without what null lists may hide
            values, null = flat.to_numpy(zero_copy_only=False).astype("<f8"), flat.is_null().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for size in set(sizes.tolist()) - {0}:
                rows = np.flatnonzero(sizes == size)
                at = starts[rows][:, None] + np.arange(size)
                x = values[at]
                ok = ~null[at].any(axis=1) & np.isfinite(x).all(axis=1) & x.any(axis=1)
                rows, x = rows[ok], x[ok]
                # By a power of two, so that squares neither overflow nor vanish; that changes no cosine.
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) + 0.0
                for k, data in zip(rows.tolist(), x, strict=True):
                    out[k] = data.tobytes()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "data"])

    return df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v")).mapInArrow(run, "vec_id long, label string, data binary")


def units(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means on unit vectors; the first centroids are spread over the sample, empty cells keep theirs."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS if k > 1 else 0):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 1e-9] = total[size > 1e-9] / size[size > 1e-9, None]
    return c


def may_reach(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's cell, and (vectors, cells) whether a vector as near as the threshold may lie in the cell."""
    dots = x @ c.T
    home = dots.argmax(axis=1)
    along = dots - dots[np.arange(len(x)), home][:, None]
    size = np.maximum(2 - 2 * (c @ c.T), 0)[home]
    reach = threshold * along + math.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(size - along**2, 0)) >= -1e-9
    reach[np.arange(len(x)), home] = True
    return home, reach


def assigned(distinct: DataFrame, c: np.ndarray | None, threshold: float, probes: int | None) -> DataFrame:
    """``id, label, dim, copies, data, cell, reach``; vectors of another length than the centroids' are in cell 0."""
    shared = distinct.sparkSession.sparkContext.broadcast(c)  # at most MOST_CELLS centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in slices(batches, 1024):
            cell, reach = np.zeros(b.num_rows, dtype=np.int64), [[0]] * b.num_rows
            data = b.column(b.schema.names.index("data")).to_pylist()
            fit = [k for k, v in enumerate(data) if c is not None and len(v) == 8 * c.shape[1]]
            if fit:
                home, may = may_reach(x := units([data[k] for k in fit]), c, threshold)
                if probes is not None:
                    rank = np.argsort(np.argsort(-(x @ c.T), axis=1, kind="stable"), axis=1)
                    may &= rank < max(1, probes)
                for k, h, m in zip(fit, home, may, strict=True):
                    cell[k], reach[k] = h, np.flatnonzero(m).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(reach, pa.list_(pa.int64()))], [*b.schema.names, "cell", "reach"])

    return distinct.select("id", "label", "dim", "copies", "data").mapInArrow(run, "id long, label string, dim int, copies long, data binary, cell long, reach array<long>")


def compared(pairs: DataFrame, threshold: float) -> DataFrame:
    """``id, links, a, b``: link counts of vectors (a and b null), and links a, b that connect a block's groups.

    pairs: ``label, first, second, mine, id, copies, data``, each pair of blocks together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in by_block(batches, 1024):
            same = block[0][1] == block[0][2]
            left = [r for r in block if r[3] == r[1]]
            right = left if same else [r for r in block if r[3] != r[1]]
            if not left or not right:
                continue
            x, y = (np.frombuffer(b"".join([r[6] for r in side]), dtype="<f8").reshape(len(side), -1) for side in (left, right))
            near = (x @ y.T) / (np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :]) >= threshold
            if same:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            counts = [(r[4], int(n)) for r, n in zip(left, near @ np.array([r[5] for r in right]), strict=True) if n]
            if not same:
                counts += [(r[4], int(n)) for r, n in zip(right, near.T @ np.array([r[5] for r in left]), strict=True) if n]
            members = left if same else left + right
            linked = near
            if not same:
                linked = np.zeros((len(members), len(members)), dtype=bool)
                linked[: len(left), len(left) :] = near
            links = [(members[p][4], members[q][4]) for p, q in spanning(linked, np.arange(len(members)))]
            yield pa.record_batch(
                [pa.array([i for i, _ in counts] + [None] * len(links), pa.int64()), pa.array([n for _, n in counts] + [None] * len(links), pa.int64())]
                + [pa.array([None] * len(counts) + [p[k] for p in links], pa.int64()) for k in (0, 1)],
                ["id", "links", "a", "b"],
            )

    rows = pairs.repartition("label", "dim", "first", "second").sortWithinPartitions("label", "dim", "first", "second", "id")
    # The run of rows is told by its first three columns, so label and length go together.
    rows = rows.select(F.struct("label", "dim").alias("group"), "first", "second", "mine", "id", "copies", "data")
    return rows.mapInArrow(run, "id long, links long, a long, b long")


def near_duplicates(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", embedding: str = "embedding", label: str = "label", probes: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    path = shared_dir(df.sparkSession)
    rows = written(vectors(df, key, embedding, label), f"{path}/vectors")
    usable = rows.where("vec_id is not null and label is not null and data is not null")
    distinct = usable.groupBy("label", "data").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("dim", (F.octet_length("data") / 8).cast("int")), f"{path}/distinct")
    largest, total = distinct.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    cells = min(MOST_CELLS, max(1, -(-(largest or 0) // BLOCK)))
    c = None
    if cells > 1:
        share = min(1.0, 1.5 * SAMPLE / total)
        picked = distinct.where(F.pmod(F.xxhash64("data", F.lit(9)), F.lit(1 << 40)) < share * (1 << 40)).select("data", "dim").collect()
        dim = max({r["dim"] for r in picked}, key=[r["dim"] for r in picked].count)
        fit = sorted(bytes(r["data"]) for r in picked if r["dim"] == dim)
        fit = [fit[k] for k in np.linspace(0, len(fit) - 1, min(SAMPLE, len(fit))).astype(int)]
        c = centroids(units(fit), min(cells, len(fit)))
    placed = written(assigned(distinct, c, threshold, probes), f"{path}/cells")
    # Written first: joined with the counts as they come, the vectors of one cell would stay together in one task.
    sized = written(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), f"{path}/sized")
    own = placed.join(sized, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("data", F.lit(4)), F.col("blocks")))
    to = sized.select("label", "dim", F.col("cell").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other_block"))
    name = lambda cell, block: F.col(cell) * (1 << 32) + F.col(block)
    pairs = own.withColumn("other", F.explode("reach")).join(to, ["label", "dim", "other"])
    pairs = pairs.withColumns({"mine": name("cell", "block"), "its": name("other", "other_block")})
    pairs = pairs.select("label", "dim", F.least("mine", "its").alias("first"), F.greatest("mine", "its").alias("second"), "mine", "id", "copies", "data")
    told = written(compared(pairs, threshold), f"{path}/told")
    counts = told.where("id is not null").groupBy("id").agg(F.sum("links").alias("others"))
    found = written(components(told.where("a is not null").select("a", "b"), f"{path}/components"), f"{path}/found")
    of_vector = distinct.join(counts, "id", "left").join(found, "id", "left").select("label", "data", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "id").alias("component"))
    known = rows.join(of_vector, ["label", "data"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return known.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
