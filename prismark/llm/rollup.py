"""Token counts by source, language and tokenizer version, kept up by signed deltas and committed in batches.

A change has what a document counted as before, and what it counts as after: an insert has no before, a delete no after,
a revision (another tokenizer, a corrected count, another language) has both. Each side is a signed row, and a batch is
their sum by key. Totals are the sum of all committed batches, so they never need the documents again.

A batch is written to a staging folder and committed by one rename to the folder of its id. A batch whose id is there
already, or has a marker, is not applied again, whoever repeats it and however far an earlier attempt came; a change that a
batch holds twice, by its id, counts once. Compaction lists the live batches once, sums these with the compaction before,
and is committed by a rename as well; its ledger names the batches it took. These get their markers and go afterwards; if
that was broken off, the next compaction finishes it first, and totals leave out what the newest ledger names. So looking
an id up asks for two paths, and ledgers hold the batches of one compaction, however many there have been.

Sums are partial before the shuffle, so a source with a third of all changes is a handful of rows a task.

Defined results: null keys are a key; a null count is 0; a change without both sides does nothing; keys whose documents
and tokens are both 0 are not in the totals; a null change id is never taken for a repeat; an empty batch is committed
and changes nothing. In the documents' history every row counts by itself, also rows that share an id or have none; null
texts are never repeats of each other and have no tokens; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import CACHES, remove, shared_dir, slices, texts, written
from prismark.llm.packing import counts

KEYS = ("source", "lang", "tokenizer_version")
DELTAS = "source string, lang string, tokenizer_version string, n_documents long, n_tokens long"


def side(source: Column | str, lang: Column | str, version: Column | str, tokens: Column | str) -> Column:
    """What a document counts as; use a null literal for a missing side."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(col(source).cast("string").alias("source"), col(lang).cast("string").alias("lang"), col(version).cast("string").alias("tokenizer_version"), F.coalesce(col(tokens).cast("long"), F.lit(0).cast("long")).alias("n_tokens"))


def missing() -> Column:
    return F.lit(None).cast("struct<source:string,lang:string,tokenizer_version:string,n_tokens:bigint>")


def deltas(changes: DataFrame) -> DataFrame:
    """Sums by key of ``change_id, before, after``."""
    own = changes.where("change_id is not null").dropDuplicates(["change_id"]).unionByName(changes.where("change_id is null"))
    signed = own.select(F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("x")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("x")))).alias("s")).where("s.x is not null")
    return signed.groupBy(*[F.col(f"s.x.{k}").alias(k) for k in KEYS]).agg(F.sum("s.sign").cast("long").alias("n_documents"), F.sum(F.col("s.sign") * F.col("s.x.n_tokens")).cast("long").alias("n_tokens"))


class Rollup:
    """A rollup in one folder, reached through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self.path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def _commit(self, staged: str, name: str) -> bool:
        """Moves a staged folder to its place; False if something is there."""
        to = self.path(f"{self.folder}/{name}")
        self.files.mkdirs(to.getParent())
        if self.files.exists(to) or not self.files.rename(self.path(staged), to):
            remove(self.spark, staged)
            return False
        inner = self.path(f"{self.folder}/{name}/{staged.rpartition('/')[2]}")
        if self.files.exists(inner):  # two at once: some file systems move into a folder that has just appeared
            self.files.delete(inner, True)
            return False
        return True

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False, and no work, if it is committed already. Ids are words of letters, digits, - and _."""
        if not batch_id or not batch_id.replace("-", "a").replace("_", "a").isalnum():
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._there(f"batches/{batch_id}") or self._there(f"markers/{batch_id}"):
            return False
        staged = f"{self.folder}/staging/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(staged)
        return self._commit(staged, f"batches/{batch_id}")

    def _there(self, name: str) -> bool:
        return self.files.exists(self.path(f"{self.folder}/{name}"))

    def _newest(self) -> tuple[str | None, set[str]]:
        """The newest compaction, and the batches that it took."""
        done = self._names("compactions")
        if not done:
            return None, set()
        at = f"{self.folder}/compactions/{done[-1]}"
        return at, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{at}/ledger").collect()}

    def committed(self) -> list[str]:
        """All ids, for reports: nothing else lists the markers."""
        return sorted({*self._names("markers"), *self._names("batches")})

    def _sums(self, newest: str | None, batches: list[str]) -> DataFrame:
        paths = ([f"{newest}/sums"] if newest else []) + [f"{self.folder}/batches/{b}" for b in batches]
        rows = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("n_documents").alias("n_documents"), F.sum("n_tokens").alias("n_tokens")).where("n_documents <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, n_documents, n_tokens`` over all committed batches."""
        newest, held = self._newest()
        return self._sums(newest, [b for b in self._names("batches") if b not in held])

    def compact(self) -> None:
        """One folder of sums for all batches so far; the batches' own folders go afterwards."""
        newest, held = self._newest()
        self._cleared(held)
        batches = [b for b in self._names("batches") if b not in held]
        staged = f"{self.folder}/staging/{uuid.uuid4().hex}"
        self._sums(newest, batches).write.parquet(f"{staged}/sums")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{staged}/ledger")
        number = int(newest.rpartition("/")[2]) + 1 if newest else 0
        if self._commit(staged, f"compactions/{number:08d}"):
            self._cleared(set(batches))

    def _cleared(self, batches: set[str]) -> None:
        """Batches that a committed compaction took: the marker first, then the folder goes."""
        for b in sorted(batches):
            if self._there(f"batches/{b}"):
                self.files.mkdirs(self.path(f"{self.folder}/markers/{b}"))
                self.files.delete(self.path(f"{self.folder}/batches/{b}"), True)


# The synthetic tables' history

#: The versions that documents are counted by: a file of the tokenizers library, then one of ranks for tiktoken.
VERSIONS = ("word_bpe_49k", "byte_bpe_multi_50k")


@lru_cache(maxsize=2)
def ranked(path: str, pattern: str) -> tiktoken.Encoding:
    """A file of byte strings and their ranks as an encoder without special strings."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


CACHES.append(ranked.cache_clear)


def token_counts(docs: DataFrame, words: str, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``one`` and ``two``: its tokens by the file of words, and by the file of ranks."""
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = texts(b.column(len(kept)))
            one, two = counts(rows, words), [len(ranked(ranks, pattern).encode_ordinary(t)) for t in rows]
            yield pa.record_batch([*b.columns[:-1], pa.array(one, pa.int64()), pa.array(two, pa.int64())], [*kept, "one", "two"])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("one", T.LongType()), T.StructField("two", T.LongType())])
    return docs.select(*kept, text).mapInArrow(run, schema)


def document_totals(docs: DataFrame, labels: DataFrame, words: str, ranks: str, pattern: str) -> DataFrame:
    """Totals after four batches: all documents inserted, repeated texts deleted, labelled ones counted anew, one replay.

    Documents count by ``words``, labelled ones then by ``ranks``. Of rows with equal texts the one with the smallest id
    stays, of those one. The deletion is sent twice, as after a lost answer.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    one, two = VERSIONS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2("text", 256).alias("same"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    counted = written(token_counts(rows, words, ranks, pattern), f"{path}/counted")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("kept")
    repeated = counted.where("same is not null").groupBy("same").agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    # Written first: joined with the sums as they come, the copies of one text would stay together in one task.
    repeated = written(repeated, f"{path}/repeated")
    gone = written(counted.join(repeated, "same").where("row <> kept").select("row", "source", "lang", "one"), f"{path}/gone")
    old, change = side("source", "lang", F.lit(one), "one"), F.col("row").cast("string").alias("change_id")
    rollup = Rollup(spark, f"{path}/rollup")
    rollup.apply("load", counted.select(change, missing().alias("before"), old.alias("after")))
    removal = gone.select(change, old.alias("before"), missing().alias("after"))
    rollup.apply("repeats", removal)
    again = counted.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").join(gone.select("row"), "row", "left_anti")
    rollup.apply("recount", again.select(change, old.alias("before"), side("source", "lang", F.lit(two), "two").alias("after")))
    rollup.compact()
    rollup.apply("repeats", removal)
    return rollup.totals()
