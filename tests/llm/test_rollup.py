import random

import pytest
from pyspark.sql import functions as F

import base64
from collections import Counter

import public_tokenizers
import tiktoken
from conftest import ODD
from tokenizers import Tokenizer

from prismark.llm.common import shared_dir
from prismark.llm.rollup import VERSIONS, Rollup, deltas, document_totals, missing, side

SCHEMA = "change_id string, s0 string, l0 string, v0 string, n0 long, s1 string, l1 string, v1 string, n1 long"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    there = lambda k: F.when(F.col(f"v{k}").isNotNull(), side(f"s{k}", f"l{k}", f"v{k}", f"n{k}")).otherwise(missing())
    return df.select("change_id", there(0).alias("before"), there(1).alias("after"))


def state(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_random_history(spark):
    rng = random.Random(1)
    rollup, docs, n = Rollup(spark, shared_dir(spark)), {}, 0
    for batch in range(6):
        rows = []
        for _ in range(40):
            old = docs.pop(i, None) if (i := rng.choice([*docs, None])) is not None and rng.random() < 0.6 else None
            new = None
            if old is None or rng.random() < 0.6:
                new = (rng.choice(["hot", "hot", "b", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.randrange(100))
                docs[f"d{n}"] = new
                n += 1
            rows.append((f"{batch}-{len(rows)}", *(old or (None,) * 4), *(new or (None,) * 4)))
        rows += rows[:7]  # sent twice within the batch
        assert rollup.apply(f"batch-{batch}", changes(spark, rows))
        if batch in (1, 3):
            rollup.compact()
        assert not rollup.apply(f"batch-{batch}", changes(spark, rows))
    want: dict = {}
    for s, lang, v, k in docs.values():
        a, b = want.get((s, lang, v), (0, 0))
        want[s, lang, v] = (a + 1, b + k)
    assert state(rollup) == want
    assert rollup.committed() == [f"batch-{k}" for k in range(6)]


def test_edges(spark):
    rollup = Rollup(spark, shared_dir(spark))
    assert state(rollup) == {} and rollup.committed() == []
    assert rollup.apply("empty", changes(spark, []))
    none = (None,) * 4
    rows = [(None, *none, "s", None, "v", None), (None, *none, "s", None, "v", 5), ("x", *none, *none), ("y", "t", "l", "v", 3, "t", "l", "v", 3)]
    assert rollup.apply("a", changes(spark, rows))
    assert state(rollup) == {("s", None, "v"): (2, 5)}
    assert deltas(changes(spark, rows)).where("source = 't'").first()[3:] == (0, 0)
    for bad in ("", "a/b", "../x"):
        with pytest.raises(ValueError):
            rollup.apply(bad, changes(spark, []))


def test_half_done_attempt_leaves_nothing(spark):
    """An attempt that dies before its rename is no batch; the next one is."""
    rollup = Rollup(spark, shared_dir(spark))
    rows = [("a", None, None, None, None, "s", "l", "v", 4)]
    deltas(changes(spark, rows)).write.parquet(f"{rollup.folder}/staging/dead")
    assert state(rollup) == {}
    assert rollup.apply("one", changes(spark, rows)) and state(rollup) == {("s", "l", "v"): (1, 4)}


def test_a_batch_that_comes_during_a_compaction_counts_once(spark, monkeypatch):
    rollup, row = Rollup(spark, shared_dir(spark)), ("a", None, None, None, None, "s", "l", "v", 4)
    rollup.apply("one", changes(spark, [row]))
    sums, done = Rollup._sums, []

    def late(self, newest, batches):
        if not done:
            done.append(rollup.apply("two", changes(spark, [row])))
        return sums(self, newest, batches)

    monkeypatch.setattr(Rollup, "_sums", late)
    rollup.compact()
    assert done == [True] and state(rollup) == {("s", "l", "v"): (2, 8)}
    rollup.compact()
    assert state(rollup) == {("s", "l", "v"): (2, 8)} and rollup.committed() == ["one", "two"]
    assert not rollup.apply("one", changes(spark, [row])) and not rollup.apply("two", changes(spark, [row]))


def test_a_broken_off_compaction_is_finished_by_the_next(spark, monkeypatch):
    """The sums are committed, but the batches were not cleared: nothing counts twice, and none is applied again."""
    rollup = Rollup(spark, shared_dir(spark))
    for k in range(3):
        rollup.apply(f"b{k}", changes(spark, [(str(k), None, None, None, None, "s", "l", "v", 4)]))
    with monkeypatch.context() as m:
        m.setattr(Rollup, "_cleared", lambda self, batches: None)
        rollup.compact()
    assert state(rollup) == {("s", "l", "v"): (3, 12)} and len(rollup._names("batches")) == 3
    assert not rollup.apply("b1", changes(spark, []))
    rollup.apply("b3", changes(spark, [("x", "s", "l", "v", 4, None, None, None, None)]))
    rollup.compact()
    assert state(rollup) == {("s", "l", "v"): (2, 8)} and rollup._names("batches") == [] and len(rollup._names("markers")) == 4
    rollup.compact()
    assert state(rollup) == {("s", "l", "v"): (2, 8)}


def test_document_totals_against_brute_force(spark):
    """Real tokenizers, null and repeated ids, repeated and null texts, a hot source, clashing columns, empty tables."""
    words, ranks = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
    one = Tokenizer.from_file(words)
    two = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}, special_tokens={})
    rows = [(i, t, "hot" if i % 3 else None, "en" if i % 2 else None, "clash") for i, t in enumerate(ODD)]
    rows += [(3, "another text of the id 3", "hot", "en", "x"), (3, "another text of the id 3", "hot", "en", "x"), (None, "no id", "b", "de", None), (None, "no id", "b", "de", None), (99, "no id", "c", "de", None), (5, None, "c", None, None)]
    labelled = [3, 3, 4, 6, None, 1000, 99, 0]
    keep, seen = [], {}
    for k, (i, t, *_) in enumerate(rows):
        if t is None:
            keep.append(k)
        else:
            seen.setdefault(t, []).append((i is None, i or 0, k))
    keep += [min(v)[2] for v in seen.values()]
    want: Counter = Counter()
    tokens: Counter = Counter()
    for k in keep:
        i, t, source, lang, _ = rows[k]
        again = i is not None and i in labelled
        key = source, lang, VERSIONS[again]
        want[key] += 1
        tokens[key] += len(two.encode_ordinary(t or "")) if again else len(one.encode(t or "", add_special_tokens=False).ids)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, one string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in labelled], "doc_id long, row long")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in document_totals(docs, labels, words, ranks, public_tokenizers.PATTERN).collect()}
    assert got == {k: (want[k], tokens[k]) for k in want}
    assert document_totals(docs.limit(0), labels.limit(0), words, ranks, public_tokenizers.PATTERN).count() == 0
