import corpus_pipeline
from test_minhash import brute
from test_packing import check

from prismark.llm.queries import oracle_sql, queries


def test_stages(spark, word_bpe):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !!", "en", "s", 8), (10**6 + 2, "", None, None, None), (None, "with the and of that this by for are was", "en", "s", 9)], docs.schema)
    docs = docs.union(extra).union(docs.limit(3))
    before = {r.doc_id: r for r in docs.collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 3:
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), docs.schema)
            kept[name] = [r.doc_id for r in docs.collect()]
            assert all(before[r.doc_id] == r for r in docs.collect())
    assert {*before} - {*kept["language"]} == {10**6, 10**6 + 1, 10**6 + 2}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {*kept["language"]} - {*kept["toxicity"]}
    assert all(labels.get(i, 1) == 1 for i in gone)
    inside = [(i, before[i].text) for i in {*kept["toxicity"]} - {None}]
    want = sorted({c for _, c in brute(inside, 5, 80, 100).values()})
    assert sorted(i for i in kept["near duplicates"] if i is not None) == want and None in kept["near duplicates"]
    check(out.collect(), {i: before[i].text for i in [*want, None]}, word_bpe)


def test_names():
    assert set(queries()) - {n for n in queries() if n.startswith("op")} == {"instruction_packing"}
    found = sorted((n for n in queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in found] == [f"op{k}" for k in range(1, 11)] and set(oracle_sql()) <= set(found)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near duplicates", "packing"]


def test_language_rejects_scripts_that_no_label_teaches(spark):
    taught = [(k, "the dog runs through the green forest" if k % 2 else "der hund läuft durch den wald", "en" if k % 2 else "de") for k in range(20)]
    odd = [(100, "собака бежит через лес", None), (101, "日本語 テキスト", ""), (102, "the dog 犬", None), (103, "12 !!", None), (104, None, None)]
    kind = "doc_id long, text string, lang string"
    got = corpus_pipeline.language(spark, spark.createDataFrame(taught + odd, kind), "")
    assert got.columns == ["doc_id", "text", "lang"] and sorted(r.doc_id for r in got.collect()) == [*range(20), 102]
    bare = spark.createDataFrame([(i, t, None if i % 2 else "") for i, t, _ in taught + odd], kind)
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, bare, "").collect()) == [*range(20), 100, 101, 102]


def test_clashing_columns_pass_through(spark):
    """Input columns that are named like what a stage works with keep their values, whatever their case or characters."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    mine = ("is_toxic", "P_TOXIC", "_is_toxic", "lang_pred", "Score", "known", "__row", "component_id", "a.b", "data")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.lit(f"my {c}").alias(c) for c in mine])
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 100 < len(rows) and all(r[c] == f"my {c}" for r in rows for c in mine), name


def test_run_deletes_what_stages_wrote(spark, monkeypatch):
    """After a run only the last stage's table is left of what it wrote; a stage gets what the one before kept."""
    import os

    from prismark.llm import common

    seen = []

    def stage(drop):
        def f(spark, docs, sf_dir):
            seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
            return common.written(docs.where(f"doc_id % {drop} <> 0"), f"{common.shared_dir(spark)}/x")

        return f

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage(2)), ("b", stage(3)), ("c", stage(5))])
    before = len(common.MADE)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert seen[1] == [i for i in seen[0] if i % 2] and sorted(r.doc_id for r in out.collect()) == [i for i in seen[2] if i % 5]
    assert len(common.MADE) == before + 1
    assert [n for n in os.listdir(common.MADE[-1].removeprefix("file://")) if not n.startswith(".")] == ["2"]


def test_a_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    import pytest

    from prismark.llm import common

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())
