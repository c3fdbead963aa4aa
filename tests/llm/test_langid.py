import random

import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismark.llm import langid

ENGLISH = "the quick brown fox jumps over the lazy dog and runs through the green forest with all of its friends while the sun is shining "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft durch den grünen wald mit allen seinen freunden während die sonne scheint "


@settings(max_examples=100, deadline=None)
@given(st.text("ab ", max_size=30), st.text("abc ", max_size=30))
def test_automaton_is_a_factor_oracle(text, query):
    a, n, at = langid.Automaton(text), 0, 0
    while at < len(query):
        size = next((k for k in range(len(query) - at, 0, -1) if query[at : at + k] in text), 1)
        n, at = n + 1, at + size
    assert a.phrases(query) == n


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abcdü .D7", max_size=700), min_size=1, max_size=8))
def test_table_agrees_with_automata(texts):
    samples = {"x": "abab dca. bad", "y": "üda caü bbb"}
    m = langid.Model(samples)
    got = m.phrases(texts)
    for row, t in zip(got, texts, strict=True):
        p = langid.plain(t)
        for k, s in enumerate(samples.values()):
            a = langid.Automaton(langid.plain(s))
            assert row[k] == sum(a.phrases(p[i : i + langid.PIECE]) for i in range(0, len(p), langid.PIECE))


def test_learning_and_odd_rows(spark, odd):
    labelled = spark.createDataFrame([(i, "en" if i % 2 else "de", (ENGLISH if i % 2 else GERMAN) * 5) for i in range(40)] + [(90, None, "x"), (91, "fr", None), (92, "", "y"), (None, "en", ENGLISH)], "id long, lang string, text string")
    m = langid.learned(labelled)
    assert m.languages == ["en", "de"]
    got = langid.predicted(odd, m).collect()
    assert len(got) == len(ODD) + 2 and set(got[0].asDict()) == {"doc_id", "text", "lang", "data", "id", "lang_pred", "score"}
    for r in got:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1 and (letters or r.score == 0)
    new = spark.createDataFrame([(1, "The DOG runs through a forest!!"), (2, "Der Hund läuft *** durch den Wald."), (3, ENGLISH * 3000)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predicted(new, m).orderBy("doc_id").collect()] == ["en", "de", "en"]
    assert langid.learned(labelled.limit(0)) is None
    assert langid.predicted(new, None).agg(F.min("lang_pred"), F.max("score")).first()[:] == ("und", 0.0)
    assert langid.predicted(new.limit(0), m).count() == 0


def test_held_out_accuracy(spark):
    from prismark.llm.queries import op6_cross_parsing

    sf = "/root/testdata/sf0.001"
    got = op6_cross_parsing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abcdü .D7", max_size=700), min_size=1, max_size=8))
def test_sparse_steps_agree_with_the_dense_table(texts):
    samples = {"x": "abab dca. bad", "y": "üda caü bbb", "z": "cc"}
    dense = langid.Model(samples)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "DENSE", 0)
        patch.setattr(langid, "ABREAST", 2)
        sparse = langid.Model(samples)
        assert dense.table is not None and sparse.table is None
        assert (dense.phrases(texts) == sparse.phrases(texts)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcdü .D7", max_size=700), min_size=1, max_size=8), st.sampled_from([1, 2, 7, 256]), st.booleans())
def test_joined_pieces_are_the_uncut_parse(texts, piece, long):
    texts = [*texts, "ab" * 400, "abab dca bad " * 60, "ü" * 600]
    samples = {"x": "abab dca. bad", "y": "üda caü bbb", "z": texts[0] + ("abab dca bad " * 50 if long else "")}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "PIECE", piece)
        patch.setattr(langid, "ABREAST", 2)
        got = langid.Model(samples).phrases(texts, joined=True)
    for k, s in enumerate(samples.values()):
        a = langid.Automaton(langid.plain(s))
        assert [r[k] for r in got] == [a.phrases(langid.plain(t)) for t in texts]


def test_prediction_is_by_the_uncut_parse(spark):
    """The text is one phrase of one language, though it is longer than a piece."""
    m = langid.Model({"en": ENGLISH * 10, "de": GERMAN * 10})
    t = ENGLISH * 5
    a = [langid.Automaton(langid.plain(x * 10)).phrases(langid.plain(t)) for x in (ENGLISH, GERMAN)]
    row = langid.predicted(spark.createDataFrame([(1, t)], "doc_id long, text string"), m).first()
    assert a[0] == 1 and row.lang_pred == "en" and row.score == 1 - 1 / a[1]


@pytest.mark.parametrize("model_chars", [langid.MODEL_CHARS, 90 * 300])
def test_every_label_is_learned(spark, monkeypatch, model_chars):
    """90 labels with words of their own: the rare ones are predicted as well as the common ones."""
    monkeypatch.setattr(langid, "MODEL_CHARS", model_chars)
    rng = random.Random(4)
    words = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20)] for k in range(90)}
    text = lambda k: " ".join(rng.choices(words[k], k=30))
    rows = [(k, text(k)) for i, k in enumerate(words) for _ in range(92 - i)]
    m = langid.learned(spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "lang string, text string, id long"))
    assert m.languages == list(words)
    new = spark.createDataFrame([(k, text(k)) for k in words], "lang string, text string")
    assert all(r.lang == r.lang_pred for r in langid.predicted(new, m).collect())


def test_samples_and_documents_fold_alike():
    """A dotted capital I, a final sigma and letters without case: a text's codes are its own sample's."""
    for t in ("İSTANBUL'DAN ISPARTA'YA", "ΣΑΣ ΟΔΟΣ σας", "Straße ẞ ǅ ﬁ", "日本語"):
        m = langid.Model({"x": t, "y": "zzz"})
        assert m.phrases([t], joined=True)[0, 0] == 1 and m.known([t]) == [1.0]
        assert [len(langid.plain(c)) for c in t] == [1] * len(t)


def test_sample_is_of_distinct_texts(spark):
    """A group of copies, without ids, that is nearly all of a label gives one excerpt, and rare texts are learned."""
    rows = [("en", "spam spam spam " * 200)] * 3000 + [("en", f"{ENGLISH} {k}") for k in range(30)] + [("de", GERMAN)] * 5
    df = spark.createDataFrame(rows, "lang string, text string")
    seen = []
    model, langid.Model = langid.Model, lambda samples: seen.append(samples) or model(samples)
    try:
        m = langid.learned(df, sample_chars=6000)
    finally:
        langid.Model = model
    assert seen[0]["en"].count("spam") <= langid.EXCERPT // 5 + 1 and "quick brown" in seen[0]["en"] and seen[0]["de"] == GERMAN
    assert m.languages == ["en", "de"]
