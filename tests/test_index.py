"""Worked example, edge cases and properties of the index."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom import schemas, session
from lexiloom.functions import text
from lexiloom.operators import index, morph, vocab
from lexiloom.session import salted_join

DOCS = "article string, titre string, texte string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("1", "Pomme rouge", "La pomme."), ("2", "Chaise", "la chaise, ROUGE")], DOCS)


@pytest.fixture(scope="module")
def freq(docs):
    return index.tf(index.tokenise(docs))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_worked_example(freq):
    assert rows(index.tfidf(freq)) == [
        ("1", "la", 0.0), ("1", "pomme", 0.602), ("1", "rouge", 0.0), ("2", "chaise", 0.602), ("2", "la", 0.0), ("2", "rouge", 0.0),
    ]
    assert rows(index.idf(freq)) == [("chaise", 1, 0.301), ("la", 2, 0.0), ("pomme", 1, 0.301), ("rouge", 2, 0.0)]
    assert rows(vocab.antidictionary(freq)) == [("la",), ("rouge",)]
    assert rows(index.postings(freq)) == [("chaise", ["2"]), ("la", ["1", "2"]), ("pomme", ["1"]), ("rouge", ["1", "2"])]


def test_forward_and_blocks(docs, freq):
    assert rows(index.forward(index.tokenise(docs)))[0] == ("1", ["pomme", "rouge", "la", "pomme"])
    joined = index.posting_blocks(freq).groupBy("token").agg(F.array_sort(F.flatten(F.collect_list("articles"))))
    assert rows(joined) == rows(index.postings(freq))


def test_filtered_worked_example(docs, freq):
    rule = vocab.stop_rules(vocab.antidictionary(freq))
    assert rows(vocab.substitute(docs, rule, ("titre", "texte"))) == [("1", "pomme", "pomme"), ("2", "chaise", "chaise")]


def test_substitution(spark):
    rule = vocab.rules(spark.createDataFrame([(1, "pomme", "poire"), (2, "la", None), (3, "pomme", "fruit rond"), (4, None, "x")], schemas.SUBSTITUTIONS))
    docs = spark.createDataFrame([("1", "La pomme."), ("2", "la LA"), ("3", None), ("4", "")], "article string, texte string")
    assert rows(vocab.substitute(docs, rule)) == [("1", "fruit rond"), ("2", ""), ("3", None), ("4", "")]


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    freq = index.tf(index.tokenise(none))
    for df in (index.tfidf(freq), index.postings(freq), vocab.antidictionary(freq), index.series(index.tfidf(freq))):
        assert df.count() == 0
    assert index.doc_count(freq).first()[0] == 0


def test_stored_tokens(spark):
    raw = [("1", 0, " De "), ("1", 0, " De "), ("1", 1, None), ("1", 1, "\ta "), (None, 0, "x"), ("2", 0, "\xa0"), ("2", None, "y")]
    assert sorted(rows(index.stored_tokens(spark.createDataFrame(raw, schemas.TOKENS))), key=str) == [("1", 0, "de"), ("1", 1, "a"), ("2", None, "y")]


def test_salted_join_keeps_hot_keys_whole(spark):
    left = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = salted_join(left, right, "key", F.col("v"), F.col("n"))
    assert out.count() == 20000 and out.select("v").distinct().count() == 20000
    assert out.where("key = 'hot'").select("n").distinct().collect()[0][0] == 6667


def test_flagged_keeps_rows_and_hot_keys(spark, monkeypatch):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("key"), F.col("id").alias("v"))
    right = session.cut(spark.createDataFrame([(7, "hot"), (8, "cold"), (-1, "none")], "key long, name string"))
    want = rows(left.join(right, "key", "left").select("v", F.coalesce("name", F.lit(""))))
    monkeypatch.setattr(session.broadcast_if_small, "__defaults__", (0, 0))
    monkeypatch.setattr(session.hot_keys, "__defaults__", (10,))
    out = session.flagged(left, right, ["key"])
    assert rows(out.select("v", F.coalesce("name", F.lit("")))) == want
    assert session.flagged(left, right.limit(0), ["key"]).count() == 3000


def test_cut_measures_and_scope_removes(spark):
    with session.scope(spark):
        t = session.cut(spark.createDataFrame([("é", 1), (None, 2)], "s string, n int"))
        assert session.rows_of(t) == 2 and session._measured[t][1] == 2 + 16 and t.count() == 2
        at = t.inputFiles()[0].removeprefix("file:").replace("file://", "")
        assert Path("/" + at.lstrip("/")).exists()
    assert not Path("/" + at.lstrip("/")).exists()


def test_shared_dir_is_needed_off_local_masters(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(dict)

        class _jsc:
            @staticmethod
            def sc():
                return Context._held

        class _held:
            @staticmethod
            def getCheckpointDir():
                class Empty:
                    isDefined = staticmethod(lambda: False)

                return Empty

    class Spark:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Spark)


def test_stored_tf_of_hot_articles(spark, monkeypatch):
    raw = [("hot", i, f"t{i % 5}") for i in range(400)] + [("hot", 3, "a"), ("hot", 3, "t3")] + [(f"c{i}", i % 7, f" T{i % 3} ") for i in range(300)] + [("c1", 1, None), (None, 0, "x"), ("c2", None, "y"), ("c9", 90, " ")]
    df = spark.createDataFrame(raw, schemas.TOKENS)
    want = rows(index.tf(index.stored_tokens(df)))
    assert rows(index.stored_tf(df)) == want and ("hot", "a", 1) in want
    monkeypatch.setattr(session.hot_keys, "__defaults__", (100,))
    assert rows(index.stored_tf(df)) == want
    assert index.stored_tf(df.limit(0)).count() == 0


def test_inflected(spark):
    df = spark.createDataFrame([("pile", "nom"), ("mobile", "adjectif"), ("limiter", "verbe"), ("x", "?"), (None, "nom")], "lemma string, kind string")
    got = dict(map(tuple, morph.inflected(df).where("word is not null").collect()))
    assert got["piles"] == "pile" and got["mobiles"] == "mobile" and got["limitent"] == "limiter" and "x" not in got and got["limiter"] == "limiter"


@pytest.mark.parametrize(("x", "want"), [("L'eau du Robinet", ["l", "eau", "du", "robinet"]), ("voiture_1 x² ½", ["voiture_1", "x²", "½"]), ("", [])])
def test_token_cases(spark, x, want):
    df = spark.createDataFrame([(x,)], "x string")
    assert df.select(text.tokens("x")).first()[0] == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aÉz09_ \t\xa0  .,'-½²", max_size=30), min_size=1, max_size=20))
def test_text_as_python_has_it(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = df.select("v", text.pystrip("v").alias("s"), text.words("v").alias("w"), text.tokens("v").alias("t"), text.is_alpha("v").alias("a")).collect()
    for r in got:
        assert r["s"] == r["v"].strip() and r["w"] == r["v"].split()
        assert r["t"] == re.findall(r"\b\w+\b", r["v"].lower()) and r["a"] == r["v"].isalpha()


def test_reports(spark):
    red = spark.createDataFrame([("1", "mange", "mang"), ("1", "mangeait", "mang"), ("1", "pomme", "pomm")], schemas.REDUCTIONS)
    assert tuple(morph.report(red).first()) == (3, 2, 33.33)
    assert rows(morph.distribution(red)) == [("mang", 2), ("pomm", 1)]
    assert tuple(morph.report(red.limit(0)).first()) == (0, 0, None)


def test_alpha_words_and_lemmas(spark):
    docs = spark.createDataFrame([("1", None, "mot, mot x1 Été")], DOCS)
    assert [r["word"] for r in morph.alpha_words(docs).orderBy("pos").collect()] == ["mot", "Été"]
    lex = spark.createDataFrame([("mot", "verbe"), ("mot", "nom"), (None, "z")], "word string, lemma string")
    assert [r["reduction"] for r in morph.lemmas(morph.alpha_words(docs), lex).orderBy("pos").collect()] == ["nom", "été"]
