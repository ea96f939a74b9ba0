"""Words reduced to stems or lemmas, and reports on the reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.stem_fr import stem
from lexiloom.functions.text import is_alpha, words
from lexiloom.session import broadcast_if_small

# Spark's list of French stop words.
STOP_WORDS = """
au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par
pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant
étante étants étantes suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient
étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez
fussent ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait
aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût
eussions eussiez eussent
""".split()


# Endings of regular French words. A verb's come in place of -er.
ENDINGS = {"nom": ("", "s"), "adjectif": ("", "s", "e", "es"), "verbe": ("er", "e", "es", "ons", "ez", "ent", "ait", "aient", "era", "eront", "é", "ée", "és", "ées", "ant")}


def inflected(lemmas: DataFrame) -> DataFrame:
    """(word, lemma): a lexicon of the regular forms of (lemma, kind) rows; kind is a key of ENDINGS, other rows give none."""
    endings = F.create_map(*(x for k, v in ENDINGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    stem = F.when(F.col("kind") == "verbe", F.regexp_replace("lemma", "er$", "")).otherwise(F.col("lemma"))
    return lemmas.select(F.explode(F.transform(F.try_element_at(endings, F.col("kind")), lambda e: F.concat(stem, e))).alias("word"), "lemma")


def alpha_words(docs: DataFrame, *fields: str) -> DataFrame:
    """(article, pos, word): words between white space that are letters only; pos counts all words."""
    return docs.select("article", F.posexplode(words(F.concat_ws(" ", *(fields or ("titre", "texte"))))).alias("pos", "word")).where(is_alpha("word"))


def stems(rows: DataFrame) -> DataFrame:
    """Adds `reduction`, the French stem of the lower-case word. Python stems each distinct word of a batch once."""
    return rows.withColumn("reduction", stem(F.lower("word")))


def lemmas(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds `reduction`: the lexicon's (word, lemma) of the lower-case word, else that word. One lemma a word: the least."""
    lex = lexicon.where("word is not null").groupBy(F.col("word").alias("_w")).agg(F.min("lemma").alias("_lemma"))
    low = F.lower("word")
    return rows.join(broadcast_if_small(lex), low == F.col("_w"), "left").withColumn("reduction", F.coalesce("_lemma", low)).drop("_w", "_lemma")


def useful_words(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lemmas of the alphabetic words that aren't French stop words ."""
    spark = docs.sparkSession
    stop = spark.createDataFrame([(w,) for w in STOP_WORDS], "stop string")
    kept = alpha_words(docs).join(F.broadcast(stop), F.lower("word") == F.col("stop"), "left_anti")
    return lemmas(kept, lexicon)


def report(reductions: DataFrame) -> DataFrame:
    """One row: reductions in all, distinct ones, and by how many per cent the vocabulary shrinks (NULL without rows)."""
    n, u = F.count("reduction"), F.count_distinct("reduction")
    return reductions.agg(n.alias("total"), u.alias("uniques")).withColumn("taux", F.round((1 - F.col("uniques") / F.nullif("total", F.lit(0))) * 100, 2))


def distribution(reductions: DataFrame) -> DataFrame:
    return reductions.groupBy("reduction").agg(F.count(F.lit(1)).alias("freq"))
