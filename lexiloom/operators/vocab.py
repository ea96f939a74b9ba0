"""Anti-dictionary, substitution and filtered corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import index
from lexiloom.session import broadcast_if_small, cut

LOW, HIGH = 0.5, 20.0


def antidictionary(freq: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Tokens with a weight below low or above high in any article.

    A token's weights are tf x idf with one idf, so its least and greatest tf decide; no join of all pairs is needed.
    """
    n = index.doc_count(freq).scalar()
    per = freq.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("tf").alias("least"), F.max("tf").alias("most"))
    idf = F.round(F.log10(n / F.col("df")), 4)
    return per.where((F.col("least") * idf < low) | (F.col("most") * idf > high)).select("token")


def exclude(tokens: DataFrame, stop: DataFrame) -> DataFrame:
    """Token rows whose token isn't in the stop list, which is written once: counting it must not make it twice."""
    return tokens.join(broadcast_if_small(cut(stop.select("token").distinct())), "token", "left_anti").select("article", "pos", "token")


def rules(substitutions: DataFrame) -> DataFrame:
    """(word, replacement), the last line of a word winning; NULL means delete and becomes ""."""
    last = F.max_by(F.coalesce("replacement", F.lit("")), "line_no")
    return substitutions.where("word is not null").groupBy("word").agg(last.alias("replacement"))


def stop_rules(stop: DataFrame) -> DataFrame:
    """A stop list as rules that delete."""
    return stop.select(F.col("token").alias("word"), F.lit("").alias("replacement"))


def substitute(docs: DataFrame, rule: DataFrame, fields: tuple[str, ...] = ("texte",), key: str = "article") -> DataFrame:
    """docs (unique by key) with the fields rewritten: lower case, tokens replaced or deleted in one pass, joined by a blank.

    NULL stays NULL; a field that loses all its tokens becomes "". Docs are laid out by key once; with a broadcast rule table
    the exploded tokens aren't shuffled again.
    """
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    long = docs.repartition(F.col(key)).select(F.col(key).alias("_key"), F.inline(parts)).where("text is not null")
    toks = long.select("_key", "field", F.posexplode(text.tokens("text")).alias("pos", "word"))
    kept = toks.join(broadcast_if_small(rule), "word", "left").withColumn("word", F.coalesce("replacement", "word")).where("word <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "word")))
    joined = F.array_join(F.transform(ordered, lambda r: r["word"]), " ")
    by_field = kept.groupBy("_key", "field").agg(joined.alias("text"))
    wide = by_field.groupBy("_key").agg(*(F.max(F.when(F.col("field") == f, F.col("text"))).alias(f"_new_{f}") for f in fields))
    out = docs.join(wide, docs[key] == wide["_key"], "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.col(f).isNotNull(), F.coalesce(f"_new_{f}", F.lit(""))))
    return out.select(*docs.columns)


def filter_corpus(docs: DataFrame, rule: DataFrame) -> DataFrame:
    """`substitute` on texte, titre, rubrique and every image legend; all else stays. The rules are written once, for both passes."""
    rule = cut(rule)
    images = docs.select("article", F.posexplode("images.image").alias("_k", "_img")).select(
        F.concat_ws("\x00", F.col("article"), F.col("_k").cast("string")).alias("_id"), "article", "_k", "_img.urlimage", "_img.legendeimage"
    )
    legends = substitute(images, rule, ("legendeimage",), key="_id")
    back = legends.groupBy("article").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "urlimage", "legendeimage"))), lambda r: F.struct(r["urlimage"].alias("urlimage"), r["legendeimage"].alias("legendeimage"))).alias("_images"))
    out = substitute(docs, rule, ("texte", "titre", "rubrique")).join(back, "article", "left")
    return out.withColumn("images", F.when(F.col("_images").isNotNull(), F.struct(F.col("_images").alias("image"))).otherwise(F.col("images"))).select(*docs.columns)


def subcorpus(docs: DataFrame, tag: str) -> DataFrame:
    """(article, tag): one field of the corpus."""
    return docs.select("article", F.col(tag))
