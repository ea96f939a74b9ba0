"""Queries of the problems p1 to p8 over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import boilerplate, distinctive, frequency, looks, mixing, names, packing, sentences, sizes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vocabulary(s: SparkSession) -> str:
    """The vocabulary file that the session names."""
    return s.conf.get("spark.lexiloom.vocabulary", sizes.VOCABULARY)


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bulletins").select("path", "html", "texte", "loaded_at")


def _packed(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    capacity = table(s, d, "containers").first()["capacity_tokens"]
    return packing.pack_texts(table(s, d, "documents"), capacity, vocabulary=_vocabulary(s)), capacity


def _mixed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets"), vocabulary=_vocabulary(s))


def _by_field(form: Callable[[DataFrame, str, str], DataFrame]) -> Query:
    """A form of looks over the texts by article, and over the dates."""

    def run(s: SparkSession, d: str) -> DataFrame:
        c = table(s, d, "corpus")
        parts = (("texte", c.select("article", "texte"), "article", "texte"), ("date", c.select("date", F.col("date").alias("value")).distinct(), "date", "value"))
        made = [(field, form(*rest)) for field, *rest in parts]
        return made[0][1].select(F.lit(made[0][0]).alias("champ"), "*").unionByName(made[1][1].select(F.lit(made[1][0]).alias("champ"), "*"))

    return run


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: boilerplate.frame(_pages(s, d)).where("frame").select("path", "line_no"),
    "p1_articles": lambda s, d: boilerplate.articles(_pages(s, d), boilerplate.frame(_pages(s, d))),
    "p1_wrappers": lambda s, d: boilerplate.expressions(_pages(s, d)),
    "p2_found": lambda s, d: distinctive.typical(table(s, d, "tokens")).select("article", "token"),
    "p2_residuals": lambda s, d: distinctive.residuals(table(s, d, "tokens")).select(
        "article", "token", "tf", "df", F.round("score", 6).alias("score"), F.round("residual", 6).alias("residual")
    ),
    "p3_found": lambda s, d: frequency.marks(frequency.frequencies(table(s, d, "tokens"))),
    "p3_frequencies": lambda s, d: frequency.frequencies(table(s, d, "tokens")),
    "p4_found": lambda s, d: names.pairs(names.writers(table(s, d, "corpus"))),
    "p4_writers": lambda s, d: names.writers(table(s, d, "corpus")),
    "p5_found": _by_field(looks.alike),
    "p5_classes": _by_field(looks.classes),
    "p5_forms": lambda s, d: table(s, d, "corpus").select("article", "loaded_at", looks.look("date").alias("date"), looks.look("texte").alias("texte"), looks.fold("texte").alias("texte_fold")),
    "p6_found": lambda s, d: packing.over_capacity(_packed(s, d)[0]),
    "p6_containers": lambda s, d: _packed(s, d)[0],
    "p6_fill": lambda s, d: packing.fill(*_packed(s, d)),
    "p7_found": lambda s, d: _mixed(s, d)[1].where("short").select("source").distinct(),
    "p7_mixture": lambda s, d: _mixed(s, d)[0],
    "p7_shares": lambda s, d: mixing.reached(*_mixed(s, d)),
    "p7_leaves": lambda s, d: mixing.reached(*_mixed(s, d), ("domain", "language", "source")),
    "p8_found": lambda s, d: sentences.sentences(table(s, d, "documents")),
}
