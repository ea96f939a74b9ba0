"""Fields of a bulletin page. All come from one `parsed` struct, so a page is parsed once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.html import parsed
from lexiloom.functions.text import pystrip, words

#: Fixed values of the page contract.
AUTHOR_LABELS = ("Rédacteur :", "Rédacteurs :")
CONTACT_LABELS = ("Pour en savoir plus, contacts :", "Rédacteurs :Pour en savoir plus, contact :")
TEXT_CLASS = "style95"
RUBRIC_SPAN = 45
AUTHOR_META = 6


def title_part(title: Column, k: int) -> Column:
    """Part k of a title `DATE > … NUMBER > TITLE`; NULL if there are fewer. Parts beyond the third are dropped."""
    return pystrip(F.get(F.split(title, ">"), F.lit(k)))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def bulletin_no(title: Column) -> Column:
    return F.try_element_at(words(title_part(title, 1)), F.lit(-1))


def after_label(spans: Column, labels: Sequence[str]) -> Column:
    """The span that follows the first one whose stripped text is a label; NULL if none does."""
    hits = F.transform(spans, lambda s: pystrip(s).isin(list(labels)))
    at = F.array_position(hits, True)
    return F.when(at > 0, F.get(spans, at.cast("int")))


def author(line: Column) -> Column:
    """`X - NAME - MAIL` as `NAME-MAIL`; NULL if the line has fewer than three parts. A compound name is cut at its hyphen, as specified."""
    p = F.transform(F.split(line, "-"), pystrip)
    return F.when(F.size(p) > 2, F.concat(F.get(p, F.lit(1)), F.lit("-"), F.get(p, F.lit(2))))


def body(cell: Column, reverse: bool = True) -> Column:
    """Text of the cell's spans of exactly the text class: reversed, each followed by a blank; or in page order, one a line."""
    texts = F.transform(F.filter(cell, lambda s: s["cls"] == TEXT_CLASS), lambda s: s["text"])
    if not reverse:
        return F.array_join(texts, "\n")
    return F.array_join(F.transform(F.reverse(texts), lambda t: F.concat(t, F.lit(" "))), "")


def pages(df: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """(path, page): one parse a page. Further columns are left out."""
    return df.select(F.col(path).alias("path"), parsed(F.col(html)).alias("page"))


def documents(df: DataFrame, reverse: bool = True) -> DataFrame:
    """Pages to documents. A page without a content cell keeps its row, with texte and images NULL and `_error` set."""
    p = F.col("page")
    return pages(df).select(
        title_part(p["title"], 0).alias("date"),
        bulletin_no(p["title"]).alias("bulletin"),
        stem(F.col("path")).alias("article"),
        title_part(p["title"], 2).alias("titre"),
        F.get(p["spans"], F.lit(RUBRIC_SPAN)).alias("rubrique"),
        body(p["cell"], reverse).alias("texte"),
        author(after_label(p["spans"], AUTHOR_LABELS)).alias("auteur"),
        after_label(p["spans"], CONTACT_LABELS).alias("contacts"),
        F.when(F.size(p["images"]) > 0, F.struct(p["images"].alias("image"))).alias("images"),
        p["failed"].alias("_error"),
    )


def meta_author(df: DataFrame) -> DataFrame:
    return pages(df).select(stem(F.col("path")).alias("article"), F.get(F.col("page.metas"), F.lit(AUTHOR_META)).alias("auteur"))


def date_nbsp(title: Column) -> Column:
    """The date part after no-break spaces became blanks."""
    return title_part(F.regexp_replace(title, r"\xa0", " "), 0)


def contact_author(spans: Column) -> Column:
    return author(after_label(spans, CONTACT_LABELS))


def spans(df: DataFrame) -> DataFrame:
    """Every span of the page's root table, with its place."""
    return pages(df).select(stem(F.col("path")).alias("article"), F.posexplode("page.spans").alias("pos", "text"))


def images(docs: DataFrame) -> DataFrame:
    """One row an image, by its place in the page; documents without images give none."""
    return docs.select("article", F.posexplode("images.image").alias("pos", "image")).select("article", "pos", "image.urlimage", "image.legendeimage")
