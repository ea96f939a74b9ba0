"""Writers: TSV, lines, XML. All write part files; one file only where asked."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed order of a document's fields in XML.
FIELDS = ("date", "bulletin", "article", "titre", "rubrique", "texte", "auteur")


def write_tsv(df: DataFrame, path: str, padded: bool = False) -> None:
    """`a TAB b` lines; padded adds the blanks that the older files have after every cell. NULL is an empty cell."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    line = F.concat(*(x for c in cells for x in (c, F.lit(" \t"))), F.lit(" ")) if padded else F.concat_ws("\t", *cells)
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, ending: str = "") -> None:
    """One element of the only column a line."""
    df.select(F.concat(F.col(df.columns[0]).cast("string"), F.lit(ending)).alias("value")).write.mode("overwrite").text(path)


def write_corpus_xml(docs: DataFrame, path: str, one_file: bool = False) -> None:
    """<corpus> of <document> rows, escaped and indented by Spark; every part file is a corpus of its own."""
    (docs.coalesce(1) if one_file else docs).write.mode("overwrite").format("xml").option("rootTag", "corpus").option("rowTag", "document").save(path)


def write_pages(pages: DataFrame, folder: str) -> int:
    """One file a page, named as its path ends; folder is one that all executors see. Returns the number of pages; one without path or html makes no file."""
    at = Path(urlparse(folder).path)
    at.mkdir(parents=True, exist_ok=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, html in zip(b["path"], b["html"], strict=True):
                (at / Path(path).name).write_text(html, encoding="utf-8", newline="")
            yield pd.DataFrame({"n": [len(b)]})

    return pages.where("path is not null and html is not null").select("path", "html").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str, value: Column) -> Column:
    """`<name>value</name>`, or nothing for NULL."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), escaped(value), F.lit(f"</{name}>")), F.lit(""))


def document_xml() -> Column:
    """One document as a line of well-formed XML; NULL fields and empty image lists are left out."""
    pictures = F.transform(
        "images.image", lambda i: F.concat(F.lit("<image>"), _element("urlImage", i["urlimage"]), _element("legendeImage", i["legendeimage"]), F.lit("</image>"))
    )
    block = F.when(F.size("images.image") > 0, F.concat(F.lit("<images>"), F.array_join(pictures, ""), F.lit("</images>"))).otherwise(F.lit(""))
    return F.concat(F.lit("<document>"), *(_element(f, F.col(f)) for f in FIELDS), block, _element("contacts", F.col("contacts")), F.lit("</document>"))
