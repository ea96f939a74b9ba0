"""Readers: pages, the XML corpus, TSV relations, and the latest version of repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom import schemas
from lexiloom.functions.html import Page
from lexiloom.functions.text import pystrip, words
from lexiloom.session import cut, flagged, rows_of


def latest(df: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """The last loaded row of each key; equal times are settled by the row's string columns. Rows without a key have no identity and are left out.

    Only keys and times are shuffled, to find the keys with several rows. Single rows, and the later of two at different times, are
    then picked out of one scan by a broadcast of those keys (above its limit by a shuffled join). The rows of any other key (three
    and more, equal or missing times) are resolved by max_by, which keeps one row a key on the map side already.
    """
    df = df.where(F.col(key).isNotNull())
    n, first, last = F.count(F.lit(1)), F.min(by), F.max(by)
    often = df.groupBy(key).agg(n.alias("_n"), F.count(by).alias("_m"), first.alias("_first"), last.alias("_last")).where("_n > 1")
    often = cut(often.select(key, "_last", ((F.col("_n") == 2) & (F.col("_m") == 2) & (F.col("_first") < F.col("_last"))).alias("_two")))
    if not rows_of(often):
        return df
    out = flagged(df, often, [key]).where(F.col("_two").isNull() | (F.col("_two") & (F.col(by) == F.col("_last")))).select(*df.columns)
    more = cut(often.where("not _two").select(key, F.lit(True).alias("_more")))
    if not rows_of(more):
        return out
    ties = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    best = F.max_by(F.struct(*(c for c in df.columns if c != key)), F.struct(by, *sorted(ties))).alias("_row")
    rest = flagged(df, more, [key]).where("_more").drop("_more").groupBy(key).agg(best).select(key, "_row.*")
    return out.unionByName(rest.select(*df.columns))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of the folder's own *.htm files, as UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm").load(folder)
    return raw.select("path", F.decode("content", "UTF-8").alias("html"))


def read_corpus_xml(spark: SparkSession, path: str, schema: T.StructType = schemas.DOCUMENT) -> DataFrame:
    """A well-formed corpus of <document> rows, or a sub-corpus of some of their fields, splittable."""
    return spark.read.format("xml").option("rowTag", "document").option("ignoreSurroundingSpaces", False).schema(schema).load(path)


def read_corpus_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """A corpus whose XML isn't well-formed (unclosed or unescaped): text of each <document> cut out by its tags, then parsed tolerantly.

    Files are read whole, one row a document from there on.
    """
    whole = spark.read.text(path, wholetext=True)
    docs = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<document>(.*?)</document>"), F.lit(1))).alias("xml"))
    fields = [f.name for f in schemas.DOCUMENT if isinstance(f.dataType, T.StringType)]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for xml in pdf["xml"]:
                page = Page(xml)
                first = {f: next(page.all(f), None) for f in fields}
                rows.append({f: None if i is None else page.content(i) for f, i in first.items()})
            yield pd.DataFrame(rows, columns=fields)

    return docs.mapInPandas(run, T.StructType([T.StructField(f, T.StringType()) for f in fields]))


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A TSV relation by position; cells are stripped, so padded and clean files read alike; blank lines are skipped."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(pystrip("value") != "")
    return rows.select(*(pystrip(F.get(cells, F.lit(k))).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)))


def read_words(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_tsv, cut at any white space."""
    cells = words("value")
    rows = spark.read.text(path).where(F.size(cells) > 0)
    return rows.select(*(F.get(cells, F.lit(k)).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)))


def read_substitutions(spark: SparkSession, path: str) -> DataFrame:
    """Lines `word TAB replacement`; without a second cell the word is deleted. line_no orders the lines of a file as they stand."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    cells = F.split(pystrip("value"), "\t")
    return lines.select("line_no", F.get(cells, F.lit(0)).alias("word"), F.get(cells, F.lit(1)).alias("replacement"))
