"""How typical a term is of a record: adjusted correspondence-analysis residuals beside the tf-idf score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators import index
from lexiloom.session import cut as written
from lexiloom.session import joined, rows_of

CUT = 20.0


def residuals(tokens: DataFrame) -> DataFrame:
    """(article, token, tf, df, score, expected, residual), one row a pair.

    With n the occurrences in all, e = row total x column total / n is expected; residual = (tf - e) / sqrt(e v) with
    v = (1 - row share)(1 - column share), the variance that the margins leave. It is 0 where v is 0, as with one article or one
    token. score = tf x round(log10(articles / df), 4). Token rows count as index.stored_tokens has it; no tokens, no rows.

    Pairs are counted where their article's rows lie, and written once: margins, totals and joins read them. A token or article with
    over a thousandth of all pairs is joined under a salt.
    """
    pairs = written(index.stored_tf(tokens))
    cols = written(pairs.groupBy("token").agg(F.sum("tf").alias("col_n"), F.count(F.lit(1)).alias("df")))
    rows = written(pairs.groupBy("article").agg(F.sum("tf").alias("row_n"), F.count(F.lit(1)).alias("width")))
    n = rows.agg(F.sum("row_n").cast("double")).first()[0] or 0.0
    articles = rows_of(rows)
    both = joined(joined(pairs, cols, "token", F.col("article"), F.col("df")), rows, "article", F.col("token"), F.col("width"))
    e = F.col("row_n") * F.col("col_n") / F.lit(n)
    spread = F.sqrt(e * (1 - F.col("row_n") / F.lit(n)) * (1 - F.col("col_n") / F.lit(n)))
    idf = F.round(F.log10(F.lit(articles) / F.col("df")), 4)
    scored = both.select("article", "token", "tf", "df", (F.col("tf") * idf).alias("score"), e.alias("expected"), spread.alias("_s"))
    return scored.select(
        "article", "token", "tf", "df", "score", "expected", F.when(F.col("_s") > 0, (F.col("tf") - F.col("expected")) / F.col("_s")).otherwise(0.0).alias("residual")
    )


def typical(tokens: DataFrame, cut: float = CUT) -> DataFrame:
    """Pairs of `residuals` with score > cut. The score that is asked for is another measure than the residual, so it decides alone; both stand in a row."""
    return residuals(tokens).where(F.col("score") > cut)
