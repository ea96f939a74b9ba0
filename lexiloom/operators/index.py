"""Tokens, frequencies, weights and the two directions of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.session import hot_keys, salted_join


def tokenise(docs: DataFrame, *fields: str, key: str = "article") -> DataFrame:
    """(article, pos, token) of the fields joined by a blank. A document without tokens gives no row."""
    return docs.select(F.col(key).alias("article"), F.posexplode(text.tokens(*(fields or ("titre", "texte")))).alias("pos", "token"))


def _stored(tokens: DataFrame) -> DataFrame:
    """Cleaned token rows with an article and a token; blank ones are "" still, so that the cleaning runs once."""
    rows = tokens.where("token is not null and article is not null")
    return rows.select("article", "pos", F.lower(F.btrim("token", F.lit(text.BLANKS))).alias("token"))


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """One row an (article, pos), laid out by `by`: one shuffle, and one sort behind it. Blank tokens are no tokens, so they don't count as the least."""
    return rows.repartition(*by).groupBy("article", "pos").agg(F.min(F.when(F.col("token") != "", F.col("token"))).alias("token"))


def stored_tokens(tokens: DataFrame) -> DataFrame:
    """Token rows as they count: cleaned, NULL and blank ones and those without an article dropped, one row an (article, pos).

    Of several tokens at one place the least in code-point order stays. A NULL pos is a place like others.
    """
    return _placed(_stored(tokens), "article", "pos").where("token is not null")


def stored_tf(tokens: DataFrame, hot: list | None = None) -> DataFrame:
    """`tf` of `stored_tokens`. Rows are laid out by article once, for the places and for the counts; articles that hold too many of
    them are laid out by place and counted in two steps. hot: those articles, if they are known."""
    if hot is None:
        hot = hot_keys(tokens.where("article is not null"), "article")
    rows = _stored(tokens)
    # nonblank is not pushed below the aggregate, so the layout stays and the cleaning isn't repeated
    count = lambda placed: placed.groupBy("article", "token").agg(F.count(F.lit(1)).alias("tf"), F.max(F.length("token")).alias("_n")).where("_n > 0").drop("_n")
    if not hot:
        return count(_placed(rows, "article"))
    return count(_placed(rows.where(~F.col("article").isin(hot)), "article")).unionByName(count(_placed(rows.where(F.col("article").isin(hot)), "article", "pos")))


def tf(tokens: DataFrame) -> DataFrame:
    """Occurrences of each token in each article. Counted before the shuffle too, so hot tokens and articles travel once a task."""
    return tokens.groupBy("article", "token").agg(F.count(F.lit(1)).alias("tf"))


def doc_count(freq: DataFrame) -> DataFrame:
    """One row: the number of articles with a token."""
    return freq.agg(F.count_distinct("article").alias("n"))


def df(freq: DataFrame) -> DataFrame:
    """Articles that hold each token; freq has one row an (article, token)."""
    return freq.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(freq: DataFrame, digits: int | None = 4) -> DataFrame:
    """log10(N / df), rounded before any use; digits=None leaves it as it is."""
    value = F.log10(doc_count(freq).scalar() / F.col("df"))
    return df(freq).withColumn("idf", value if digits is None else F.round(value, digits))


def tfidf(freq: DataFrame, digits: int | None = 4) -> DataFrame:
    """(article, token, w = tf x idf). Tokens held by many articles are joined under a salt."""
    joined = salted_join(freq, idf(freq, digits), "token", F.col("article"), F.col("df"))
    return joined.select("article", "token", (F.col("tf") * F.col("idf")).alias("w"))


def postings(freq: DataFrame) -> DataFrame:
    """Articles of each token, in order. The list is the result, so a token found everywhere has a long one; use `posting_blocks` for a stored index."""
    return freq.groupBy("token").agg(F.sort_array(F.collect_set("article")).alias("articles"))


def posting_blocks(freq: DataFrame, blocks: int = 256) -> DataFrame:
    """Postings cut by a hash of the article: no list grows beyond one block of the collection."""
    block = F.pmod(F.xxhash64("article"), F.lit(blocks)).cast("int").alias("block")
    return freq.groupBy("token", block).agg(F.sort_array(F.collect_set("article")).alias("articles"))


def forward(tokens: DataFrame) -> DataFrame:
    """Tokens of each article, in order, repeats kept."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return tokens.groupBy("article").agg(F.transform(rows, lambda r: r["token"]).alias("tokens"))


def band_counts(weights: DataFrame) -> DataFrame:
    """Rows in all, above 10, above 20, below 0.5."""
    w = F.col("w")
    return weights.agg(F.count(F.lit(1)).alias("n"), F.count_if(w > 10).alias("above_10"), F.count_if(w > 20).alias("above_20"), F.count_if(w < 0.5).alias("below_half"))


def series(weights: DataFrame, article: str | Column | None = None, above: float = 20.0) -> DataFrame:
    """(token, w) to plot: all articles with w above the cut, or one article uncut. Of a token's rows that of the last article counts."""
    kept = weights.where(F.col("w") > above) if article is None else weights.where(F.col("article") == article)
    return kept.groupBy("token").agg(F.max_by("w", "article").alias("w"))
