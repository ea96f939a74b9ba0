"""Mixtures to target shares by hierarchical budgeting.

The total is shared out down a tree domain - language - source by the weights of its leaves. A source of several domains or languages
has a leaf in each, with a share of its weight in proportion to its tokens there. A leaf holds its tokens times its allowed repeats and
no more; what it can't take goes to its siblings first, what they can't take to the branches beside their parent, and so on. Each leaf
is then read in whole epochs and a prefix of one more, in an order seeded by epoch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.sizes import VOCABULARY, sized

MAX_LEAVES = 200_000
BUCKET_ROWS = 100_000
SHARES = (
    "leaf int, source string, domain string, language string, target_share double, max_repeats int, supply bigint, n_docs bigint, budget double, short boolean"
)


@dataclass
class Leaf:
    source: str
    path: tuple[str, ...]
    weight: float
    repeats: int
    supply: int
    n_docs: int
    budget: float = 0.0

    @property
    def cap(self) -> int:
        return self.repeats * self.supply


def water_fill(total: float, weights: list[float], caps: list[float]) -> list[float]:
    """total shared by weight, no share over its cap; what is cut off is shared among the rest, until all is given or full."""
    out = [0.0] * len(caps)
    free = [i for i in range(len(caps)) if weights[i] > 0]
    left = total
    while free and left > 0:
        w = math.fsum(weights[i] for i in free)
        full = [i for i in free if weights[i] / w * left >= caps[i]]
        if not full:
            for i in free:
                out[i] = weights[i] / w * left
            break
        for i in full:
            out[i] = caps[i]
        left -= math.fsum(caps[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def assign(leaves: list[Leaf], total: float, depth: int = 0) -> None:
    """Sets the budgets of leaves under one node."""
    if not leaves:
        return
    if depth == len(leaves[0].path):
        for x, b in zip(leaves, water_fill(total, [x.weight for x in leaves], [x.cap for x in leaves]), strict=True):
            x.budget = b
        return
    branches: dict[str, list[Leaf]] = {}
    for x in leaves:
        branches.setdefault(x.path[depth], []).append(x)
    groups = list(branches.values())
    budgets = water_fill(total, [math.fsum(x.weight for x in g) for g in groups], [sum(x.cap for x in g if x.weight > 0) for g in groups])
    for g, b in zip(groups, budgets, strict=True):
        assign(g, b, depth + 1)


def language(lang: Column) -> Column:
    """A language code in one form: lower case, without its region; NULL and undetermined are `und`."""
    code = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(code == "", "und").otherwise(F.coalesce(code, F.lit("und")))


def _at(docs: DataFrame) -> tuple[Column, Column]:
    """Domain and language of a document; without a column domain, one domain holds all."""
    domain = F.coalesce("domain", F.lit("all")) if "domain" in docs.columns else F.lit("all")
    return domain.alias("domain"), language(F.col("lang")).alias("language")


def budgets(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """SHARES, one row a leaf: a source of targets in a domain and language. docs: (source, lang, size), optionally domain.

    total: the tokens wanted, all of docs' if not given. target_share is the source's times the leaf's part of its tokens. short, of
    all leaves of a source: max_repeats x supply < target_share x total of the source. A source without documents has one leaf, which supplies
    0. NULL or negative shares and repeats count as 0; of repeated rows of targets one counts, the one of greatest share. At most
    MAX_LEAVES leaves; more are an error.
    """
    spark = docs.sparkSession
    d = docs.select("source", *_at(docs), F.coalesce("size", F.lit(0)).alias("size"))
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("k"))).alias("t"))
    parts = d.groupBy("source", "domain", "language").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
    supply = goal.join(parts, "source", "left").select("source", "t", F.coalesce("domain", F.lit("all")).alias("domain"), F.coalesce("language", F.lit("und")).alias("language"), F.coalesce("n", F.lit(0)).alias("supply"), F.coalesce("docs", F.lit(0)).alias("n_docs"))
    if total is None:
        total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = supply.orderBy("source", "domain", "language").limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    of_source: dict[str, int] = {}
    for r in rows:
        of_source[r["source"]] = of_source.get(r["source"], 0) + r["supply"]
    held = lambda r: r["supply"] / of_source[r["source"]] if of_source[r["source"]] else float(r is first[r["source"]])
    first = {r["source"]: r for r in reversed(rows)}
    leaves = [Leaf(r["source"], (r["domain"], r["language"]), max(0.0, r["t"]["w"]) * held(r), max(0, r["t"]["k"]), r["supply"], r["n_docs"]) for r in rows]
    short = {r["source"]: max(0, r["t"]["k"]) * of_source[r["source"]] < max(0.0, r["t"]["w"]) * total for r in rows}
    assign(leaves, float(total))
    data = [(i, x.source, *x.path, x.weight, x.repeats, x.supply, x.n_docs, float(x.budget), short[x.source]) for i, x in enumerate(leaves)]
    return spark.createDataFrame(data, SHARES)


def select(docs: DataFrame, shares: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """(source, domain, language, key, epoch, size): the mixture. docs: (key, source, lang, size), optionally domain.

    A leaf's budget is read as whole epochs and, of the next, the longest prefix in the order of a hash of seed, epoch and key
    that stays within the rest. Prefix sums run over hash buckets of about BUCKET_ROWS documents, so no leaf is sorted in one task.
    """
    most = shares.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, most / BUCKET_ROWS))))
    s = F.broadcast(shares.select("leaf", "source", "domain", "language", "supply", "budget", F.floor(F.col("budget") / F.nullif("supply", F.lit(0))).cast("int").alias("_full")).where("_full is not null"))  # MAX_LEAVES rows at most
    d = docs.select("source", *_at(docs), key, F.coalesce("size", F.lit(0)).alias("size")).join(s, ["source", "domain", "language"])
    d = d.withColumn("_o", F.xxhash64(F.lit(seed), F.col("_full"), F.col(key)))
    d = d.withColumn("_b", F.shiftrightunsigned("_o", 64 - bits) if bits else F.lit(0).cast("long"))
    d = d.withColumn("_rest", F.col("budget") - F.col("_full") * F.col("supply"))
    run = Window.partitionBy("leaf").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = d.groupBy("leaf", "_b", "_rest").agg(F.sum("size").alias("n")).withColumn("_upto", F.sum("n").over(run))
    edge = sums.where(F.col("_upto") > F.col("_rest")).groupBy("leaf").agg(F.min_by(F.struct("_b", (F.col("_upto") - F.col("n")).alias("_before")), "_b").alias("_e"))
    d = d.join(F.broadcast(edge), "leaf", "left")  # a row a leaf at most
    out = ("source", "domain", "language", key)
    whole = d.where(F.col("_full") > 0).select(*out, F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("epoch"), "size")
    b, e = F.col("_b"), F.col("_e._b")
    inside = d.where(F.col("_rest") > 0).where(F.col("_e").isNull() | (b < e)).select(*out, F.col("_full").alias("epoch"), "size")
    upto = F.sum("size").over(Window.partitionBy("leaf").orderBy("_o", key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    border = d.where(F.col("_rest") > 0).where(b == e).withColumn("_upto", upto + F.col("_e._before")).where(F.col("_upto") <= F.col("_rest"))
    return whole.unionByName(inside).unionByName(border.select(*out, F.col("_full").alias("epoch"), "size"))


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 0, key: str = "doc_id", vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of texts."""
    d = sized(docs, key, "source", "lang", *(["domain"] if "domain" in docs.columns else []), vocabulary=vocabulary)
    shares = budgets(d, targets)
    return select(d, shares, seed, key), shares


def reached(mix: DataFrame, shares: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Per source (or node of the tree: `by`) the target, supply and budget, and the tokens, share and epochs that it has in the mixture."""
    goal = shares.groupBy(*by).agg(F.round(F.sum("target_share"), 9).alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.sum("supply").alias("supply"), F.sum("n_docs").alias("n_docs"), F.sum("budget").alias("budget"), F.max("short").alias("short"))
    got = mix.groupBy(*by).agg(F.sum("size").alias("tokens"), F.max("epoch").alias("last_epoch"))
    everything = F.nullif(mix.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar(), F.lit(0))
    out = goal.join(F.broadcast(got), list(by), "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))  # MAX_LEAVES rows at most
    return out.withColumn("reached", F.round(F.coalesce(F.col("tokens") / everything, F.lit(0.0)), 6)).withColumn("epochs", F.coalesce(F.col("last_epoch") + 1, F.lit(0))).drop("last_epoch")
