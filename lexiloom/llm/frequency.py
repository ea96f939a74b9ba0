"""Occurrences and articles of every distinct term, by recursive radix spilling with DuckDB.

A task partitions its terms by bits of their hash, at first in memory, on disk once it holds more than `hold` rows; a partition
over that size is split by the next bits, and so on; each is aggregated on its own by DuckDB, which goes out of core under a
memory limit. That runs twice: where the counted (article, token) pairs lie, giving at most one row a term and task, so that no
hot term is shuffled row by row; and after those rows were shuffled by the leading hash bits.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.text import BLANKS
from lexiloom.operators import index
from lexiloom.session import cut, hot_of, shared_dir

FANOUT_BITS = 4
#: Hash bits by which partial sums are laid out: at most so many tasks share them.
LAYOUT_BITS = 20
HOLD_ROWS = 1_000_000
DUCKDB_MB = 512
RARE_BELOW = 3
COMMON_ABOVE = 0.5

_SCHEMA = pa.schema([("h", pa.int64()), ("token", pa.string()), ("occurrences", pa.int64()), ("articles", pa.int64())])
_TYPES = "h bigint, token string, occurrences bigint, articles bigint"


class _Part:
    """Rows of one hash range: held in memory, then in a file."""

    def __init__(self, folder: str, name: str) -> None:
        self.path = os.path.join(folder, name)
        self.held: list[pa.RecordBatch] = []
        self.rows = 0
        self.file: pa.ipc.RecordBatchFileWriter | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows += batch.num_rows
        self.held.append(batch)

    def spill(self) -> None:
        if self.held:
            self.file = self.file or pa.ipc.new_file(self.path, _SCHEMA)
            for b in pa.Table.from_batches(self.held).combine_chunks().to_batches():
                self.file.write_batch(b)
            self.held = []

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.file is not None:
            self.spill()
            self.file.close()
            self.file = None
            with pa.memory_map(self.path) as m:
                r = pa.ipc.open_file(m)
                yield from (r.get_batch(i) for i in range(r.num_record_batches))
            os.remove(self.path)
        else:
            yield from self.held


def _aggregate(part: _Part, folder: str) -> Iterator[pa.RecordBatch]:
    import duckdb

    rows = pa.RecordBatchReader.from_batches(_SCHEMA, part.batches())
    with duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": folder}) as con:
        sql = "select any_value(h)::bigint h, token, sum(occurrences)::bigint occurrences, sum(articles)::bigint articles from rows group by token"
        yield from con.sql(sql).to_arrow_reader(65536)


def radix(batches: Iterable[pa.RecordBatch], folder: str, hold: int = HOLD_ROWS, shift: int = 64, name: str = "r") -> Iterator[pa.RecordBatch]:
    """Sums by term. shift: the hash bits below which all rows of `batches` may differ.

    A part that can't be split any more (all 64 bits used: equal hashes) is aggregated as it is.
    """
    import numpy as np

    shift -= FANOUT_BITS
    parts = [_Part(folder, f"{name}-{k:x}") for k in range(1 << FANOUT_BITS)]
    held = 0
    for b in batches:
        if not b.num_rows:
            continue
        bits = (b.column("h").to_numpy().view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << FANOUT_BITS) - 1)
        order = np.argsort(bits, kind="stable")
        cuts = np.searchsorted(bits[order], np.arange((1 << FANOUT_BITS) + 1))
        b = b.take(pa.array(order))
        for k, p in enumerate(parts):
            if cuts[k + 1] > cuts[k]:
                p.add(b.slice(cuts[k], cuts[k + 1] - cuts[k]))
        held += b.num_rows
        if held > hold:
            for p in parts:
                p.spill()
            held = 0
    for k, p in enumerate(parts):
        if p.rows > hold and shift >= FANOUT_BITS:
            yield from radix(p.batches(), folder, hold, shift, f"{name}{k:x}")
        elif p.rows:
            yield from _aggregate(p, folder)


def _scratch(spark: SparkSession) -> str | None:
    """The shared folder, if it is a path; else None: the task's own work folder, which the cluster removes with it."""
    at = urlparse(shared_dir(spark))
    return at.path if at.scheme in ("", "file") else None


def _sums(rows: DataFrame, hold: int, shift: int = 64) -> DataFrame:
    base = _scratch(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = base or os.getcwd()
        os.makedirs(at, exist_ok=True)
        folder = tempfile.mkdtemp(prefix="radix-", dir=at)
        try:
            yield from radix((b.cast(_SCHEMA) for b in batches), folder, hold, shift)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return rows.mapInArrow(run, _TYPES)


def frequencies(tokens: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE, hold: int = HOLD_ROWS) -> DataFrame:
    """(token, occurrences, articles, rare, common), one row a term.

    rare: held by fewer articles than rare_below; common: by more than that share of the articles that have a token. Small
    collections may mark a term both ways. NULL and blank tokens and rows without an article don't count, nor does a repeated (article, pos).
    """
    per = cut(tokens.where("article is not null").groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.btrim("token", F.lit(BLANKS)) != ""), F.lit(False)).alias("some")))
    n = float(per.where("some").count())
    pairs = index.stored_tf(tokens, hot_of(per, "article"))
    rows = pairs.select(F.xxhash64("token").alias("h"), "token", F.col("tf").alias("occurrences"), F.lit(1).cast("bigint").alias("articles"))
    partial = _sums(rows, hold)
    # a task's rows may agree in the bits they were laid out by, so it splits by those below
    total = _sums(partial.repartition(F.shiftrightunsigned("h", 64 - LAYOUT_BITS)), hold, 64 - LAYOUT_BITS)
    return total.select("token", "occurrences", "articles", (F.col("articles") < rare_below).alias("rare"), (F.col("articles") > common_above * n).alias("common"))


def marks(freq: DataFrame) -> DataFrame:
    """(mark, token) of the terms not worth an index entry."""
    both = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return freq.select(F.explode(both).alias("mark"), "token")
