"""Items stored for readers: literal search by trigrams and pages by seeking, both reading little of the table.

Three tables under one path. `items`: the items in stored order (ord), range-partitioned, in pages of
BLOCK_ROWS rows, so that a range of ord reaches the scan and skips files, row groups and pages.
`blocks`: (block, lo, hi, n) of each BLOCK_ROWS positions of ord. `grams`: (gram, block), in order of
gram: which blocks hold each run of three characters of the lower-cased text; a few grams read a
few of its pages. A search meets the needle's grams, keeps the blocks that have them all, and reads
only those; the literal test on the text decides. Needles under three characters, and those whose
blocks are more than MAX_BLOCKS, read as the plain search does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemforge.operators.search import CHAPTER_PAGE, SEARCH_PAGE
from itemforge.operators.search import chapter_page as plain_page
from itemforge.operators.search import search as plain_search

BLOCK_ROWS = 256
#: Blocks that a search names as ranges; what the driver gets is at most one more row.
MAX_BLOCKS = 1000
GRAM = 3


def grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def _ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Runs of neighbouring numbers."""
    out: list[tuple[int, int]] = []
    for k in numbers:
        if out and out[-1][1] == k - 1:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


@dataclass
class StoredItems:
    spark: SparkSession
    path: str
    searched: bool = True

    @classmethod
    def build(cls, questions: DataFrame, path: str, searched: bool = True) -> StoredItems:
        """questions: ord (a long of its own for each item), question and other columns. Items that are only
        paged through need no grams: not searched, they have none, and a search reads them as the plain one does."""
        spark, block = questions.sparkSession, F.floor(F.col("ord") / BLOCK_ROWS).alias("block")
        ordered = questions.repartitionByRange("ord").sortWithinPartitions("ord")
        ordered.write.mode("overwrite").option("parquet.page.row.count.limit", BLOCK_ROWS).option("parquet.block.size", 4 << 20).parquet(f"{path}/items")
        stored = spark.read.parquet(f"{path}/items")
        counted = stored.groupBy(block).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n"))
        counted.repartitionByRange("block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{path}/blocks")
        if not searched:
            return cls(spark, path, searched)
        found = stored.select(block, F.explode(grams(F.col("question"))).alias("gram")).distinct()
        found = found.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block")
        found.write.mode("overwrite").option("parquet.page.row.count.limit", 4096).option("parquet.block.size", 4 << 20).parquet(f"{path}/grams")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def items(self) -> DataFrame:
        return self._table("items")

    def candidates(self, needle: str) -> DataFrame:
        """(block) of the blocks that hold all grams of the lower-cased needle."""
        low = needle.lower()
        own = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
        held = self._table("grams").where(F.col("gram").isin(own))
        return held.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(own)).select("block")

    def holding(self, needle: str) -> DataFrame:
        """The items in blocks that may hold the needle."""
        if len(needle) < GRAM or not self.searched:
            return self.items()
        blocks = sorted(r["block"] for r in self.candidates(needle).limit(MAX_BLOCKS + 1).collect())
        if len(blocks) > MAX_BLOCKS:
            return self.items()
        spans = [F.col("ord").between(a * BLOCK_ROWS, (b + 1) * BLOCK_ROWS - 1) for a, b in _ranges(blocks)]
        return self.items().where(reduce(Column.__or__, spans)) if spans else self.items().limit(0)

    def search(self, chapter=None, year=None, marks=None, text=None, number: int = 1, size: int = SEARCH_PAGE) -> DataFrame:
        """As the plain search: all given criteria hold, the needle is trimmed."""
        needle = (text or "").strip()
        return plain_search(self.holding(needle) if needle else self.items(), chapter, year, marks, text, number, size)

    def chapter_page(self, chapter: str, marks=None, year=None, text: str = "", number: int = 1, size: int = CHAPTER_PAGE) -> DataFrame:
        """As the plain page: a blank needle is none, another isn't trimmed."""
        rows = self.holding(text) if text.strip() else self.items()
        return plain_page(rows, chapter, marks, year, text, number, size)

    def after(self, last: int | None, size: int) -> DataFrame:
        """The next page in stored order: size items whose ord is above last (None: from the start). Reads
        the blocks that hold them, wherever they lie; a reader passes on the last ord of its page."""
        later = self._table("blocks") if last is None else self._table("blocks").where(F.col("hi") > last)
        # The first may be used up in part; each other one has an item at least.
        ahead = later.orderBy("block").limit(size + 1).collect()
        if not ahead:
            return self.items().limit(0)
        seen, stop = 0, ahead[-1]["hi"]
        for k, r in enumerate(ahead):
            seen += r["n"] if k or last is None or r["lo"] > last else 0
            if seen >= size:
                stop = r["hi"]
                break
        rows = self.items().where(F.col("ord") <= stop)
        return (rows if last is None else rows.where(F.col("ord") > last)).orderBy("ord").limit(size)
