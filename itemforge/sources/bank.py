"""Sources and sinks of the item bank."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemforge import schemas
from itemforge.scratch import materialize

# Solved papers by file name, with their year.
SOLVED_PAPERS = {
    "Physics 2020.pdf": 2020, "Physics 2025.pdf": 2025, "Solved Paper 2013.pdf": 2013, "Solved Paper 2014.pdf": 2014,
    "Solved Paper 2015.pdf": 2015, "Solved Paper 2016.pdf": 2016, "Solved Paper 2017.pdf": 2017, "Solved Paper 2018.pdf": 2018,
    "Solved Paper 2019.pdf": 2019, "Solved Paper 2022 Term I.pdf": 2022, "Solved Paper 2022 Term II.pdf": 2022, "Solved Paper 2023.pdf": 2023,
}


def chapter_files(spark: SparkSession, folder: str, pattern: str = "class-12-physics-*") -> DataFrame:
    """Names in a folder of any store that match the pattern, in name order: its files, and the folders in
    it that hold some at any depth, such as tables of several files, once each."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/").count("/") + 1
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.split("path", "/").alias("parts"))
    found = found.select(F.array_join(F.slice("parts", 1, at + 1), "/").alias("path"), F.get("parts", F.lit(at)).alias("file"))
    return found.where(F.rlike("file", F.lit(f"^(?:{glob})\\z"))).distinct().orderBy("file")


def solved_papers(files: DataFrame) -> DataFrame:
    """The listed papers that exist, with their year; absent ones are skipped."""
    listed = files.sparkSession.createDataFrame(list(SOLVED_PAPERS.items()), "file string, year int")
    return listed.join(files.select("file").distinct(), "file", "left_semi")


def document_text(pages: DataFrame) -> DataFrame:
    """(file, text) from (file, page_no, text): pages in order, each followed by a newline."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("file").agg(F.concat(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n"), F.lit("\n")).alias("text"))


def append(*tables: DataFrame) -> DataFrame:
    """The rows of all tables (union all), as lists from several files are put together."""
    return reduce(DataFrame.unionByName, tables)


def text_lines(docs: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(file, n, line): every line, empty ones too, numbered from 0."""
    return docs.select(F.col(key), F.posexplode(F.split(text, "\n", -1)).alias("n", "line"))


def read_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions and chapters of a bank document, with their stored order: one JSON file, or the folder that
    write_bank makes."""
    if exists(spark, f"{path}/{QUESTIONS}"):
        return _records(spark, f"{path}/{QUESTIONS}", schemas.QUESTION), _records(spark, f"{path}/{CHAPTERS}", schemas.CHAPTER)
    root = spark.read.schema(schemas.ROOT).option("multiLine", True).json(path)
    questions = root.select(F.posexplode("questions").alias("ord", "q")).select(F.col("ord").cast("long").alias("ord"), "q.*")
    chapters = root.select(F.posexplode("chapters").alias("ord", "c")).select("ord", "c.*")
    return questions, chapters


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def preferred(spark: SparkSession, raw: str, cooked: str) -> str:
    """The raw document where there is one."""
    return raw if exists(spark, raw) else cooked


# The root document as a folder: its files, in name order, are the text of one JSON document, a
# record a line. Tasks write the records of their range of the order; the frame around them is short.
HEAD, QUESTIONS, MIDDLE, CHAPTERS, TAIL = "0-head", "1-questions", "2-middle", "3-chapters", "4-tail"


def write_bank(questions: DataFrame, chapters: DataFrame, path: str) -> None:
    """One root document for exchange, of any size, with what it holds in stored order (ord) and the totals."""
    spark = questions.sparkSession

    def records(df: DataFrame, folder: str) -> None:
        first = df.agg(F.min("ord")).first()[0]
        line = F.concat(F.when(F.col("ord") == F.lit(first), "").otherwise(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
        ordered = df.repartitionByRange("ord").sortWithinPartitions("ord")
        ordered.select(line.alias("value")).write.mode("overwrite").text(f"{path}/{folder}")

    def frame(text: str, folder: str) -> None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{folder}")

    totals = questions.agg(F.count("*").alias("n"), F.count_if(F.coalesce("answer", F.lit("")) != "").alias("answered")).first()
    frame('{"questions":[', HEAD)
    records(questions, QUESTIONS)
    frame('],"chapters":[', MIDDLE)
    records(chapters, CHAPTERS)
    frame(f'],"total":{totals["n"]},"matched_answers":{totals["answered"]}}}', TAIL)


def _records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path).where("value <> ''")
    return text.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("r")).select("r.*")


def bank_totals(spark: SparkSession, path: str) -> DataFrame:
    """(total, matched_answers) of a document that write_bank made."""
    end = F.concat(F.lit("{"), F.substring(F.col("value"), 3, 1 << 20))
    return spark.read.text(f"{path}/{TAIL}").select(F.from_json(end, "total bigint, matched_answers bigint").alias("r")).select("r.*")


def write_bank_lines(questions: DataFrame, chapters: DataFrame, path: str) -> None:
    """A bank of any size as JSON lines with their stored order, one folder a table, and the totals."""
    questions.write.mode("overwrite").json(f"{path}/questions")
    chapters.write.mode("overwrite").json(f"{path}/chapters")
    matched = F.count_if(F.coalesce("answer", F.lit("")) != "").alias("matched_answers")
    questions.agg(F.count("*").alias("total"), matched).write.mode("overwrite").json(f"{path}/totals")


def read_bank_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schemas.QUESTION).json(f"{path}/questions"), spark.read.schema(schemas.CHAPTER).json(f"{path}/chapters")


def stored_set(table: DataFrame, key: str) -> DataFrame:
    """Ids of a stored JSON array under key in (key, value); a missing or broken value is empty."""
    value = F.coalesce(F.from_json("value", "array<string>"), F.array().cast("array<string>"))
    return table.where(F.col("key") == key).select(F.explode(value).alias("id")).distinct()


def stored_value(value: Column, kind: str, default: Column) -> Column:
    return F.coalesce(F.from_json(value, kind), default)


def set_value(ids: DataFrame) -> DataFrame:
    """The stored form of a small set: one JSON array. Sets of any size go to StoredSets."""
    return ids.agg(F.to_json(F.array_sort(F.collect_set("id"))).alias("value"))


@dataclass
class StoredSets:
    """Sets of ids by key, of any size, that a failed write leaves as they were.

    A write goes to a folder of its own with the next number; Spark's commit puts its _SUCCESS there when
    all tasks have written. Readers take the highest number that has one, so they see the former set or
    the new one. Folders that nobody reads any more are left to clean().
    """

    spark: SparkSession
    path: str

    def _folders(self, key: str, pattern: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{key}/{pattern}")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(part for f in found or () for part in f.getPath().toString().split("/") if part.startswith("set-"))

    def write(self, key: str, ids: DataFrame) -> None:
        done = self._folders(key, "set-*/_SUCCESS")
        number = int(done[-1].split("-")[1]) + 1 if done else 0
        ids.select("id").distinct().write.parquet(f"{self.path}/{key}/set-{number:012}-{uuid.uuid4().hex}")

    def read(self, key: str) -> DataFrame:
        """(id) of the set; a key that was never written is an empty set."""
        done = self._folders(key, "set-*/_SUCCESS")
        return self.spark.read.parquet(f"{self.path}/{key}/{done[-1]}") if done else self.spark.createDataFrame([], "id string")

    def clean(self, key: str) -> None:
        """Delete folders of former and of failed writes. Run while nobody reads or writes the key."""
        keep = self._folders(key, "set-*/_SUCCESS")[-1:]
        for name in self._folders(key, "set-*"):
            if name not in keep:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{key}/{name}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """Positions from 0 in the given order, without one task for all rows: a range partitioning,
    written once, then each partition's count is added to the positions in the later ones."""
    at = "at"
    while at in df.columns:
        at += "_"
    part, inside = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = ranged.withColumn(name, inside) if name not in df.columns else ranged.drop(name).withColumn(name, inside)
    out = rows.alias("r").join(F.broadcast(base.alias("b")), F.shiftright(F.col(f"r.{at}"), 33) == F.col("b.part"))  # one row a partition
    kept = [c for c in rows.columns if c not in (name, at)]
    return out.select(*(F.col(f"r.`{c}`") for c in kept), (F.col("b.base") + F.col(f"r.{name}")).alias(name))
