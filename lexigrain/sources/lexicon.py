"""Dictionaries against the vocabulary, n-grams, training text and hierarchical documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.plans.corpus import Corpus


def read_table(spark: SparkSession, path: str, header: bool = True, separator: str = ",") -> DataFrame:
    """A CSV file as strings: quoted cells, doubled quotes, line breaks in cells, a byte order mark."""
    return spark.read.csv(path, header=header, sep=separator, quote='"', escape='"', multiLine=True, encoding="UTF-8")


def read_words(spark: SparkSession, path: str, skip_title: bool = True) -> DataFrame:
    """One word per line; a first line that starts with __ is a title."""
    lines = spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''")
    return lines.where(~F.col("term").startswith("__")) if skip_title else lines


def read_hunspell(spark: SparkSession, path: str) -> DataFrame:
    """term, tags of a .dic file: the headword before a slash, and its tab-separated morphological fields."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[0-9]*\s*$"))
    cut = F.split("value", "\t")
    return lines.select(F.trim(F.split(cut[0], "/")[0]).alias("term"), F.array_join(F.slice(cut, F.lit(2), F.size(cut)), " ").alias("tags"))


def read_lemmas(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """form, tag, lemma, ord of a CSV file with these in its first three columns; an empty tag is NULL, ord follows the file."""
    rows = read_table(spark, path, header)
    form, tag, lemma = rows.columns[:3]
    # A file with line breaks in cells is read as one piece, so the numbers follow its lines.
    numbered = rows.select(F.trim(F.col(f"`{form}`")).alias("form"), F.nullif(F.trim(F.col(f"`{tag}`")), F.lit("")).alias("tag"), F.trim(F.col(f"`{lemma}`")).alias("lemma"), F.monotonically_increasing_id().alias("ord"))
    return numbered.where("form <> '' and lemma <> ''")


def read_expressions(spark: SparkSession, path: str) -> DataFrame:
    """term, tags, words of the entries of a .dic file that have several words."""
    return read_hunspell(spark, path).withColumn("words", F.size(F.split(F.trim("term"), r"\s+"))).where("words > 1")


def unique_by(df: DataFrame, key: str, order: str, policy: str = "ignore") -> DataFrame:
    """One row per key: the first (ignore) or the last (replace) in ``order``, or an error if there are several."""
    if policy == "error":
        twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0][0]!r} is defined more than once")
        return df
    by = Window.partitionBy(key).orderBy(F.asc(order) if policy == "ignore" else F.desc(order))
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def compiled(vocabulary: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary entries that the corpus holds, with their frequencies."""
    return vocabulary.join(dictionary, "term").select("term", "tf", "df", "tags")


def unknown(vocabulary: DataFrame, dictionary: DataFrame, k: int) -> DataFrame:
    """The commonest terms that the dictionary lacks."""
    return vocabulary.join(dictionary.select("term"), "term", "left_anti").orderBy(F.desc("tf"), "term").limit(k).select("term", "tf")


def flagged(vocabulary: DataFrame, flags: DataFrame, wanted: list[str]) -> DataFrame:
    """Terms of which the first part-of-speech flag (in ``ord``) is wanted; the flag NULL, or none, lets all pass."""
    if not wanted or "NULL" in wanted:
        return vocabulary
    first = unique_by(flags.where(F.col("flag").startswith("po:")), "term", "ord")
    other = flags.where(~F.col("flag").startswith("po:"))
    hit = first.select("term", "flag").unionByName(other.select("term", "flag")).where(F.col("flag").isin(wanted)).select("term").distinct()
    return vocabulary.join(hit, "term", "left_semi")


def ngrams(tokens: DataFrame, n: int, k: int) -> DataFrame:
    """gram, n: the k commonest runs of n tokens."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = tokens.select("term", *(F.lead("term", i).over(order).alias(f"t{i}") for i in range(1, n))).where(F.col(f"t{n - 1}").isNotNull())
    gram = F.concat_ws(" ", "term", *(f"t{i}" for i in range(1, n)))
    return rows.groupBy(gram.alias("gram")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(k)


def name_runs(tokens: DataFrame, k: int) -> DataFrame:
    """name, n: the k commonest runs of two or more words with a capital initial, of surface tokens."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    rows = tokens.withColumn("capital", F.col("term").rlike(r"^\p{Lu}\p{L}")).withColumn("run", F.sum(F.when(F.col("capital"), 0).otherwise(1)).over(order))
    runs = rows.where("capital").groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "term"))).alias("t"))
    names = runs.where(F.size("t") > 1).select(F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def training_lines(corpus: Corpus, stop: list[str], number: str = "#") -> DataFrame:
    """doc_id, line: a document's terms but the stop words, blanks in them as ``_`` and numbers as one sign, for training word vectors; needs no shuffle."""
    words = F.filter("words", lambda x: x.isNotNull() & ~x.isin(stop))
    plain = F.transform(words, lambda x: F.when(x.rlike("^[0-9]+(?:[.,][0-9]+)*$"), F.lit(number)).otherwise(F.replace(x, F.lit(" "), F.lit("_"))))
    return corpus.rail.select("doc_id", F.array_join(plain, " ").alias("line"))


def chapters(rows: DataFrame, book: str = "conv_id", order: str = "turn") -> DataFrame:
    """Chapters of books in their order: book, chapter, ord, role, n_chars."""
    place = F.row_number().over(Window.partitionBy(book).orderBy(order))
    return rows.select(F.col(book).alias("book"), F.col(order).alias("chapter"), place.alias("ord"), "role", F.length("text").cast("long").alias("n_chars"))
