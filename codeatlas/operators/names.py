"""Names that contain a term: by substrings made on the way, or by a stored index of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from codeatlas.functions.text import ascii_lower
from codeatlas.shared import shared_dir

#: Length of the substrings by which contained names are found.
GRAM = 3
#: Folders of each stored table. More than a search of one term or name reads, few enough for a small table.
BUCKETS = 16


def like(col: Column, pattern: Column) -> Column:
    """LIKE of a pattern column made from a raw term, with its wildcards live."""
    return F.like(col, F.concat(F.lit("%"), F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("%")))


def literal(term: Column) -> Column:
    """The longest stretch of a term without wildcards; the first of equal ones."""
    parts = F.split(term, "[%_]")
    return F.element_at(F.filter(parts, lambda x: F.length(x) == F.array_max(F.transform(parts, F.length))), 1)


def grams(text: Column, size: int) -> Column:
    """The substrings of ``size`` characters, or the text itself where it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))


def term_grams(term: Column) -> Column:
    """Substrings that every name which fits a term must hold: those of its long stretches, else its longest one."""
    long = F.filter(F.split(term, "[%_]"), lambda x: F.length(x) >= GRAM)
    return F.when(F.size(long) > 0, F.array_distinct(F.flatten(F.transform(long, lambda x: grams(x, GRAM))))).otherwise(F.array(literal(term)))


def contained(names: DataFrame, terms: DataFrame) -> DataFrame:
    """``symbol, folded``: terms and the names that contain them, by an equi-join on substrings.

    ``names``: ``folded``; ``terms``: ``symbol``, none of wildcards alone; both distinct. A term is looked
    up by the first ``GRAM`` characters of its longest literal stretch, or all of it if it is shorter, and
    names by all their substrings of such lengths; LIKE then decides.
    """
    asked = terms.withColumn("gram", F.substring(literal(F.col("symbol")), 1, GRAM)).withColumn("size", F.length("gram"))
    sizes = asked.select("size").distinct()  # at most GRAM rows
    places = F.sequence(F.lit(1), F.greatest(F.length("folded") - F.col("size") + 1, F.lit(1)))
    parts = names.join(F.broadcast(sizes)).select("folded", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("folded"), i, F.col("size"))))).alias("gram"))
    met = parts.join(asked.select("gram", "symbol"), "gram")
    return met.where(like(F.col("folded"), F.col("symbol"))).select("symbol", "folded").distinct()


def bucket_of(text: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class NameIndex:
    """Placed symbols by name, and names by their substrings of 1 to ``GRAM`` characters, as stored tables.

    Both lie in folders by hash, and in order within these: one term reads one folder of substrings, and there the row
    groups of its rarest one; what it found reads the folders of these names. A table of terms does the same by joins,
    where Spark prunes folders by the terms' side if that is small.
    """

    spark: SparkSession
    path: str
    schema: StructType
    buckets: int = BUCKETS

    @property
    def placed(self) -> DataFrame:
        """Columns of :func:`~codeatlas.operators.selector.place`, with ``folded`` and ``bucket``."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/placed")

    @property
    def grams(self) -> DataFrame:
        """``gram, folded, bucket``: each name once for each of its substrings."""
        return self.spark.read.schema("gram string, folded string, bucket int").parquet(f"{self.path}/grams")

    @property
    def counts(self) -> DataFrame:
        """``gram, names``: grows with the characters in use, not with the names."""
        return self.spark.read.schema("gram string, names long").parquet(f"{self.path}/counts")

    def like(self, term: str) -> DataFrame:
        """``folded, bucket``: names that contain a folded ``term``, which isn't of wildcards alone."""
        asked = self.spark.range(1).select(F.explode(term_grams(F.lit(term))).alias("gram"))
        # One row: the substring that the fewest names hold.
        rarest = asked.join(self.counts, "gram", "left").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram"))).first()[0]
        bucket = self.spark.range(1).select(bucket_of(F.lit(rarest), self.buckets)).first()[0]
        found = self.grams.where((F.col("bucket") == bucket) & (F.col("gram") == rarest) & like(F.col("folded"), F.lit(term)))
        return found.select("folded", bucket_of(F.col("folded"), self.buckets).alias("bucket"))

    def symbols_like(self, term: str) -> DataFrame:
        """Placed symbols whose name contains a folded ``term``; all of them for wildcards alone."""
        if not term.strip("%_"):
            return self.placed
        return self.placed.join(self.like(term), ["bucket", "folded"], "left_semi")

    def contained(self, terms: DataFrame) -> DataFrame:
        """``symbol, folded``, as :func:`contained` gives; every term meets the list of its rarest substring alone."""
        asked = terms.select("symbol", F.explode(term_grams(F.col("symbol"))).alias("gram"))
        rarest = asked.join(self.counts, "gram", "left").groupBy("symbol").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
        keyed = rarest.withColumn("bucket", bucket_of(F.col("gram"), self.buckets))
        return self.grams.join(keyed, ["bucket", "gram"]).where(like(F.col("folded"), F.col("symbol"))).select("symbol", "folded")


def build_name_index(placed: DataFrame, buckets: int = BUCKETS) -> NameIndex:
    """Write the index of placed symbols to the shared folder. Symbols without a name aren't found by one and left out.

    Tables are dealt out by range, so a substring that most names hold is spread over tasks.
    """
    schema = StructType([*placed.schema.fields]).add("folded", StringType()).add("bucket", IntegerType())
    index = NameIndex(placed.sparkSession, shared_dir(placed.sparkSession, "names"), schema, buckets)

    def write(rows: DataFrame, key: str, order: list[str], name: str) -> None:
        keyed = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
        dealt = keyed.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
        dealt.write.partitionBy("bucket").parquet(f"{index.path}/{name}")

    write(placed.where("name is not null").withColumn("folded", ascii_lower("name")), "folded", ["folded", "id"], "placed")
    names = index.placed.select("folded").distinct()
    parts = F.array_distinct(F.flatten(F.array(*[grams(F.col("folded"), size) for size in range(1, GRAM + 1)])))
    write(names.select(F.explode(parts).alias("gram"), "folded").where("gram != ''"), "gram", ["gram", "folded"], "grams")
    index.grams.groupBy("gram").agg(F.count("*").alias("names")).write.parquet(f"{index.path}/counts")
    return index
