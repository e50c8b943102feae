"""The title index: titles, names and keys from the title lists, and lookups in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions.titles import title_keys
from cataloom.operators.linkage import near_join
from cataloom.sources.census import TITLE_KINDS


@dataclass
class TitleIndex:
    titles: DataFrame
    names: DataFrame
    keys: DataFrame

    def save(self, folder: str) -> None:
        """Keys are sorted, so a lookup reads few row groups."""
        self.titles.write.mode("overwrite").parquet(f"{folder}/titles")
        self.names.write.mode("overwrite").parquet(f"{folder}/names")
        self.keys.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/keys")

    @classmethod
    def load(cls, spark, folder: str) -> TitleIndex:
        return cls(*(spark.read.parquet(f"{folder}/{n}") for n in ("titles", "names", "keys")))

    def under(self, wanted: DataFrame) -> DataFrame:
        """(key, tconst) of titles under the wanted keys."""
        return self.keys.join(wanted.select("key").distinct(), "key", "left_semi")

    def near(self, wanted: DataFrame) -> DataFrame:
        """(key, tconst) of titles under a key one edit from a wanted one."""
        pairs = near_join(wanted, self.keys, "key").where("left_key <> right_key")
        return self.keys.join(pairs.select(F.col("right_key").alias("key")).distinct(), "key", "left_semi")

    def rows(self, found: DataFrame) -> DataFrame:
        """Titles with the sorted list of all their names."""
        chosen = self.titles.join(found.select("tconst").distinct(), "tconst", "left_semi")
        return chosen.join(self.names, "tconst").groupBy(*self.titles.columns).agg(F.sort_array(F.collect_set("title")).alias("names"))


def build(basics: DataFrame, akas: DataFrame) -> TitleIndex:
    kept = basics.where(F.col("titleType").isin(*TITLE_KINDS) & (F.col("isAdult") == "0"))
    titles = kept.select("tconst", F.col("titleType").alias("kind"), F.col("primaryTitle").alias("primary_title"), F.col("originalTitle").alias("original_title"), F.col("startYear").try_cast("int").alias("year"), F.col("runtimeMinutes").try_cast("int").alias("minutes"))
    regional = akas.select(F.col("titleId").alias("tconst"), "title").join(titles.select("tconst"), "tconst", "left_semi")
    names = titles.select("tconst", F.col("primary_title").alias("title")).union(titles.select("tconst", "original_title")).union(regional).where("title is not null").distinct()
    keys = names.select(F.explode(title_keys(F.col("title"))).alias("key"), "tconst").distinct()
    return TitleIndex(titles, names, keys)
