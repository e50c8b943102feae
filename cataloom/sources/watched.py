"""What a film diary service exports: five tables merged, the diary feed, and the state that is remembered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rating_of(text: Column) -> Column:
    """Half stars as a whole number, 0 where there is none."""
    return F.coalesce(F.round(text.try_cast("double") * 2).cast("int"), F.lit(0))


def _key() -> Column:
    return F.coalesce(F.nullif("uri", F.lit("")), F.concat_ws("|", "name", F.coalesce("year", F.lit(""))))


def merge_export(watched: DataFrame, diary: DataFrame, reviews: DataFrame, ratings: DataFrame) -> DataFrame:
    """(key, title, year, logged, dates, rating) of every film in any of the tables (name, year, uri; date; watched_date; rating).

    One union and one grouping instead of a chain of outer joins. Of several names of a key the least counts; rows without a name are left out.
    """
    empty = {"logged": F.lit(None).cast("string"), "day": F.lit(None).cast("string"), "stars": F.lit(None).cast("int")}
    parts = [(watched, {"logged": F.coalesce("date", F.lit(""))}), (diary, {"day": F.col("watched_date")}), (reviews, {"day": F.col("watched_date")}), (ratings, {"stars": rating_of(F.col("rating"))})]
    rows = None
    for table, own in parts:
        part = table.where("name <> ''").select(_key().alias("key"), F.col("name").alias("title"), F.trim(F.coalesce("year", F.lit(""))).alias("year"), *[c.alias(n) for n, c in (empty | own).items()])
        if "day" in own:
            part = part.where("day <> ''")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("key").agg(F.min("title").alias("title"), F.min("year").alias("year"), F.coalesce(F.max("logged"), F.lit("")).alias("logged"), F.sort_array(F.collect_set("day")).alias("dates"), F.coalesce(F.max("stars"), F.lit(0)).alias("rating"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, year, tmdb, rating, day) of the items of a diary feed, fields by their local names; items without a film are left out."""
    fields = {"filmTitle": "title", "filmYear": "year", "movieId": "tmdb", "memberRating": "rating", "watchedDate": "day"}
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(", ".join(f"{f} string" for f in fields)).load(path)
    named = rows.select(*[F.trim(F.col(f)).alias(n) for f, n in fields.items()]).where("title <> ''")
    return named.withColumn("rating", rating_of(F.col("rating")))


STATE = "films array<struct<title:string,year:string,tmdb:string,rating:int,dates:array<string>>>, pending array<struct<title:string,year:string,date:string,rating:int,rewatch:boolean,sent:string>>, unnamed array<string>"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """One row of what is remembered; nothing where there is no file yet. A file that is no such document fails the read."""
    return spark.read.schema(STATE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_state(films: DataFrame, pending: DataFrame, unnamed: DataFrame, path: str) -> None:
    """The state as one document: films by title and year, pending rows as they come, names once each in order. Of one person's size."""
    film = F.struct(F.lower("title").alias("o"), "year", F.struct("title", "year", "tmdb", "rating", "dates").alias("film"))
    one = films.agg(F.transform(F.sort_array(F.collect_list(film)), lambda x: x["film"]).alias("films"))
    waiting = pending.agg(F.collect_list(F.struct("title", "year", "date", "rating", "rewatch", "sent")).alias("pending"))
    names = unnamed.agg(F.sort_array(F.collect_set("name")).alias("unnamed"))
    k = F.lit(1).alias("k")
    document = one.select("*", k).join(waiting.select("*", k), "k").join(names.select("*", k), "k").drop("k")  # one row each
    document.coalesce(1).write.mode("overwrite").json(path)
