"""Semi-structured sources: availability JSON, spell bindings JSON, news XML. Raw text in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = """
teams array<struct<id:bigint,name:string>>,
events array<struct<id:bigint,is_next:boolean>>,
elements array<struct<code:string,id:string,web_name:string,element_type:int,team:bigint,status:string,
  chance_of_playing_next_round:string,chance_of_playing_this_round:string,news:string,news_added:string>>
"""
BINDINGS = """results struct<bindings array<struct<
  club struct<value string>, coachLabel struct<value string>, label struct<value string>,
  n struct<value string>, start struct<value string>, startPrecision struct<value string>,
  end struct<value string>>>>"""
FEED = "channel struct<item array<struct<title string, description string, pubDate string>>>"
# Player types of the game; other types are not players.
POSITIONS = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}


def availability_rows(payloads: DataFrame) -> DataFrame:
    """One row per player from snapshots ``season, observed_at, payload``; absent values are ""."""
    parsed = payloads.select("season", "observed_at", F.from_json("payload", PAYLOAD).alias("p"))
    upcoming = F.filter("p.events", lambda e: e.is_next)
    names = F.map_from_entries("p.teams")
    positions = F.create_map(*[F.lit(x) for pair in POSITIONS.items() for x in pair])
    rows = parsed.select(
        "season", "observed_at", names.alias("names"), F.get(upcoming, F.lit(0))["id"].alias("next"),
        F.explode("p.elements").alias("e"),
    ).withColumn("position", F.try_element_at(positions, F.col("e.element_type"))).filter("position is not null")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"),
        "season", text(F.col("next")).alias("fpl_next_event"),
        text(F.col("e.code")).alias("player_code"), text(F.col("e.id")).alias("player_id"),
        text(F.col("e.web_name")).alias("web_name"), "position",
        F.element_at("names", F.col("e.team")).alias("fpl_team"),
        text(F.col("e.status")).alias("status"),
        text(F.col("e.chance_of_playing_next_round")).alias("chance_next"),
        text(F.col("e.chance_of_playing_this_round")).alias("chance_this"),
        F.trim(text(F.col("e.news"))).alias("news"), text(F.col("e.news_added")).alias("news_added"),
    )


def _item(column: str) -> Column:
    return F.substring_index(F.col(column), "/", -1)


def spell_rows(answers: DataFrame, clubs: DataFrame) -> DataFrame:
    """Spells from query answers (column ``answer``), clubs named by ``team, wikidata_id``.

    Records without a start drop out; a precision of a year or coarser marks ``year_only``.
    """
    rows = answers.select(F.explode(F.from_json("answer", BINDINGS)["results"]["bindings"]).alias("b"))
    date = lambda c: F.try_to_date(F.substring(F.col(c), 1, 10), "yyyy-MM-dd")
    return (
        rows.filter(F.coalesce("b.start.value", F.lit("")) != "")
        .select(
            _item("b.club.value").alias("wikidata_id"), F.col("b.coachLabel.value").alias("manager"),
            date("b.start.value").alias("start_date"), date("b.end.value").alias("end_date"),
            (F.coalesce(F.col("b.startPrecision.value").cast("int"), F.lit(11)) <= 9).alias("year_only"),
        )
        .join(clubs, "wikidata_id")
        .select("team", "manager", "start_date", "end_date", "year_only")
    )


def item_counts(answers: DataFrame) -> DataFrame:
    """Name candidates of a resolution answer: ``label, item, n, row_no``."""
    return answers.select(
        F.posexplode(F.from_json("answer", BINDINGS)["results"]["bindings"]).alias("row_no", "b")
    ).select(
        F.col("b.label.value").alias("label"), _item("b.club.value").alias("item"),
        F.col("b.n.value").cast("bigint").alias("n"), "row_no",
    )


def published_date(stamp: Column) -> Column:
    """Calendar date of an RFC 822 stamp, in the stamp's own zone; null if unreadable."""
    return F.try_to_date(F.regexp_extract(stamp, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), "d MMM yyyy")


def headlines(feeds: DataFrame) -> DataFrame:
    """Headlines from feed documents (column ``xml``); undated items drop out."""
    items = feeds.select(F.explode(F.from_xml("xml", FEED)["channel"]["item"]).alias("i"))
    return items.select(
        F.trim(F.coalesce("i.title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("i.description", F.lit(""))).alias("summary"),
        published_date(F.col("i.pubDate")).alias("published"),
    ).filter("published is not null")


def headlines_from_files(spark: SparkSession, path: str) -> DataFrame:
    """The same from feed files, read item by item."""
    items = spark.read.format("xml").option("rowTag", "item").schema(
        "title string, description string, pubDate string"
    ).load(path)
    return items.select(
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("description", F.lit(""))).alias("summary"),
        published_date(F.col("pubDate")).alias("published"),
    ).filter("published is not null")
