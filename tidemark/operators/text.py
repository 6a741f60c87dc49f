"""Headline signals: classify, tag the one entity named, and find what the record has not followed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.names import DISPLAY_NAMES
from tidemark.session import stage

# Wording of a change in charge, wording that points at somebody else, nicknames.
CHANGE = (
    r"\b(sack(ed|s|ing)?|appoint(s|ed|ment)?|names? .{0,40}(manager|head coach|boss)|"
    r"new (manager|head coach|boss)|part(s|ed)? (company|ways)|resign(s|ed)?|"
    r"(manager|head coach|boss) (leaves|departs|exits|quits)|interim (manager|head coach|boss)|"
    r"caretaker)\b"
)
NOT_THE_MANAGER = (
    r"\b(director|chairman|chief executive|owner|academy|under-\d+|u\d\d|women|wsl|"
    r"assistant|coach of the month|manager of the month|referee|captain|signs?|signing|"
    r"loan|transfer|contract extension)\b"
)
NICKNAMES = {
    "Tottenham Hotspur": ("Spurs",),
    "Manchester United": ("Man Utd", "Man United"),
    "Aston Villa": ("Villa",),
    "Nottingham Forest": ("Forest",),
    "Crystal Palace": ("Palace",),
    "Wolverhampton Wanderers": ("Wolves",),
    "Brighton & Hove Albion": ("Brighton",),
}


def club_names(clubs: list[str]) -> dict[str, list[str]]:
    """Every name headlines use for each club."""
    return {c: [c, DISPLAY_NAMES.get(c, c), *NICKNAMES.get(c, ())] for c in clubs}


def word_pattern(names: list[str]) -> str:
    """Names as whole words, longest first, any case, Unicode letters counting as letters."""
    ordered = sorted(set(names), key=lambda n: (-len(n), n))
    return r"(?iU)\b(" + "|".join(re.escape(n) for n in ordered) + r")\b"


def is_change(title: Column, summary: Column, include: str = CHANGE, exclude: str = NOT_THE_MANAGER) -> Column:
    """The title reads like a change, and neither title nor summary points at somebody else."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(summary, F.lit("")))
    return title.rlike(f"(?iU){include}") & ~text.rlike(f"(?iU){exclude}")


def tag_entities(text: Column, names: dict[str, list[str]]) -> Column:
    """Sorted array of the entities a text names. The name list is a setting, so it stays in the
    expression: one pass over each text, no join and no shuffle."""
    hits = [
        F.when(text.rlike(word_pattern(aliases)), F.lit(entity)) for entity, aliases in sorted(names.items())
    ]
    return F.array_compact(F.array(*hits))


#: Words of a text that are looked up together; a longer text is several rows, each with the words its last names need.
_SPAN = 2_000
#: Parts a name's texts are spread over where the names are too many to broadcast.
_SALTS = 16
#: Bits of the filter of names, in words of 64: at most 2**20 rows, so that it may be broadcast whatever the names.
_FILTER_BITS = 1 << 26
#: Names whose entities are broadcast with them, those of most entities: so many names, each of at most so many rows.
_KNOWN_EVERYWHERE, _ROWS_EVERYWHERE = 1 << 18, 4
_EDGE = r"(?U)^\W+|\W+$"


def _pieces(text: Column) -> Column:
    """Words and what stands between them, in turn, from the first word on; lower case."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, _EDGE, "")), F.lit(r"(?U)(\w+|\W+)"), F.lit(1))


def _text_pieces(text: Column) -> Column:
    """The same, with what follows the last word, in which no name can end; every character is matched once."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?U)^\W++", "")), F.lit(r"(?U)\w++|\W++"), F.lit(0))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def _filter_place(name: str) -> Column:
    return F.xxhash64(name).bitwiseAND(F.lit(_FILTER_BITS - 1))


def _name_filter(known: DataFrame) -> DataFrame:
    place = _filter_place("_name")
    return known.select(F.shiftright(place, 6).alias("_at_word"), _bit(place).alias("_bit")).groupBy("_at_word").agg(
        F.bit_or("_bit").alias("_filter"))


def _numbered(entities: DataFrame) -> DataFrame:
    """Entities with numbers from 0 on without gaps, however they are partitioned, so that few of them are few bits."""
    apart = stage(entities.withColumn("_id", F.monotonically_increasing_id()), "entities").withColumn("_part", F.shiftright("_id", 33))
    # One row per partition, whatever the entities.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = apart.groupBy("_part").agg(F.count("*").alias("_here")).select(
        "_part", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_first"))
    return stage(apart.join(F.broadcast(first), "_part").select(
        "entity", (F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("_number")), "numbers")


def _known_everywhere(known: DataFrame) -> DataFrame:
    most = known.groupBy("_name").agg(F.sum(F.bit_count("_bits")).alias("_entities"), F.count("*").alias("_rows")).filter(
        F.col("_rows") <= _ROWS_EVERYWHERE).orderBy(F.desc("_entities"), "_name").limit(_KNOWN_EVERYWHERE)
    return known.join(F.broadcast(most.select("_name")), "_name")


def tag_by_names(
    texts: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", longest: bool = False
) -> DataFrame:
    """The entities each text names, for tables of names too large for patterns: ``key, entity``, one row each.

    ``names`` has ``alias, entity``. A name is found as ``tag_entities`` finds it: as whole words, in any case, with the
    same characters between its words. Word runs as long as some name are joined to the names, so the work follows the
    texts' words and not texts times names. With ``longest`` a name does not count inside a longer one found there.
    Characters before a name's first and after its last word are ignored; a name without words, a null entity and a null
    key or text give no row. Rows of one key are one text of several parts.

    The names are stored once, their entities as numbered bits, 64 to a row. Runs that surely are no names stay where
    they are: a filter of bounded size is broadcast. So are the names of most entities; runs of these become bits of their
    text in the task that reads it. All other runs are joined.
    """
    given = stage(
        names.select("entity", _pieces(F.col("alias")).alias("_p")).filter("entity is not null and size(_p) > 0")
        .select("entity", F.array_join("_p", "").alias("_name"), F.size("_p").alias("_n")).distinct(), "names")
    # A name's length in words is bounded by how long names are, not by how many there are.
    sizes = sorted(r[0] for r in given.select("_n").distinct().collect())
    if not sizes:
        return texts.select(key, F.lit(None).cast("string").alias("entity")).limit(0)
    numbers = _numbered(given.select("entity").distinct())
    known = stage(
        given.join(numbers, "entity").groupBy("_name", F.shiftright("_number", 6).alias("_word"))
        .agg(F.bit_or(_bit(F.col("_number"))).alias("_bits")), "bits")
    # While the row's number is read on, no filter moves below it, where pieces would be taken once more.
    part = texts.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), _text_pieces(F.col(text)).alias("_p"),
    ).filter("size(_p) > 0").select(
        "_key", "_row", "_p", F.explode(F.sequence(F.lit(0), F.size("_p") - 1, F.lit(2 * _SPAN))).alias("_from"))
    part = part.select("_key", "_row", "_from", F.slice("_p", F.col("_from") + 1, F.lit(2 * _SPAN + sizes[-1])).alias("_p"))
    starts = F.sequence(F.lit(1), F.least(F.lit(2 * _SPAN - 1), F.size("_p")), F.lit(2))
    start = part.select("*", F.explode(starts).alias("_i"))

    def run_of(n: int) -> Column:
        """The run of ``n`` pieces that starts here, null where the text ends before."""
        run = F.get("_p", F.col("_i") - 1) if n == 1 else F.array_join(F.slice("_p", F.col("_i"), F.lit(n)), "")
        return F.when(F.col("_i") + (n - 1) <= F.size("_p"), run)

    # Only where places matter are a text's equal runs told apart.
    runs = F.inline(F.array(*[
        F.struct((F.col("_from") + F.col("_i")).alias("_at"), F.lit(n).alias("_n"), run_of(n).alias("_name")) for n in sizes
    ])) if longest else F.explode(F.array(*[run_of(n) for n in sizes])).alias("_name")
    place = _filter_place("_name")
    found = start.select("_key", "_row", runs).filter("_name is not null").withColumn("_at_word", F.shiftright(place, 6)).withColumn(
        "_bit", _bit(place)).join(F.broadcast(_name_filter(given)), "_at_word").filter(
        F.col("_filter").bitwiseAND(F.col("_bit")) != 0).drop("_at_word", "_bit", "_filter")
    salt = F.pmod(F.xxhash64("_key", "_row"), F.lit(_SALTS)).cast("int")
    spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    if longest:
        hits = found.withColumn("_salt", salt).join(spread, ["_name", "_salt"])
        # In order of start and, at one start, of length, a run lies in a longer one if an earlier run ends as late.
        earlier = Window.partitionBy("_key", "_row").orderBy("_at", F.desc("_n")).rangeBetween(
            Window.unboundedPreceding, Window.currentRow)
        end = F.struct((F.col("_at") + F.col("_n")).alias("end"), F.col("_n").alias("n"))
        hits = hits.withColumn("_furthest", F.max(end).over(earlier)).filter("_furthest.end = _at + _n and _furthest.n = _n")
    else:
        # A run is either resolved, as bits without a name, or a name without bits; null names meet none.
        sorted_out = found.join(F.broadcast(_known_everywhere(known)), "_name", "left").groupBy(
            "_key", "_row", F.when(F.col("_bits").isNull(), F.col("_name")).alias("_name"), "_word",
        ).agg(F.bit_or("_bits").alias("_bits"))
        rest = spread.select("_name", "_salt", F.col("_word").alias("_word_met"), F.col("_bits").alias("_bits_met"))
        hits = sorted_out.withColumn("_salt", F.when(F.col("_name").isNotNull(), salt).otherwise(
            F.hash("_key", "_row"))).join(rest, ["_name", "_salt"], "left").select(
            "_key", F.coalesce("_word", "_word_met").alias("_word"), F.coalesce("_bits", "_bits_met").alias("_bits"))
    told = hits.filter("_bits is not null").groupBy("_key", "_word").agg(F.bit_or("_bits").alias("_bits"))
    held = F.expr("filter(sequence(0, 63), b -> shiftrightunsigned(_bits, b) & 1 = 1)")
    return told.select("_key", "_word", F.explode(held).alias("_b")).withColumn(
        "_number", F.col("_word") * 64 + F.col("_b")).join(
        numbers, "_number").select(F.col("_key").alias(key), "entity")


def attributed_changes(
    headlines: DataFrame, names: dict[str, list[str]], include: str = CHANGE, exclude: str = NOT_THE_MANAGER
) -> DataFrame:
    """Headlines of a change that name exactly one entity, added as ``team``."""
    return (
        headlines.filter(is_change(F.col("title"), F.col("summary"), include, exclude))
        .withColumn("_named", tag_entities(F.col("title"), names))
        .filter(F.size("_named") == 1)
        .withColumn("team", F.element_at("_named", 1))
        .drop("_named")
    )


def latest_appointment(spells: DataFrame) -> DataFrame:
    return spells.groupBy("team").agg(F.max("start_date").alias("appointed"))


def unconfirmed(changes: DataFrame, appointments: DataFrame, today, grace_days: int = 3) -> DataFrame:
    """Reported changes older than the grace period that the record has not caught up with."""
    return (
        changes.join(appointments, "team", "left")
        .filter(F.datediff(F.lit(today).cast("date"), "published") >= grace_days)
        .filter(F.col("appointed").isNull() | (F.col("appointed") < F.date_sub("published", 7)))
    )
