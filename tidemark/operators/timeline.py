"""Timeline order, two-sided unpivot and the team-level point-in-time state.

Input is a match table with ``pool, match_id, season, competition, matchday, match_date, kickoff,
home_team, away_team, home_goals, away_goals`` and, where known, shots and ratings.

Order is carried by two text keys that compare bytewise:

``block_key``  rows of a target round share one, placed at the round's first date; every other match
               has its own and comes after the rounds of that date
``seq_key``    ``block_key`` plus date, kick-off and match id: a total order inside a pool

``chunk`` is the half-year of the block. Team timelines are cut by it, so a club (or pair) that holds a
large share of all rows is spread over half-years, and only one summary row per half-year crosses chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FEATURES, LEAGUE_COMPETITIONS, TARGET_COMPETITION
from tidemark.functions.scalars import bounded_tail, padded, points

SIDE_STATS = ("shots", "shots_on_target")


def half_year(date: Column) -> Column:
    """Index of the half-year from August or February that holds a date."""
    return F.floor((F.year(date) * 12 + F.month(date) - 8) / 6).cast("int")


def timeline(matches: DataFrame, target: str = TARGET_COMPETITION) -> DataFrame:
    """Add ``block_date, block_key, seq_key, chunk, in_block``; undated rows drop out."""
    dated = matches.filter(F.col("match_date").isNotNull()).withColumn(
        "block_round", F.when(F.col("competition") == target, F.col("matchday"))
    )
    starts = (
        dated.filter(F.col("block_round").isNotNull())
        .groupBy("pool", "season", "block_round")
        .agg(F.min("match_date").alias("round_start"))
    )
    joined = dated.join(starts, ["pool", "season", "block_round"], "left")
    in_block = F.col("block_round").isNotNull()
    kickoff = F.coalesce(F.col("kickoff"), F.lit(""))
    block_key = F.when(
        in_block,
        F.concat_ws(
            "|", F.col("round_start"), F.lit("0"), F.col("season"),
            padded(F.col("block_round"), 4),
        ),
    ).otherwise(F.concat_ws("|", F.col("match_date"), F.lit("1"), kickoff, F.col("match_id")))
    return (
        joined.withColumn("in_block", in_block)
        .withColumn("block_date", F.coalesce("round_start", "match_date"))
        .withColumn("block_key", block_key)
        .withColumn(
            "seq_key", F.concat_ws("|", "block_key", F.col("match_date"), kickoff, F.col("match_id"))
        )
        .withColumn("chunk", half_year(F.col("block_date")))
        .drop("block_round", "round_start")
    )


def _optional(frame: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in frame.columns else F.lit(None).cast(kind)


def sides(matches: DataFrame) -> DataFrame:
    """Each match as two team rows, for and against swapped. No shuffle."""

    def side(us: str, them: str) -> Column:
        fields = [
            F.col(f"{us}_team").alias("team"),
            F.col(f"{them}_team").alias("opponent"),
            F.lit(us == "home").alias("is_home"),
            F.col(f"{us}_goals").cast("int").alias("goals_for"),
            F.col(f"{them}_goals").cast("int").alias("goals_against"),
            _optional(matches, f"{us}_elo").alias("elo"),
            _optional(matches, f"{them}_elo").alias("opponent_elo"),
        ]
        for stat in SIDE_STATS:
            fields.append(_optional(matches, f"{us}_{stat}").alias(f"{stat}_for"))
            fields.append(_optional(matches, f"{them}_{stat}").alias(f"{stat}_against"))
        return F.struct(*fields)

    swapped = ("home_", "away_")
    keep = [c for c in matches.columns if not c.startswith(swapped)]
    return (
        matches.select(*keep, F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s"))
        .select(*keep, "s.*")
        .withColumn("played", F.col("goals_for").isNotNull() & F.col("goals_against").isNotNull())
    )


def history_before(
    rows: DataFrame,
    keys: list[str],
    item: Column,
    depth: int,
    sums: dict[str, Column] | None = None,
    sum_key: str | None = None,
    first: tuple[str, ...] = (),
    laid: bool = False,
) -> DataFrame:
    """State read at the start of each row's block, from strictly earlier blocks.

    Adds ``history``: the last ``depth`` values of ``item`` over played rows in timeline order; and,
    for each entry of ``sums``, its running total over the same earlier rows, kept apart per
    ``sum_key`` (the season).

    Two levels. Inside (keys, chunk) windows read earlier blocks of the half-year. One summary row per
    (keys, chunk) then carries the end state of earlier chunks forward. A window group is therefore
    one half-year of one entity, or one row per half-year of one entity, never an entity's whole past. The
    rows are shuffled once, and the summaries join on that same partitioning.

    No sort holds a history. Played rows are numbered, and each row reads the ``depth`` numbers before its block in the
    last window, which nothing has to sort again. Columns in ``first`` take their value from the block's first row.

    ``rows`` is read twice, so hand in a stored table, not a plan that ends in the rating fold.

    With ``laid`` the rows of a key already lie in one partition (a table staged by the first key). Then they are neither
    shuffled nor read twice: windows run over the whole key, whose rows Spark spills where memory is short.
    """
    sums = sums or {}
    grain = [*keys] if laid else [*keys, "chunk"]
    staged = rows.withColumn("_item", item)
    if sums:
        staged = staged.withColumn("_sum_key", F.col(sum_key)).withColumn(
            "_delta", F.struct(*[v.alias(n) for n, v in sums.items()])
        )
    if not laid:
        staged = staged.repartition(*grain)

    # Running values up to the previous row as one column, and the value its block started with. The second
    # window reuses the first one's sort.
    def at_block_start(partition: list[str], values: dict[str, Column], name: str, frame: DataFrame, own: str = "") -> DataFrame:
        running = (
            Window.partitionBy(*partition)
            .orderBy("block_key", "seq_key")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        block = Window.partitionBy(*partition, "block_key").orderBy("seq_key")
        rest = [c for c in frame.columns if c != "_delta"]
        frame = frame.select(*rest, *[v.over(running).alias(f"{name}_{n}") for n, v in values.items()])
        frame = frame.select(*rest, F.struct(*[F.col(f"{name}_{n}").alias(n) for n in values]).alias(own + name))
        return frame.withColumns({name: F.first(own + name).over(block)} | {
            n: F.first(n).over(block) for n in (first if own else ())})

    if sums:
        # Chunk summaries add the row's own terms again.
        own_terms = [] if laid else [F.col("_delta").alias("_terms")]
        staged = at_block_start(
            [*grain, "_sum_key"], {n: F.sum(f"_delta.{n}") for n in sums}, "_l", staged.select("*", *own_terms)
        )
    # How many rows of the grain were played before this row, and before its block.
    staged = at_block_start(grain, {"n": F.count_if("played")}, "_before", staged, "_own")
    staged = staged.withColumns({"_before": F.col("_before.n"), "_own_before": F.col("_own_before.n")})

    # Every row reads at its block's number; a played row is also one that is read, at its own number, which for the first
    # of a block is the same.
    def part(reads: bool, at: str, read: Column) -> Column:
        return F.struct(F.lit(reads).alias("_reads"), F.col(at).alias("_at"), read.alias("_read"))

    none = F.lit(None)
    parts = (
        F.when(~F.col("played"), F.array(part(True, "_before", none)))
        .when(F.col("_before") == F.col("_own_before"), F.array(part(True, "_before", F.col("_item"))))
        .otherwise(F.array(part(True, "_before", none), part(False, "_own_before", F.col("_item"))))
    )
    last_played = Window.partitionBy(*grain).orderBy("_at").rangeBetween(-depth, -1)
    read = (
        staged.select(*[c for c in staged.columns if c not in ("_item", "_terms")], F.inline(parts))
        .withColumn("_local", F.collect_list("_read").over(last_played))
        .filter("_reads")
    )
    if laid:
        return read.select(
            *rows.columns, F.col("_local").alias("history"), *[F.coalesce(F.col(f"_l.{n}"), F.lit(0)).alias(n) for n in sums])

    # Chunk summaries. A chunk may hold rows of two seasons; totals are kept apart, the tail is not.
    one_chunk = Window.partitionBy(*keys, "chunk")
    late = F.col("played") & (F.col("_own_before") >= F.count_if("played").over(one_chunk) - depth)
    ends = staged.withColumn("_late", late)
    tail = F.collect_list(F.when(F.col("_late"), F.struct("_own_before", "_item")))
    span = grain + (["_sum_key"] if sums else [])
    spans = ends.groupBy(*span).agg(
        tail.alias("_tail"), *[F.sum(f"_terms.{n}").alias(n) for n in sums]
    ).repartition(*keys)
    if sums:
        so_far = (
            Window.partitionBy(*keys, "_sum_key")
            .orderBy("chunk")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        spans = spans.select(
            *span, "_tail",
            F.struct("_sum_key", *[F.sum(n).over(so_far).alias(n) for n in sums]).alias("_prior"),
        )
        spans = spans.groupBy(*keys, "chunk").agg(
            F.flatten(F.collect_list("_tail")).alias("_tail"), F.collect_list("_prior").alias("_prior")
        )
    spans = spans.withColumn("_has", F.size("_tail") > 0)
    filled = Window.partitionBy(*keys, "_has").orderBy("chunk").rowsBetween(-(depth - 1), 0)
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    items = F.transform(F.sort_array("_tail"), lambda t: t["_item"])
    spans = spans.withColumn("_tail", items).withColumn(
        "_cum",
        F.when(F.col("_has"), bounded_tail(F.flatten(F.collect_list("_tail").over(filled)), depth)),
    ).withColumn("_carry", F.last("_cum", ignorenulls=True).over(before))
    carry = spans.select(*keys, "chunk", "_carry", *(["_prior"] if sums else []))

    out = read.join(carry, [*keys, "chunk"], "left")
    result = [
        bounded_tail(F.concat(F.coalesce("_carry", F.slice("_local", 1, 0)), "_local"), depth).alias("history")
    ]
    if sums:
        prior = F.filter("_prior", lambda p: p["_sum_key"] == F.col("_sum_key"))
        out = out.withColumn("_mine", F.get(prior, F.lit(0)))
        result += [
            (F.coalesce(F.col(f"_l.{n}"), F.lit(0)) + F.coalesce(F.col(f"_mine.{n}"), F.lit(0))).alias(n)
            for n in sums
        ]
    return out.select(*rows.columns, *result)


def outcome_item() -> Column:
    """What one played match leaves in a team's bounded history."""
    return F.struct(
        F.col("match_date").alias("date"),
        F.col("goals_for").alias("gf"),
        F.col("goals_against").alias("ga"),
        points(F.col("goals_for"), F.col("goals_against")).alias("pts"),
        F.col("shots_for").alias("sf"),
        F.col("shots_against").alias("sa"),
        F.col("shots_on_target_for").alias("tf"),
        F.col("shots_on_target_against").alias("ta"),
        F.col("opponent_elo").alias("oe"),
    )


def record_terms() -> dict[str, Column]:
    """Season-to-date counters: league matches only, with home and away splits."""
    league = F.col("played") & F.col("competition").isin(*LEAGUE_COMPETITIONS)
    pts = points(F.col("goals_for"), F.col("goals_against"))
    home, away = league & F.col("is_home"), league & ~F.col("is_home")

    def count(condition):
        return F.when(condition, 1).otherwise(0).cast("bigint")

    def total(condition, value):
        return F.when(condition, value).otherwise(0).cast("bigint")

    terms = {
        "rec_played": count(league),
        "rec_won": count(league & (pts == 3)),
        "rec_drawn": count(league & (pts == 1)),
        "rec_lost": count(league & (pts == 0)),
        "rec_gf": total(league, F.col("goals_for")),
        "rec_ga": total(league, F.col("goals_against")),
    }
    for name, side in (("home", home), ("away", away)):
        terms[f"rec_{name}_played"] = count(side)
        terms[f"rec_{name}_points"] = total(side, pts)
        terms[f"rec_{name}_gf"] = total(side, F.col("goals_for"))
        terms[f"rec_{name}_ga"] = total(side, F.col("goals_against"))
    return terms


def team_state(
    side_rows: DataFrame, depth: int = FEATURES.history_depth, first: tuple[str, ...] = (), laid: bool = False
) -> DataFrame:
    """Bounded history and season record for every side row, as of its block's start."""
    return history_before(
        side_rows, ["pool", "team"], outcome_item(), depth, record_terms(), "season", first, laid
    )
