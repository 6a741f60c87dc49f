"""Streaming rating fold: clubs and waiting blocks in the state store, blocks released in order by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import RATING, RatingSettings
from tidemark.operators.rating import PoolRatings

_FIELDS = ("seq_key", "match_id", "season", "competition", "home_team", "away_team", "home_goals", "away_goals")
OUT = "pool string, match_id string, home_elo double, away_elo double"
_ROW = ("seq_key string, match_id string, season string, competition string, home_team string, away_team string, "
        "home_goals int, away_goals int")
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Ratings passed on together, and waiting rows of a part.
_OUT_ROWS, _PART_ROWS = 10_000, 2_000


def _told(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["pool", "match_id", "home_elo", "away_elo"])


def closing_rows(matches: DataFrame, event_time: str = "event_time") -> DataFrame:
    """A row per pool, without a match and far in the future, that releases all others. Later rows would be too late."""
    far = F.lit("2200-01-01").cast("timestamp")
    return matches.select("pool").distinct().select(*[
        F.col(c) if c == "pool" else (far if c == event_time else F.lit("~") if c == "seq_key" else F.lit(None)).cast(t).alias(c)
        for c, t in matches.dtypes])


class RatingProcessor(StatefulProcessor):
    """One pool. State: each club's rating and season; the waiting rows in order of their blocks, in parts; one timer.

    A call's rows are sorted and written in parts of at most ``_PART_ROWS``, under the part's first block and a number. The timer
    is that of the earliest waiting block. It rates all blocks that the watermark has passed, in order: parts are met as
    their first block comes up, so it holds the parts that reach over a block, the clubs met and the ratings not yet
    passed on. What such a part still keeps for later is written back as one part. A club is read and written once a
    call, a part as well, whatever blocks it holds.
    """

    def __init__(self, event_time: str, settings: RatingSettings) -> None:
        self.event_time, self.settings = event_time, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clubs = handle.getMapState("clubs", "team string", "rating double, season string")
        self.parts = handle.getMapState("parts", "block long", "n int")
        self.waiting = handle.getMapState(
            "waiting", "block long, part int",
            f"blocks array<long>, rows array<struct<{_ROW.replace(' string', ':string').replace(' int', ':int')}>>")

    def _keep(self, listed: list[tuple]) -> None:
        """Writes sorted (block, row) pairs as parts."""
        for start in range(0, len(listed), _PART_ROWS):
            part = listed[start : start + _PART_ROWS]
            block = part[0][0]
            had = self.parts.getValue((block,))
            number = had[0] if had else 0
            self.waiting.updateValue((block, number), ([b for b, _ in part], [r for _, r in part]))
            self.parts.updateValue((block,), (number + 1,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[frame["match_id"].notna()]
            values = frame[list(_FIELDS)].astype(object).where(frame[list(_FIELDS)].notna(), None)
            listed = sorted((
                (block, (*r[:6], None if r[6] is None else int(r[6]), None if r[7] is None else int(r[7])))
                for block, r in zip(frame[self.event_time].astype("datetime64[ms]").astype("int64").tolist(), values.values.tolist())
            ), key=lambda x: x[0])
            if listed:
                self._keep(listed)
                first = listed[0][0] if first is None else min(first, listed[0][0])
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def _passed(self, until: int) -> Iterator[tuple[int, list[tuple]]]:
        """Blocks before ``until`` in order, with their rows; what later blocks hold goes back into the state."""
        met: list[tuple] = []
        firsts = sorted((block, n) for (block,), (n,) in self.parts.iterator())
        while True:
            block = min([b for b, _ in firsts[:1]] + [b for b, _ in met[:1]], default=None)
            if block is None or block >= until:
                break
            fresh = False
            while firsts and firsts[0][0] == block:
                _, count = firsts.pop(0)
                for part in range(count):
                    blocks, rows = self.waiting.getValue((block, part))
                    met.extend(zip(blocks, (tuple(r) for r in rows)))
                    self.waiting.removeKey((block, part))
                self.parts.removeKey((block,))
                fresh = True
            if fresh:
                met.sort(key=lambda x: x[0])
            end = next((i for i, (b, _) in enumerate(met) if b > block), len(met))
            yield block, [r for _, r in met[:end]]
            del met[:end]
        if met:
            self._keep(met)
        later = [b for b, _ in firsts[:1]] + [b for b, _ in met[:1]]
        if later:
            # Later blocks wait for the next timer; rows that come for an earlier one register theirs.
            self.handle.registerTimer(min(later) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, out = PoolRatings(self.settings), []
        for _, rows in self._passed(timerValues.getCurrentWatermarkInMs()):
            for team in {t for r in rows for t in r[4:6]} - fold.value.keys():
                known = self.clubs.getValue((team,))
                if known:
                    fold.value[team], fold.season[team] = known
            for _, match_id, season, competition, home, away, scored, conceded in sorted(rows, key=lambda r: r[0]):
                before = fold.enter(home, season, competition), fold.enter(away, season, competition)
                if scored is not None and conceded is not None:
                    fold.settle(home, away, scored, conceded, competition)
                out.append((key[0], match_id, *before))
            if len(out) >= _OUT_ROWS:
                yield _told(out)
                out = []
        for team, rating in fold.value.items():
            self.clubs.updateValue((team,), (float(rating), fold.season[team]))
        if out:
            yield _told(out)

    def close(self) -> None:
        pass


def rating_stream(
    matches: DataFrame, event_time: str = "event_time", delay: str = "7 days", settings: RatingSettings = RATING
) -> DataFrame:
    """Ratings before each match, as soon as the watermark has passed its block.

    A pool's clubs and waiting rows lie in the state store under keys of their own; a task holds one micro-batch's rows
    of a pool, then one block at a time, so bound the micro-batch at the source (``maxFilesPerTrigger``). Rows later than
    the watermark are dropped by Spark; a correction is a rerun of the batch fold for that pool. With the start of a
    row's block as event time the rows come in the order of the batch fold. The last rows wait until newer ones or
    ``closing_rows`` push the watermark past them. Sets the session's state store to RocksDB, which timers need.
    """
    matches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return (
        matches.select("pool", event_time, *_FIELDS).withWatermark(event_time, delay)
        .groupBy("pool")
        .transformWithStateInPandas(RatingProcessor(event_time, settings), OUT, "append", "eventTime")
    )
