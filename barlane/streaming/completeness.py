"""A stream of transcripts: a match comes out once all of its rounds are there for both sides.

The state of a match is a map from round and side to the newest text, so a text that comes again replaces one entry. A timer
KEEP_DAYS of event time after the newest text forgets the match, whether it came out or not.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_OUT = "match_id bigint, round int, side string, text string"
#: Texts may come in so late; a match whose texts are all older is forgotten, whether it came out or not.
KEEP_DAYS = 7
_DAY_MS = 86_400_000
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Has the session's streams keep state where maps and timers are known."""
    spark.conf.set(_STORE, _ROCKS)


class Collect(StatefulProcessor):
    """Keeps the text of each round and side that was created last; what comes after the match is complete is ignored."""

    def init(self, handle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "round int, side string", "text string, at bigint")
        self.match = handle.getValueState("match", "total int, newest bigint, due bigint, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, newest, due, done = self.match.get() if self.match.exists() else (0, 0, 0, False)
        for part in rows:
            if not len(part):
                continue
            newest = max(newest, int(part["at"].max()))
            if done:
                continue
            total = max(total, int(part["total_rounds"].max()))
            for r in part.sort_values("at", kind="stable").drop_duplicates(["round", "side"], keep="last").itertuples(index=False):
                own = (int(r.round), r.side)
                old = self.texts.getValue(own)
                if old is None or r.at >= old[1]:
                    self.texts.updateValue(own, (r.text, int(r.at)))
        if not done and total:
            have = sorted((*k, v[0]) for k, v in self.texts.iterator() if 1 <= k[0] <= total)
            if len(have) >= 2 * total:
                done = True
                self.texts.clear()
                yield pd.DataFrame([(key[0], *h) for h in have], columns=["match_id", "round", "side", "text"]).astype({"match_id": "int64", "round": "int32"})
        end = max(newest // 1000, timerValues.getCurrentWatermarkInMs()) + KEEP_DAYS * _DAY_MS
        if end != due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(end)
        self.match.update((total, newest, end, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.texts.clear()
        self.match.clear()
        return iter([])

    def close(self) -> None:
        pass


def complete_matches(stream: DataFrame) -> DataFrame:
    """stream: match_id, round, side, text, created, total_rounds. Rows of matches as they become complete.

    A text counts by when it was created, not by when it arrives; rows without a value in any column are left out. Sets the
    state store of the stream's session (`with_state`).
    """
    with_state(stream.sparkSession)
    own = stream.dropna().withWatermark("created", f"{KEEP_DAYS} days")
    own = own.select("match_id", "round", "side", "text", "created", F.unix_micros("created").alias("at"), "total_rounds")
    return own.groupBy("match_id").transformWithStateInPandas(Collect(), _OUT, "Append", "EventTime")
