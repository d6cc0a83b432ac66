"""A change feed of leaderboards, kept by event-time timers of a stateful Structured Streaming query.

Lines come in batches, by the day of their arrival. Their revenue is enriched once (`enriched`) and written by batch; a
batch's files are moved into the folder that the stream watches, and the query is started anew on one checkpoint for each
batch. Event time is the arrival day. A nation's items are dealt into `parts` by hash, and a part is a key of the state:
accepted deltas, added up within each task before they are shuffled, are buffered by arrival day under a timer for the
earliest of them. Once the watermark has passed it, the timer fires, and all complete days are folded into the running
revenues, ascending. A part then tells what changed among its ten best. The sink of each micro-batch merges, by nation, what
parts tell with the ten best that they had before, and writes the differences of the nation's boards beside the new best
under the number of the micro-batch: a batch that is tried again replaces what it wrote. A part tells at most 20 rows a day,
so a nation's task never sees a number of rows that grows with the lines. End sentinels, rows of a day beyond all others,
bring the last days to be flushed and are not part of any board.

Defined results: lines that were seen more than `delay` days before the latest one of all earlier batches are dropped;
lines without a nation or item are ignored, but count for that latest day; equal lines count each; batches without lines
are skipped; an empty table gives an empty feed; days are those since 1970 and not before it; other columns are ignored.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import arrow
from .graphs import spread
from .store import shared_dir

#: Places of a board, days that a line may be seen late, parts of a nation's items.
PLACES, DELAY, PARTS = 10, 3, 8
#: The sentinels' day, in the year 4840.
END = 1 << 20
_DAYS = 1 << 21
#: Distinct sums that one task holds before it hands them on.
HELD = 500_000
_DAY_MS = 86_400_000
_LINES = "seen bigint, day bigint, nation_id int, item_id bigint, cents bigint"
_STATE = "day binary, item_id binary, cents binary, ids binary, sums binary, best binary"
_LOCAL = "nation_id int, day bigint, item_id bigint, cents bigint, top boolean"
FEED = "nation_id int, arrival_day bigint, item_id bigint, batch int, change string, old_rank int, new_rank int, revenue bigint"


def enriched(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """Lines of the shop with batch, seen, day, nation_id, item_id and cents, signed; null where a line is to be ignored.

    The two lookups repeat what is known of a key, so that a hot key's lines go to several tasks; of rows of one vendor_id
    or item_id, the smallest nation_id and price count.
    """
    keys = ("sale_id", "item_id", "vendor_id", "line_no")
    h = F.crc32(F.concat_ws(",", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)))
    seen = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")).cast("bigint"), 19723 + F.col("h") % 150)
    day = F.col("seen") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    a = lines.withColumn("h", h).withColumn("seen", seen).withColumn("day", day)
    # Rows that are shuffled twice are packed: days and a bit of the hash in one number, revenue or quantity in another.
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    own = F.floor(100 * F.col("amount") + 0.5)
    packed = ((F.col("seen") * _DAYS + F.col("day")) * 16 + F.col("h") % 8 * 2 + own.isNull().cast("int")).alias("packed")
    a = a.select("vendor_id", "item_id", packed, (sign * F.coalesce(own, "quantity", F.lit(0))).cast("bigint").alias("base"))
    v = vendors.groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    i = items.groupBy("item_id").agg(F.min(F.floor(100 * F.col("price") + 0.5)).alias("price"), F.lit(True).alias("listed"))
    both = spread(spread(a, v.hint("merge"), "vendor_id", "packed", how="left").drop("vendor_id"), i.hint("merge"), "item_id", "packed", how="left")
    cents = F.when(F.col("packed") % 2 == 1, F.col("base") * F.coalesce("price", F.lit(0))).otherwise(F.col("base")).cast("bigint")
    both = both.withColumn("cents", F.when(F.col("listed") & F.col("nation_id").isNotNull(), cents)).withColumn("days", F.floor(F.col("packed") / 16))
    both = both.withColumn("day", F.pmod("days", F.lit(_DAYS))).withColumn("seen", F.floor(F.col("days") / _DAYS))
    batch = F.least(F.lit(10), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - 19723) * 10 / 180))).cast("int").alias("batch")
    return both.select(batch, "seen", "day", "nation_id", "item_id", "cents")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revenue of each nation, part, day and item, added up over this task's rows."""
    keys, held, n = ["nation_id", "part", "day", "item_id"], [], 0

    def done() -> Iterator[pa.RecordBatch]:
        if held:
            one = pa.concat_tables(held).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"])
            held[:] = [one]
            yield from one.to_batches()

    for batch in batches:
        held.append(pa.Table.from_batches([batch]).group_by(keys).aggregate([("cents", "sum")]).rename_columns([*keys, "cents"]))
        n += held[-1].num_rows
        if n > HELD:
            yield from done()
            held.clear()
            n = 0
    yield from done()


def _best(ids: np.ndarray, cents: np.ndarray, places: int) -> np.ndarray:
    """Indexes of the highest positive revenues, ties to the smaller id."""
    at = np.flatnonzero(cents > 0)
    if len(at) > places:
        at = at[cents[at] >= np.partition(cents[at], len(at) - places)[-places]]
    return at[np.lexsort((ids[at], -cents[at]))][:places]


def _ints(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int64)


def _part(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, places: int) -> Iterator[pd.DataFrame]:
    """Buffers deltas of one part of a nation's items by day; complete days are folded, ascending, and what changes among
    the best is told. A timer stands at the earliest day that is still open."""
    day, item, cents, ids, sums, best = map(_ints, state.get) if state.exists else [np.zeros(0, np.int64)] * 6
    new = [] if state.hasTimedOut else [f for f in frames if len(f)]
    day, item, cents = (np.concatenate([old, *(f[c].to_numpy(np.int64) for f in new)]) for c, old in (("day", day), ("item_id", item), ("cents", cents)))
    complete = day * _DAY_MS <= state.getCurrentWatermarkMs()
    told = []
    if complete.any():
        own, now_item, now_cents = day[complete], item[complete], cents[complete]
        day, item, cents = day[~complete], item[~complete], cents[~complete]
        every = np.union1d(ids, now_item)
        total = np.zeros(len(every), np.int64)
        total[np.searchsorted(every, ids)] = sums
        before = np.searchsorted(every, best)
        for d in np.unique(own):
            of = own == d
            was = total[before].copy()
            np.add.at(total, np.searchsorted(every, now_item[of]), now_cents[of])
            now = _best(every, total, places)
            changed = np.union1d(np.setxor1d(now, before), before[total[before] != was])
            told.append((np.full(len(changed), d), every[changed], total[changed], np.isin(changed, now)))
            before = now
        ids, sums, best = every, total, every[before]
    state.update(tuple(x.tobytes() for x in (day, item, cents, ids, sums, best)))
    if len(day):
        state.setTimeoutTimestamp(int(day.min()) * _DAY_MS - 1)  # it fires once the watermark is beyond it
    if told:
        d, i, c, top = (np.concatenate(x) for x in zip(*told))
        yield pd.DataFrame({"nation_id": pd.Series([key[0]] * len(d), dtype="int32"), "day": d, "item_id": i, "cents": c, "top": top})


def _boards(told: pd.DataFrame, places: int, first: int, width: float, batches: int) -> pd.DataFrame:
    """A nation's changes, day by day, and after them its parts' best: rows of FEED, the best without a day.

    told: what parts tell, and the best and the board of before as rows without a day.
    """
    before = told[told["day"].isna()]
    live = dict(zip(before["item_id"].tolist(), before["cents"].tolist()))
    placed = before[before["place"].notna()].sort_values("place")
    board, nation, out = placed["item_id"].tolist(), told["nation_id"].iloc[0], []
    for day, some in told[told["day"].notna()].groupby("day"):
        left = {}
        for item, c, top in zip(some["item_id"].tolist(), some["cents"].tolist(), some["top"].tolist()):
            live[item] = c
            if not top:
                left[item] = live.pop(item)
        now = sorted(live, key=lambda x: (-live[x], x))[:places]
        old_rank, new_rank = ({x: n for n, x in enumerate(b, 1)} for b in (board, now))
        batch = min(batches, max(1, 1 + int((day - first) // width)))
        for item in old_rank | new_rank:
            a, b = old_rank.get(item), new_rank.get(item)
            if a != b:
                out.append((nation, int(day), item, batch, "enter" if a is None else "exit" if b is None else "move", a, b, live[item] if item in live else left[item]))
        board = now
    rank = {x: n for n, x in enumerate(board, 1)}
    out += [(nation, None, item, None, None, None, rank.get(item), c) for item, c in live.items()]
    made = pd.DataFrame(out, columns=[c.split()[0] for c in FEED.split(", ")])
    return made.astype({"nation_id": "int32", "arrival_day": "Int64", "item_id": "int64", "batch": "Int32", "old_rank": "Int32", "new_rank": "Int32", "revenue": "int64"})


def _stream_session(spark: SparkSession, parts: str) -> SparkSession:
    """A session for the query: days are flushed by data (or sentinels), never by empty batches, and old states go soon."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", parts)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    own.conf.set("spark.sql.streaming.stateStore.minDeltasForSnapshot", "20")
    own.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "10s")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    return own


def _query(spark: SparkSession, feed: str, latest: int | None, places: int, delay: int, parts: int) -> DataFrame:
    """What parts tell of the files in the folder; latest: the last day that earlier batches saw."""
    lines = spark.readStream.schema(_LINES).parquet(feed)
    known = "nation_id IS NOT NULL AND item_id IS NOT NULL AND cents IS NOT NULL"
    lines = lines.filter(f"day = {END} OR {known}" if latest is None else f"day = {END} OR {known} AND seen + {delay} >= {latest}")
    lines = lines.select("nation_id", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int").alias("part"), "day", "item_id", "cents")
    lines = arrow.over(lines, _summed, "nation_id int, part int, day bigint, item_id bigint, cents bigint")
    lines = lines.withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400)).withWatermark("ts", "0 seconds").filter(f"day < {END}")
    own = lambda key, frames, state: _part(key, frames, state, places)
    return lines.groupBy("nation_id", "part").applyInPandasWithState(own, _LOCAL, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _merged(told: DataFrame, number: int, out: str, places: int, first: int, width: float, batches: int) -> None:
    """The sink: boards of micro-batch `number` from those of the one before."""
    told = told.select("nation_id", "day", "item_id", "cents", "top", F.lit(None).cast("int").alias("place"))
    if number:
        best = told.sparkSession.read.schema(FEED).parquet(f"{out}/{number - 1}").filter("arrival_day IS NULL")
        told = told.unionByName(best.select("nation_id", F.lit(None).cast("bigint").alias("day"), "item_id", F.col("revenue").alias("cents"), F.lit(True).alias("top"), F.col("new_rank").alias("place")))
    made = told.groupBy("nation_id").applyInPandas(lambda one: _boards(one, places, first, width, batches), FEED)
    made.write.mode("overwrite").parquet(f"{out}/{number}")


def changes(
    lines: DataFrame, batches: int = 10, first: int = 19723, width: float = 18.0, places: int = PLACES, delay: int = DELAY, parts: int = PARTS,
) -> DataFrame:
    """The feed of lines (batch, seen, day, nation_id, item_id, cents): FEED's columns.

    batch: 1 to `batches`, the days from `first` on cut into batches of `width` days, the last one open-ended.
    """
    spark = lines.sparkSession
    own = _stream_session(spark, spark.conf.get("spark.sql.shuffle.partitions"))
    root = f"{shared_dir(spark)}/barlane/feed-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    lines.write.partitionBy("batch").parquet(f"{root}/cut")
    most = {r.batch: r.seen for r in spark.read.schema(f"{_LINES}, batch int").parquet(f"{root}/cut").groupBy("batch").agg(F.max("seen").alias("seen")).collect()}  # a row for each batch
    ends = spark.range(1).select(F.lit(None).cast("bigint").alias("seen"), F.lit(END).cast("bigint").alias("day"), *(F.lit(None).cast(t).alias(c) for c, t in (("nation_id", "int"), ("item_id", "bigint"), ("cents", "bigint"))))
    ends.write.parquet(f"{root}/cut/batch={batches + 1}")
    files.mkdirs(path(f"{root}/lines"))
    latest = None
    for batch in sorted({*most, batches + 1}):
        files.rename(path(f"{root}/cut/batch={batch}"), path(f"{root}/lines/batch={batch}"))
        told = _query(own, f"{root}/lines/*", latest, places, delay, parts).writeStream.option("checkpointLocation", f"{root}/state").outputMode("append")
        told = told.foreachBatch(lambda df, number: _merged(df, number, f"{root}/changes", places, first, width, batches))
        told.trigger(availableNow=True).start().awaitTermination()
        if most.get(batch) is not None:
            latest = max(most[batch], most[batch] if latest is None else latest)
    for done in ("cut", "lines", "state"):
        files.delete(path(f"{root}/{done}"), True)
    return spark.read.schema(FEED).parquet(f"{root}/changes/*").filter("arrival_day IS NOT NULL")
