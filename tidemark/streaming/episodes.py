"""Episodes of a keyed stream, closed by timers, each with its pool of members against the pool before it.

State is kept by RocksDB for blocks of keys, as a call into it costs more than the rows it is for: one value with the spans still open (key, start,
end, rows, members) and the timer that stands, and one with the pools of the keys' last closed episodes. A row joins the spans within `gap` of it, and
joins two of them where it lies between. When event time passes one gap after a span's end no row can reach the span any more, and it is put out with
what entered, left and stayed since the one before: with the block's rows of that batch, or by the block's timer where it has none.
"""

from __future__ import annotations

import time as clock
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key long, start_us long, end_us long, n long, members long, entered long, departed long, retained long, comparable boolean"
#: Blocks that keys are dealt to: calls into the state grow with them and not with the keys.
BLOCKS = 4096
Span = tuple[int, int, int, set[int]]
_ROW = Row(*[x.split()[0] for x in OUT.split(", ")])


def on_rocks(spark: SparkSession) -> SparkSession:
    """Streams started from here on keep their state in RocksDB, which states of several variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def joined(spans: list[Span], gap: int) -> list[Span]:
    """Spans (start, end, rows, members) by start; those no more than the gap apart are one. Their sets may be changed."""
    out: list[Span] = []
    for start, end, n, members in sorted(spans, key=lambda x: x[0]):
        if out and start - out[-1][1] <= gap:
            first, last, m, known = out[-1]
            known |= members
            out[-1] = (first, max(last, end), m + n, known)
        else:
            out.append((start, end, n, members))
    return out


class Episodes(StatefulProcessor):
    """Takes rows (block, key, us, member). ttl_ms: how long, by the clock on the wall, a pool without a successor is kept; None is for ever."""

    def __init__(self, gap_us: int, ttl_ms: int | None = None) -> None:
        self.gap, self.ttl = gap_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "key array<long>, start array<long>, end array<long>, n array<long>, members array<array<long>>, timer long")
        self.pools = handle.getValueState("pools", "key array<long>, until array<long>, members array<array<long>>", self.ttl)

    def _timer(self, end: int) -> int:
        # A row one gap after the end still joins; the first millisecond beyond it doesn't.
        return (end + self.gap) // 1000 + 1

    def _spans(self) -> tuple[dict[int | None, list[Span]], int | None]:
        """Open spans of each key, and the timer that stands."""
        out: dict[int | None, list[Span]] = defaultdict(list)
        if (held := self.open.get()) is None:
            return out, None
        for key, start, end, n, members in zip(*held[:5]):
            out[key].append((start, end, n, set(members)))
        return out, held[5]

    def _closed(self, spans: dict[int | None, list[Span]], stands: int | None, now: int) -> list[Row]:
        """Rows of the spans that no row can reach any more; the others are kept, with a timer no later than the first of them needs."""
        done = [(key, x) for key, own in spans.items() for x in own if self._timer(x[1]) <= now]
        left = [(key, *x) for key, own in spans.items() for x in own if self._timer(x[1]) > now]
        out = self._put_out(done) if done else []
        wanted = min((self._timer(x[2]) for x in left), default=None)
        # One that comes too early finds nothing to close and sets the next: cheaper than moving it with every batch.
        if stands is not None and (wanted is None or not now < stands <= wanted):
            self.handle.deleteTimer(stands)
            stands = None
        if stands is None and wanted is not None:
            self.handle.registerTimer(wanted)
            stands = wanted
        if left:
            *columns, members = zip(*left)
            self.open.update((*map(list, columns), [list(x) for x in members], stands))
        else:
            self.open.clear()
        return out

    def _put_out(self, done: list[tuple[int | None, Span]]) -> list[Row]:
        """Closed spans, those of a key by their start, beside the key's pool, which each replaces."""
        out, wall = [], clock.time_ns() // 1_000_000
        held = self.pools.get()
        pools = {} if held is None else {key: (until, members) for key, until, members in zip(*held) if until is None or until > wall}
        for key, (start, end, n, mine) in done:
            known = key in pools
            before = set(pools[key][1]) if known else set()
            stayed = len(mine & before)
            out.append(_ROW(key, start, end, n, len(mine), len(mine) - stayed, len(before) - stayed, stayed, known))
            pools[key] = (None if self.ttl is None else wall + self.ttl, mine)
        self.pools.update((list(pools), [x for x, _ in pools.values()], [list(x) for _, x in pools.values()]))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        spans, stands = self._spans()
        fresh: dict[int | None, list[Span]] = defaultdict(list)
        most: dict[int | None, int] = {}
        for row in rows:
            who, us, member = row[1], row[2], row[3]
            own = fresh[who]
            # Rows mostly come near the one before: they lengthen its span, so that a key's rows are not held.
            if own and own[-1][0] - self.gap <= us <= own[-1][1] + self.gap:
                start, end, n, mine = own[-1]
                own[-1] = (min(start, us), max(end, us), n + 1, mine)
            else:
                if len(own) >= most.get(who, 1024):
                    own[:] = joined(own, self.gap)
                    most[who] = max(1024, 2 * len(own))
                mine = set()
                own.append((us, us, 1, mine))
            if member is not None:
                mine.add(member)
        for who, own in fresh.items():
            spans[who] = joined(spans[who] + own, self.gap)
        return iter(self._closed(spans, stands, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        spans, _ = self._spans()
        # The timer that came is no longer there to be deleted.
        return iter(self._closed(spans, None, timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, key: str, time: str, member: str, gap_us: int, ttl_ms: int | None = None) -> DataFrame:
    """OUT rows, one a closed episode: rows of a key no more than the gap apart. Needs a watermark on `time`; rows beyond it are late and left out.

    Null keys are a key of their own; a null member counts as a row and is in no pool. Without a pool before it an episode is not comparable, and
    all its members have entered. State grows with the open spans and the members of these and of one pool a key; a block's state is in memory while its
    rows are worked on, and written anew with each batch that has rows for it.
    """
    on_rocks(stream.sparkSession)
    who = F.col(key).cast("long")
    rows = stream.select(F.pmod(F.xxhash64(who), F.lit(BLOCKS)).alias("block"), who.alias("key"), F.unix_micros(time).alias("us"), F.col(member).cast("long").alias("member"), F.col(time))
    return rows.groupBy("block").transformWithState(Episodes(gap_us, ttl_ms), OUT, "Append", "EventTime")
