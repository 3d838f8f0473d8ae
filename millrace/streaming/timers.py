"""Users who fall silent: keyed state in lists with event-time timers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

SILENCE, DELAY, KEEP = 6 * 3600, "1 hour", 3  # seconds; of the watermark; last events that are kept


class Silence(StatefulProcessor):
    """Visits of a key, each told once, when the watermark has passed its last row by the silence.

    State: a list of open visits, each with its last rows. A row joins the visits that it is within the silence of, which may make two
    into one, so rows may come in any order and in any batches. A key has one timer, for the visit that is over first, so that a
    batch reads and writes its state once, however many visits it has.
    """

    def __init__(self, silence: int, keep: int):
        self.silence, self.keep = silence * 1_000_000, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getListState("visits", "start long, last long, n long, ats array<long>, ids array<long>")

    def _due(self, last: int) -> int:
        """When a visit is over, in whole milliseconds, as timers have them."""
        return -(-(last + self.silence) // 1000)

    def _open(self) -> list:
        """(start, last, rows, last rows) of the visits in state."""
        return [(s, last, n, list(zip(ats, ids, strict=True))) for s, last, n, ats, ids in self.visits.get()]

    def _put(self, visits: list) -> None:
        if visits:
            self.visits.put([(s, last, n, [at for at, _ in rows], [i for _, i in rows]) for s, last, n, rows in visits])
        else:  # nothing of a silent user stays
            self.visits.clear()

    def _timer(self, before: list, visits: list) -> None:
        have, want = (min((self._due(v[1]) for v in x), default=None) for x in (before, visits))
        if have != want:
            if have is not None:
                self.handle.deleteTimer(have)
            if want is not None:
                self.handle.registerTimer(want)

    def handleInputRows(self, key, rows, timerValues):
        before = self._open()
        visits = before
        for pdf in rows:
            new = [(at, at, 1, [(at, own)]) for at, own in zip(pdf["at"].tolist(), pdf["id"].tolist(), strict=True)]
            met: list[list] = []
            for start, last, n, own in sorted([*visits, *new], key=lambda v: v[0]):
                if met and start <= met[-1][1] + self.silence:
                    met[-1][1:3] = max(met[-1][1], last), met[-1][2] + n
                    met[-1][3] += own
                else:
                    met.append([start, last, n, list(own)])
            visits = [(s, last, n, sorted(own)[-self.keep :]) for s, last, n, own in met]
        self._put(visits)
        self._timer(before, visits)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, visits = timerValues.getCurrentWatermarkInMs(), self._open()
        over = sorted(v for v in visits if self._due(v[1]) <= max(now - 1, expiredTimerInfo.getExpiryTimeInMs()))
        left = [v for v in visits if v not in over]
        self._put(left)
        self._timer([], left)  # Spark removes the timer that is over
        yield pd.DataFrame([(key[0], s, last, n, [i for _, i in own]) for s, last, n, own in over], columns=["key", "start", "last", "n", "ids"])

    def close(self) -> None:
        pass


def silent(s: DataFrame, key: str, time: str, row: str, silence: int = SILENCE, delay: str = DELAY, keep: int = KEEP) -> DataFrame:
    """key, start_ts, last_ts, n, last_ids of each visit of a stream once its key is silent for so many seconds, by the watermark.

    time is a timestamp, key and row whole numbers. Rows that come later than the watermark allows are dropped. Null keys are a key;
    rows with a null time tell nothing. State is a key's open visits, with `keep` rows of each at most.
    """
    ship(s.sparkSession)
    rows = s.withWatermark(time, delay).where(F.col(time).isNotNull()).select(F.col(key).alias("key"), time, F.unix_micros(time).alias("at"), F.col(row).alias("id"))
    out = rows.groupBy("key").transformWithStateInPandas(Silence(silence, keep), "key long, start long, last long, n long, ids array<long>", "Append", "EventTime")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select(F.col("key").alias(key), at("start").alias("start_ts"), at("last").alias("last_ts"), "n", F.col("ids").alias("last_ids"))
