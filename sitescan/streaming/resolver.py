"""Per-URL state of a crawl: what is known until the URL is settled."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "attempts"
RECORD = ("attempt", "outcome", "terminal", "error", "status_code", "ts")
_RECORD_TYPE = "attempt int, outcome string, terminal boolean, error string, status_code int, ts timestamp"
# Of an open URL its deciding records; none for a settled URL.
_STATE_TYPE = f"records array<struct<{_RECORD_TYPE.replace(' ', ':').replace(',:', ',')}>>"
# Of a bucket its URLs, each with the time when it is settled or forgotten unless there is news.
_BUCKET_TYPE = f"urls array<struct<url:string,due:bigint,{_STATE_TYPE.replace('records array', 'records:array')}>>"
OUTPUT_TYPE = "url string, attempt int, outcome string, terminal boolean, error string, status_code int"


def resolver(max_attempts: int, timeout_s: int, keep_s: int, in_buckets: bool = False) -> StatefulProcessor:
    kind = BucketResolver if in_buckets else AttemptResolver
    return kind(max_attempts, timeout_s * 1000, keep_s * 1000)


class AttemptResolver(StatefulProcessor):
    """Keeps the deciding record of each attempt of an open URL, and a mark per settled URL.

    Attempts 1 to `max_attempts` have a slot each; lower numbers share slot 0, higher ones and
    missing ones the last slot. So an open URL holds `max_attempts` + 2 records at most, whatever
    its log looks like. Timers end all kinds of state, so it is bounded by the traffic of
    the two time spans.

    Every call of the state or of a timer is a round trip to the JVM, so a URL has one value, which is read
    once and written once, and only a URL that has one is asked for timers.
    """

    state_type = _STATE_TYPE

    def __init__(self, max_attempts, timeout_ms, keep_ms):
        self.max_attempts, self.timeout_ms, self.keep_ms = max_attempts, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState(STATE, self.state_type)

    def _slot(self, attempt):
        return self.max_attempts + 1 if attempt is None else min(max(attempt, 0), self.max_attempts + 1)

    def _order(self, record):
        """The same order as in batch: the smallest decides."""
        attempt, _, terminal, _, _, ts = record
        rank = 0 if attempt is None else attempt if terminal else self.max_attempts - attempt
        return attempt is None or attempt > self.max_attempts, attempt is None, not terminal, rank, ts.timestamp()

    def _take(self, best, record):
        """Puts the record into its slot if it decides there; tells whether it does."""
        slot = self._slot(record[0])
        decides = slot not in best or self._order(record) < self._order(best[slot])
        if decides:
            best[slot] = record
        return decides

    def _deciding(self, best):
        return min(best.values(), key=self._order) if len(best) > 1 else next(iter(best.values()))

    def _settles(self, best, record):
        allowed = record[0] is not None and record[0] <= self.max_attempts
        return allowed and (record[2] or all(n in best for n in range(1, self.max_attempts + 1)))

    def _verdict(self, url, record):
        attempt, outcome, terminal, error, status_code, _ = record
        return Row(url=url, attempt=attempt, outcome=outcome, terminal=terminal, error=error, status_code=status_code)

    def _set_timer(self, at_ms, known):
        for old in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at_ms))

    def _settle(self, key, now_ms, record, known=True):
        self.attempts.update(([],))
        self._set_timer(now_ms + self.keep_ms, known)
        yield self._verdict(key[0], record)

    def _known(self):
        """The records of an open URL, none for a settled one, None for a new one."""
        value = self.attempts.get()
        return None if value is None else [tuple(record) for record in value[0]]

    def handleInputRows(self, key, rows, timerValues):
        known = self._known()
        if known is not None and not known:
            return
        best = {self._slot(record[0]): record for record in known or ()}
        changed, newest = False, 0
        for row in rows:
            newest = max(newest, int(row["ts"].timestamp() * 1000))
            changed |= self._take(best, tuple(row[name] for name in RECORD))
        record = self._deciding(best)
        if self._settles(best, record):
            yield from self._settle(key, newest, record, known is not None)
        else:
            if changed:
                self.attempts.update((list(best.values()),))
            self._set_timer(newest + self.timeout_ms, known is not None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self._known()
        if known:
            yield from self._settle(key, expiredTimerInfo.getExpiryTimeInMs(), min(known, key=self._order))
        else:
            self.attempts.clear()

    def close(self) -> None:
        pass


class BucketResolver(AttemptResolver):
    """The same for a bucket of URLs at once, with one value and one timer, that of the URL that is due first.

    So the round trips to the JVM are those of the buckets a batch touches, however many URLs they hold. Of a row only
    `ts` and `said`, all the rest as JSON, are read: Spark converts each value of a row by itself, which costs more.
    """

    state_type = _BUCKET_TYPE

    def _read(self):
        """URL -> its due time, and its records by slot, none once it is settled."""
        value = self.attempts.get()
        urls = {}
        for url, due, records in value[0] if value is not None else ():
            urls[url] = due, {self._slot(record[0]): tuple(record) for record in records}
        return urls

    def _first_due(self, urls):
        return min((due for due, _ in urls.values()), default=None)

    def _write(self, urls, timer):
        """Stores the URLs; `timer` is the one that is still set."""
        if urls:
            self.attempts.update(([(url, due, list(best.values())) for url, (due, best) in urls.items()],))
        else:
            self.attempts.clear()
        first = self._first_due(urls)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues):
        urls = self._read()
        timer, newest, verdicts = self._first_due(urls), {}, []
        for row in rows:
            ts, said = row["ts"], json.loads(row["said"])
            url = said.get("url")
            if url not in urls:
                urls[url] = None, {}
            elif not urls[url][1]:
                # Settled: a new URL has a record by its second row.
                continue
            newest[url] = max(newest.get(url, 0), int(ts.timestamp() * 1000))
            self._take(urls[url][1], (*map(said.get, RECORD[:-1]), ts))
        if not newest:
            return
        for url, at in newest.items():
            best = urls[url][1]
            record = self._deciding(best)
            if self._settles(best, record):
                urls[url] = at + self.keep_ms, {}
                verdicts.append(self._verdict(url, record))
            else:
                urls[url] = at + self.timeout_ms, best
        self._write(urls, timer)
        yield from verdicts

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left, verdicts = {}, []
        for url, (due, best) in self._read().items():
            if best and due <= now:
                verdicts.append(self._verdict(url, self._deciding(best)))
                due, best = due + self.keep_ms, {}
            if due > now:
                left[url] = due, best
        # The timer that has expired is gone by itself.
        self._write(left, None)
        yield from verdicts
