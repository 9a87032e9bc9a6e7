"""Streams of bytes that arrive in chunks, as records: what is cut over chunks comes together in state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gemello.sources.records import MAX_RECORD

OUT = "stream string, seq long, line string, problem string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Records(StatefulProcessor):
    """Lines of one stream. State: chunks that came before an earlier one (map), pieces of the line that isn't ended (list), and counters (value).

    A timer is set anew with later chunks of a stream that hasn't ended; when the watermark has reached it, the stream is given up as incomplete.
    """

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "n long", "bytes binary")
        self.pieces = handle.getListState("pieces", "bytes binary")
        self.at = handle.getValueState("at", "next long, seq long, held long, done boolean, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  named by Spark
        stream = key[0]
        next_, seq, held, done, over = self.at.get() if self.at.exists() else (0, 0, 0, False, False)
        arrived, latest = {}, 0
        for r in rows:
            latest = max(latest, int(r.at.timestamp() * 1000))
            if not over and r.n >= next_:
                arrived.setdefault(r.n, r.bytes)  # a chunk that comes again says the same
        for n, b in arrived.items():
            if n != next_ and n not in self._run(next_, arrived):
                self.early.updateValue((n,), (b,))
        tail: list[bytes] = []
        fresh = held == 0
        while not over:
            if next_ in arrived:
                chunk = arrived[next_]
            elif self.early.containsKey((next_,)):
                chunk = self.early.getValue((next_,))[0]
                self.early.removeKey((next_,))
            else:
                break
            next_ += 1
            lines = [b""] if chunk is None else bytes(chunk).split(b"\n")
            for k, piece in enumerate(lines):
                last = k == len(lines) - 1
                tail.append(piece)
                held += len(piece)
                if held > self.most:
                    yield Row(stream=stream, seq=seq, line=None, problem="record too long")
                    over = True
                    break
                if not last or chunk is None:
                    before = [] if fresh else [bytes(p[0]) for p in self.pieces.get()]
                    line = b"".join([*before, *tail])
                    tail, held, fresh = [], 0, True
                    self.pieces.clear()
                    if line.strip():
                        row, kind = self._record(stream, seq, line)
                        done |= kind == "complete"
                        over = row.problem is not None
                        seq += 1
                        yield row
                        if over:
                            break
            if chunk is None and not over:
                if not done:
                    yield Row(stream=stream, seq=seq, line=None, problem="incomplete")
                over = True
        if over:
            self.early.clear()
            self.pieces.clear()
            held = 0
        elif tail:
            for p in tail:
                if p:
                    self.pieces.appendValue((p,))
        self.at.update((next_, seq, held, done, over))
        timers = list(self.handle.listTimers())
        for t in timers:
            self.handle.deleteTimer(t)
        if not over:
            self.handle.registerTimer(max([latest, timerValues.getCurrentWatermarkInMs() + 1, *timers]))

    @staticmethod
    def _run(next_: int, arrived: dict) -> range:
        """The chunks from next_ on that are all there."""
        end = next_
        while end in arrived:
            end += 1
        return range(next_, end)

    @staticmethod
    def _record(stream: str, seq: int, line: bytes) -> tuple[Row, str | None]:
        """The row of a line and its record's type; what is no JSON object ends the stream."""
        try:
            record = json.loads(line.decode())
        except ValueError:
            record = None
        if not isinstance(record, dict):
            return Row(stream=stream, seq=seq, line=None, problem="invalid record"), None
        return Row(stream=stream, seq=seq, line=line.decode(), problem=None), record.get("type")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        next_, seq, held, done, over = self.at.get() if self.at.exists() else (0, 0, 0, False, False)
        if not over:
            yield Row(stream=key[0], seq=seq, line=None, problem="incomplete")
        self.early.clear()
        self.pieces.clear()
        self.at.update((next_, seq, 0, done, True))

    def close(self) -> None:
        pass


def records(chunks: DataFrame, patience: str = "10 minutes", most: int = MAX_RECORD) -> DataFrame:
    """(stream, seq, line, problem) of a stream of chunks (stream, n, bytes, at): lines numbered from 0, or why there are no more.

    n numbers a stream's chunks from 0, null bytes end it, at is when a chunk was sent. Chunks may come in any order and more than once. A stream that
    ends without a complete record, or whose last chunk is older than the latest of any stream by the patience, is incomplete; a line beyond
    the bound, or that is no JSON object in UTF-8, ends it too. Needs the RocksDB state store.
    """
    timed = chunks.select("stream", "n", "bytes", "at").withWatermark("at", patience)
    return timed.groupBy("stream").transformWithState(Records(most), OUT, "Append", "EventTime")


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream with state over what is there, appending to Parquet files."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)
