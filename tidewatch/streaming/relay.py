"""Datagrams to a shared folder, and that folder as a stream.

A relay runs beside each receiver, outside Spark: it stamps datagrams on arrival and writes what came every second as one Parquet file. Spark reads
the folder with its file source, so lines go from the files to the executors and never through the driver, a batch that is
repeated reads the same lines, and any number of relays writes side by side.

Between socket and file lies a queue of ``most`` lines. What doesn't fit is counted, not lost unnoticed: the next line that fits is preceded by a row
with the code SOURCE_OVERFLOW, the time since the first loss and the number of lines, and begins a new ``session``, which cuts the
intervals that reach over the gap (they aren't losses of radio). A pause does the same with LIVE_PAUSE, a restart by its new session.
"""

from __future__ import annotations

import os
import queue
import socket
import threading
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORT, LARGEST, MOST = 17020, 65_535, 8192
SCHEMA = "received_ns bigint, sequence bigint, source_id string, session bigint, sentence string, code string, start_ns bigint, dropped bigint"
_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (c.split() for c in SCHEMA.split(", "))])


class Relay:
    """``folder`` is a path that this machine can write and Spark can read, such as a mounted one."""

    def __init__(self, folder: str, source_id: str = "udp", host: str = "127.0.0.1", port: int = PORT, most: int = MOST, every_s: float = 1.0, clock=time.time_ns):
        self.folder, self.source_id, self.address, self.every_s, self.clock = folder, source_id, (host, port), every_s, clock
        self.queue: queue.Queue = queue.Queue(most)
        self.session = clock()
        self.sequence = self.files = self.dropped = self.lost_since = 0
        self.paused_at: int | None = None
        self.lock, self.over = threading.Lock(), threading.Event()
        self.threads: list[threading.Thread] = []
        os.makedirs(folder, exist_ok=True)

    def _row(self, ns: int, sentence: str | None, code: str | None = None, start_ns: int | None = None, dropped: int | None = None) -> tuple:
        self.sequence += 1
        return ns, self.sequence, self.source_id, self.session, sentence, code, start_ns, dropped

    def _close_gap(self, ns: int) -> None:
        self.session += 1
        self.queue.put_nowait(self._row(ns, None, "SOURCE_OVERFLOW", self.lost_since, self.dropped))
        self.dropped = 0

    def offer(self, ns: int, sentence: str) -> bool:
        """Take a line; False if there is no room, or while paused."""
        with self.lock:
            if self.paused_at is not None:
                return False
            if self.queue.maxsize - self.queue.qsize() < (2 if self.dropped else 1):
                if not self.dropped:
                    self.lost_since = ns
                self.dropped += 1
                return False
            if self.dropped:
                self._close_gap(max(ns, self.lost_since))
            self.queue.put_nowait(self._row(ns, sentence))
            return True

    def datagram(self, data: bytes) -> None:
        now = self.clock()
        for line in data.decode("utf-8", "replace").splitlines():
            if line.strip():
                self.offer(now, line.strip())

    def pause(self) -> None:
        with self.lock:
            self.paused_at = self.clock()

    def resume(self) -> None:
        with self.lock:
            if self.paused_at is not None:
                self.session += 1
                row = self._row(self.clock(), None, "LIVE_PAUSE", self.paused_at, 0)
                self.paused_at = None
        self._write([*self._taken(), row])

    def _taken(self) -> list[tuple]:
        rows = []
        while True:
            try:
                rows.append(self.queue.get_nowait())
            except queue.Empty:
                return rows

    def _write(self, rows: list[tuple]) -> None:
        if not rows:
            return
        self.files += 1
        name = f"{self.source_id}-{rows[0][3]}-{self.files:09d}.parquet"
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW), f"{self.folder}/.{name}")
        os.replace(f"{self.folder}/.{name}", f"{self.folder}/{name}")  # readers see whole files only

    def drain(self) -> None:
        """Write what has come."""
        self._write(self._taken())

    def _listen(self) -> None:
        while not self.over.is_set():
            try:
                self.datagram(self.socket.recv(LARGEST))
            except TimeoutError:
                continue

    def _keep_writing(self) -> None:
        while not self.over.wait(self.every_s):
            self.drain()

    def start(self) -> Relay:
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind(self.address)
        self.socket.settimeout(0.2)
        self.threads = [threading.Thread(target=f, daemon=True) for f in (self._listen, self._keep_writing)]
        for t in self.threads:
            t.start()
        return self

    def stop(self) -> None:
        """End, and write what is left; lines that were lost last get their row."""
        self.over.set()
        for t in self.threads:
            t.join()
        if self.threads:
            self.socket.close()
        self.drain()
        with self.lock:
            if self.dropped:
                self._close_gap(self.clock())
        self.drain()


def read_relays(spark: SparkSession, folder: str) -> DataFrame:
    """The lines and control rows of all relays as a stream, for ``live_outcomes``."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def exclusion_periods(rows: DataFrame) -> DataFrame:
    """Stretches that count for nothing: what the source lost, and pauses."""
    return rows.where("code IN ('SOURCE_OVERFLOW', 'LIVE_PAUSE')").select("source_id", "code", "start_ns", F.col("received_ns").alias("end_ns"), "dropped")


def frame(outcomes: DataFrame) -> DataFrame:
    """One row for a micro-batch of ``live_outcomes``: what was decoded, repeated and diagnosed, and the records of the last second of arrival."""
    newest = outcomes.agg(F.max("received_ns").alias("newest_ns"))
    df = outcomes.join(F.broadcast(newest))  # one row
    done = F.col("code").isNull()
    return df.agg(F.count("*").alias("outcomes"), F.count_if(done).alias("decoded"), F.count_if(F.col("code") == "DUPLICATE").alias("duplicates"), F.count_if(~done).alias("diagnostics"), F.count_if(F.col("received_ns") >= F.col("newest_ns") - 1_000_000_000).alias("last_second"), F.max("newest_ns").alias("newest_ns"))
