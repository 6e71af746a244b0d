"""What a store of evidence holds: a bounded number of videos, of which the one put least recently goes.

One state machine for tables and streams. A store's operations are applied in order of ``seq``: a put (which
renews its video; reading does not), the clearing of a video, or of all. It says what each operation changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VIDEOS = 16
#: An operation: ``put``, ``clear`` (of ``video_id``) or ``clear_all``.
OPERATIONS = "store string, seq long, op string, video_id string, stage_id string, payload string"
#: A change: ``put``, ``evict`` or ``clear`` of a stage's payload.
CHANGES = "store string, seq long, change string, video_id string, stage_id string, payload string"
_NAMES = ["store", "seq", "change", "video_id", "stage_id", "payload"]


class Shelf:
    """Videos in order of their last put, each with its stages' payloads."""

    def __init__(self, most: int, held: dict[str, dict[str, str]] | None = None) -> None:
        self.most, self.held = most, held or {}

    def apply(self, seq: int, op: str, video: str | None, stage: str | None, payload: str | None) -> Iterator[tuple]:
        """The changes (seq, change, video, stage, payload) that an operation makes; unknown ones make none."""
        if op == "put" and video is not None and stage is not None:
            stages = self.held.pop(video, {})
            stages[stage] = payload
            self.held[video] = stages
            yield seq, "put", video, stage, payload
            while len(self.held) > self.most:
                oldest = next(iter(self.held))
                yield from self._dropped(seq, "evict", oldest)
        elif op == "clear" and video in self.held:
            yield from self._dropped(seq, "clear", video)
        elif op == "clear_all":
            for v in list(self.held):
                yield from self._dropped(seq, "clear", v)

    def _dropped(self, seq: int, change: str, video: str) -> Iterator[tuple]:
        for stage, payload in sorted(self.held.pop(video).items()):
            yield seq, change, video, stage, payload


def changes(operations: DataFrame, most: int = VIDEOS) -> DataFrame:
    """The changes of a table of operations. A task folds its stores in order, holding one shelf at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, shelf = None, Shelf(most)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["store"] != store:
                    store, shelf = r["store"], Shelf(most)
                out += ((store, *c) for c in shelf.apply(r["seq"], r["op"], r["video_id"], r["stage_id"], r["payload"]))
            columns = list(zip(*out)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "seq" else pa.string()) for n, c in zip(_NAMES, columns)], _NAMES)

    rows = operations.select("store", "seq", "op", "video_id", "stage_id", "payload").where("store IS NOT NULL AND seq IS NOT NULL")
    return rows.repartition("store").sortWithinPartitions("store", "seq").mapInArrow(run, CHANGES)


class KeyedShelf(StatefulProcessor):
    """A store's shelf as keyed state: the last put of each video, and each stage's payload."""

    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = handle.getMapState("order", "video_id string", "place long")
        self.held = handle.getMapState("held", "video_id string, stage_id string", "payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        videos = sorted(((place[0], video[0]) for video, place in self.order.iterator()))
        held: dict[str, dict[str, str]] = {v: {} for _, v in videos}
        for (video, stage), payload in self.held.iterator():
            held[video][stage] = payload[0]
        before = {v: dict(s) for v, s in held.items()}
        shelf = Shelf(self.most, held)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            given = (None if pd.isna(x) else x for x in (r.video_id, r.stage_id, r.payload))
            out += ((key[0], *c) for c in shelf.apply(int(r.seq), r.op, *given))
        for video, stages in before.items():
            if video not in shelf.held:
                self.order.removeKey((video,))
            for stage in stages:
                if stage not in shelf.held.get(video, ()):
                    self.held.removeKey((video, stage))
        for place, (video, stages) in enumerate(shelf.held.items()):
            self.order.updateValue((video,), (place,))
            for stage, payload in stages.items():
                if stage not in before.get(video, ()) or before[video][stage] != payload:
                    self.held.updateValue((video, stage), (payload,))
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def streamed_changes(operations: DataFrame, most: int = VIDEOS) -> DataFrame:
    """The changes of a stream of operations, in order of ``seq`` within a batch and of arrival between batches.

    Needs the RocksDB state store: set ``spark.sql.streaming.stateStore.providerClass`` (see ``ROCKS``)."""
    rows = operations.select("store", "seq", "op", "video_id", "stage_id", "payload").where("store IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("store").transformWithStateInPandas(KeyedShelf(most), outputStructType=CHANGES, outputMode="Append", timeMode="None")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def contents(changed: DataFrame) -> DataFrame:
    """``store, video_id, stage_id, seq, payload``: what the stores hold after all changes. A stage's last change
    counts; in one operation a put comes before the evictions it causes."""
    order = F.struct("seq", F.col("change") != "put")
    last = changed.groupBy("store", "video_id", "stage_id").agg(F.max_by(F.struct("change", "seq", "payload"), order).alias("c"))
    return last.where("c.change = 'put'").select("store", "video_id", "stage_id", "c.seq", "c.payload")
