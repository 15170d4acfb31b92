"""The trackers over streams: a state a scene or camera, whose rows are gone through in order of event time."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.groups import Columns, as_numpy
from ..operators.track import ImageSettings, Settings, image_columns, track_images_on, track_on, tracking_columns

#: The columns of some rows and what is remembered of earlier ones -> results, and what to remember.
Advance = Callable[[Columns, Any], tuple[Columns, Any]]


def in_event_time(rows: DataFrame, keys: list[str], order: list[str], used: list[str], t: str, lateness: str, idle_ms: int, advance: Advance, start: Any, schema: str) -> DataFrame:
    """What ``advance`` gives for a stream of rows that come in any order within the lateness.

    ``t`` is the event time; rows that ``advance`` must see together have the same. Rows wait in the state of
    their keys until the watermark has passed them, and go on in order; later ones are dropped by the watermark.
    A state holds what waits and what is remembered, and ends when its keys were silent for ``idle_ms`` of event time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, memory, last = pickle.loads(state.get[0]) if state.exists else (None, start, 0)
        timed_out = state.hasTimedOut
        frames = ([held] if held is not None else []) + ([] if timed_out else list(parts))
        mark = state.getCurrentWatermarkMs()
        waiting = pd.concat(frames, ignore_index=True) if frames else None
        if waiting is not None:
            at = waiting["__t"].to_numpy()
            last = max(last, int(at.max()) // 1000)
            ready = waiting[at <= mark * 1000].sort_values(order, kind="stable", ignore_index=True)
            waiting = waiting[at > mark * 1000].reset_index(drop=True)
            waiting = waiting if len(waiting) else None
            if len(ready):
                out, memory = advance({c: as_numpy(pa.array(ready[c], from_pandas=True)) for c in used}, memory)
                yield pd.DataFrame({k: v.tolist() if v.dtype == object else v for k, v in out.items()})
        if waiting is None and timed_out and mark >= last + idle_ms:
            state.remove()
            return
        state.update((pickle.dumps((waiting, memory, last)),))
        due = int(waiting["__t"].min()) // 1000 + 1 if waiting is not None else last + idle_ms
        state.setTimeoutTimestamp(max(due, mark + 1))

    read = rows.withWatermark(t, lateness).select(*used, F.col(t), F.unix_micros(t).alias("__t"))
    return read.groupBy(*keys).applyInPandasWithState(step, schema, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)


def tracked_stream(detections: DataFrame, scene: list[str], t: str, lateness: str, idle_ms: int = 600_000, settings: Settings = Settings()) -> DataFrame:
    """What operators.track.tracked() gives, by in_event_time(); ``stable`` tells whether a track has enough hits by then."""
    keep, used, schema = tracking_columns(detections, scene)

    def advance(g: Columns, memory: Any) -> tuple[Columns, Any]:
        out, tracks, number = track_on(g, settings, *memory)
        out["stable"] = out["hits"] >= settings.stable_hits
        return {**{k: g[k] for k in keep}, **out}, ([x for x in tracks if not x.dead], number)

    return in_event_time(detections, scene, ["keyframe", "index"], used, t, lateness, idle_ms, advance, ([], 0), schema)


def tracked_images_stream(boxes: DataFrame, keys: list[str], t: str, lateness: str, idle_ms: int = 600_000, settings: ImageSettings = ImageSettings()) -> DataFrame:
    """What operators.track.tracked_images() gives, by in_event_time()."""
    used, schema = image_columns(boxes, keys)

    def advance(g: Columns, memory: Any) -> tuple[Columns, Any]:
        out, *memory = track_images_on(g, settings, *memory)
        return {**{k: np.repeat(g[k][:1], len(out["frame"])) for k in keys}, **out}, tuple(memory)

    return in_event_time(boxes, keys, ["frame", "index"], used, t, lateness, idle_ms, advance, ([], 0), schema)
