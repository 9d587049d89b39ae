"""Odometry over a stream of frames: the state of a sequence is its map, last poses and threshold sums."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.solvers import POSE_SCHEMA, Odometry, pose_row, xyz


def odometry_stream(points: DataFrame, seq: str = "seq_id", frame: str = "frame_id", **settings) -> DataFrame:
    """ST1-ST3: poses in append mode. A frame arrives whole within a micro-batch; frames go by number.

    The map is evicted by distance at each frame, so that state doesn't grow with time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else Odometry(**settings)
        rows = pd.concat(list(frames))
        out = [{seq: key[0], frame: f} | pose_row(now.register(xyz(part))) for f, part in rows.sort_values([frame, "pt_id"]).groupby(frame)]
        state.update((pickle.dumps(now),))
        yield pd.DataFrame(out)

    return points.select(seq, frame, "pt_id", "x", "y", "z").groupBy(seq).applyInPandasWithState(step, f"{seq} long, {frame} long, {POSE_SCHEMA}", "state binary", "append", GroupStateTimeout.NoTimeout)
