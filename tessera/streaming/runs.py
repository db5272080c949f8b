"""Runs of logs as they are written: state of each log that outlives batches and restarts, replaced whole when a newer run begins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import logs

STATE = "markers long, unnamed long, run long, marker_line long, active boolean, records long, bad long, seen long, disorder boolean, lines array<bigint>, indices array<int>"
STATUS = "file string, status string, run long, marker_line long, records long, bad long, lines array<bigint>, seen long"
START = (0, 0, None, None, False, 0, 0, -1, False, [], [])


def run_states(lines: DataFrame, marker: str, record: str, world: int, count: int) -> DataFrame:
    """The rows of sources.logs.run_states for a stream of lines (file, line, value), a new row for a file whenever lines of it come; seen is its
    last marker or record, so of a file's rows the one that has seen most counts.

    A file's lines may be split between batches anywhere, but come in order: within a batch they are sorted, and a line that comes after a later
    one turns the file's status to "disorder" for good, as no state of bounded size could place it. The state holds the records of the newest
    run that matches, at most `count` of them; a run of more is broken and only counted.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        markers, unnamed, run, marker_line, active, records, bad, seen, disorder, kept, indices = state.get if state.exists else START
        kept, indices = list(kept), list(indices)
        rows = pd.concat(list(batches)).sort_values("line", kind="stable")
        for line, is_marker, w, c, index, reason in zip(*(rows[n].tolist() for n in ("line", "is_marker", "marker_world", "marker_count", "index", "reject_reason"))):
            disorder |= line <= seen
            seen = max(seen, line)
            if is_marker:
                markers += 1
                unnamed += isinstance(reason, str)
                active = w == str(world) and c == str(count)
                if active:
                    run, marker_line, records, bad, kept, indices = markers, line, 0, 0, [], []
            elif active:
                records += 1
                bad += isinstance(reason, str)
                if records <= count:
                    kept.append(line)
                    indices.append(-1 if pd.isna(index) else int(index))
                else:
                    kept, indices = [], []
        state.update((markers, unnamed, run, marker_line, bool(active), records, bad, seen, bool(disorder), kept, indices))
        whole = records == count == len(set(indices)) and not bad
        status = "disorder" if disorder else "marker" if unnamed else "none" if run is None else "whole" if whole else "broken"
        some = (None, None) if run is None else (records, bad)
        yield pd.DataFrame([(*key, status, run, marker_line, *some, kept if status == "whole" else [], seen)], columns=[f.split()[0] for f in STATUS.split(", ")])

    rows = logs.fields(lines, marker, record).select("file", "line", "is_marker", "marker_world", "marker_count", "index", "reject_reason")
    return rows.groupBy("file").applyInPandasWithState(follow, STATUS, STATE, "update", GroupStateTimeout.NoTimeout)
