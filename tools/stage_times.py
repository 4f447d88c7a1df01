"""Slowest stages of a Spark event log (plain or zstd), e.g. one written by
``SIFTWISE_EVENT_LOG=<dir> python bench.py``.

Usage: python tools/stage_times.py <event log file or folder> [top_n]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) if os.path.isdir(path) else [path]
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as r:
                raw = r.read()
        yield from raw.decode("utf-8").splitlines()


def main() -> None:
    path, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 10
    stages = {}
    for line in lines(path):
        try:
            e = json.loads(line)
        except json.JSONDecodeError:      # a log still being written can end mid-line
            continue
        if e.get("Event") == "SparkListenerStageCompleted":
            i = e["Stage Info"]
            stages[i["Stage ID"]] = (i.get("Completion Time", 0) - i.get("Submission Time", 0),
                                     i["Number of Tasks"], i["Stage Name"][:70])
    print(f"{len(stages)} stages, {sum(v[0] for v in stages.values()) / 1000:.1f} s in total")
    for sid, (ms, tasks, name) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        print(f"stage {sid:5d} {ms / 1000:7.2f} s {tasks:5d} tasks  {name}")


if __name__ == "__main__":
    main()
