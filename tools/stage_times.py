"""Summarise job and stage durations from a Spark event log folder."""

import glob
import json
import os
import sys


def main(d):
    files = [f for f in glob.glob(os.path.join(d, "**", "*"), recursive=True) if os.path.isfile(f)]
    stages, jobs = {}, {}
    for f in sorted(files):
        if f.endswith(".zstd"):
            import io
            import zstandard
            with open(f, "rb") as fh:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), errors="replace").read()
            lines = text.splitlines()
        else:
            lines = open(f, errors="replace").read().splitlines()
        for line in lines:
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if not isinstance(e, dict):
                continue
            ev = e.get("Event")
            if ev == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                stages[si["Stage ID"]] = (si["Stage Name"][:50], si["Number of Tasks"],
                                          round((si["Completion Time"] - si["Submission Time"]) / 1000, 2))
            elif ev == "SparkListenerJobStart":
                jobs[e["Job ID"]] = [e["Submission Time"], e.get("Stage IDs", [])]
            elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
                jobs[e["Job ID"]].append(e["Completion Time"])
    for j, v in sorted(jobs.items()):
        if len(v) == 3:
            print("job", j, round((v[2] - v[0]) / 1000, 2), [stages[s] for s in v[1] if s in stages])


if __name__ == "__main__":
    main(sys.argv[1])
