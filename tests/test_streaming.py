"""Logs as streams: appended once, replayed without repeats."""

import json
import os
import shutil

from quillon.operators import governance
from quillon.streaming import logs


def record(n, kind="quality", outcome="passed", time="2024-01-01T00:00:00Z", summary="fine"):
    return json.dumps({"review_id": f"rev-{n}", "kind": kind, "reviewed_at": time, "outcome": outcome, "summary": summary})


def write(folder, name, *lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


SCHEMA = "review_id string, kind string, reviewed_at string, outcome string, summary string"


def test_a_replayed_batch_leaves_each_record_once(spark, tmp_path):
    inbox, out, refused, state = (f"{tmp_path}/{x}" for x in ("in", "out", "refused", "state"))
    run = lambda: logs.append_log(logs.lines_stream(spark, inbox), out, refused, state).awaitTermination()
    ids = lambda: sorted(r.review_id for r in logs.held(spark, out, SCHEMA).collect())
    write(inbox, "a.jsonl", record(1), record(2, kind="cleaning"), record(1, outcome="failed"), "{broken", record(3, outcome="maybe"), "")
    run()
    assert ids() == ["rev-1", "rev-2"]
    write(inbox, "b.jsonl", record(2), record(4))
    run()
    assert ids() == ["rev-1", "rev-2", "rev-4"]
    # the driver dies before the second batch is committed: it runs again
    for f in os.listdir(f"{state}/commits"):
        if f.strip(".").split(".")[0] == "1":
            os.remove(f"{state}/commits/{f}")
    run()
    assert ids() == ["rev-1", "rev-2", "rev-4"]
    # and once more after half of it was written
    shutil.rmtree(f"{out}/batch=1")
    for f in os.listdir(f"{state}/commits"):
        if f.strip(".").split(".")[0] == "1":
            os.remove(f"{state}/commits/{f}")
    run()
    assert ids() == ["rev-1", "rev-2", "rev-4"]
    problems = sorted(r.problems for r in spark.read.parquet(refused).collect())
    assert problems == ["bad-outcome", "duplicate-id", "duplicate-id", "invalid-line"]


def test_the_latest_review_follows_the_stream(spark, tmp_path):
    inbox, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    schema = "collection string, kind string, reviewed_at string, review_id long, outcome string"
    rows = [("a", "quality", "2024-01-01", 1, "passed"), ("a", "quality", "2024-03-01", 2, "failed"), ("b", "cleaning", "2024-01-05", 3, "passed"), ("a", "quality", "2024-03-01", 4, "passed"), ("a", "cleaning", "2024-02-01", 5, "findings"), ("b", "cleaning", "2024-01-01", 6, "failed")]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], schema).coalesce(1).write.mode("append").json(inbox)
        logs.latest_stream(spark.readStream.schema(schema).json(inbox), out, state).awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{out}/version={k % 2}").collect()}
        want = governance.latest_review(spark.createDataFrame(rows[: 2 * k + 2], schema))
        assert got == {tuple(r) for r in want.select("collection", "kind", "reviewed_at", "review_id", "outcome").collect()}
    assert logs.lines_stream(spark, inbox).isStreaming
