import json

from prosegauge.operators.limiter import decide, sliding_limit
from prosegauge.streaming.requests import judged, read_requests, requests_per_minute, write_results


def test_requests_once_each(spark, tmp_path):
    good = "This is a text of enough length to be judged. " * 8
    rows = [("a", "c1", good), ("b", "c1", "short"), ("c", "c2", ""), ("d", "c2", good + "  "), ("e", "c2", None)]
    src = tmp_path / "in"
    src.mkdir()
    for k, (i, client, text) in enumerate(rows):
        (src / f"{k}.json").write_text(json.dumps({"analysis_id": i, "ts": f"2024-01-01T00:00:0{k}Z", "client": client, "text": text, "unknown": 1}) + "\n")
    out = str(tmp_path / "out")
    for _ in range(2):
        write_results(judged(read_requests(spark, str(src))), out, str(tmp_path / "cp")).awaitTermination()
    # files of one moment come in any order: which of two equal texts is first is open
    got = sorted((r.status, r.code, r.analysis_id) for r in spark.read.parquet(out).collect())
    assert [g[:2] for g in got] == [("completed", "ok"), ("failed", "empty"), ("failed", "too_short")]
    assert got[0][2] in "ad" and got[1][2] in "ce" and got[2][2] == "b"
    per = requests_per_minute(spark.read.schema("analysis_id string, ts timestamp, client string, text string").json(str(src)), limit=2)
    assert {r.client: (r.n, r.allowed) for r in per.collect()} == {"c1": (2, True), "c2": (3, False)}


def test_sliding_limit(spark, sf):
    assert decide([0, 1, 2, 60, 61, 62.5], 60, 2) == [(True, 0), (True, 0), (False, 58), (False, 1), (True, 0), (True, 0)]
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = {r.event_id: (r.allowed, r.retry_after) for r in sliding_limit(events).collect()}
    by = {}
    for r in events.selectExpr("user_id", "event_id", "unix_micros(CAST(ts AS timestamp)) / 1e6D AS t").collect():
        by.setdefault(r.user_id, []).append((r.t, r.event_id))
    for rows in by.values():
        rows.sort()
        for (_, e), want in zip(rows, decide([t for t, _ in rows], 3600, 2), strict=True):
            assert got[e] == want


def test_sliding_limit_as_a_stream(spark, tmp_path):
    """Batch after batch, each client's log goes on where it was."""
    import json

    from prosegauge.operators.limiter import decide
    from prosegauge.streaming.requests import read_requests, sliding_limit

    times = {"a": [0, 5, 10, 59, 61, 62, 130], "b": [3, 4, 200]}
    rows = sorted((t, c) for c, ts in times.items() for t in ts)
    for i in range(0, len(rows), 4):
        (tmp_path / f"{i:03}.jsonl").write_text("".join(json.dumps({"analysis_id": f"{c}{t:04}", "ts": f"2024-01-01T00:{t // 60:02}:{t % 60:02}Z", "client": c, "text": "x"}) + "\n" for t, c in rows[i : i + 4]))
        import os

        os.utime(tmp_path / f"{i:03}.jsonl", (1_700_000_000 + i, 1_700_000_000 + i))
    out = sliding_limit(read_requests(spark, str(tmp_path)), 60, 3)
    stream = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = {r.analysis_id: (r.allowed, r.retry_after) for r in spark.table("limited").collect()}
    for c, ts in times.items():
        assert [got[f"{c}{t:04}"] for t in ts] == decide([float(t) for t in ts], 60, 3)
