"""Request states as a stream: micro-batches, bounded state, resumption from a stored table."""

import random
from datetime import datetime, timedelta

from fleetwright.operators.runs import request_state
from fleetwright.streaming.requests import no_idle_batches, read_request_state, request_state_stream, start_request_state

EPOCH = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, request_id bigint, ts timestamp, state string"


def events(seed, n, requests):
    rng = random.Random(seed)
    states = ["new", "pending", "progress", "progress", "pending", "done", "failed"]
    return [
        (i, rng.randrange(requests), EPOCH + timedelta(seconds=rng.randrange(5000)), rng.choice(states))
        for i in range(n)
    ]


def stream(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def states(df):
    return {(r["request_id"], r["state"], r["since"], r["terminal"]) for r in df.collect()}


def test_many_micro_batches_equal_one_table(spark, tmp_path):
    rows = events(1, 150, 30)
    source = stream(spark, str(tmp_path / "in"), [rows[i : i + 30] for i in range(0, 150, 30)])
    out = str(tmp_path / "out")
    start_request_state(source, out, str(tmp_path / "marks"), snapshot_every=2).awaitTermination()
    assert len(list((tmp_path / "out" / "kind=snapshot").glob("batch=*"))) == 2
    assert states(read_request_state(spark, out)) == states(request_state(spark.createDataFrame(rows, SCHEMA)))


def test_stream_goes_on_from_a_stored_table(spark, tmp_path):
    rows = events(2, 120, 20)
    first = str(tmp_path / "first")
    start_request_state(stream(spark, str(tmp_path / "in"), [rows[:60]]), first, str(tmp_path / "marks")).awaitTermination()
    # The second stream knows nothing of the first but the table it left.
    second = str(tmp_path / "second")
    left = read_request_state(spark, first)
    later = stream(spark, str(tmp_path / "later"), [rows[60:90], rows[90:]])
    start_request_state(later, second, str(tmp_path / "marks-2"), initial=left).awaitTermination()
    assert states(read_request_state(spark, second)) == states(request_state(spark.createDataFrame(rows, SCHEMA)))


def test_closed_requests_leave_the_state(spark, tmp_path):
    parts = []
    for i in range(6):
        new = range(i * 20, i * 20 + 20)
        parts.append([(2 * r, r, EPOCH, "new") for r in new] + [(2 * r + 1, r, EPOCH + timedelta(1), "done") for r in new if r % 20])
    source = stream(spark, str(tmp_path / "in"), parts)
    sizes = []

    def look(batch, batch_id):
        sizes.append(batch.count())

    states = request_state_stream(source, closed_seconds=0.001)
    with no_idle_batches(spark):
        query = (
            states.writeStream.outputMode("update")
            .foreachBatch(look)
            .option("checkpointLocation", str(tmp_path / "marks"))
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    # One request of each micro-batch stays open; the nineteen others are gone in the next.
    assert sizes[:6] == [20] * 6
    assert held[-1] < 3 * 20 and held[-1] - held[1] <= 2 * 6
