"""Streams: the state machine over shuffled, late and doubled events, and the sink that writes each once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.streaming import machine, sink, stages

EVENTS = "run_id string, seq long, stage string, status string, valid boolean, ts timestamp"


def brute_states(events):
    """States of runs from their events in order."""
    runs: dict = {}
    for run, seq, stage, status, valid, _ in sorted(set(events), key=lambda e: (e[0], e[1])):
        runs.setdefault(run, []).append((seq, stage, status, valid))
    out = {}
    for run, own in runs.items():
        ended, bad, failed = False, None, False
        for seq, stage, status, valid in own:
            if (not valid or ended) and bad is None:
                bad = seq
            if stage == "error" or (stage == "run" and status == "complete"):
                failed, ended = failed or stage == "error", True
        out[run] = (len(own), "protocol_error" if bad is not None else "open" if not ended else "failed" if failed else "complete", bad)
    return out


def random_events(seed, runs=30):
    r, out = random.Random(seed), []
    for run in range(runs):
        seqs = r.sample(range(20_000), r.randint(1, 25))
        end = r.choice([None, max(seqs), max(seqs), r.choice(seqs)])
        for seq in seqs:
            stage, status = (("run", "complete") if r.random() < 0.7 else ("error", "failed")) if seq == end else (r.choice(["claims", "evidence", "run"]), "started")
            out.append((f"r{run}", seq, stage, status, r.random() > 0.02, f"2024-01-01 00:{seq // 400:02d}:00"))
    return out


def as_table(spark, events):
    return spark.createDataFrame(events, "run_id string, seq long, stage string, status string, valid boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def put(spark, events, path, files, seed):
    """Files of shuffled events, a third of them doubled."""
    r = random.Random(seed)
    both = [*events, *r.sample(events, len(events) // 3)]
    r.shuffle(both)
    for k in range(files):
        if both[k::files]:
            as_table(spark, both[k::files]).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, tmp_path, **more):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(path)
    with machine.state_store(spark):
        q = machine.machine_states(stream, lateness="30 days", **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(machine.STATES).parquet(str(tmp_path / "out"))


def test_machine_against_brute_force_with_a_restart(spark, tmp_path):
    events, path = random_events(1), str(tmp_path / "in")
    put(spark, events[::2], path, 3, 2)
    first = run(spark, path, tmp_path)
    assert {x["run_id"]: tuple(x)[1:] for x in machine.latest_states(first).collect()} == brute_states(events[::2])
    before = first.count()
    put(spark, events[1::2] + events[:50:2], path, 3, 3)
    updates = run(spark, path, tmp_path)  # goes on from the checkpoint
    assert {x["run_id"]: tuple(x)[1:] for x in machine.latest_states(updates).collect()} == brute_states(events)
    assert updates.count() > before and updates.groupBy("run_id", "version").count().filter("count > 1").count() == 0
    assert run(spark, path, tmp_path).count() == updates.count()  # nothing new, nothing twice
    want = {x["run_id"]: tuple(x)[1:] for x in stages.run_states(as_table(spark, sorted(set(events)))).collect()}
    assert want == brute_states(events)


class HeldMap:
    """A map state in memory that counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def keys(self):
        self.calls += 1
        return iter(list(self.held))


def folded(batches):
    m = machine.RunMachine(1, 1, None)
    m.seen = HeldMap()
    names = [f.split()[0] for f in machine._RUN.split(", ")]
    state = dict(zip(names, (0, None, False, None, None, 0, None, False, None), strict=False))
    for events in batches:
        m._fold(state, np.array([e[0] for e in events], np.int64), np.array([e[1] for e in events], np.uint8))
    return m, state


def test_blocks_are_as_many_as_the_events_need():
    r = random.Random(3)
    far = [(r.randrange(1 << 50), 1) for _ in range(300)]
    m, state = folded([far[:150], far[150:], far[100:200]])
    assert state["n"] == 300 and len(m.seen.held) == 1 and m.seen.calls < 10
    for spread in (1, 1 << 40):  # far more than a block holds, in any order, with repeats and early ends last
        seqs = [spread * i for i in r.sample(range(20_000), 15_000)]
        flags = {q: 1 | (2 if k in (5000, 12_000) else 0) | (8 if k in (9000, 14_000) else 0) for k, q in enumerate(seqs)}
        batches = [[(q, flags[q]) for q in seqs[a : a + 900] + seqs[max(0, a - 50) : a]] for a in range(0, len(seqs), 900)]
        m, state = folded(batches)
        end = min(q for q in seqs if flags[q] & 2)
        assert (state["n"], state["end_seq"], state["invalid"]) == (15_000, end, min(q for q in seqs if flags[q] & 8))
        assert state["after"] == min((q for q in seqs if q > end), default=None)
        sizes = [len(m._block(k[0])[0]) for k in m.seen.held]
        assert sum(sizes) == 15_000 and max(sizes) <= machine.HELD and len(sizes) < 16
        assert sorted(q for k in m.seen.held for q in m._block(k[0])[0].tolist()) == sorted(seqs)


def test_machine_goes_on_from_a_table(spark, tmp_path):
    events, path = random_events(4, runs=8), str(tmp_path / "in")
    put(spark, events, path, 2, 5)
    past = as_table(spark, events[::2])
    got = machine.latest_states(run(spark, path, tmp_path, before=past)).collect()
    want = brute_states(events)
    assert {x["run_id"]: tuple(x)[1:] for x in got} == {x["run_id"]: want[x["run_id"]] for x in got} and len(got) >= 7


def test_machine_reports_stalled_runs(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", 0, "claims", "started", True, "2024-01-01 00:00:00"), ("b", 0, "run", "complete", True, "2024-01-01 00:00:00")]
    as_table(spark, rows).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(EVENTS).parquet(path)
    states = machine.machine_states(stream, lateness="1 second", stall_ms=1000, keep_ms=10_000_000)
    with machine.state_store(spark):
        for late in ("01:00:00", "01:00:10"):
            q = states.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            q.awaitTermination()
            as_table(spark, [("c", int(late[-2:]), "claims", "started", True, f"2024-01-01 {late}")]).coalesce(1).write.mode("append").parquet(path)
        q = states.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {x["run_id"]: x["state"] for x in machine.latest_states(spark.read.schema(machine.STATES).parquet(str(tmp_path / "out"))).collect()}
    assert got["a"] == "stalled" and got["b"] == "complete" and got["c"] == "open"


def test_sink_writes_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [{"run_id": "a", "seq": i, "line": f'{{"stage":"claims","status":"started","data":{{"é":{i}}}}}'} for i in range(5)]
    writer = sink.EventWriter(path)
    lost = writer.write(iter(rows))  # a task that failed after writing: no commit names its file
    writer.commit([writer.write(iter(rows[:3])), None, writer.write(iter([]))], 0)
    writer.commit([writer.write(iter(rows[:3]))], 0)  # the batch again
    failed = writer.write(iter(rows[3:]))
    writer.abort([failed, None], 1)
    writer.commit([writer.write(iter(rows[3:]))], 1)
    got = sorted((r["seq"], r["batch"], r["line"]) for r in sink.read_events(spark, path).collect())
    assert got == [(i, int(i > 2), rows[i]["line"]) for i in range(5)] and lost.name
    parsed = stages.parse_events(sink.read_events(spark, path), "line").collect()
    assert all(r["valid"] and r["stage"] == "claims" for r in parsed)


def test_sink_of_a_stream_with_doubled_events(spark, tmp_path):
    events, path = random_events(6, runs=5), str(tmp_path / "in")
    put(spark, events, path, 3, 7)
    lines = sink.once(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path), "30 days").withColumn("line", sink.event_line(F.col("stage"), F.lit("completed")))
    for _ in range(2):  # the second start finds nothing new
        sink.write_events(lines, str(tmp_path / "out"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = sink.read_events(spark, str(tmp_path / "out")).collect()
    assert sorted((r["run_id"], r["seq"]) for r in got) == sorted((e[0], e[1]) for e in events)
    assert all(r["line"].endswith('"status":"complete","data":{}}') for r in got)


def test_sink_needs_a_path():
    with pytest.raises(ValueError, match="path"):
        sink.RunEvents({}).streamWriter(None, False)
