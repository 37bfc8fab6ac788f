"""The change queue: batch against a fold in plain Python, the stream cut at every event against the batch, restarts and replays."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestack.streaming import changes as C
from lodestack.streaming import queue as Q

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "repository string, seq long, at timestamp, kind string, path string"


def fold(rows, gap_ms, most):
    out = []
    for repo in sorted({r[0] for r in rows}):
        session = []

        def end():
            pending, over = {}, False
            for _, _, at, kind, path in session:
                if len(pending) >= most and path not in pending:
                    over = True
                old = pending.get(path)
                if kind == "modified" and old and old[0] == "created":
                    pending[path] = old
                elif kind == "created" and old and old[0] == "deleted":
                    pending[path] = "modified", at
                else:
                    pending[path] = kind, at
            if over:
                out.append((repo, session[0][2], "overflow", ".", "modified", session[-1][2]))
            else:
                out.extend((repo, session[0][2], "drained", p, k, at) for p, (k, at) in pending.items())

        for r in sorted((r for r in rows if r[0] == repo), key=lambda r: (r[2], r[1])):
            if session and r[2] - session[-1][2] >= timedelta(milliseconds=gap_ms):
                end()
                session = []
            session.append(r)
        if session:
            end()
    return sorted(out)


def events(n, seed, repos=3, paths=4, step=(0, 100, 400, 999, 1000, 1500)):
    r, at = random.Random(seed), START
    out = []
    for k in range(n):
        at += timedelta(milliseconds=r.choice(step))
        out.append((f"r{r.randrange(repos)}", k, at, r.choice(C.KINDS[:3]), f"p{r.randrange(paths)}"))
    return out


def rows_of(df):
    utc = lambda v: v.astimezone(timezone.utc) if v.tzinfo else v.replace(tzinfo=timezone.utc)
    local = df.select("repository", F.unix_micros("session").alias("s"), "status", "path", "kind", F.unix_micros("at").alias("a")).collect()
    back = lambda us: utc(START + timedelta(microseconds=us - int(START.timestamp() * 1_000_000)))
    return sorted((r[0], back(r[1]), r[2], r[3], r[4], back(r[5])) for r in local)


@pytest.mark.parametrize("gap,most,bucket", [(1000, 100, 3600), (1000, 2, 2), (400, 3, 1), (60_000, 3, 5)])
def test_batch_against_a_fold(spark, gap, most, bucket):
    rows = events(300, gap)
    df = spark.createDataFrame([*rows, (None, 1, START, "created", "x"), ("r0", 1, None, "created", "x"), ("r0", 1, START, "created", None)], EVENTS).repartition(3)
    assert rows_of(Q.queue_drains(df, gap, most, bucket)) == fold(rows, gap, most)
    assert Q.queue_drains(df.limit(0)).count() == 0


def leave(folder, k, rows):
    lines = [json.dumps({"repository": r[0], "seq": r[1], "at": r[2].isoformat(), "kind": r[3], "path": r[4]}) for r in rows]
    (folder / f"{k:05d}.json").write_text("\n".join(lines))
    os.utime(folder / f"{k:05d}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files come by their time


def stream(spark, folder, per_trigger=1):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).option("latestFirst", "false").json(str(folder))


def drive(spark, folder, tmp, got, gap, most, ledger=None):
    """Runs what lies in the folder; got: rows of each batch by number."""
    keep = lambda df, n: got.setdefault(n, []).extend(rows_of(df))
    over = lambda repos, n: got.setdefault((n, "over"), []).extend(repos)
    q = Q.process(Q.stateful_drains(stream(spark, folder), gap, most), keep, over, ledger or Q.Ledger(spark, f"file://{tmp}/ledger"), f"{tmp}/checkpoint")
    q.awaitTermination(240)
    assert q.exception() is None


def test_a_stream_cut_at_every_event_and_stopped_between(spark, tmp_path):
    """One event a micro-batch, and a restart in the middle of a session: the rows of the batch form."""
    rows = events(14, 5, repos=2, paths=3, step=(0, 300, 400, 1200))
    folder = tmp_path / "in"
    folder.mkdir()
    last = ("other", 10_000, rows[-1][2] + timedelta(hours=1), "created", "end")
    got = {}
    for k, r in enumerate(rows[:7]):
        leave(folder, k, [r])
    drive(spark, folder, tmp_path, got, 1000, 100)
    for k, r in enumerate([*rows[7:], last], 7):
        leave(folder, k, [r])
    drive(spark, folder, tmp_path, got, 1000, 100)
    want = [w for w in fold(rows, 1000, 100)]
    assert sorted(r for n, rs in got.items() if isinstance(n, int) for r in rs) == want
    both = C.coalesced(spark.createDataFrame([("r", 1, START, "deleted", "p"), ("r", 2, START + timedelta(seconds=1), "created", "p")], EVENTS)).collect()
    assert [r["kind"] for r in both] == ["modified"]


def test_a_deletion_and_a_creation_in_two_batches_and_an_overflow(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda ms: START + timedelta(milliseconds=ms)
    leave(folder, 0, [("a", 1, at(0), "deleted", "p"), ("b", 1, at(0), "created", "p0")])
    leave(folder, 1, [("a", 2, at(200), "created", "p"), ("b", 2, at(200), "created", "p1"), ("b", 3, at(210), "modified", "p2")])
    leave(folder, 2, [("b", 4, at(300), "deleted", "p0"), ("c", 1, at(9_000_000), "created", "z")])
    got = {}
    drive(spark, folder, tmp_path, got, 1000, 2)
    flat = [r for n, rs in got.items() if isinstance(n, int) for r in rs]
    assert flat == [("a", at(0), "drained", "p", "modified", at(200))]
    assert [r for n, rs in got.items() if not isinstance(n, int) for r in rs] == ["b"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A failure after the sink and before Spark's own commit: the batch comes again and is passed over."""
    folder = tmp_path / "in"
    folder.mkdir()
    leave(folder, 0, [("a", 1, START, "created", "p")])
    leave(folder, 1, [("a", 2, START + timedelta(hours=1), "created", "q"), ("b", 3, START + timedelta(hours=2), "created", "z")])

    class Failing(Q.Ledger):
        def record(self, batch, identity):
            super().record(batch, identity)
            raise RuntimeError("lost after the sink")

    got, calls = {}, []
    drains = lambda: Q.stateful_drains(stream(spark, folder, 2), 1000, 10)
    q = Q.process(drains(), lambda df, n: calls.append(n) or got.setdefault(n, rows_of(df)), lambda *_: None, Failing(spark, f"file://{tmp_path}/ledger"), f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="lost after the sink"):
        q.awaitTermination(120)
    done = dict(got)
    q = Q.process(drains(), lambda df, n: calls.append(n) or got.setdefault(n, rows_of(df)), lambda *_: None, Q.Ledger(spark, f"file://{tmp_path}/ledger"), f"{tmp_path}/checkpoint")
    q.awaitTermination(120)
    assert q.exception() is None and len(calls) == len(set(calls)) and done.items() <= got.items()
    assert sorted(r[3] for rs in got.values() for r in rs) == ["p", "q"]


def test_ledger(spark, tmp_path):
    ledger, done = Q.Ledger(spark, f"file://{tmp_path}/l"), []
    assert ledger.once(3, "x", lambda: done.append(1)) and not ledger.once(3, "x", lambda: done.append(2)) and done == [1]
    with pytest.raises(RuntimeError):
        ledger.once(3, "y", lambda: None)
    with pytest.raises(ZeroDivisionError):
        ledger.once(4, "x", lambda: 1 / 0)
    assert ledger.identity(4) is None and ledger.once(4, "x", lambda: None) and ledger.identity(4) == "x"


def test_processing_time(spark, tmp_path):
    """Quiet by the clock: what arrived is given out although no later event moves a watermark."""
    folder = tmp_path / "in"
    folder.mkdir()
    leave(folder, 0, [("a", 1, START, "deleted", "p")])
    leave(folder, 1, [("a", 2, START, "created", "p")])
    got = []
    q = Q.process(Q.stateful_drains(stream(spark, folder), 1500, 10, time="processing"), lambda df, n: got.extend(rows_of(df)), lambda *_: None, Q.Ledger(spark, f"file://{tmp_path}/l"), f"{tmp_path}/c", available_now=False)
    for _ in range(60):
        q.awaitTermination(1)
        if got:
            break
    q.stop()
    assert [r[3:5] for r in got] == [("p", "modified")]
