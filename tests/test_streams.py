"""State of the streams: what a row costs, repeated batches, retention by folders."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from watchtide.operators import correlate as rules
from watchtide.plans import streams as plans
from watchtide.sources import sinks
from watchtide.streaming import keyed, streams


class MapState:
    """A map state that counts what is done to it."""

    def __init__(self):
        self.rows, self.done = {}, Counter()

    def getValue(self, key):  # noqa: N802
        self.done["read"] += 1
        return self.rows.get(key)

    def containsKey(self, key):  # noqa: N802
        return key in self.rows

    def updateValue(self, key, value):  # noqa: N802
        self.done["write"] += 1
        self.rows[key] = tuple(map(list, value))

    def removeKey(self, key):  # noqa: N802
        self.done["remove"] += 1
        self.rows.pop(key, None)


def processor(rules):
    found = keyed.RulesProcessor(["org", "kind", "entity_id", "id", "us"], 60, {"source": rules})
    found.log, found.rules = MapState(), rules
    return found


def loop(rows, rules):
    """Every rule over the whole history, again for every signal."""
    out = []
    for name, span, needs, bit in rules:
        was, last = False, None
        for t in sorted({x[0] for x in rows}):
            inside = [v >> bit & (1 << len(needs)) - 1 for u, _, v in rows if t - span <= u <= t]
            hit = all(sum(v >> k & 1 for v in inside) >= n for k, n in enumerate(needs))
            if hit and not (was and t - last <= span):
                first = min(i for u, i, _ in rows if u == t)
                out.append((first, t, name, len(inside), sum(v > 0 for v in inside), min(u for u, _, _ in rows if t - span <= u <= t)))
            was, last = hit, t
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_rules_in_one_queue_equal_a_loop(monkeypatch, seed):
    monkeypatch.setattr(keyed, "PAGE", 4)
    rng = random.Random(seed)
    rules = [("a", 40, (2, 1), 0), ("b", 15, (1, 1), 2), ("c", 90, (3,), 4)]
    rows, t = [], 0
    for i in range(300):
        t += rng.choice([0, 1, 3, 20])
        rows.append((t, i, rng.choice([0, 0, 1, 2, 5, 8, 16, 31])))
    p, memo, made, at = processor(rules), [], [], 0
    while at < len(rows):  # equal times come together, as a watermark makes them
        end = at + rng.randrange(1, 40)
        while end < len(rows) and rows[end][0] == rows[end - 1][0]:
            end += 1
        memo, out = p.advance(memo, rows[at:end])
        made += out
        at = end
    assert sorted(made) == loop(rows, rules)


def test_state_changes_of_a_row_do_not_depend_on_the_window():
    counts = {}
    for span in (1_000, 100_000):
        p, memo = processor([("a", span, (10**9,), 0)]), []
        for batch in range(50):
            memo, _ = p.advance(memo, [(batch * 1000 + k, k, 1) for k in range(1000)])
        counts[span] = sum(p.log.done.values())
    assert counts[100_000] <= 1.1 * counts[1_000]
    assert counts[100_000] < 50_000 * 3 / keyed.PAGE * 1.5


def test_repeated_batches_change_nothing(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame(
        [(1, '{"event_type":"x","host":"h"}'), (2, "CEF:0|bad"), (3, "  "), (4, None), (5, "free text")], "id long, line string"
    )

    def twice(stream, name, write):
        for number in (0, 1, 1, 0):
            write(stream.filter(F.col("id") % 2 == number), number)

    monkeypatch.setattr(streams, "each_batch", twice)
    now = F.timestamp_seconds(F.lit(7))
    streams.ingest_stream(lines, str(tmp_path), now, F.lit(2024))
    events = spark.read.parquet(f"{tmp_path}/events").select("id", "parser").collect()
    assert sorted(map(tuple, events)) == [(1, "json"), (5, "raw")]
    refused = {r.id: r.reason for r in spark.read.parquet(f"{tmp_path}/quarantine").collect()}
    assert refused == {2: streams.NO_EVENTS, 3: streams.EMPTY_LINE, 4: streams.EMPTY_LINE}


def test_retention_drops_folders_and_does_not_read_them(spark, tmp_path):
    path, day = str(tmp_path / "kept"), dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(hours=k)) for k in range(24 * 6)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    for number in range(3):
        part = df.filter(F.col("id") % 3 == number)
        sinks.store_batch(part, path, number)
        sinks.store_batch(part, path, number)  # a repeated batch
    assert sinks.cutoff(spark, path, 3600) == rows[-1][1] - dt.timedelta(hours=1)
    since = day + dt.timedelta(days=3, hours=22)
    read = sinks.stored_events(spark, path, since)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1].split("]")[0] and "GreaterThanOrEqual(ts" in plan
    sinks.drop_expired(spark, path, since)
    left = spark.read.parquet(path)
    assert sorted(r.id for r in left.collect()) == [k for k, t in rows if t >= since]
    assert not list((tmp_path / "kept").glob("event_date=2024-01-0[123]/batch=*"))
    # Of the cutoff's day the batch without a row inside is gone: hours 22 and 23 are two batches.
    assert len(list((tmp_path / "kept").glob("event_date=2024-01-04/batch=*"))) == 2


@pytest.mark.parametrize("later", [False, True])
def test_steps_come_in_equal_numbers_of_files_one_step_per_trigger(spark, monkeypatch, later):
    monkeypatch.setattr(plans, "FILE_ROWS", 50)
    day = dt.datetime(2024, 1, 1)
    # Most rows lie in a quarter of an hour: steps are cut by rows.
    rows = [(k, day + dt.timedelta(seconds=k if k < 900 else k * 60)) for k in range(1000)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp")
    again = table.filter("event_id % 10 = 0").withColumn("event_id", F.col("event_id") + 1000)
    seen = []

    def keep(batch, number):
        found = batch.select("event_id", F.input_file_name().alias("file")).collect()
        seen.append(([r.event_id for r in found], Counter(r.file for r in found)))

    streams.each_batch(plans._dealt(table, "dealt", later=again if later else None), "dealt-test", keep)
    assert len(seen) == plans.STEPS + 1 and seen[-1][0] == [-1]
    assert len({len(files) for _, files in seen[:-1]}) == 1 and max(max(f.values()) for _, f in seen) < 100
    steps = [sorted(i for i in ids if i < 1000) for ids, _ in seen[:-1]]
    assert sum(steps, []) == list(range(1000))
    copies = [sorted(i - 1000 for i in ids if i >= 1000) for ids, _ in seen[:-1]]
    assert copies == ([[], *[[i for i in s if i % 10 == 0] for s in steps[:-1]]] if later else [[]] * plans.STEPS)


@pytest.mark.parametrize("seed", range(2))
def test_correlation_by_batches_equals_the_batch_operator(spark, tmp_path, monkeypatch, seed):
    rng, delay = random.Random(seed), 60
    day, rows, late, batches = dt.datetime(2024, 1, 1), [], [], [[] for _ in range(4)]
    kinds = ["login_failed"] * 3 + ["login_success", "data_export", "admin_add", "page_view"]
    for k in range(400):
        at = rng.randrange(4 * 3600)
        row = (k, k % 2, rng.choice(kinds), f"s{k % 3}", f"u{k % 5}", day + dt.timedelta(seconds=at))
        number = at // 3600
        if number < 3 and at % 3600 >= 3600 - delay // 2:
            number += k % 2  # a little late: the watermark has not passed it
        elif number < 2 and k % 9 == 0:  # too late
            batches[number + 2].append(row)
            late.append(row)
            continue
        rows.append(row)
        batches[number].append(row)
    for number in range(4):  # the hour's last second, so that the watermark is known
        row = (1000 + number, 0, "page_view", "s0", "u0", day + dt.timedelta(seconds=3600 * (number + 1) - 1))
        rows.append(row)
        batches[number].append(row)
    end = (2000, -1, "end", "end", "end", dt.datetime(2100, 1, 1))
    form = "id long, org long, event_type string, source string, user_name string, ts timestamp"

    def each(stream, name, write):
        for number, part in enumerate([*batches, [end]]):
            for _ in range(2):  # every batch is repeated
                write(spark.createDataFrame(part, form), number)

    monkeypatch.setattr(streams, "each_batch", each)
    streams.correlate_batches(None, str(tmp_path), delay)
    columns = ["org", "rule_id", "entity_id", "trigger_id", "window_events", "matched_events", "first_seen", "last_seen"]
    whole = rules.correlate(spark.createDataFrame(rows, form).withColumn("us", F.unix_micros("ts")))
    wanted = sorted(map(tuple, whole.select(columns).collect()))
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/incidents").select(columns).collect()))
    assert late and len(wanted) > 20 and found == wanted
    # The state is what later signals can see, not the history.
    assert sorted(p.name for p in (tmp_path / "signals").iterdir()) == ["batch=3", "batch=4"]
    assert spark.read.parquet(f"{tmp_path}/signals/batch=4").count() < len(rows) // 4


@pytest.mark.parametrize("later", [False, True])
def test_a_very_common_time_is_shared_out_over_steps_and_files(spark, monkeypatch, later):
    monkeypatch.setattr(plans, "FILE_ROWS", 50)
    day = dt.datetime(2024, 1, 1)
    # Nine tenths of the rows have the same time.
    rows = [(k, day + dt.timedelta(seconds=k if k < 100 or k >= 1900 else 1000)) for k in range(2000)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp")
    again = table.filter("event_id % 10 = 0").withColumn("event_id", F.col("event_id") + 2000)
    seen = []

    def keep(batch, number):
        found = batch.select("event_id", "ts", F.input_file_name().alias("file")).collect()
        seen.append(([r.event_id for r in found], [r.ts for r in found if r.event_id < 2000], Counter(r.file for r in found)))

    streams.each_batch(plans._dealt(table, "common", later=again if later else None), "common-test", keep)
    steps = seen[:-1]
    assert max(max(f.values()) for *_, f in steps) < 100 and len({len(files) for *_, files in steps}) == 1
    assert len(steps) == plans.STEPS and seen[-1][0] == [-1]
    assert sorted(i for ids, *_ in steps for i in ids if i < 2000) == list(range(2000))
    assert all(max(a) <= min(b) for (_, a, _), (_, b, _) in zip(steps, steps[1:], strict=False))
    copies = [i for ids, *_ in steps for i in ids if i >= 2000]
    assert len(copies) == len(set(copies)) and bool(copies) == later
    assert not any(i >= 2000 for i in steps[0][0])
