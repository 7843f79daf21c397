"""Timers, the kept dashboard, the ledger of calls and sketches, over batches, replays and restarts."""

import inspect
import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_library import stream, write_files

from marlstone.functions import sketches
from marlstone.operators import scoring
from marlstone.streaming import alerts, dashboard
from marlstone.streaming import events as E

START = datetime.datetime(2024, 1, 1)


def runs(rows, gap):
    """What silences() gives for rows of which none was late, without the condition on the watermark."""
    out, times = set(), {}
    for _, user, _, _, ts in rows:
        if user is not None and ts is not None:
            times.setdefault(user, []).append(ts)
    for user, ts in times.items():
        ts.sort()
        cuts = [0, *(i for i in range(1, len(ts)) if ts[i] - ts[i - 1] > gap), len(ts)]
        out |= {(user, ts[a], ts[b - 1], b - a) for a, b in zip(cuts, cuts[1:])}
    return out


def test_silences_over_batches_and_a_restart(spark, tmp_path):
    """Rows out of order within the delay, repeated, without a user or time; a hot user; stopped and begun again."""
    r = random.Random(4)
    minute = lambda m: START + datetime.timedelta(minutes=m)
    rows = [(i, r.choice([1, 1, 1, 2, 3, 4, 5]), "view", 1.0, minute(r.randrange(i * 4, i * 4 + 50))) for i in range(400)]
    rows = [x for x in rows if x[1] != 3 or x[0] % 40 < 5] + [(900, None, "view", 1.0, minute(300)), (901, 2, "view", 1.0, None)]
    rows.sort(key=lambda x: x[0])
    batches = [rows[i : i + 60] + rows[i : i + 1] for i in range(0, len(rows), 60)]
    folder = write_files(spark, tmp_path, batches)
    late = [p for p in sorted((tmp_path / "in").iterdir()) if int(p.name.split("-")[0]) >= 3]
    (tmp_path / "later").mkdir()
    for p in late:
        p.rename(tmp_path / "later" / p.name)
    out, at, told = str(tmp_path / "out"), str(tmp_path / "at"), {}
    with alerts.rocksdb(spark):
        E.run_to_end(alerts.silences(stream(spark, folder), "30 minutes", "1 hour"), "append", out, at)
        for p in late:
            (tmp_path / "later" / p.name).rename(p)
        got = E.run_to_end(alerts.silences(stream(spark, folder), "30 minutes", "1 hour"), "append", out, at, told)
    gap, last = datetime.timedelta(minutes=30), max(x[4] for b in batches for x in b if x[4])
    every = runs([x for b in batches for x in b], gap)
    want = {x for x in every if x[2] + gap + datetime.timedelta(hours=1) <= last}
    found = [tuple(x) for x in got.collect()]
    assert set(found) == want and len(found) == len(want) and len(want) > 10 and told["late"] == 0


def test_late_rows_are_counted(spark, tmp_path):
    at = lambda h: START + datetime.timedelta(hours=h)
    folder = write_files(spark, tmp_path, [[(1, 7, "view", 1.0, at(1))], [(2, 7, "view", 1.0, at(9))], [(3, 7, "view", 1.0, at(10))], [(4, 7, "view", 1.0, at(2))]])
    told = {}
    E.run_to_end(E.tumbling(stream(spark, folder), late="1 hour"), "append", told=told)
    assert told["late"] == 1


@pytest.mark.parametrize("every", [2, 3, 100])
def test_dashboard_after_any_split_and_replay(spark, tmp_path, every):
    r = random.Random(every)
    rows = [(r.choice([None, "a", "b"]), r.choice(["x", "y"]), r.choice([None, 5, 7])) for _ in range(200)]
    schema = "lang string, source string, chars long"
    kept = dashboard.Dashboard(spark, str(tmp_path / "d"), ["lang", "source"], ["chars"], every)
    assert kept.table().count() == 0
    cuts = sorted(r.sample(range(1, 200), 6))
    batches = [spark.createDataFrame(rows[a:b], schema) for a, b in zip([0, *cuts], [*cuts, 200])]

    def whole(upto):
        n, total = Counter(), Counter()
        for lang, source, chars in rows[: [*cuts, 200][upto]]:
            n[lang, source] += 1
            total[lang, source] += chars or 0
        return {(*k, n[k], total[k]) for k in n}

    for i, batch in enumerate(batches):
        kept.merge(batch, i)
        if i % 2:
            kept.merge(batch, i)  # the last batch again, as after a failure before it was committed
        assert {tuple(x) for x in dashboard.Dashboard(spark, str(tmp_path / "d"), ["lang", "source"], ["chars"]).table().collect()} == whole(i)
    kept.merge(batches[0].limit(0), len(batches))
    assert {tuple(x) for x in kept.table().collect()} == whole(6)


def test_a_part_that_was_not_written_whole_is_not_read(spark, tmp_path):
    kept = dashboard.Dashboard(spark, str(tmp_path), ["k"], ["v"])
    kept.merge(spark.createDataFrame([("a", 1)], "k string, v long"), 0)
    kept.merge(spark.createDataFrame([("a", 2)], "k string, v long"), 1)
    (tmp_path / "parts" / "1" / "_SUCCESS").unlink()
    assert [tuple(x) for x in kept.table().collect()] == [("a", 1, 1)]
    kept.merge(spark.createDataFrame([("a", 2)], "k string, v long"), 1)
    assert [tuple(x) for x in kept.table().collect()] == [("a", 2, 3)]


def test_ledger_pays_once(spark, tmp_path):
    """A scorer that fails in the middle, then a second run, then a third that asks nothing."""
    asked = tmp_path / "asked"
    asked.mkdir()
    flag, texts = tmp_path / "failed", [f"t{i % 150}" for i in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")

    def scorer(batch):
        import uuid

        if "t77" in set(batch) and not flag.exists():
            flag.touch()
            raise OSError("service gone")
        (asked / uuid.uuid4().hex).write_text("\n".join(batch))
        return batch.str.len().astype("float64")

    run = lambda df=docs: scoring.with_ledger(df, scorer, str(tmp_path / "ledger"), rows=16, calls=2)
    with pytest.raises(Exception, match="service gone"):
        run().collect()
    before = sum(len(p.read_text().split("\n")) for p in asked.iterdir())
    want = Counter([*((i, float(len(t))) for i, t in enumerate(texts)), (900, None), (901, 0.0)])
    for _ in range(2):
        assert Counter((r.doc_id, r.score) for r in run().collect()) == want
    paid = Counter(t for p in asked.iterdir() for t in p.read_text().split("\n"))
    assert 0 < before < 151 and set(paid.values()) == {1} and len(paid) == 151
    assert max(len(p.read_text().split("\n")) for p in asked.iterdir()) <= 16
    assert run(docs.limit(0)).count() == 0


def test_sketches_of_days_are_those_of_all_rows(spark):
    """Merged sketches keep the bounds of one sketch: 5 % of the users, 3 % of the ranks. Nulls are in neither."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("kind"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 7001).alias("user"),
        F.when(F.col("id") % 13 > 0, F.pow(F.rand(3), 3)).alias("v"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts"),
    )
    rows = rows.unionByName(rows.limit(1).select(F.lit("none").alias("kind"), F.lit(None).cast("long").alias("user"), F.lit(None).cast("double").alias("v"), "ts"))
    ranks = [0.1, 0.5, 0.9]
    got = {r.kind: r for r in sketches.estimates(sketches.merged(sketches.daily(rows, ["kind"], "user", "v"), ["kind"]), ["kind"], ranks).collect()}
    bounds = F.array(*(F.lit(x + e) for x in ranks for e in (-0.03, 0.03)))
    for r in rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), F.percentile("v", bounds).alias("b")).collect():
        found = got.pop(r.kind)
        assert found.n == r.n and abs(found.distinct - r.users) <= 0.05 * r.users
        assert (found.quantiles is None) == (r.b is None)
        assert r.b is None or all(r.b[2 * i] <= q <= r.b[2 * i + 1] for i, q in enumerate(found.quantiles))
    assert not got and sketches.merged(sketches.daily(rows.limit(0), ["kind"], "user", "v"), ["kind"]).count() == 0


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    """A table may be one file or a folder of files; a stream reads all of either."""
    events = spark.range(90).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    some = tmp_path / "one"
    some.mkdir()
    next((tmp_path / "events.parquet").glob("part-*.parquet")).rename(some / "events.parquet")
    for folder, want in ((tmp_path, 60), (some, 30)):
        assert E.run_to_end(E.read_events(spark, str(folder)), "append").distinct().count() == want


def test_silences_set_one_timer_a_user(spark, tmp_path):
    """Runs that end together with the watermark are reported alike, whether their user has other runs or not."""
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    begin = [at(0), at(100), at(160)]
    rows = [(1, 1, "view", 1.0, begin[0]), (2, 1, "view", 1.0, begin[1]), (3, 2, "view", 1.0, begin[1]), (4, 3, "view", 1.0, begin[2])]
    rows += [(10 + i, 4, "view", 1.0, at(i)) for i in range(0, 60, 2)]
    folder = write_files(spark, tmp_path, [rows])
    with alerts.rocksdb(spark):
        got = E.run_to_end(alerts.silences(stream(spark, folder), "40 minutes", "20 minutes"), "append").collect()
    ended = {(r.user_id, r.n) for r in got}
    assert (1, 1) in ended and (4, 30) in ended
    assert sum(r.user_id == 1 for r in got) == 1 + sum(r.user_id == 2 for r in got) == 2
    assert "self.handle.registerTimer(min(" in inspect.getsource(alerts.Silence.handleInputRows)


def test_few_calls_go_over_the_texts_in_waves(spark, tmp_path):
    """No task reads all texts, however few may run at once; results are those of one wave."""
    docs = spark.createDataFrame([*((i, "x" * (i % 50)) for i in range(400)), (900, None)], "doc_id long, text string")
    want = Counter([*((i, float(i % 50)) for i in range(400)), (900, None)])
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def scorer(batch):
        import uuid

        (sizes / uuid.uuid4().hex).write_text(str(len(batch)))
        return batch.str.len().astype("float64")

    for calls in (2, None):
        found = scoring.with_scorer(docs, scorer, calls=calls, rows=20, bytes_each=1000)
        assert Counter((r.doc_id, r.score) for r in found.select("doc_id", "score").collect()) == want
    assert max(int(p.read_text()) for p in sizes.iterdir()) <= 20
    found = scoring.with_scorer(docs, scorer, calls=2, bytes_each=1000)
    assert found.rdd.getNumPartitions() > 2 and found.columns == ["doc_id", "text", "score"]
    found = scoring.with_ledger(docs, scorer, str(tmp_path / "ledger"), rows=16, calls=2, bytes_each=100)
    assert Counter((r.doc_id, r.score) for r in found.collect()) == want
