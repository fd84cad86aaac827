import datetime
import random

from pyspark.sql import functions as F

from isobath.streaming import daily

SCHEMA = "series string, ts timestamp, value double"
FIRST = datetime.datetime(2024, 1, 1)


def observations(seed=4):
    rng = random.Random(seed)
    rows = []
    for series in ("a", "b"):
        for day in range(40):
            if rng.random() < 0.85:
                level = rng.choice([0.0, 10.0])
                rows += [(series, FIRST + datetime.timedelta(days=day, hours=rng.random() * 24), rng.choice([level, level + 1, None])) for _ in range(rng.randint(1, 4))]
    # a last observation whose day lets all others be given out
    return [*rows, ("c", FIRST + datetime.timedelta(days=60), 0.0)]


def replay(spark, tmp_path, batches):
    out, source = [], tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        query = daily.settled_runs(stream, 5.0).writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "notes")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def by_hand(rows, threshold=5.0):
    days = {}
    for series, ts, value in rows:
        if value is not None:
            days.setdefault((series, ts.date()), []).append(value)
    mean = {k: sum(v) / len(v) for k, v in days.items()}
    out = []
    for (series, day), m in sorted(mean.items()):
        if m > threshold:
            if out and out[-1][0] == series and out[-1][2] == day - datetime.timedelta(days=1):
                s, start, _, n, top = out[-1]
                out[-1] = (s, start, day, n + 1, max(top, m))
            else:
                out.append((series, day, day, 1, m))
    return out


def test_shuffled_replay_equals_the_batch(spark, tmp_path):
    rows = observations()
    # late by up to a day and a half, where two days are allowed
    rng = random.Random(9)
    came = sorted(rows[:-1], key=lambda r: r[1] + datetime.timedelta(hours=36 * rng.random()))
    cuts = [0, len(came) // 4, len(came) // 2, len(came) * 3 // 4, len(came)]
    batches = [came[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    got = replay(spark, tmp_path, [*batches, rows[-1:]])
    assert sorted(got) == by_hand(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    batch = daily.runs_up_to(df, 5.0, F.lit(rows[-1][1] - datetime.timedelta(days=2))).select("series", "start", "end", "days", "maximum")
    assert sorted(map(tuple, batch.collect())) == by_hand(rows)


def test_a_late_day_joins_two_runs(spark, tmp_path):
    at = lambda day, v: ("a", FIRST + datetime.timedelta(days=day, hours=12), v)
    got = replay(spark, tmp_path, [[at(0, 9.0), at(2, 7.0)], [at(1, 8.0)], [at(10, 0.0)]])
    assert got == [("a", FIRST.date(), FIRST.date() + datetime.timedelta(days=2), 3, 9.0)]


def test_open_runs_and_days_are_held_back(spark, tmp_path):
    at = lambda day, v: ("a", FIRST + datetime.timedelta(days=day, hours=12), v)
    assert replay(spark, tmp_path, [[at(0, 9.0), at(1, 9.0)], [at(3, 9.0)]]) == []
