"""The streamed ledger, stopped and started again, tells what the table's does."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from quillstone.streaming import ledger as G

SCHEMA = "scope string, day date, at timestamp, id long, kind string, amount double"


def rows_of(seed, day, n=60):
    r = random.Random(seed)
    out, moment = [], dt.datetime(2024, 1, day)
    for i in range(n):
        moment += dt.timedelta(seconds=r.choice([0, 30, 600]))
        kind = r.choice(["reserve", "reserve", "reserve", "commit", "rollback"])
        out.append((r.choice("ab"), dt.date(2024, 1, day), moment, r.randrange(25), kind, r.choice([None, 10.0, 25.5, 60.0]) if kind != "reserve" else r.choice([10.0, 25.5, 60.0])))
    return out


def plain(rows, cap):
    """By the definition: one list in order, one dictionary."""
    out, accounts = Counter(), {}
    order = {"rollback": 0, "commit": 1, "reserve": 2}
    for scope, day, at, i, kind, amount in sorted(rows, key=lambda x: (x[2], order[x[4]], x[3])):
        a = accounts.setdefault((scope, day), {"spent": 0.0, "open": {}})
        if kind == "reserve":
            what = "repeated" if i in a["open"] else "admitted" if a["spent"] + sum(a["open"].values()) + amount <= cap else "refused"
            if what == "admitted":
                a["open"][i] = amount
        elif i not in a["open"]:
            what = "unknown"
        else:
            own = a["open"].pop(i)
            what = "committed" if kind == "commit" else "rolled back"
            a["spent"] += (own if amount is None else amount) if kind == "commit" else 0.0
        out[scope, day, at, i, kind, what, round(a["spent"], 6), round(sum(a["open"].values()), 6)] += 1
    return out


def told(df):
    return Counter((x.scope, x.day, x.at, x.id, x.kind, x.outcome, round(x.committed, 6), round(x.reserved, 6)) for x in df.collect())


def test_table(spark):
    rows = rows_of(1, 1) + rows_of(2, 2) + rows_of(3, 3, 400) + [(None, *x[1:]) for x in rows_of(4, 4)] + [(x[0], None, *x[2:]) for x in rows_of(5, 5)]
    assert told(G.settled(spark.createDataFrame(rows, SCHEMA), 150.0)) == plain(rows, 150.0)
    assert G.settled(spark.createDataFrame([], SCHEMA), 1.0).count() == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = sorted(rows_of(1, 1) + rows_of(2, 2), key=lambda x: x[2])
    parts = [rows[:40], rows[40:70], rows[70:]]
    # A part ends between moments, as rows of one moment are taken together.
    for k in (0, 1):
        while parts[k + 1] and parts[k][-1][2] == parts[k + 1][0][2]:
            parts[k].append(parts[k + 1].pop(0))

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        query = G.streamed(stream, 150.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    for part in parts:
        run(part)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert told(out) == plain(rows, 150.0)
    run([("a", dt.date(2024, 1, 9), dt.datetime(2024, 1, 9), 1, "reserve", 10.0)])
    # By now the watermark has passed the first days: what comes for them is too late.
    run([("a", dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 5), 99, "reserve", 1.0), ("b", dt.date(2024, 1, 9), dt.datetime(2024, 1, 9, 1), 2, "reserve", 500.0)])
    more = spark.read.parquet(f"{tmp_path}/out").where(F.col("day") == "2024-01-09").orderBy("id").collect()
    assert [(x.scope, x.outcome) for x in more] == [("a", "admitted"), ("b", "refused")] and spark.read.parquet(f"{tmp_path}/out").where("id = 99").count() == 0
