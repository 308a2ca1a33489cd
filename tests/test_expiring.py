"""State that expires: streams with events out of order against plain folds, state read back, nothing at all."""

import datetime
import random

from pyspark.sql import functions as F

from spindrift.streaming import expiring as X

START = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id long, category string, ts timestamp, event_id long, kind string"


def written(spark, rows, schema, path, files):
    """Rows as files of a stream, in order of their names and times."""
    for i, part in enumerate(files):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03}")
    return X.session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def shuffled(n, rng, reach):
    """Positions in order, each moved by up to reach."""
    order = sorted(range(n), key=lambda i: i + rng.uniform(0, reach))
    return [order[i : i + 20] for i in range(0, n, 20)]


def test_counters_with_events_out_of_order(spark, tmp_path):
    rng = random.Random(2)
    at = 0
    rows = []
    for i in range(160):
        at += rng.choice([1, 5, 20, 20, 3000])
        rows.append((rng.choice([1, 2, None]), rng.choice(["a", "b"]), START + datetime.timedelta(minutes=at), i, rng.choice(["add", "add", "take", "else"])))
    rows.append((9, "z", START + datetime.timedelta(minutes=at + 3 * 1440), 999, "add"))  # moves the watermark past all others
    files = [*shuffled(160, rng, 2.5), [160]]
    stream = written(spark, rows, SCHEMA, str(tmp_path / "in"), files)
    step = F.when(F.col("kind") == "add", 1).when(F.col("kind") == "take", -1)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    X.run_to_end(X.counters(stream, step, 2 * 86400, "2 days"), out, state, "update")
    counts, last = {}, {}
    late = rows[-1][2] - datetime.timedelta(days=2)
    for user, category, ts, _, kind in rows[:-1]:
        if kind != "else" and ts <= late:
            k = (user, category)
            n = 0 if k in last and ts - last[k] > datetime.timedelta(days=2) else counts.get(k, 0)
            counts[k], last[k] = max(0, n + (1 if kind == "add" else -1)), ts
    want = {k: n for k, n in counts.items() if n and late - last[k] <= datetime.timedelta(days=2)}
    got = {(r["user_id"], r["category"]): r["n"] for r in X.last_of_each(spark.read.parquet(out), "user_id", "category").where("n > 0").collect()}
    assert got == want
    held = X.session(spark).read.format("statestore").option("stateVarName", "held").load(state)
    assert {(r["key"]["user_id"], r["key"]["category"]): r["value"]["n"] for r in held.collect() if r["value"]["n"]} == want


def test_cache_with_lifetimes(spark, tmp_path):
    minute = lambda m: START + datetime.timedelta(minutes=m)
    schema = "key string, ts timestamp, event_id long, op string, value string, seconds long"
    rows = [
        ("k", minute(5), 2, "get", None, None), ("k", minute(0), 1, "put", "one", 600), ("k", minute(10), 3, "get", None, None), ("k", minute(11), 4, "get", None, None),
        ("k", minute(12), 5, "put", "two", None), ("k", minute(13), 6, "get", None, None), ("k", minute(20), 7, "put", "three", 6000), ("k", minute(21), 8, "delete", None, None), ("k", minute(22), 9, "get", None, None),
        ("q", minute(3), 10, "get", None, None), (None, minute(4), 11, "put", "x", 60), (None, minute(4), 12, "get", None, None), ("end", minute(900), 13, "put", "", 1),
    ]
    stream = written(spark, rows, schema, str(tmp_path / "in"), [range(6), range(6, 12), [12]])
    out = str(tmp_path / "out")
    X.run_to_end(X.cache_reads(stream, "1 hour"), out, str(tmp_path / "state"), "append")
    got = {r["event_id"]: r["value"] for r in spark.read.parquet(out).collect()}
    assert got == {2: "one", 3: "one", 4: None, 6: None, 9: None, 10: None, 12: "x"}


def test_counters_of_a_user_share_a_state(spark, tmp_path):
    rng, at, rows = random.Random(5), 0, []
    for i in range(120):
        at += rng.choice([1, 5, 20, 3000])
        rows.append((rng.choice([1, 2, None]), rng.choice(["a", "b", None]), START + datetime.timedelta(minutes=at), i, rng.choice(["add", "add", "take", "else"])))
    rows.append((9, "z", START + datetime.timedelta(minutes=at + 2 * 1440), 999, "add"))  # moves the watermark to the last of the others
    stream = written(spark, rows, SCHEMA, str(tmp_path / "in"), [*shuffled(120, rng, 2.5), [120]])
    step = F.when(F.col("kind") == "add", 1).when(F.col("kind") == "take", -1)
    got = []
    for i, count in enumerate((X.counters, X.user_counters)):
        out = str(tmp_path / f"out{i}")
        X.run_to_end(count(stream, step, 2 * 86400, "2 days"), out, str(tmp_path / f"state{i}"), "update")
        got.append(sorted(map(str, X.last_of_each(spark.read.parquet(out), "user_id", "category").where("n > 0").collect())))
    assert got[0] == got[1] and got[0]
    held = X.session(spark).read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "state1"))
    users = [r["key"]["user_id"] for r in held.collect()]
    assert len(users) == len(set(users))


def test_the_callers_settings_stay(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    own = X.session(spark)
    assert "RocksDB" in own.conf.get("spark.sql.streaming.stateStore.providerClass") and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


class Told:
    """A key's state and timers in memory, which counts the messages that a real one would be sent."""

    def __init__(self):
        self.messages, self.timers, self.value, self.rows = 0, set(), None, []

    def getValueState(self, name, schema):
        return self

    def getListState(self, name, schema):
        return Waiting(self)

    def registerTimer(self, at):
        self.messages += 1
        self.timers.add(at)

    def exists(self):
        self.messages += 1
        return self.value is not None

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages += 1
        self.value = value

    def clear(self):
        self.messages += 1
        self.value = None

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def passed(self, processor, key, watermark):
        """Rows of the timers that are due by a watermark."""
        self.watermark, out = watermark, []
        while due := [t for t in self.timers if t <= watermark]:
            out += [row for t in due for row in processor.handleExpiredTimer(key, self, t)]
            self.timers.difference_update(due)
        return out


class Waiting:
    def __init__(self, told):
        self.told = told

    def appendValue(self, row):
        self.appendList([row])

    def appendList(self, rows):
        self.told.messages += 1
        self.told.rows += rows

    def put(self, rows):
        self.told.messages += 1
        self.told.rows = list(rows)

    def get(self):
        self.told.messages += 1
        return iter(self.told.rows)

    def clear(self):
        self.put([])


def test_a_key_of_many_events_takes_few_messages():
    told, counter, hour = Told(), X.Counter(3600), 3_600_000
    counter.init(told)
    rows = [{"at": (7 * i % 400) * 1_000_000, "event_id": i, "step": 1} for i in range(400)]
    assert list(counter.handleInputRows((1, "a"), iter(rows), None)) == [] and told.messages <= 2  # 800 before
    assert [r["n"] for r in told.passed(counter, (1, "a"), 99_500)] == [100] and told.messages <= 10
    assert [r["n"] for r in told.passed(counter, (1, "a"), 399_000)] == [400] and told.messages <= 20  # some 2,800 before
    assert list(counter.handleInputRows((1, "a"), iter([{"at": 400_000_000, "event_id": 400, "step": -1}]), None)) == []
    assert [r["n"] for r in told.passed(counter, (1, "a"), 400_000)] == [399] and told.passed(counter, (1, "a"), 400_000 + hour) == []
    assert [r["n"] for r in told.passed(counter, (1, "a"), 400_001 + hour)] == [0] and told.value is None and not told.timers and told.messages <= 40


def test_a_user_of_many_categories_takes_few_messages():
    told, counter, hour = Told(), X.UserCounters(3600), 3_600_000
    counter.init(told)
    rows = [{"at": (7 * i % 400) * 1_000_000, "event_id": i, "step": 1, "category": f"c{i % 40}" if i % 40 else None} for i in range(400)]
    assert list(counter.handleInputRows((1,), iter(rows), None)) == [] and told.messages <= 2
    got = told.passed(counter, (1,), 399_000)
    assert len(got) == 40 and {r["n"] for r in got} == {10} and told.messages <= 10  # some 240 with a state a category
    gone = told.passed(counter, (1,), 399_001 + hour)
    assert {r["category"] for r in gone} == {None, *(f"c{i}" for i in range(1, 40))} and {r["n"] for r in gone} == {0} and told.value is None and not told.timers
