from conftest import one, rows
from pyspark.sql import functions as F

from worksignal.plans.map_plan import mail_facts
from worksignal.session import fresh_path
from worksignal.sources import runs
from worksignal.streaming import day_stream, progress, quiet_sender

_MAIL = "tenant_id string, date_key string, from_hdr string, subject string, body string, is_hot boolean"


def _arrive(spark, path, items):
    for item in items:  # one file each, so a batch can hold one item
        spark.createDataFrame([item], _MAIL).coalesce(1).write.mode("append").parquet(path)


def _mail_stream(spark, path, per_batch=None):
    reader = spark.readStream.schema(_MAIL)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path)


def test_a_day_counts_all_its_mail_however_it_is_batched(spark):
    items = [("t", "2024-05-01", f"{k}@x.org", s, "b", k == "c") for k, s in (("a", "x"), ("b", "re: x"), ("c", "y"))]
    items.append(("t", "2024-05-02", "a@x.org", "z", "b", False))
    path = fresh_path(spark, "arrivals")
    _arrive(spark, path, items)
    ledgers = []
    for per_batch in (1, None):
        ledger, state = fresh_path(spark, "ledger"), fresh_path(spark, "state")
        late = day_stream.run_ledger_stream(_mail_stream(spark, path, per_batch), ledger, state, "email", mail_facts)
        assert late.count() == 0
        ledgers.append(rows(runs.read_table(spark, ledger, "entries"), "tenant_id", "day", "item_count", "hot"))
    assert ledgers[0] == ledgers[1] == [("t", "2024-05-01", 3, True), ("t", "2024-05-02", 1, False)]
    _arrive(spark, path, [("t", "2024-05-01", "d@x.org", "late", "b", False), ("t", "2024-05-03", "d@x.org", "new", "b", False)])
    late = day_stream.run_ledger_stream(_mail_stream(spark, path, 1), ledger, state, "email", mail_facts)
    assert rows(late, "date_key", "n_late") == [("2024-05-01", 1)]  # of this run's arrivals only
    assert rows(runs.read_table(spark, ledger, "entries"), "day", "item_count") == [("2024-05-01", 3), ("2024-05-02", 1), ("2024-05-03", 1)]


def test_a_sender_quiet_twice_keeps_all_counts(spark):
    path = fresh_path(spark, "seen")
    schema = "tenant_id string, email string, seen timestamp"
    for day in ("2024-05-01", "2024-05-09", "2024-05-10", "2024-05-11", "2024-05-30", "2024-05-31"):
        sender = "a@x.org" if day in ("2024-05-01", "2024-05-11") else "b@x.org"
        one = spark.createDataFrame([("t", sender, day)], "tenant_id string, email string, day string")
        one.select("tenant_id", "email", F.to_timestamp("day").alias("seen")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    quiet = quiet_sender.quiet_sender_stream(stream, 3)
    got = day_stream.settle(quiet, fresh_path(spark, "quiet"), fresh_path(spark, "quiet-state"))
    told = rows(got.filter("email = 'a@x.org'"), "item_count", F.to_date("last_seen").cast("string"), F.to_date("first_seen").cast("string"))
    assert told == [(1, "2024-05-01", "2024-05-01"), (2, "2024-05-11", "2024-05-01")]


def test_arrivals_of_a_run_that_died_are_taken_once(spark, monkeypatch):
    path, ledger, state = (fresh_path(spark, name) for name in ("arrivals", "ledger", "state"))
    _arrive(spark, path, [("t", "2024-05-01", f"{k}@x.org", "s", "b", False) for k in "ab"])
    for name in ("write_rows", "commit"):
        with monkeypatch.context() as patch:
            patch.setattr(runs, name, lambda *a, **k: 1 / 0)
            try:
                day_stream.run_ledger_stream(_mail_stream(spark, path, 1), ledger, state, "email", mail_facts)
            except ZeroDivisionError:
                pass
        assert runs.read_table(spark, ledger, "entries").count() == 0
    _arrive(spark, path, [("t", "2024-05-01", "c@x.org", "s", "b", False)])
    with monkeypatch.context() as patch:  # dies once its days are committed
        patch.setattr(day_stream, "discard", lambda *a: 1 / 0)
        try:
            day_stream.run_ledger_stream(_mail_stream(spark, path, 1), ledger, state, "email", mail_facts)
        except ZeroDivisionError:
            pass
    late = day_stream.run_ledger_stream(_mail_stream(spark, path, 1), ledger, state, "email", mail_facts)
    assert late.count() == 0
    assert rows(runs.read_table(spark, ledger, "entries"), "day", "item_count") == [("2024-05-01", 3)]


def test_silent_senders_are_forgotten(spark):
    path, log = fresh_path(spark, "seen"), fresh_path(spark, "log")
    days = ["2024-05-01", "2024-05-02", "2024-05-20", "2024-05-21", "2024-06-20", "2024-06-21"]
    for k, day in enumerate(days):
        sender = "a@x.org" if k in (0, 4) else f"{k}@x.org"
        one = spark.createDataFrame([("t", sender, day)], "tenant_id string, email string, day string")
        one.select("tenant_id", "email", F.to_timestamp("day").alias("seen")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("tenant_id string, email string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    quiet = quiet_sender.quiet_sender_stream(stream, 3, forget_days=10)
    got = day_stream.settle(quiet, fresh_path(spark, "quiet"), fresh_path(spark, "quiet-state"), log)
    # a@x.org was forgotten in May, so June counts anew; nobody is told of twice for one silence.
    assert rows(got, "email", "item_count") == [("1@x.org", 1), ("2@x.org", 1), ("3@x.org", 1), ("a@x.org", 1)]
    told = {r.batch_id: r.state_rows for r in progress.read_progress(spark, log).collect()}
    sizes = [told[k] for k in sorted(told)]
    assert max(sizes) >= 2 and sizes[-1] < max(sizes)


def test_progress_counts_late_rows_and_listeners_log_it(spark):
    path, log, own = (fresh_path(spark, name) for name in ("arrivals", "log", "own"))
    schema = "id long, at timestamp"
    state, out = fresh_path(spark, "state"), fresh_path(spark, "out")
    listener = progress.ProgressLog(spark, log)
    spark.streams.addListener(listener)
    try:
        for ids, day in (((1, 2), "2024-05-20"), ((3, 4, 5), "2024-05-01"), ((6, 6), "2024-05-20")):
            some = spark.createDataFrame([(i, day) for i in ids], "id long, day string")
            some.select("id", F.to_timestamp("day").alias("at")).coalesce(1).write.mode("append").parquet(path)
            first = day_stream.first_of_each(spark.readStream.schema(schema).parquet(path), "at", "2 days", ["id"])
            day_stream.settle(first, out, state, own)
        for _ in range(100):  # listeners are told a little later
            if progress.read_progress(spark, log).agg(F.sum("input_rows")).first()[0] == 7:
                break
    finally:
        spark.streams.removeListener(listener)
    for table in (own, log):
        assert one(progress.read_progress(spark, table).agg(F.sum("input_rows"), F.sum("late_rows"))) == (7, 3)
    assert rows(spark.read.schema(schema).parquet(out), "id") == [(1,), (2,), (6,)]


def test_a_senders_mail_is_one_row_of_a_task():
    import pandas as pd

    batch = pd.DataFrame({"tenant_id": ["t", "t"], "email": ["a", "b"], "seen": [pd.Timestamp(5, unit="us")] * 2, "us": [5, 6]})
    (merged,) = quiet_sender._pre_aggregate(iter([batch, batch.assign(us=9, seen=pd.Timestamp(9, unit="us")), batch.head(1)]))
    assert merged[["email", "item_count", "first_us", "last_us"]].values.tolist() == [["a", 3, 5, 9], ["b", 2, 6, 9]]
    assert list(merged["seen"]) == [pd.Timestamp(9, unit="us")] * 2


def test_a_new_sender_costs_three_calls_of_the_state():
    from pyspark.sql import Row

    class State:
        def __init__(self):
            self.calls, self.value, self.timers = [], None, [1]

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                self.value = args[0] if name == "update" else self.value
                return {"get": self.value, "listTimers": self.timers, "exists": self.value is not None}.get(name)

            return call

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    state, senders = State(), quiet_sender.QuietSenders(3, 365)
    senders._handle = senders._seen = state
    rows_in = [Row(item_count=2, first_us=5, last_us=8), Row(item_count=1, first_us=4, last_us=6)]
    assert list(senders.handleInputRows(("t", "a"), iter(rows_in), Times())) == []
    assert state.value == (3, 4, 8, False) and state.calls == ["get", "update", "registerTimer"]
    list(senders.handleInputRows(("t", "a"), iter(rows_in), Times()))
    assert state.value == (6, 4, 8, False) and state.calls[3:] == ["get", "update", "listTimers", "deleteTimer", "registerTimer"]
