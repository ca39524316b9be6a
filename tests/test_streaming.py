import datetime as dt

from evidloom.operators.ledger import append_chain
from evidloom.streaming import ledger as L


def drain(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}")


def test_chains_are_checked_as_they_arrive(spark, tmp_path):
    events = spark.createDataFrame([(c, i, f"b{i}") for c in ("p", "q") for i in range(20)], "chain string, at int, body string")
    chain = append_chain(events, ["chain"], ["body"], ["at"]).where("not (chain = 'q' and sequence = 5)")
    path = f"{tmp_path}/events"
    for low, high in ((1, 8), (8, 30)):
        chain.where(f"sequence >= {low} and sequence < {high}").coalesce(1).write.mode("append").parquet(path)
    stream = L.check_chains(spark.readStream.schema(chain.schema).option("maxFilesPerTrigger", 1).parquet(path), "chain")
    assert [tuple(r) for r in drain(spark, stream, "chain_problems").collect()] == [("q", 6, "sequence")]


def test_windows_and_repeats(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h, tzinfo=dt.UTC)
    rows = spark.createDataFrame([(1, t(1), "a"), (1, t(1), "a"), (2, t(2), "b"), (3, t(3), "a")], "id long, at timestamp, kind string")
    path = f"{tmp_path}/rows"
    rows.coalesce(1).write.parquet(path)
    read = lambda: spark.readStream.schema(rows.schema).parquet(path)
    assert drain(spark, L.without_repeats(read(), ["id"], "at"), "no_repeats").count() == 3
    counts = {(r.kind, r.n) for r in drain(spark, L.windowed_counts(read(), "at", "kind"), "windowed", "complete").collect()}
    assert counts == {("a", 3), ("b", 1)}
