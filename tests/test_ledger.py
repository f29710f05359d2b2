"""Ledgers that take each key once, tables replaced as a whole, claims with expiry, and repaired texts."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import fuzzy, text
from pagequarry.streaming import ledger

ROW = "doi string, field string, timestamp string, note string"


def source(spark, folder, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(ROW).json(str(folder))


def rows_of(spark, folder):
    return sorted((r["doi"], r["field"], r["note"]) for r in spark.read.parquet(folder).collect())


def test_a_ledger_takes_each_key_once(spark, tmp_path):
    folder, checkpoint, keys = f"file://{tmp_path}/ledger", str(tmp_path / "check"), ["doi", "field"]
    run = lambda stream: ledger.append_once(stream, folder, checkpoint, keys).awaitTermination()
    run(source(spark, tmp_path / "in", [("a", "f", "2", "late"), ("a", "f", "1", "first"), ("b", None, "1", "null key"), ("b", None, "2", "again")]))
    assert rows_of(spark, folder) == [("a", "f", "first"), ("b", None, "null key")]
    run(source(spark, tmp_path / "in", [("a", "f", "0", "known"), ("c", "f", "1", "new")]))
    want = [("a", "f", "first"), ("b", None, "null key"), ("c", "f", "new")]
    assert rows_of(spark, folder) == want
    # a crash after the write of the last batch, before it was noted as done: the batch is run again
    last = max((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(spark.readStream.schema(ROW).json(str(tmp_path / "in")))
    assert rows_of(spark, folder) == want
    # a crash within the write: part of the batch's folder is gone
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "ledger" / "batch=1")
    run(spark.readStream.schema(ROW).json(str(tmp_path / "in")))
    assert rows_of(spark, folder) == want


def test_a_table_is_replaced_as_a_whole(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/queue", "task string, n int"
    assert ledger.current(spark, folder, schema).count() == 0
    assert ledger.replace(spark.createDataFrame([("a", 1), ("b", 2)], schema), folder) == 1
    old = ledger.current(spark, folder, schema)
    assert ledger.replace(old.withColumn("n", F.col("n") + 1).where("task = 'a'"), folder) == 2
    assert [tuple(r) for r in ledger.current(spark, folder, schema).collect()] == [("a", 2)] and old.count() == 2
    (tmp_path / "queue" / "version=3").mkdir()  # a writer that died
    (tmp_path / "queue" / "version=3" / "part-0.parquet").write_bytes(b"broken")
    assert [tuple(r) for r in ledger.current(spark, folder, schema).collect()] == [("a", 2)]
    assert ledger.replace(spark.createDataFrame([("z", 9)], schema), folder) == 3
    assert [tuple(r) for r in ledger.current(spark, folder, schema).collect()] == [("z", 9)]


def test_claims_expire(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    batches = [
        [("t1", "claimed", "x", at(0)), ("t1", "claimed", "y", at(1)), ("t2", "claimed", "x", at(0)), ("t3", "claimed", "z", at(1)), ("t4", None, None, None)],
        [("t1", "claimed", "w", at(0)), ("t3", "done", "z", at(2)), ("t5", "claimed", "q", at(40))], [("t6", "claimed", "q", at(41))], [("t2", "claimed", "n", at(42))],
    ]
    seen, folder = [], tmp_path / "in"
    for batch in batches:
        spark.createDataFrame(batch, "task_id string, status string, agent_id string, claimed_at timestamp").coalesce(1).write.mode("append").parquet(str(folder))
        stream = ledger.claims_with_expiry(spark.readStream.schema(ledger.CLAIM).parquet(str(folder)), 24)
        run = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, n: seen.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
        run.awaitTermination()
    last = {}
    for task, status, agent, when in seen:
        last[task] = (status, agent, when)
    assert last["t1"] == ("reopened", None, at(1)) and last["t3"] == ("done", "z", at(2)) and "t4" not in last
    assert last["t2"] == ("claimed", "n", at(42)) and ("t2", "reopened", None, at(0)) in seen and last["t5"][0] == "claimed"
    assert [s for t, s, *_ in seen if t == "t3"].count("reopened") == 0


DAMAGED = ["Universität Zürich", "naïve café — “quoted”", "Łódź, Škoda", "日本語のテキスト", "€ 5 and ½", "emoji 🎉 here", "Ångström’s façade", "Привет, мир"]


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_round_trips_are_undone(spark, rounds):
    """What was read as code page 1252 (empty places as Latin 1 has them) once or more is restored."""
    def damaged(t):
        for _ in range(rounds):
            t = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode())
        return t

    df = spark.createDataFrame([(t, damaged(t)) for t in DAMAGED], "want string, got string")
    assert [r for r in df.select("want", text.repaired(F.col("got")).alias("r")).collect() if r["want"] != r["r"]] == []


def test_clean_texts_stay(spark):
    clean = [*DAMAGED, None, "", "plain", "Â", "ÃÉ", "São Paulo", "A – B", "x" * 5000]
    mixed = ("größer und grÃ¶ÃŸer", "größer und größer")
    df = spark.createDataFrame([(t, t) for t in clean] + [mixed], "got string, want string")
    assert [r for r in df.select("want", text.repaired(F.col("got")).alias("r")).collect() if r["want"] != r["r"]] == []
    assert spark.createDataFrame([("\r\n ;GrÃ¼n; ",)], "m string").select(text.stripped_message(F.col("m"))).first()[0] == "Grün"


def test_edits_against_the_table():
    import random

    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
        assert fuzzy.edits(a, b) == row[-1], (a, b)
    assert fuzzy.edits("a" * 100_000, "b" + "a" * 100_000) == 1 and fuzzy.edited("", "") == 1.0
