import pytest
from pyspark.sql import functions as F

from hushframe.operators.anonymize_table import anonymize_table
from hushframe.streaming.tokens import StreamTokens

ROWS = [(k, f"user{k % 7}@example.com", f"+420 602 111 {k % 5:03d}", k * 1.5) for k in range(40)]
SCHEMA = "id long, email string, telefon string, amount double"


def test_batches_have_the_tokens_of_one_table(spark, tmp_path, as_of):
    table = spark.createDataFrame(ROWS, SCHEMA)
    whole = sorted(map(tuple, anonymize_table(table, ["id"], "strict", as_of).table.collect()))
    made = StreamTokens(spark, str(tmp_path / "tokens"), ["id"], "strict", as_of)
    parts = [made.anonymize(table.where(F.col("id").between(a, b)), n).table.collect() for n, (a, b) in enumerate([(0, 2), (3, 3), (4, 39)])]
    got = sorted(tuple(r) for p in parts for r in p)
    # Within one batch columns are numbered one after the other; here each type has one column, so rows decide.
    assert got == whole
    entries = made.entries().collect()
    assert len({(e["pii_type"], e["token_no"]) for e in entries}) == len(entries) == 12
    assert {e["batch"] for e in entries} == {0, 1, 2}


def test_a_batch_that_runs_again_keeps_its_tokens(spark, tmp_path, as_of):
    table = spark.createDataFrame(ROWS, SCHEMA)
    made = StreamTokens(spark, str(tmp_path / "tokens"), ["id"], "strict", as_of)
    first = sorted(map(tuple, made.anonymize(table.where("id < 5"), 0).table.collect()))
    second = sorted(map(tuple, made.anonymize(table.where("id >= 5"), 1).table.collect()))
    before = sorted(map(tuple, made.entries().collect()))
    assert sorted(map(tuple, made.anonymize(table.where("id >= 5"), 1).table.collect())) == second
    assert sorted(map(tuple, made.anonymize(table.where("id < 5"), 0).table.collect())) == first
    # A batch whose dictionary was not finished is numbered anew, as if it had never run.
    (tmp_path / "tokens/batch=1/_SUCCESS").unlink()
    assert sorted(map(tuple, made.anonymize(table.where("id >= 5"), 1).table.collect())) == second
    assert sorted(map(tuple, made.entries().collect())) == before


@pytest.mark.parametrize("broken", [False, True])
def test_a_stream_goes_on_where_it_was(spark, tmp_path, as_of, broken):
    table = spark.createDataFrame(ROWS, SCHEMA)
    made = StreamTokens(spark, str(tmp_path / "tokens"), ["id"], "strict", as_of)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        made.start(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()

    table.where("id < 3").write.parquet(str(tmp_path / "in"))
    run()
    table.where("id >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    if broken:
        # The last batch was done, but the stream does not know: it runs again.
        for f in (tmp_path / "checkpoint/commits").glob("*1*"):
            f.unlink()
        run()
    out = spark.read.parquet(str(tmp_path / "out"))
    whole = anonymize_table(table, ["id"], "strict", as_of).table
    assert out.count() == 40
    assert sorted(map(tuple, out.select("email", "telefon").collect())) == sorted(map(tuple, whole.select("email", "telefon").collect()))
    assert dict(out.dtypes)["amount"] == "string"
