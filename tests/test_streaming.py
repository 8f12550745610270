"""The stream's edges are those of the batch rules."""

import random

from lockweave.operators import held
from lockweave.streaming import held_stream


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(m % 2, m, off, rng.choice(["enter", "enter", "exit"]), rng.choice("ABCD")) for off in range(60) for m in range(6)]
    schema = "component long, m long, off long, op string, lock string"
    whole = spark.createDataFrame(rows, schema)
    for i in range(3):  # three files come one after the other, the last with a repeat of what was
        part = [r for r in rows if r[2] // 20 == i or i == 2 and r[2] == 25]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = held_stream.order_edges(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    effects = whole.selectExpr("m", "off", "lock", "if(op = 'enter', 1, -1) AS d")
    want = held.order_edges(whole.where("op = 'enter'").drop("op"), effects).select("component", "m", "off", "src", "dst").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
