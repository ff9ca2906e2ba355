import pytest

from mdframe import Engine, QueryError
from mdframe.streaming import start, watermarked

SCHEMA = "id long, kind string, ts timestamp, n long"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("id", "concat('k', id % 3) kind", "timestamp_seconds(id * 60) ts", "id % 7 n")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    e = Engine(spark)
    e.register("s", watermarked(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "ts", "1 hour"))
    e.register("b", rows)
    query = "select kind, count(*) as n, sum(n) as s from {} where id > 10 group by kind"
    q = start(e, query.format("s"), "out1", "complete", str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("out1").collect())) == sorted(map(tuple, e.sql(query.format("b")).frame.collect()))
    q = start(e, 'select id, upper(kind) as k from s where kind = "k1"', "out2")
    q.processAllAvailable()
    q.stop()
    assert spark.table("out2").count() == 67
    with pytest.raises(QueryError):
        start(e, "select id from b", "out3")
