import datetime

from gridmark.streaming.incremental import running_quantities


def test_each_bar_once(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 8, 0)
    rows = [(t, "a", "plan", "S-1", "c-1", "25m", 4), (t, "a", "plan", "S-1", "c-1", "25m", 4), (t, "b", "atelier", "s1", "C1", "25M", 3)]
    schema = "event_time timestamp, id string, source string, feuillet string, element string, diametre string, quantite int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = running_quantities(stream).writeStream.outputMode("append").format("memory").queryName("running").start()
    q.processAllAvailable()
    later = [(t + datetime.timedelta(hours=5), "z", "plan", "S-9", "Z", "10M", 1)]
    spark.createDataFrame(later, schema).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    got = [(r.feuillet_n, r.element_n, r.diametre, r.plan, r.atelier, r.n) for r in spark.sql("select * from running").collect()]
    assert ("S1", "C1", "25M", 4, 3, 2) in got and len(got) <= 2
