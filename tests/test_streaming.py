from entiquery import Component, Double, Program, System, World, match
from entiquery.streaming.driver import FrameStream, upsert


class Value(Component):
    value: Double


class Total(Component):
    value: Double


class Collect(System):
    writes = (Total,)

    def run(self, ctx, id, total, value):
        return {Total: {"value": total.value + value.value}}


def test_each_batch_is_a_frame(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0, 1), (2, 5.0, 1)], "id long, value double, at int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    world = World(spark)
    world.put(Total, {1: Total(value=0.0), 2: Total(value=0.0), 3: Total(value=0.0)})
    frames = FrameStream(Program(match(Total, Value).foreach(Collect()), double=True), world)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = frames.start(stream, upsert(Value, "at"), str(tmp_path / "check"))
    q.processAllAvailable()
    spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (3, 7.0, 1)], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["value"] for r in frames.world.rows(Total).collect()} == {1: 21.0, 2: 10.0, 3: 7.0}
    done = frames.last
    frames.step(rows, done, upsert(Value, "at"))  # delivered again
    assert {r["id"]: r["value"] for r in frames.world.rows(Total).collect()} == {1: 21.0, 2: 10.0, 3: 7.0}
