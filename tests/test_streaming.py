import pytest

from framewise.operators import stack as st
from framewise.streaming import live

SCHEMA = "k bigint, frame_id bigint, value double, coverage double"


@pytest.fixture()
def parts(spark, tmp_path):
    """The same samples as five files, so that a stream takes five batches."""
    rows = [(k, f, float((k * 7 + f * 13) % 50 + (500 if f == 3 and k == 1 else 0)), 1.0 if (k + f) % 4 else 0.5) for f in range(20) for k in range(6)]
    for i in range(5):
        spark.createDataFrame(rows[i::5], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    return batch, stream, str(tmp_path)


def same(got, want, columns):
    a, b = ({r["k"]: r for r in d.collect()} for d in (got, want))
    assert set(a) == set(b)
    for k in a:
        for c in columns:
            assert a[k][c] == pytest.approx(b[k][c]), (k, c)


@pytest.mark.parametrize("method", live.METHODS)
def test_live_stack_equals_batch(spark, parts, method):
    batch, stream, folder = parts
    df = live.live_stack(stream, ["k"], method)
    live.keep_latest(df, ["k"], folder, "out").awaitTermination()
    want = st.stack_average(batch, ["k"]) if method == "average" else st.stack_extreme(batch, ["k"], method)
    same(live.latest(spark, folder, "out", df.schema, ["k"]), want, ["value", "coverage", "samples"])


def test_repeated_samples_count_once(spark, parts):
    batch, stream, folder = parts
    batch.limit(40).coalesce(1).write.parquet(f"{folder}/in/again")
    df = live.live_stack_unique(stream, ["k"], ["k", "frame_id"])
    live.keep_latest(df, ["k"], folder, "once").awaitTermination()
    same(live.latest(spark, folder, "once", df.schema, ["k"]), st.stack_average(batch, ["k"]), ["value", "samples"])


def test_live_robust_equals_batch(spark, parts):
    batch, stream, folder = parts
    live.live_robust(stream, ["k"], folder, "robust", "winsorized", low=2.0, high=2.0).awaitTermination()
    want = st.stack_winsorized(batch, ["k"], low=2.0, high=2.0)
    same(live.latest(spark, folder, "robust-result", want.schema, ["k"]), want, ["value", "samples", "rejected_high"])


def test_arguments(spark, parts):
    _, stream, _ = parts
    with pytest.raises(ValueError):
        live.live_stack(stream, ["k"], "median")
    with pytest.raises(ValueError):
        live.live_stack(stream, ["k"], "max", weight="coverage")
    with pytest.raises(ValueError):
        live.unique_samples(stream, ["k"], "ts")
