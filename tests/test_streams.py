"""State by contig: streams give what tables give, across batches and restarts; disorder is an error."""

import random

import pytest
from genoframe.streaming import contigs
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQueryException

SCHEMA = "chrom string, pos long, rec long, span long, ac double, is_snp boolean, is_indel boolean"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(contigs._PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(contigs._PROVIDER)


def drawn(seed):
    rng = random.Random(seed)
    rows, rec = [], 0
    for chrom in "ab":
        pos = 1
        for _ in range(150):
            pos += rng.choice([0, 1, 2, 3, 9, 30])
            indel = rng.random() < 0.3
            rows.append((chrom, pos, rec, rng.choice([1, 2, 8, 40]) if indel else 1, float(rng.randint(0, 4)) if rng.random() < 0.9 else None, not indel and rng.random() < 0.9, indel))
            rec += 1
        rows.append((chrom, 10**9, None, None, None, None, None))
    return rows


def run(spark, folder, checkpoint, make):
    """All files there are, one a batch, from where the run before ended; what all runs have given."""
    stream = make(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    out = f"{checkpoint}-out"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()]


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("what", ["snp_gap", "indel_gap"])
def test_stream_equals_table_across_batches_and_restarts(rocksdb, tmp_path, what):
    spark, rows = rocksdb, drawn(3)
    gap = 5
    table = spark.createDataFrame([r for r in rows if r[2] is not None], SCHEMA)
    pick = (lambda df: df.filter("is_indel or rec is null")) if what == "indel_gap" else (lambda df: df)
    make = lambda df: getattr(contigs, what)(pick(df), gap)
    cuts = sorted(random.Random(5).sample(range(1, len(rows)), 6))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    got = []
    for batch in (parts[:3], parts[3:]):  # the second run goes on from the first one's state
        for part in batch:
            write(spark, part, tmp_path / "in")
        got = run(spark, tmp_path / "in", tmp_path / "state", make)
    assert sorted(got) == sorted(tuple(r) for r in make(table).collect()) and len(set(got)) == len(got)


def test_disorder_is_an_error(rocksdb, tmp_path):
    spark = rocksdb
    write(spark, [("a", 50, 1, 1, 1.0, True, False)], tmp_path / "in")
    run(spark, tmp_path / "in", tmp_path / "state", lambda df: contigs.snp_gap(df, 3))
    write(spark, [("a", 49, 2, 1, 1.0, True, False)], tmp_path / "in")
    with pytest.raises(StreamingQueryException, match="not in order"):
        run(spark, tmp_path / "in", tmp_path / "state", lambda df: contigs.snp_gap(df, 3))


def test_the_store_is_asked_for(spark, tmp_path):
    write(spark, [("a", 50, 1, 1, 1.0, True, False)], tmp_path / "in")
    with pytest.raises(ValueError, match="RocksDB"):
        contigs.snp_gap(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 3)
