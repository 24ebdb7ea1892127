"""Frames over Spark, the size model against the kernels, sources and streams."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalane import queries
from stratalane.config import BY_ID, Config, FrameError
from stratalane.operators import frames, sizes
from stratalane.plans import blocks
from stratalane.sources.datasource import FramesSource
from stratalane.sources.files import CODECS, PARQUET, baselines, numeric, read_binary, totals, widened, write_csv

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = []
    for k in range(5000):
        null = k % 7 == 3
        rows.append((k, None if null else k * 3, float(k % 100) / 4 if k % 5 else None, k % 3 == 0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), None))
    return spark.createDataFrame(rows, "pos long, a long, b double, c boolean, t timestamp_ntz, z int")


@pytest.mark.parametrize("cfg", [Config("fastest", block_size=64), Config("fast", block_size=1024), Config("balanced"), Config("max", "sample"), Config("max")])
def test_round_trip_with_nulls(spark, mixed, cfg):
    cols = ["a", "b", "c", "t", "z"]
    got = {(r.col, r.pos): r.lane for r in frames.decode(frames.encode(mixed, cols, cfg)).collect()}
    want = {(r.col, r.pos): r.lane for r in blocks.lanes(mixed, cols).collect()}
    assert got == want


def test_size_model_equals_payloads(spark, mixed):
    df = mixed.where("a is not null and b is not null").drop("z")
    df = blocks.number(df.drop("pos"), ["t"])
    rows = queries.with_value(blocks.in_blocks(blocks.lanes(df, ["a", "b", "t"]), 2048))
    model = {}
    for name, make in [("RAW", sizes.simple), ("CONST", sizes.simple), ("STRIDE", sizes.simple), ("XORZ", sizes.simple), ("FOR", sizes.simple), ("DELTA_BP", sizes.simple), ("RLE", sizes.rle), ("DICT", sizes.dictionary), ("FLOAT_MULT", sizes.scaled), ("ALP", sizes.alp), ("ALP_RD", sizes.alp_rd)]:
        for r in make(rows).select("col", "block", F.col(name).alias("s")).where("s is not null").collect():
            model[name, r.col, r.block] = r.s
    for name in {k[0] for k in model}:
        for r in frames.encode(df, ["b"] if name.startswith("ALP") else ["a", "b", "t"], Config("fast", block_size=2048), forced=name).collect():
            if BY_ID[r["mode"]].name == name:
                assert model[name, r.col, r.first // 2048] == len(r.payload), (name, r.col)
            else:
                assert (name, r.col, r.first // 2048) not in model


def test_winners_are_what_is_written(spark, mixed):
    """The plan's winners against the encoder's, on shapes that each encoding wins; and one shuffle for all but ALP."""
    n = 6000
    df = spark.range(n).selectExpr("id as pos", "id * 7 as ramp", "5L as same", "id div 300 as runs", "(id * 7919) % 13 * 100000000 as few", "xxhash64(id) as noise", "id * id as rising", "cast(id % 997 as double) / 100 as cents", "sqrt(cast(id as double)) as roots", "cast(shiftrightunsigned(xxhash64(id), 12) as double) / 4503599627370496 + 1 as unit")
    cols = [c for c in df.columns if c != "pos"]
    rows = queries.with_value(blocks.in_blocks(blocks.lanes(df, cols), 2048))
    for level in ("fastest", "fast"):
        plan = {(r.col, r.block): (r.mode, r.payload) for r in sizes.winners(rows, level).collect()}
        got = {(r[0], r[1] // 2048): (BY_ID[r[2]].name, r[3]) for r in frames.encode(df, cols, Config(level, block_size=2048)).selectExpr("col", "`first`", "mode", "length(payload)").collect()}
        assert plan == got
    assert {m for m, _ in plan.values()} >= {"STRIDE", "CONST", "RAW", "DELTA_BP", "FLOAT_MULT"}
    text = sizes.measure(rows, "fast")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_wrapping(spark):
    from stratalane.functions import lanes as L

    edge = [0, 1, -1, 2**63 - 1, -(2**63), 0x9E3779B97F4A7C15 - 2**64]
    df = spark.createDataFrame([(a, b) for a in edge for b in edge], "a long, b long")
    out = df.select("a", "b", L.wrap_sub(F.col("a"), F.col("b")).alias("s"), L.wrap_add(F.col("a"), F.col("b")).alias("p"), L.zigzag(F.col("a")).alias("z"), L.unzigzag(L.zigzag(F.col("a"))).alias("u"), L.bucket(F.col("a")).alias("h"), L.bit_width(F.col("a")).alias("w"), L.varint_len(F.col("a")).alias("v"))
    for r in out.collect():
        assert r.s == (r.a - r.b + 2**63) % 2**64 - 2**63 and r.p == (r.a + r.b + 2**63) % 2**64 - 2**63
        assert r.u == r.a and r.h == (r.a * 0x9E3779B97F4A7C15 % 2**64) >> 50
        assert r.w == (r.a % 2**64).bit_length() and r.v == max(1, -(-r.w // 7))


def test_corrupt_frames(spark, mixed):
    got = frames.encode(mixed, ["a"], Config("fast")).withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="checksum"):
        frames.decode(got).collect()
    assert all(r.error for r in frames.decode(got, permissive=True).collect())


def test_empty(spark, mixed):
    assert frames.decode(frames.encode(mixed.where("false"), ["a"], Config("max"))).count() == 0


def test_validity_size(spark, mixed):
    (r,) = sizes.validity(blocks.lanes(mixed, ["a"]), size=512).collect()
    valid = np.array([k % 7 != 3 for k in range(5000)])
    raw = frames.pack_validity(valid)
    assert r.bytes == len(raw) + 2 and r.nulls == int((~valid).sum())


@pytest.mark.parametrize("adaptive,partitions", [("true", 4), ("true", 8), ("true", 200), ("false", 8)])
def test_number_is_dense(spark, adaptive, partitions):
    n = 600_000
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id"), (F.col("id") * 3).alias("three"), F.rand(5).alias("r"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = blocks.number(df, ["k"])
        r = got.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.count_distinct("id"), F.sum((F.col("three") != 3 * F.col("id")).cast("int"))).first()
        assert tuple(r) == (n, n, 0, n - 1, n, 0)
        key = got.groupBy("k").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n"))
        assert key.where("b - a + 1 <> n").count() == 0
        ends = [(x.a, x.b) for x in key.orderBy("k").collect()]
        assert all(p[1] + 1 == q[0] for p, q in zip(ends, ends[1:]))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_rejects_strings(spark):
    with pytest.raises((TypeError, KeyError)):
        blocks.lanes(spark.createDataFrame([(0, "x")], "pos long, s string"), ["s"])
    assert numeric(spark.createDataFrame([(0, "x")], "pos long, s string")).columns == ["pos"]


def test_data_source(spark, mixed, tmp_path):
    spark.dataSource.register(FramesSource)
    path = str(tmp_path / "frames")
    coded = frames.encode(mixed, ["a", "b"], Config("fast", block_size=512))
    for mode, rows in (("overwrite", 10000), ("overwrite", 10000), ("append", 20000), ("overwrite", 10000)):
        coded.write.format("stratalane").mode(mode).save(path)
        got = spark.read.format("stratalane").load(path)
        assert got.count() == rows
    failing = coded.withColumn("n", F.expr("if(first > 2000, raise_error('no'), n)"))
    with pytest.raises(Exception):
        failing.write.format("stratalane").mode("append").save(path)
    assert got.count() == 10000 and not [x for x in (tmp_path / "frames").iterdir() if not x.name.endswith(".parquet")]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    got = spark.read.format("stratalane").option("skip", "true").load(path)
    part = got.where("col = 'a' and lane between 600 and 900")
    assert {r.lane for r in part.collect()} == {k * 3 for k in range(200, 301) if k % 7 != 3}


def test_binary_and_baselines(spark, mixed, tmp_path):
    v = np.arange(1000) / 7
    (tmp_path / "x.bin").write_bytes(v.astype("<f8").tobytes())
    got = read_binary(spark, str(tmp_path / "x.bin")).orderBy("pos").collect()
    assert [r.value for r in got] == v.tolist()
    sized = baselines(blocks.lanes(mixed.where("a is not null"), ["a", "t"]))
    assert {r.codec for r in sized.collect()} == {*CODECS, *PARQUET, "bitshuffle-lz4"} and all(0 < r.bytes < r.raw for r in sized.where("codec not like 'parquet%'").collect())
    assert all(abs(r.ratio - r.raw / r.bytes) < 1e-6 for r in totals(sized).collect())
    (tmp_path / "x.bin").write_bytes(v.astype("<f8").tobytes()[:-3])
    with pytest.raises(Exception, match="ends within a value"):
        read_binary(spark, str(tmp_path / "x.bin")).collect()
    write_csv(totals(sized), str(tmp_path / "out.csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out.csv"))
    assert back.columns == ["codec", "raw", "bytes", "ratio"] and back.count() == len(CODECS) + len(PARQUET) + 1


def test_widening(spark):
    df = spark.sql("select cast(1 as tinyint) a, cast(2 as smallint) b, cast(3 as decimal(20,0)) c, cast(18446744073709551615 as decimal(20,0)) d, 'x' s, cast(1.5 as float) f")
    assert dict(widened(df).dtypes) == {"a": "int", "b": "int", "c": "bigint", "d": "decimal(20,0)", "f": "float"}


def test_stream(spark, tmp_path):
    from stratalane.streaming.encode import encode_stream

    src = str(tmp_path / "in")
    for k in range(2):
        spark.range(k * 100, k * 100 + 100).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    q = encode_stream(stream, ["id"], ["id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120) and q.exception() is None
    got = frames.decode(spark.read.parquet(str(tmp_path / "out")).drop("batch")).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(200)) and sorted(r.lane for r in got) == list(range(200))


@pytest.mark.parametrize("name", ["select_fast", "encode_fast", "alp_rd_exceptions", "fcm_prediction", "stream_size_nulls", "poly_prediction", "roundtrip_pred2", "roundtrip_decimal"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "part", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    cols = sorted(want.columns)
    want = sorted((tuple(str(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()))
    got = sorted(tuple(str(r[c]).lower() if isinstance(r[c], bool) else str(r[c]) for c in cols) for r in queries.QUERIES[name](spark, SF).collect())
    assert [tuple(x.lower() for x in r) for r in got] == [tuple(x.lower() for x in r) for r in want]


def test_frame_error_is_a_value_error():
    assert issubclass(FrameError, ValueError)


TYPED = "a long, b double, c boolean, t timestamp_ntz, z int, d decimal(18,2), w decimal(38,0), day date, u timestamp, f float, s smallint, y tinyint, big binary"


@pytest.mark.parametrize("cfg", [Config("fastest", block_size=1000), Config("max")])
def test_typed_round_trip(spark, cfg):
    import decimal
    import struct

    rows = []
    for k in range(3000):
        null = k % 11 == 5
        wide = (-1) ** k * (10**37 + k * 10**20) if k % 3 else k
        b = [k / 4, float("inf"), -0.0, struct.unpack("<d", struct.pack("<Q", 0x7FF8000000000000 + k))[0]][k % 4]
        v = (k * 3, b, k % 3 == 0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), -k, decimal.Decimal(k * 7 - 900) / 100, decimal.Decimal(wide), dt.date(1960, 1, 1) + dt.timedelta(days=k), dt.datetime(2001, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=k), float(k % 50) / 8, k - 1500, k % 200 - 100, (2**200 + k).to_bytes(32, "little"))
        rows.append((k, *(None if null and j % 2 else x for j, x in enumerate(v))))
    df = spark.createDataFrame(rows, "pos long, " + TYPED).repartition(5)
    cols = [c for c in df.columns if c != "pos"]
    coded = frames.encode(df, cols, cfg)
    got = frames.restore(coded, TYPED)
    assert got.dtypes == df.dtypes
    bits = F.expr("struct(*, if(b is null, null, reflect('java.lang.Double', 'doubleToRawLongBits', b)) as raw)")
    assert got.select(bits).exceptAll(df.select(bits)).count() == 0 and got.count() == 3000
    assert frames.restore(coded, "d decimal(18,2)").agg(F.sum("d")).first()[0] == df.agg(F.sum("d")).first()[0]
    with pytest.raises(Exception, match="is bigint, not double"):
        frames.decompress(coded, "a").collect()
    assert frames.decompress(frames.compress(df, "b", cfg), "b").count() == 3000
    with pytest.raises(FrameError):
        frames.compress(df, "a", cfg)
    with pytest.raises(Exception, match="use restore"):
        frames.decode(coded.where("col = 'd'")).collect()


def test_streams_and_bounds(spark, mixed):
    from stratalane.config import bound

    coded = frames.encode(mixed, ["a", "b"], Config("fast", block_size=700))
    parts = frames.stream_parts(coded).collect()
    for name, kind in (("a", "bigint"), ("b", "double")):
        raw = b"".join(bytes(r.part) for r in sorted((r for r in parts if r.col == name), key=lambda r: r["first"]))
        got = frames.from_bytes(raw)
        assert {f["kind"] for f in got} == {kind} and sum(f["n"] + f["nulls"] for f in got) == 5000 and len(raw) <= bound(5000)
        want = {r.pos: r.lane for r in blocks.lanes(mixed, [name]).collect()}
        assert {r.pos: r.lane for f in got for r in spark.createDataFrame(frames.rows_of(f | {"col": name}).to_pylist(), "col string, kind string, pos long, lane long, value double, error string").collect()} == want


def test_sql_functions(spark):
    frames.register(spark)
    df = spark.range(5000).selectExpr("id div 1000 as g", "id", "id * 3 as x").groupBy("g").agg(F.expr("transform(array_sort(collect_list(struct(id, x))), e -> e.x) as lanes"))
    df.createOrReplaceTempView("lane_arrays")
    got = spark.sql("select lanes, frame_decode('FOR', 'bigint', frame_encode('FOR', 'bigint', lanes), size(lanes)) as back, frame_encode('CONST', 'bigint', lanes) as none from lane_arrays").collect()
    assert len(got) == 5 and all(r.lanes == r.back and r.none is None for r in got)


def test_strict_refuses_a_stand_in(spark, mixed):
    with pytest.raises(Exception, match="CONST doesn't fit a"):
        frames.encode(mixed, ["a"], Config("fast"), forced="CONST", strict=True).collect()


@pytest.mark.parametrize("mode", ["DICT", "RLE", "ALP_RD"])
def test_strict_keeps_blocks_that_save_nothing(spark, mode):
    """Almost all values distinct, in every bit: the size rules turn such blocks away, a strict round trip does not."""
    df = spark.range(3000).selectExpr("id as pos", "reflect('java.lang.Double', 'longBitsToDouble', xxhash64(id div 7 * 7 + least(id % 7, 5))) as x").selectExpr("pos", "cast(x as double) as x")
    df = df.where("x = x").selectExpr("row_number() over (order by pos) - 1 as pos", "x")
    plain = frames.encode(df, ["x"], Config("high", block_size=1000), forced=mode)
    assert {BY_ID[r["mode"]].name for r in plain.collect()} == {"RAW"}
    got = frames.encode(df, ["x"], Config("high", block_size=1000), forced=mode, strict=True)
    assert {BY_ID[r["mode"]].name for r in got.collect()} == {mode}
    assert frames.decode(got).select("pos", "lane").exceptAll(blocks.lanes(df, ["x"]).select("pos", "lane")).count() == 0
    assert frames.decode(got).count() == df.count()


def test_roundtrip_dict_of_many_users(spark, tmp_path):
    """As copies of the tables with shifted keys: over half of the users of a block are distinct."""
    spark.read.parquet(f"{SF}/events.parquet").withColumn("user_id", F.col("event_id") * 3).write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["roundtrip_dict"](spark, str(tmp_path))
    want = queries.rows_of(spark, str(tmp_path), ("events",), floats=True, only=queries.FITS["DICT"]).select("col", "pos", "lane")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def sql_rows_of(name, sf):
    """Rows of a query in SQL and the order of its columns."""
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "part"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    return sorted(tuple(str(v).lower() for v in r) for r in want.fetchall()), want.columns


def shuffled(spark, df):
    """Rows of a query, and the records that its stages wrote to shuffles."""
    store, seen = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    records = lambda: sum(x.shuffleWriteRecords() for x in map(lambda k: stages.apply(k), range(stages.size())))
    stages = store.stageList(seen, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), seen)
    before = records()
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(seen, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), seen)
    return rows, records() - before


@pytest.mark.parametrize("name", ["pareto_frontier", "block_features", "level_totals", "stream_size_fast", "top_modes", "candidates_fast", "runner_up", "select_fast", "win_histogram", "rle_runs", "size_rle", "rle_expand", "size_dict", "fcm_prediction", "strided_sample", "dfcm_prediction", "size_pred", "order1_entropy", "for_stretches"])
def test_blocks_are_shuffled_as_table_rows(spark, name):
    """Rows of a table are shuffled, not their lanes; and once for all sizes, not once for each use of them."""
    rows, records = shuffled(spark, queries.QUERIES[name](spark, SF))
    want, cols = sql_rows_of(name, SF)
    assert sorted(tuple(str(r[c]).lower() for c in cols) for r in rows) == want
    table = sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("events", "orders"))
    assert records < 3 * table, (records, table)


def test_partitions_grow_in_number(spark, monkeypatch):
    """A task's rows are bounded by DEAL, whatever the tables' size and the number of shuffle partitions."""
    for deal in (1 << 17, 1 << 10):
        monkeypatch.setattr(blocks, "DEAL", deal)
        rows = queries.rows_of(spark, SF, floats=True, size=8)
        part = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("block").alias("b")).collect()
        assert sum(r.n for r in part) == rows.count() and max(r.n for r in part) < 2 * deal
        assert sum(r.b for r in part) == rows.select("block").distinct().count()
        assert rows.rdd.getNumPartitions() == max(4, -(-sum(r.n for r in part) // deal))


def test_decode_takes_frames_in_small_batches(spark):
    """A frame is a large row: a worker holds a few megabytes of them, not all of a partition."""
    df = spark.range(4096 * 200).coalesce(1).selectExpr("id as pos", "xxhash64(id) as x")
    coded = frames.encode(df, ["x"], Config("fastest", block_size=4096), forced="XORZ").coalesce(1)

    def held(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pylist([{"n": b.num_rows, "bytes": b.nbytes}])

    sizes_of = [r["bytes"] for r in coded.mapInArrow(held, "n long, bytes long").collect()]
    assert sum(sizes_of) > 5 << 20 and max(sizes_of) < 5 << 20
    assert frames.decode(coded).count() == 4096 * 200
