"""Exact payload sizes of encodings in closed form, without encoding: DataFrame aggregates and windows only.

Input: rows (col, kind, block, i, lane) of non-null lanes. One shuffle on (col, block) serves the windows and
the aggregates of a block. Blocks are bounded, so no window grows with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BY_NAME, FRAME_BYTES, HEADER_BYTES, PENALTY
from ..functions.lanes import bit_width, bucket, exponent, flip, varint_len, wrap_sub, zigzag
from ..plans.blocks import LANES
from .kernels import DOWN, PAIRS, ROUND, SCALES, UP

KEY = ["col", "kind", "block"]
SIGNED = [k for k, (_, _, s) in LANES.items() if s]
FLOATS = [k for k, (f, _, _) in LANES.items() if f == "float"]


def in_block():
    """A block's rows in order; made on use, as a window needs a session."""
    return Window.partitionBy(*KEY).orderBy("i")


def lane_bytes() -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == k, LANES[k][1]), LANES, F.when(F.lit(False), 0)).otherwise(8)


def _long(x: Column) -> Column:
    return x.cast("long")


def stretch(width: Column) -> Column:
    """Bytes of a bit-packed stretch: its width, smallest value and bits."""
    return 9 + 128 * width


def moved(rows: DataFrame) -> DataFrame:
    """Adds the value before, wrapped difference, its zig-zag and the xor with the value before."""
    prev = F.lag("lane").over(in_block())
    rows = rows.withColumn("prev", prev)
    delta = F.coalesce(wrap_sub(F.col("lane"), F.col("prev")), F.lit(0).cast("long"))
    return rows.withColumn("delta", delta).withColumn("zz", zigzag(F.col("delta"))).withColumn("xored", F.col("lane").bitwiseXOR(F.coalesce("prev", F.lit(0).cast("long"))))


def stretches(rows: DataFrame) -> DataFrame:
    """Smallest and largest lane, and bit widths of distances and differences, of every 1024 values."""
    key = F.when(F.col("kind").isin(SIGNED), F.col("lane")).otherwise(flip(F.col("lane")))
    out = moved(rows).withColumn("key", key).withColumn("zkey", flip(F.col("zz"))).withColumn("sub", F.expr("i div 1024").cast("int"))
    moves = F.when(F.col("i") > 0, F.col("delta"))
    out = out.groupBy(*KEY, "sub").agg(
        F.count("*").alias("n"),
        F.min("key").alias("lo"),
        F.max("key").alias("hi"),
        F.min("zkey").alias("zlo"),
        F.max("zkey").alias("zhi"),
        F.min(moves).alias("dlo"),
        F.max(moves).alias("dhi"),
        F.sum(_long(varint_len(F.col("xored")))).alias("xorz"),
    )
    return out.withColumn("width", bit_width(wrap_sub(F.col("hi"), F.col("lo")))).withColumn("zwidth", bit_width(wrap_sub(F.col("zhi"), F.col("zlo"))))


def simple(rows: DataFrame) -> DataFrame:
    """A row per block: n and the sizes of RAW, CONST, STRIDE, XORZ, FOR and DELTA_BP; null where one doesn't fit."""
    b = stretches(rows).groupBy(*KEY).agg(
        F.sum("n").alias("n"),
        (F.min("lo") == F.max("hi")).alias("same"),
        (F.min("dlo") == F.max("dhi")).alias("even"),
        F.sum("xorz").alias("XORZ"),
        F.sum(_long(stretch(F.col("width")))).alias("f"),
        F.sum(_long(stretch(F.col("zwidth")))).alias("d"),
    )
    n = _long(varint_len(F.col("n")))
    return b.select(
        *KEY,
        "n",
        (F.col("n") * lane_bytes()).alias("RAW"),
        F.when(F.col("same"), F.lit(8).cast("long")).alias("CONST"),
        F.when(F.col("even"), F.lit(16).cast("long")).alias("STRIDE"),
        "XORZ",
        (n + F.col("f")).alias("FOR"),
        (8 + n + F.col("d")).alias("DELTA_BP"),
    )


def _packed(rows: DataFrame, value: Column, at: Column, keys: list[str], name: str) -> DataFrame:
    """Size of the unsigned bit-packed stream of `value` in positions `at`, by keys."""
    s = rows.select(*keys, value.alias("v"), F.floor(at / 1024).alias("sub")).groupBy(*keys, "sub")
    s = s.agg(F.count("*").alias("n"), F.min(flip(F.col("v"))).alias("lo"), F.max(flip(F.col("v"))).alias("hi"))
    s = s.groupBy(*keys).agg(F.sum("n").alias("m"), F.sum(_long(stretch(bit_width(wrap_sub(F.col("hi"), F.col("lo")))))).alias("f"))
    return s.select(*keys, F.col("m").alias(f"{name}_n"), (_long(varint_len(F.col("m"))) + F.col("f")).alias(name))


def runs(rows: DataFrame) -> DataFrame:
    """Runs of equal lanes: (run, value, len)."""
    change = F.when(F.lag("lane").over(in_block()).eqNullSafe(F.col("lane")) & (F.col("i") > 0), 0).otherwise(1)
    out = rows.withColumn("c", change).withColumn("run", F.sum("c").over(in_block()) - 1)
    return out.groupBy(*KEY, "run").agg(F.first("lane").alias("value"), F.count("*").alias("len"))


def rle(rows: DataFrame) -> DataFrame:
    r = runs(rows)
    lens = _packed(r, F.col("len"), F.col("run"), KEY, "lens")
    n = r.groupBy(*KEY).agg(F.sum("len").alias("n"))
    size = _long(varint_len(F.col("lens_n"))) + 8 * F.col("lens_n") + F.col("lens")
    return lens.join(n, KEY).select(*KEY, F.when(F.col("lens_n") - 1 <= F.expr("n div 2") + 1, size).alias("RLE"))


def codes(rows: DataFrame) -> DataFrame:
    """Adds each lane's code: its rank among the block's distinct values, unsigned."""
    return rows.withColumn("code", _long(F.dense_rank().over(Window.partitionBy(*KEY).orderBy(flip(F.col("lane"))))) - 1)


def dictionary(rows: DataFrame) -> DataFrame:
    coded = codes(rows)
    packed = _packed(coded, F.col("code"), F.col("i"), KEY, "codes")
    values = coded.groupBy(*KEY, "code").agg(F.first("lane").alias("lane"))
    by = Window.partitionBy(*KEY).orderBy("code")
    step = F.coalesce(wrap_sub(F.col("lane"), F.lag("lane").over(by)), F.lit(0).cast("long"))
    steps = _packed(values.withColumn("zz", zigzag(step)), F.col("zz"), F.col("code"), KEY, "steps")
    v = F.least(8 * F.col("steps_n"), 8 + F.col("steps"))
    size = _long(varint_len(F.col("steps_n"))) + 1 + _long(varint_len(v)) + v + 1 + F.col("codes")
    return packed.join(steps, KEY).select(*KEY, F.when(F.col("steps_n") <= F.expr("codes_n div 2") + 1, size).alias("DICT"))


def scaled(rows: DataFrame) -> DataFrame:
    """FLOAT_MULT: the first decimal scale at which all of a block's doubles are integers. rows also hold `value`."""
    v = F.col("value")
    checks, spans = [], []
    for k, s in enumerate(SCALES):
        p = v * F.lit(s)
        i = F.when(F.abs(p) < 9e18, F.round(p).cast("long"))
        ok = F.coalesce((i / F.lit(s) == v) & ~((v == 0) & (F.col("lane") != 0)), F.lit(False))
        checks.append(F.bool_and(ok).alias(f"ok{k}"))
        spans.append((F.min(i).alias(f"lo{k}"), F.max(i).alias(f"hi{k}")))
    s = rows.where(F.col("kind").isin(FLOATS)).withColumn("sub", F.expr("i div 1024").cast("int")).groupBy(*KEY, "sub")
    s = s.agg(F.count("*").alias("n"), *checks, *[x for p in spans for x in p])
    sizes = [F.sum(F.when(F.col(f"ok{k}"), _long(stretch(bit_width(wrap_sub(F.col(f"hi{k}"), F.col(f"lo{k}"))))))).alias(f"f{k}") for k in range(len(SCALES))]
    b = s.groupBy(*KEY).agg(F.sum("n").alias("n"), *[F.bool_and(f"ok{k}").alias(f"ok{k}") for k in range(len(SCALES))], *sizes)
    size = F.coalesce(*[F.when(F.col(f"ok{k}"), F.col(f"f{k}")) for k in range(len(SCALES))])
    scale = F.coalesce(*[F.when(F.col(f"ok{k}"), F.lit(k)) for k in range(len(SCALES))])
    return b.select(*KEY, scale.alias("scale"), (2 + _long(varint_len(F.col("n"))) + size).alias("FLOAT_MULT"))


def predicted(rows: DataFrame, deltas: bool = False) -> DataFrame:
    """Value predicted by context, the value (or difference) before, collision-free: the last value that came in
    the same context. Both windows share one shuffle on the block."""
    x = moved(rows).withColumn("x", F.col("delta") if deltas else F.col("lane")) if deltas else rows.withColumn("x", F.col("lane"))
    if deltas:  # the first difference is the first value itself
        x = x.withColumn("x", F.when(F.col("i") == 0, F.col("lane")).otherwise(F.col("delta")))
    x = x.withColumn("ctx", F.coalesce(F.lag("x").over(in_block()), F.lit(0).cast("long")))
    by = Window.partitionBy(*KEY, "ctx").orderBy("i")
    return x.withColumn("pred", F.coalesce(F.lag("x").over(by), F.lit(0).cast("long")))


def features(rows: DataFrame) -> DataFrame:
    """Exponent range, low distinct count on a strided sample of buckets, runs, and integer noise."""
    n = F.count("*").over(Window.partitionBy(*KEY))
    x = moved(rows).withColumn("n", n)
    step = F.greatest(F.expr("n div 4096"), F.lit(1))
    probe = F.greatest(F.expr("n div 2048"), F.lit(1))
    seen = F.when(F.col("i") % step == 0, bucket(F.col("lane")))
    near = (F.col("i") % probe == 0) & (F.col("i") > 0)
    e = exponent(F.col("lane"))
    b = x.groupBy(*KEY).agg(
        F.first("n").alias("n"),
        (F.max(e) - F.min(e)).cast("int").alias("exp_range"),
        F.count_distinct(seen).alias("buckets"),
        F.sum(F.when(F.coalesce("prev", "lane") == F.col("lane"), 1).otherwise(0)).alias("equal"),
        F.min(F.when(near | (F.col("i") == 0), flip(F.col("lane")))).alias("vlo"),
        F.max(F.when(near | (F.col("i") == 0), flip(F.col("lane")))).alias("vhi"),
        F.max(F.when(near, flip(F.col("zz")))).alias("dhi"),
    )
    low, repeats = F.col("buckets") < 2048, 2 * F.col("equal") > F.col("n")
    bits = 8 * lane_bytes() - 4
    noise = ~F.col("kind").isin(FLOATS) & ~low & ~repeats & (F.col("n") >= 256) & (bit_width(wrap_sub(F.col("vhi"), F.col("vlo"))) >= bits) & (bit_width(flip(F.col("dhi"))) >= bits)
    return b.select(*KEY, "n", "exp_range", low.alias("distinct_low"), repeats.alias("repeats"), F.coalesce(noise, F.lit(False)).alias("noise"))


#: Encodings whose sizes measure() gives, by level.
MEASURED = {"fastest": ["RAW", "CONST", "STRIDE", "FOR", "DELTA_BP"], "fast": ["RAW", "CONST", "STRIDE", "XORZ", "FOR", "DELTA_BP", "FLOAT_MULT", "ALP", "ALP_RD", "DICT", "RLE"]}


def _least(x: Column, name: str) -> list[Column]:
    return [F.min(x).alias(f"{name}_lo"), F.max(x).alias(f"{name}_hi")]


def _width(name: str) -> Column:
    return bit_width(wrap_sub(F.col(f"{name}_hi"), F.col(f"{name}_lo")))


def measure(rows: DataFrame, level: str) -> DataFrame:
    """A row per block: n, noise and the size of every encoding of the level but ALP and ALP_RD; null where one doesn't fit.

    All families share one shuffle on the block. Each row gives a slot of the block's stretches of 1024; the last row of a
    run gives one more for the run's length, the first one of a dictionary entry one for the entry, in stretches of runs and
    entries. The slots' bounds are aggregated to the stretch, and these to the block, where the rows already are."""
    fast = level == "fast"
    block = Window.partitionBy(*KEY)
    x = moved(rows).withColumn("n", F.count("*").over(block))
    probe, step = F.greatest(F.expr("n div 2048"), F.lit(1)), F.greatest(F.expr("n div 4096"), F.lit(1))
    near = (F.col("i") % probe == 0) & (F.col("i") > 0)
    none, is_float = F.lit(None).cast("long"), F.col("kind").isin(FLOATS)
    if fast:
        fresh = F.col("prev").isNull() | (F.col("prev") != F.col("lane"))
        after = F.lead("lane").over(in_block())
        x = x.withColumn("fresh", fresh).withColumn("last", after.isNull() | (after != F.col("lane")))
        x = x.withColumn("run", F.sum(F.col("fresh").cast("int")).over(in_block()) - 1).withColumn("from", F.max(F.when(F.col("fresh"), F.col("i"))).over(in_block()))
        by_lane = block.orderBy(flip(F.col("lane")))
        x = x.withColumn("code", _long(F.dense_rank().over(by_lane)) - 1).withColumn("below", F.lag("lane").over(by_lane))
    fields = {
        "key": F.when(F.col("kind").isin(SIGNED), F.col("lane")).otherwise(flip(F.col("lane"))),
        "zkey": flip(F.col("zz")),
        "move": F.when(F.col("i") > 0, F.col("delta")),
        "xorz": _long(varint_len(F.col("xored"))),
        "equal": F.when(F.coalesce("prev", "lane") == F.col("lane"), 1).otherwise(0).cast("long"),
        "probed": F.when(near | (F.col("i") == 0), flip(F.col("lane"))),
        "zprobed": F.when(near, flip(F.col("zz"))),
        "seen": F.when(F.col("i") % step == 0, bucket(F.col("lane"))),
    }
    if fast:
        fields["code"] = F.col("code")
        for k, s in enumerate(SCALES):
            p = F.col("value") * F.lit(s)
            i = F.when(is_float & (F.abs(p) < 9e18), F.round(p).cast("long"))
            fields[f"s{k}"] = F.when((i / F.lit(s) == F.col("value")) & ~((F.col("value") == 0) & (F.col("lane") != 0)), i)
    main = F.struct(F.lit(0).alias("family"), F.expr("i div 1024").cast("int").alias("slot"), *(v.alias(k) for k, v in fields.items()))
    empty = [none.alias(k) for k in fields if k != "key"]
    entries = [main]
    if fast:
        size = _long(F.col("i") - F.col("from") + 1)
        entries.append(F.when(F.col("last"), F.struct(F.lit(1).alias("family"), F.expr("run div 1024").cast("int").alias("slot"), flip(size).alias("key"), *empty)))
        first = F.col("below").isNull() | (F.col("below") != F.col("lane"))
        rise = zigzag(F.coalesce(wrap_sub(F.col("lane"), F.col("below")), F.lit(0).cast("long")))
        entries.append(F.when(first, F.struct(F.lit(2).alias("family"), F.expr("code div 1024").cast("int").alias("slot"), flip(rise).alias("key"), *empty)))
        entries = [F.filter(F.array(*entries), lambda e: e.isNotNull())]
    else:
        entries = [F.array(main)]
    x = x.select(*KEY, F.inline_outer(entries[0]))
    scales = range(len(SCALES)) if fast else ()
    s = x.groupBy(*KEY, "family", "slot").agg(
        F.count("*").alias("m"), *_least(F.col("key"), "key"), *_least(F.col("zkey"), "zkey"), *_least(F.col("move"), "move"), *_least(F.col("probed"), "probed"), F.max("zprobed").alias("zprobed"),
        F.sum("xorz").alias("xorz"), F.sum("equal").alias("equal"), F.collect_set("seen").alias("seen"),
        *(_least(F.col("code"), "code") if fast else []), *[c for k in scales for c in (F.count(f"s{k}").alias(f"ok{k}"), *_least(F.col(f"s{k}"), f"s{k}"))],
    )
    here = lambda family, c: F.when(F.col("family") == family, c)
    b = s.groupBy(*KEY).agg(
        F.sum(here(0, F.col("m"))).alias("n"), F.min(here(0, F.col("key_lo"))).alias("lo"), F.max(here(0, F.col("key_hi"))).alias("hi"), F.min("move_lo").alias("dlo"), F.max("move_hi").alias("dhi"),
        F.sum("xorz").alias("XORZ"), F.sum("equal").alias("equal"), F.min("probed_lo").alias("plo"), F.max("probed_hi").alias("phi"), F.max("zprobed").alias("zhi"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("buckets"),
        F.sum(here(0, _long(stretch(_width("key"))))).alias("f"), F.sum(here(0, _long(stretch(_width("zkey"))))).alias("d"),
        *([F.sum(here(0, _long(stretch(_width("code"))))).alias("c"), F.sum(here(1, F.col("m"))).alias("runs"), F.sum(here(1, _long(stretch(_width("key"))))).alias("r"), F.sum(here(2, F.col("m"))).alias("card"), F.sum(here(2, _long(stretch(_width("key"))))).alias("v")] if fast else []),
        *[c for k in scales for c in (F.sum(here(0, F.col(f"ok{k}"))).alias(f"ok{k}"), F.sum(here(0, _long(stretch(_width(f"s{k}"))))).alias(f"f{k}"))],
    )
    n = _long(varint_len(F.col("n")))
    low, repeats, bits = F.col("buckets") < 2048, 2 * F.col("equal") > F.col("n"), 8 * lane_bytes() - 4
    noise = ~is_float & ~low & ~repeats & (F.col("n") >= 256) & (bit_width(wrap_sub(F.col("phi"), F.col("plo"))) >= bits) & (bit_width(flip(F.col("zhi"))) >= bits)
    out = [
        (F.col("n") * lane_bytes()).alias("RAW"),
        F.when(F.col("lo") == F.col("hi"), F.lit(8).cast("long")).alias("CONST"),
        F.when(F.col("dlo") == F.col("dhi"), F.lit(16).cast("long")).alias("STRIDE"),
        (n + F.col("f")).alias("FOR"),
        (8 + n + F.col("d")).alias("DELTA_BP"),
    ]
    if fast:
        out.append(F.col("XORZ"))
        whole = F.coalesce(*[F.when(is_float & (F.col(f"ok{k}") == F.col("n")), F.col(f"f{k}")) for k in scales])
        out.append((2 + n + whole).alias("FLOAT_MULT"))
        card, of = F.col("card"), lambda c: _long(varint_len(c))
        v = F.least(8 * card, 8 + of(card) + F.col("v"))
        out.append(F.when(card <= F.expr("n div 2") + 1, of(card) + 1 + of(v) + v + 1 + n + F.col("c")).alias("DICT"))
        r = F.col("runs")
        out.append(F.when(r - 1 <= F.expr("n div 2") + 1, of(r) + 8 * r + of(r) + F.col("r")).alias("RLE"))
    return b.select(*KEY, "n", F.coalesce(noise, F.lit(False)).alias("noise"), *out)


# --- ALP and ALP_RD: blocks as arrays. Arrays are opened by outer generators, which infer no filters that repeat them.


def _bind(x: Column, f) -> Column:
    """f(x) with x evaluated once, also where the optimizer merges projections: a lambda's argument isn't copied into its body."""
    return F.transform(F.array(x), f)[0]


def _digit(x: Column, up_e: Column, down_f: Column, up_f: Column, down_e: Column) -> Column:
    """A value's integer at an exponent and factor; null where it doesn't give the value back bit by bit.

    x is a struct of value and lane: a negative zero is only seen in the lane."""
    t = x["value"] * up_e * down_f
    d = F.when(F.abs(t) < 2.0**63, ((t + F.lit(ROUND)) - F.lit(ROUND)).try_cast("long"))
    return F.when((d.cast("double") * up_f * down_e == x["value"]) & (x["lane"] != F.lit(-(2**63)).cast("long")), d)


def _pairs() -> Column:
    one = lambda e, f: f"struct({e} as e, {f} as f, {UP[e]!r}D as ue, {DOWN[f]!r}D as df, {UP[f]!r}D as uf, {DOWN[e]!r}D as de)"
    return F.expr(f"array({', '.join(one(e, f) for e, f in PAIRS)})")


def alp_blocks(rows: DataFrame) -> DataFrame:
    """A row per 1024 doubles: the values `a` in order, n, the exponent and factor with the least cost on up to 32 of
    them (e, f, bad, tried), and `d`, each value's integer at these, null for exceptions. rows hold `value`."""
    floats = rows.where(F.col("kind").isin(FLOATS)).withColumn("sub", F.expr("i div 1024").cast("int"))
    a = floats.groupBy(*KEY, "sub").agg(F.sort_array(F.collect_list(F.struct("i", "lane", "value"))).alias("a")).withColumn("n", F.size("a"))
    step = F.greatest(F.expr("n div 32"), F.lit(1))
    tried = F.slice(F.filter("a", lambda x, k: k % step == 0), 1, 32)

    def cost(s: Column, p: Column) -> Column:
        digits = F.filter(F.transform(s, lambda x: _digit(x, p["ue"], p["df"], p["uf"], p["de"])), lambda d: d.isNotNull())
        bad = lambda d: F.size(s) - F.size(d)
        bits = lambda d: F.when(F.size(d) == 0, 64).otherwise(bit_width(wrap_sub(F.array_max(d), F.array_min(d))))
        return _bind(digits, lambda d: F.struct((bits(d) * F.size(s) + 80 * bad(d)).alias("cost"), p["e"].alias("e"), p["f"].alias("f"), bad(d).alias("bad"), p["ue"].alias("ue"), p["df"].alias("df"), p["uf"].alias("uf"), p["de"].alias("de")))

    a = a.withColumn("s", tried).withColumn("best", F.array_min(F.transform(_pairs(), lambda p: cost(F.col("s"), p))))
    best = F.col("best")
    digits = F.transform("a", lambda x: _digit(x, best["ue"], best["df"], best["uf"], best["de"]))
    return a.select(*KEY, "sub", "n", "a", F.size("s").alias("tried"), best["e"].alias("e"), best["f"].alias("f"), best["bad"].alias("bad"), digits.alias("d"))


def alp_stretches(rows: DataFrame) -> DataFrame:
    """A row per 1024 doubles: its exponent and factor, exceptions and the digits' width."""
    a = alp_blocks(rows).withColumn("d", F.filter("d", lambda d: d.isNotNull()))
    width = F.when(F.size("d") == 0, 0).otherwise(bit_width(wrap_sub(F.array_max("d"), F.array_min("d"))))
    return a.select(*KEY, "sub", "n", "tried", "e", "f", "bad", (F.col("n") - F.size("d")).alias("exceptions"), width.alias("width"))


def alp_rows(rows: DataFrame) -> DataFrame:
    """Every double with its stretch's exponent and factor and its digit, null for an exception."""
    x = alp_blocks(rows).select(*KEY, "e", "f", F.inline_outer(F.arrays_zip("a", "d")))
    return x.select(*KEY, "e", "f", "a.i", "a.lane", "a.value", F.col("d").alias("digit"))


def alp(rows: DataFrame) -> DataFrame:
    """Size of ALP by block: null where a stretch has over half exceptions in its sample or digits over 32 bits."""
    s = alp_stretches(rows)
    fits = (2 * F.col("bad") <= F.col("tried")) & (F.col("width") <= 32)
    b = s.groupBy(*KEY).agg(F.sum("n").alias("n"), F.bool_and(fits).alias("fits"), F.sum(_long(13 + 128 * F.col("width") + 10 * F.col("exceptions"))).alias("size"))
    return b.select(*KEY, F.when(F.col("fits"), _long(varint_len(F.col("n"))) + F.col("size")).alias("ALP"))


def _top(left: Column) -> Column:
    """The eight most frequent values of an array of small integers, as (negative count, value), by count and then value."""

    def counted(x: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(x)), lambda k: (k == F.size(x)) | (F.get(x, k) != F.get(x, k - 1)))
        return _bind(ends, lambda e: F.transform(e, lambda k, j: F.struct((F.when(j == 0, 0).otherwise(F.get(e, j - 1)) - k).alias("c"), F.get(x, k - 1).alias("v"))))

    return F.slice(F.sort_array(_bind(F.sort_array(left), counted)), 1, 8)


def _code_bits(entries: Column) -> Column:
    """Bits of a code among so many entries: one at least."""
    return F.greatest(F.lit(1), bit_width(_long(entries - 1)))


def alp_rd_cuts(rows: DataFrame) -> DataFrame:
    """A row per block of doubles: its lanes in order, and the width of the left part with the least cost on about 2048 of them."""
    a = rows.where(F.col("kind").isin(FLOATS)).groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "lane"))), lambda x: x["lane"]).alias("a")).withColumn("n", F.size("a"))
    a = a.withColumn("s", F.filter("a", lambda x, k: k % F.greatest(F.expr("n div 2048"), F.lit(1)) == 0))

    def cost(cut: Column) -> Column:
        left = F.transform("s", lambda x: F.call_function("shiftrightunsigned", x, 64 - cut))
        m = F.size("s")

        def of(top: Column) -> Column:
            covered = -F.aggregate(top, F.lit(0), lambda acc, t: acc + t["c"])
            return F.struct(F.floor((_long(m) * (64 - cut + _code_bits(F.size(top))) + 96 * (m - covered)) / m).alias("cost"), cut.alias("cut"))

        return _bind(_top(left), of)

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(24)), cost))
    return a.withColumn("best", best).select(*KEY, "n", "a", F.col("best.cut").alias("cut"), F.col("best.cost").alias("cost"))


def alp_rd_codes(rows: DataFrame) -> DataFrame:
    """Adds the block's dictionary `top` and each value's code, -1 for an exception."""
    cuts = alp_rd_cuts(rows)
    left = _bind(F.col("cut"), lambda cut: F.transform("a", lambda x: F.call_function("shiftrightunsigned", x, 64 - cut)))
    cuts = cuts.withColumn("left", left)
    cuts = cuts.withColumn("top", F.transform(_top(F.col("left")), lambda t: t["v"]))
    codes = _bind(F.col("top"), lambda top: F.transform("left", lambda x: F.array_position(top, x).cast("int") - 1))
    return cuts.withColumn("codes", codes).drop("left")


def _array_stretches(x: Column, n: Column) -> Column:
    """Bytes of the bit-packed stretches of an array of non-negative integers."""
    subs = F.sequence(F.lit(0), F.floor((n - 1) / 1024).cast("int"))
    part = lambda k: F.slice(x, k * 1024 + 1, F.lit(1024))
    return F.aggregate(subs, F.lit(0).cast("long"), lambda acc, k: acc + _bind(part(k), lambda p: _long(stretch(bit_width(_long(F.array_max(p)) - _long(F.array_min(p)))))))


def alp_rd(rows: DataFrame) -> DataFrame:
    """Size of ALP_RD by block: null where the cut saves nothing or over a quarter of the values are exceptions."""
    b = alp_rd_codes(rows)
    n = F.col("n")
    bad = _bind(F.col("codes"), lambda c: F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get(c, k) < 0))
    b = b.withColumn("bad", bad)
    b = b.withColumn("codes0", F.transform("codes", lambda c: F.greatest(c, F.lit(0))))
    right = _bind(F.col("cut"), lambda cut: F.transform("a", lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 64 - cut) - F.lit(1))))
    head = lambda c: _long(varint_len(_long(c)))
    c = head(n) + _bind(F.col("codes0"), lambda x: _array_stretches(x, n))
    r = head(n) + _bind(right, lambda x: _array_stretches(x, n))
    where = F.aggregate("bad", F.lit(0).cast("long"), lambda acc, k: acc + head(k) + 8)
    b = b.select(*KEY, "n", "cost", F.size("bad").alias("e"), F.size("top").alias("d"), where.alias("where"), c.alias("c"), r.alias("r"))
    size = 2 + 8 * F.col("d") + head(F.col("e")) + F.col("where") + 1 + head(F.col("c")) + F.col("c") + 1 + F.col("r")
    fits = F.when((F.col("cost") < 63) & (4 * F.col("e") <= F.col("n")), size)
    # a row per block already: the aggregate keeps filters on the size from being pushed into the arrays' lambdas
    return b.groupBy(*KEY).agg(F.first(fits).alias("ALP_RD"))


def sized(rows: DataFrame, level: str) -> DataFrame:
    """A row per block: n, noise, and the size of each encoding of the level. Float rows hold `value` at level fast."""
    wide = measure(rows, level)
    return wide if level == "fastest" else wide.join(alp(rows), KEY, "left").join(alp_rd(rows), KEY, "left")


def _entries(level: str) -> Column:
    """The candidates of a block as an array; noise has only RAW."""
    size = lambda m: F.col(m).cast("long")
    score = lambda m: size(m) + F.shiftright(F.lit(PENALTY[level] * BY_NAME[m].weight) * F.col("n") * lane_bytes(), 8)
    one = lambda m: F.when(F.col(m).isNotNull() & ((F.lit(m) == "RAW") | ~F.col("noise")), F.struct(score(m).alias("score"), F.lit(BY_NAME[m].seq).alias("seq"), F.lit(m).alias("mode"), F.lit(BY_NAME[m].weight).alias("weight"), size(m).alias("payload")))
    return F.filter(F.array(*(one(m) for m in MEASURED[level])), lambda e: e.isNotNull())


def _gated(entries: Column) -> Column:
    """Dictionaries and runs compete only if the best other candidate saves over 5 % of 8-byte values."""
    late = lambda e: e["mode"].isin("DICT", "RLE")
    best = F.array_min(F.filter(entries, lambda e: ~late(e)))
    return F.filter(entries, lambda e: ~late(e) | (20 * best["payload"] < 19 * 8 * F.col("n")))


def candidates(rows: DataFrame, level: str) -> DataFrame:
    """(col, kind, block, n, seq, mode, weight, payload, score): what is tried at levels fastest and fast."""
    return sized(rows, level).select(*KEY, "n", F.inline_outer(_entries(level)))


def winners(rows: DataFrame, level: str) -> DataFrame:
    """The best candidate of each block: the least score, the earlier one of a tie."""
    best = sized(rows, level).select(*KEY, "n", _entries(level).alias("entries")).select(*KEY, "n", F.array_min(_gated(F.col("entries"))).alias("b"))
    return best.select(*KEY, "b.mode", "b.payload", "b.score", "n")


def runners_up(rows: DataFrame, level: str, k: int = 2) -> DataFrame:
    """The k best candidates of each block with their rank, by the rules of winners()."""
    top = F.slice(F.sort_array(_gated(F.col("entries"))), 1, k)
    out = sized(rows, level).select(*KEY, "n", _entries(level).alias("entries")).select(*KEY, "n", F.posexplode_outer(top).alias("rank", "b"))
    return out.select(*KEY, "b.mode", "b.payload", "b.score", (F.col("rank") + 1).alias("rank"))


def streams(best: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Rows, raw bytes, bytes of each column's stream and their ratio; with the validity of columns that have nulls."""
    raw = (F.col("n") * lane_bytes()).alias("raw")
    out = best.groupBy("col", "kind").agg(F.sum("n").alias("n"), (HEADER_BYTES + F.sum(F.col("payload") + FRAME_BYTES)).alias("bytes"))
    if valid is not None:
        v = valid.select("col", F.col("n").alias("_n"), F.col("bytes").alias("_bytes"))
        out = out.join(v, "col", "left").select("col", "kind", F.coalesce("_n", "n").alias("n"), (F.col("bytes") + F.coalesce("_bytes", F.lit(0))).alias("bytes"))
    return out.select("col", "n", raw, "bytes").withColumn("ratio", F.round(F.col("raw") / F.col("bytes"), 6))


def validity(rows: DataFrame, size: int = 32768) -> DataFrame:
    """Bytes of a column's validity: the smaller of a bitmap and run lengths, for rows (col, pos, lane or null).

    Runs are found by stretch and joined where one goes on in the next, so that no window holds a whole column."""
    x = rows.select("col", "pos", F.col("lane").isNotNull().cast("int").alias("v"), F.expr(f"pos div {size}").alias("s"))
    w = Window.partitionBy("col", "s").orderBy("pos")
    x = x.withColumn("change", F.when(F.lag("v").over(w).eqNullSafe(F.col("v")), 0).otherwise(1)).withColumn("r", F.sum("change").over(w))
    part = x.groupBy("col", "s", "r", "v").agg(F.count("*").alias("len"), F.min("pos").alias("pos"))
    edge = part.groupBy("col", "s").agg(F.max("r").alias("last"))
    part = part.join(edge, ["col", "s"])
    # first and last runs of stretches meet their neighbours in a table of two rows per stretch
    ends = part.where("r = 1 or r = last")
    by = Window.partitionBy("col").orderBy("pos")
    tied = ends.withColumn("g", F.sum(F.when(F.lag("v").over(by).eqNullSafe(F.col("v")) & (F.lag("pos").over(by) + F.lag("len").over(by) == F.col("pos")), 0).otherwise(1)).over(by))
    whole = tied.groupBy("col", "g", "v").agg(F.sum("len").alias("len"), F.min("pos").alias("pos")).select("col", "v", "len", "pos").union(part.where("r > 1 and r < last").select("col", "v", "len", "pos"))
    b = whole.groupBy("col").agg(F.sum("len").alias("n"), F.sum(F.when(F.col("v") == 1, F.col("len")).otherwise(0)).alias("valid"), F.sum(_long(varint_len(F.col("len")))).alias("runs"), F.min_by("v", "pos").alias("v0"))
    rle_bytes = F.col("runs") + F.col("v0")  # an empty first run of nulls takes a byte
    body = 1 + F.least(rle_bytes, F.expr("(n + 7) div 8"))
    return b.select("col", "n", (F.col("n") - F.col("valid")).alias("nulls"), F.when(F.col("valid") < F.col("n"), _long(varint_len(body)) + body).otherwise(0).cast("long").alias("bytes"))
