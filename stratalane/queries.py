"""Registered queries over the driver's tables, each with the same in SQL.

Queries read whole tables. Blocks of the SQL checks have 4096 values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .config import LEVELS, MODES, Config, allowed
from .functions import lanes as L
from .operators import frames, kernels, sizes
from .plans import blocks as B
from .sources.files import baselines, totals

SIZE = 4096
#: table: (order key, integer or time columns, double columns)
TABLES = {
    "events": ("event_id", ["event_id", "ts", "user_id", "day", "zero"], ["value"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderdate"], ["o_totalprice"]),
    "customer": ("c_custkey", ["c_custkey", "c_nationkey"], ["c_acctbal"]),
    "part": ("p_partkey", ["p_partkey", "p_size"], ["p_retailprice"]),
}


#: Columns made from others, for runs and constants: in Spark and in SQL.
DERIVED = {
    "third": ("value / 3.0D", "value / 3.0::DOUBLE"),
    "whole": ("cast(event_id % 700 as double) * 3.0D", "(event_id % 700)::DOUBLE * 3.0::DOUBLE"),
    "day": ("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 86400000000", "epoch_us(ts) // 86400000000"),
    "zero": ("cast(0 as bigint)", "0"),
}


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark, sf_dir, name, columns=None) -> DataFrame:
    """A table with positions in the order of its key: its numbers and times, or the columns asked for."""
    key, ints, floats = TABLES[name]
    cols = [F.expr(DERIVED[c][0]).alias(c) if c in DERIVED else F.col(c) for c in dict.fromkeys([key, *(columns or [*ints, *floats])])]
    return B.number(table(spark, sf_dir, name).select(*cols), [key])


def columns_of(t: str, ints=True, floats=False, only=None) -> list[str]:
    _, i, f = TABLES[t]
    return [c for c in only if c in KEPT[t]] if only else (i if ints else []) + (f if floats else [])


#: Columns that a query may ask for by name, by table.
KEPT = {"events": ["event_id", "ts", "user_id", "day", "zero", "value", "third", "whole"], "orders": ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"]}


def rows_of(spark, sf_dir, names=("events", "orders"), ints=True, floats=False, size=SIZE, only=None, by_block=True) -> DataFrame:
    """Lanes of the tables with their blocks; `by_block` deals them so that a block's rows are together."""
    parts = [(t, numbered(spark, sf_dir, t, columns_of(t, ints, floats, only)), columns_of(t, ints, floats, only)) for t in names]
    if by_block:
        return B.dealt(parts, size)
    return reduce(DataFrame.unionByName, [B.in_blocks(B.lanes(df, cols), size).withColumn("col", F.concat(F.lit(t + "."), "col")) for t, df, cols in parts])


def with_value(rows: DataFrame) -> DataFrame:
    """Adds the double of float lanes, by arithmetic on the bits that stays in the JVM."""
    return rows.withColumn("value", F.when(F.col("kind").isin(sizes.FLOATS), L.bits_double(F.col("lane"))))


# --- SQL of the lanes


def _lane(col: str, kind: str) -> str:
    return {"double": f"(({col})::BIT)::BIGINT", "timestamp_ntz": f"epoch_us({col})"}.get(kind, f"({col})::BIGINT")


_KIND = {"ts": "timestamp_ntz", "o_orderdate": "timestamp_ntz", "c_nationkey": "int", "p_size": "int"}


_DOUBLES = {"value", "third", "whole", "o_totalprice", "c_acctbal", "p_retailprice"}


def sql_rows(names=("events", "orders"), ints=True, floats=False, size=SIZE, only=None) -> str:
    parts = []
    for t in names:
        key = TABLES[t][0]
        for c in columns_of(t, ints, floats, only):
            kind = _KIND.get(c, "double" if c in _DOUBLES else "bigint")
            expr = DERIVED[c][1] if c in DERIVED else c
            value = f"({expr})" if c in _DOUBLES else "NULL::DOUBLE"
            parts.append(f"SELECT '{t}.{c}' AS col, '{kind}' AS kind, row_number() OVER (ORDER BY {key}) - 1 AS pos, {_lane(expr, kind)} AS lane, {value} AS value FROM {t}")
    return f"rows AS (SELECT *, pos // {size} AS block, pos % {size} AS i FROM ({' UNION ALL '.join(parts)}))"


def u(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN ({x})::HUGEINT + 18446744073709551616::HUGEINT ELSE ({x})::HUGEINT END)"


def bw(x: str) -> str:
    """Bit width of an unsigned value in a HUGEINT."""
    return f"(CASE WHEN ({x}) = 0 THEN 0 ELSE length(bin(({x})::UBIGINT)) END)"


def vl(x: str) -> str:
    return f"greatest(1, ({bw(x)} + 6) // 7)"


def signed(x: str) -> str:
    """A HUGEINT difference wrapped to 64 bits."""
    return f"(CASE WHEN ({x}) > 9223372036854775807 THEN ({x}) - 18446744073709551616::HUGEINT WHEN ({x}) < -9223372036854775808::HUGEINT THEN ({x}) + 18446744073709551616::HUGEINT ELSE ({x}) END)::BIGINT"


def zz(d: str) -> str:
    """Zig-zag of a signed value, unsigned in a HUGEINT."""
    return f"(CASE WHEN ({d}) >= 0 THEN 2 * ({d})::HUGEINT ELSE -2 * ({d})::HUGEINT - 1 END)"


K = "col, kind, block"
WIN = f"(PARTITION BY {K} ORDER BY i)"
SQL_MOVED = f"""moved AS (SELECT *, {zz('delta')} AS z, {u('xor(lane, coalesce(prev, 0))')} AS x FROM (
  SELECT *, coalesce({signed('lane::HUGEINT - prev::HUGEINT')}, 0) AS delta FROM (SELECT *, lag(lane) OVER {WIN} AS prev FROM rows)))"""
SQL_STRETCH = f"""stretches AS (SELECT {K}, i // 1024 AS sub, count(*) AS n,
  CASE WHEN kind = 'double' THEN max({u('lane')}) - min({u('lane')}) ELSE max(lane)::HUGEINT - min(lane)::HUGEINT END AS span,
  max(z) - min(z) AS zspan, sum({vl('x')}) AS xorz, min(lane) AS lo, max(lane) AS hi,
  min(CASE WHEN i > 0 THEN delta END) AS dlo, max(CASE WHEN i > 0 THEN delta END) AS dhi FROM moved GROUP BY {K}, i // 1024)"""
LANE_BYTES = "(CASE WHEN kind = 'int' THEN 4 ELSE 8 END)"
SQL_SIMPLE = f"""simple AS (SELECT {K}, sum(n)::BIGINT AS n, (sum(n) * {LANE_BYTES})::BIGINT AS "RAW",
  CASE WHEN min(lo) = max(hi) THEN 8::BIGINT END AS "CONST", CASE WHEN min(dlo) = max(dhi) THEN 16::BIGINT END AS "STRIDE", sum(xorz)::BIGINT AS "XORZ",
  ({vl('sum(n)::HUGEINT')} + sum(9 + 128 * {bw('span')}))::BIGINT AS "FOR", (8 + {vl('sum(n)::HUGEINT')} + sum(9 + 128 * {bw('zspan')}))::BIGINT AS "DELTA_BP" FROM stretches GROUP BY {K})"""


def packed(source: str, value: str, at: str, keys: str) -> str:
    """SELECT of m and the size f of a bit-packed stream of unsigned values."""
    return f"""SELECT {keys}, sum(n)::BIGINT AS m, ({vl('sum(n)::HUGEINT')} + sum(9 + 128 * {bw('w')}))::BIGINT AS f
  FROM (SELECT {keys}, ({at}) // 1024 AS sub, count(*) AS n, max(({value})::HUGEINT) - min(({value})::HUGEINT) AS w FROM {source} GROUP BY {keys}, ({at}) // 1024) GROUP BY {keys}"""


SQL_RUNS = f"""runs AS (SELECT {K}, run, first(lane ORDER BY i) AS value, count(*) AS len FROM (SELECT *, sum(c) OVER {WIN} - 1 AS run
  FROM (SELECT *, CASE WHEN i > 0 AND lag(lane) OVER {WIN} = lane THEN 0 ELSE 1 END AS c FROM rows)) GROUP BY {K}, run)"""
SQL_RLE = f"""rle AS (SELECT {K}, CASE WHEN p.m - 1 <= c.n // 2 + 1 THEN ({vl('p.m::HUGEINT')} + 8 * p.m + p.f)::BIGINT END AS "RLE"
  FROM ({packed('runs', 'len', 'run', K)}) p JOIN (SELECT {K}, count(*) AS n FROM rows GROUP BY {K}) c USING ({K}))"""
SQL_CODES = f"codes AS (SELECT *, dense_rank() OVER (PARTITION BY {K} ORDER BY {u('lane')}) - 1 AS code FROM rows)"
_ENTRY = f"(SELECT *, {zz('d')} AS z FROM (SELECT *, coalesce({signed('lane::HUGEINT - prev::HUGEINT')}, 0) AS d FROM (SELECT *, lag(lane) OVER (PARTITION BY {K} ORDER BY code) AS prev FROM (SELECT DISTINCT {K}, code, lane FROM codes))))"
SQL_DICT = f"""dict AS (SELECT {K}, CASE WHEN s.m <= c.m // 2 + 1 THEN ({vl('s.m::HUGEINT')} + 1 + {vl('least(8 * s.m, 8 + s.f)::HUGEINT')} + least(8 * s.m, 8 + s.f) + 1 + c.f)::BIGINT END AS "DICT"
  FROM ({packed('codes', 'code', 'i', K)}) c JOIN ({packed(_ENTRY, 'z', 'code', K)}) s USING ({K}))"""


def _mult() -> str:
    ok, lo, top = [], [], []
    for k, s in enumerate(kernels.SCALES):
        p = f"(value * {s:.1f}::DOUBLE)"
        i = f"(CASE WHEN abs({p}) < 9e18::DOUBLE THEN round({p})::BIGINT END)"
        ok.append(f"bool_and(coalesce({i} / {s:.1f}::DOUBLE = value AND NOT (value = 0 AND lane <> 0), false)) AS ok{k}")
        lo.append(f"max({i})::HUGEINT - min({i})::HUGEINT AS w{k}")
        top.append(f"CASE WHEN bool_and(ok{k}) THEN sum(CASE WHEN ok{k} THEN 9 + 128 * {bw(f'w{k}')} END) END")
    scale = ", ".join(f"CASE WHEN bool_and(ok{k}) THEN {k} END" for k in range(len(ok)))
    return f"""mult AS (SELECT {K}, coalesce({scale}) AS scale, (2 + {vl('sum(n)::HUGEINT')} + coalesce({', '.join(top)}))::BIGINT AS "FLOAT_MULT"
  FROM (SELECT {K}, i // 1024 AS sub, count(*) AS n, {', '.join(ok)}, {', '.join(lo)} FROM rows WHERE kind = 'double' GROUP BY {K}, i // 1024) GROUP BY {K})"""


SQL_MULT = _mult()

_C = f"{kernels.ROUND}::DOUBLE"
SQL_PAIRS = "pairs(e, f, ue, df, uf, de) AS (VALUES " + ", ".join(f"({e}, {f}, {kernels.UP[e]!r}::DOUBLE, {kernels.DOWN[f]!r}::DOUBLE, {kernels.UP[f]!r}::DOUBLE, {kernels.DOWN[e]!r}::DOUBLE)" for e, f in kernels.PAIRS) + ")"
_T = "(value * ue * df)"
#: The integer of a value at an exponent and factor, where it gives the value back.
_D = f"(SELECT *, CASE WHEN d0::DOUBLE * uf * de = value AND lane <> -9223372036854775808 THEN d0 END AS d FROM (SELECT *, CASE WHEN abs({_T}) < 9223372036854775808.0::DOUBLE THEN TRY_CAST((({_T} + {_C}) - {_C}) AS BIGINT) END AS d0 FROM %s))"
_W = "(CASE WHEN {0} = {1} THEN {2} ELSE " + bw("span") + " END)"
SQL_ALP = f"""fl AS (SELECT *, i // 1024 AS sub, i % 1024 AS j, count(*) OVER (PARTITION BY {K}, i // 1024) AS sn FROM rows WHERE kind = 'double'),
{SQL_PAIRS},
tries AS (SELECT {K}, sub, e, f, count(*) AS tried, count(*) - count(d) AS bad, max(d)::HUGEINT - min(d)::HUGEINT AS span
  FROM {_D % "(SELECT fl.*, pairs.* FROM fl, pairs WHERE j % greatest(sn // 32, 1) = 0 AND j // greatest(sn // 32, 1) < 32)"} GROUP BY {K}, sub, e, f),
chosen AS (SELECT {K}, sub, arg_min(e, k) AS e, arg_min(f, k) AS f, arg_min(bad, k) AS bad, arg_min(tried, k) AS tried
  FROM (SELECT *, ({_W.format("bad", "tried", 64)} * tried + 80 * bad) * 1000 + e * 20 + f AS k FROM tries) GROUP BY {K}, sub),
digits AS {_D % f"(SELECT fl.*, c.e, c.f, c.bad, c.tried, p.ue, p.df, p.uf, p.de FROM fl JOIN chosen c USING ({K}, sub) JOIN pairs p ON p.e = c.e AND p.f = c.f)"},
parts AS (SELECT {K}, sub, count(*) AS n, any_value(tried)::INTEGER AS tried, any_value(e) AS e, any_value(f) AS f, any_value(bad)::INTEGER AS bad, (count(*) - count(d))::INTEGER AS exceptions, {_W.format("count(d)", "0", 0).replace("span", "(max(d)::HUGEINT - min(d)::HUGEINT)")}::INTEGER AS width FROM digits GROUP BY {K}, sub),
alp AS (SELECT {K}, CASE WHEN bool_and(2 * bad <= tried AND width <= 32) THEN ({vl("sum(n)::HUGEINT")} + sum(13 + 128 * width + 10 * exceptions))::BIGINT END AS "ALP" FROM parts GROUP BY {K})"""
_CUTS = "cuts(cut, unit) AS (VALUES " + ", ".join(f"({c}, {1 << (64 - c)}::HUGEINT)" for c in range(1, 25)) + ")"
_TOP8 = "(SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY c DESC, l) AS rank FROM (SELECT {0}, l, count(*) AS c FROM {1} GROUP BY {0}, l)) WHERE rank <= 8"
SQL_RD = f"""{_CUTS},
rd AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS bn, {u("lane")} AS ul FROM rows WHERE kind = 'double'),
rd_try AS (SELECT {K}, cut, bn, ul // unit AS l FROM rd, cuts WHERE i % greatest(bn // 2048, 1) = 0),
rd_m AS (SELECT {K}, cut, count(*) AS m FROM rd_try GROUP BY {K}, cut),
rd_top AS (SELECT {K}, cut, sum(c) AS covered, count(*) AS entries FROM {_TOP8.format(K + ", cut", "rd_try")} GROUP BY {K}, cut),
rd_cost AS (SELECT {K}, cut, ((m * (64 - cut + greatest(1, {bw("(entries - 1)::HUGEINT")})) + 96 * (m - covered)) // m)::BIGINT AS cost FROM rd_m JOIN rd_top USING ({K}, cut)),
rd_best AS (SELECT {K}, arg_min(cut, cost * 100 + cut) AS cut, min(cost) AS cost FROM rd_cost GROUP BY {K}),
rd_all AS (SELECT rd.*, b.cut, b.cost, ul // unit AS l, ul % unit AS r FROM rd JOIN rd_best b USING ({K}) JOIN cuts ON cuts.cut = b.cut),
rd_dict AS (SELECT {K}, l, rank - 1 AS code FROM {_TOP8.format(K, "rd_all")}),
rd_codes AS (SELECT a.*, coalesce(d.code, 0) AS code, d.code IS NULL AS miss FROM rd_all a LEFT JOIN rd_dict d USING ({K}, l)),
rd_c AS ({packed("rd_codes", "code", "i", K)}), rd_r AS ({packed("rd_codes", "r", "i", K)}),
rd_n AS (SELECT {K}, count(*) AS n, any_value(cost) AS cost, any_value(cut) AS cut, count(*) FILTER (WHERE miss) AS e, coalesce(sum({vl("i::HUGEINT")} + 8) FILTER (WHERE miss), 0) AS places, count(DISTINCT CASE WHEN NOT miss THEN l END) AS entries FROM rd_codes GROUP BY {K}),
alp_rd AS (SELECT {K}, CASE WHEN cost < 63 AND 4 * e <= rd_n.n THEN (2 + 8 * entries + {vl("e::HUGEINT")} + places + 1 + {vl("rd_c.f::HUGEINT")} + rd_c.f + 1 + rd_r.f)::BIGINT END AS "ALP_RD"
  FROM rd_n JOIN rd_c USING ({K}) JOIN rd_r USING ({K}))"""


def _bucket(x: str) -> str:
    """The product is taken in halves, as it may pass 127 bits."""
    hi, lo = f"({u(x)} // 4294967296::HUGEINT)", f"({u(x)} % 4294967296::HUGEINT)"
    k = "11400714819323198485::HUGEINT"
    return f"((((({hi} * {k}) % 4294967296::HUGEINT) * 4294967296::HUGEINT + {lo} * {k}) % 18446744073709551616::HUGEINT) // 1125899906842624::HUGEINT)::BIGINT"


SQL_FEATURES = f"""features AS (SELECT {K}, n, exp_range, buckets < 2048 AS distinct_low, 2 * equal > n AS repeats,
  coalesce(kind <> 'double' AND NOT buckets < 2048 AND NOT 2 * equal > n AND n >= 256 AND {bw('vspan')} >= 8 * {LANE_BYTES} - 4 AND {bw('dhi')} >= 8 * {LANE_BYTES} - 4, false) AS noise
  FROM (SELECT {K}, first(n) AS n, (max((({u('lane')} // 4503599627370496::HUGEINT) % 2048)) - min((({u('lane')} // 4503599627370496::HUGEINT) % 2048)))::INTEGER AS exp_range,
    count(DISTINCT CASE WHEN i % greatest(n // 4096, 1) = 0 THEN {_bucket('lane')} END) AS buckets,
    sum(CASE WHEN coalesce(prev, lane) = lane THEN 1 ELSE 0 END) AS equal,
    max(CASE WHEN i % greatest(n // 2048, 1) = 0 THEN {u('lane')} END) - min(CASE WHEN i % greatest(n // 2048, 1) = 0 THEN {u('lane')} END) AS vspan,
    max(CASE WHEN i % greatest(n // 2048, 1) = 0 AND i > 0 THEN z END) AS dhi
    FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM moved) GROUP BY {K}))"""


def _entries(level: str) -> str:
    names = sizes.MEASURED[level]
    by = {m.name: m for m in MODES}
    pen = {"fastest": 16, "fast": 4}[level]
    join = f"simple JOIN features f USING ({K})" + (f" LEFT JOIN rle USING ({K}) LEFT JOIN dict USING ({K}) LEFT JOIN mult USING ({K}) LEFT JOIN alp USING ({K}) LEFT JOIN alp_rd USING ({K})" if level == "fast" else "")
    parts = [f"SELECT {K}, simple.n, '{m}' AS mode, {by[m].seq} AS seq, \"{m}\" AS payload, \"{m}\" + ({pen * by[m].weight} * simple.n * {LANE_BYTES} >> 8) AS score FROM {join} WHERE \"{m}\" IS NOT NULL AND (NOT noise OR '{m}' = 'RAW')" for m in names]
    return f"entries AS ({' UNION ALL '.join(parts)})"


SQL_WIN = f"""first AS (SELECT {K}, arg_min(payload, score * 100 + seq) AS first FROM entries WHERE mode NOT IN ('DICT', 'RLE') GROUP BY {K}),
gated AS (SELECT * FROM entries JOIN first USING ({K}) WHERE mode NOT IN ('DICT', 'RLE') OR 20 * first < 19 * 8 * n),
best AS (SELECT {K}, arg_min(mode, score * 100 + seq) AS mode, arg_min(payload, score * 100 + seq) AS payload, min(score) AS score, arg_min(n, score * 100 + seq) AS n FROM gated GROUP BY {K})"""


def _fast(level: str, floats: bool) -> list[str]:
    base = [sql_rows(floats=floats), SQL_MOVED, SQL_STRETCH, SQL_SIMPLE, SQL_FEATURES]
    return base + ([SQL_RUNS, SQL_RLE, SQL_CODES, SQL_DICT, SQL_MULT, SQL_ALP, SQL_RD] if level == "fast" else []) + [_entries(level)]


def sql(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return wrap


# --- lanes, nulls, blocks


@query(sql([sql_rows(floats=True)], "SELECT col, pos, lane FROM rows"))
def lane_lowering(spark, sf):
    return rows_of(spark, sf, floats=True, by_block=False).select("col", "pos", "lane")


@query("SELECT event_id - (SELECT min(event_id) FROM events) AS pos, value, ts, user_id FROM events")
def lane_lifting(spark, sf):
    """Frames back to a table with its types."""
    got = frames.encode(numbered(spark, sf, "events"), ["value", "ts", "user_id"], Config("fastest"))
    return frames.restore(got, "value double, ts timestamp_ntz, user_id bigint")


NULLED = "CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN NULL ELSE user_id END"


def nulled(spark, sf) -> DataFrame:
    """events.user_id with nulls."""
    t = table(spark, sf, "events").select("event_id", F.expr(NULLED).alias("x"))
    return B.lanes(B.number(t, ["event_id"]), ["x"])


_SQL_NULLED = f"v AS (SELECT 'x' AS col, row_number() OVER (ORDER BY event_id) - 1 AS pos, {NULLED} AS lane FROM events)"


@query(f"WITH {_SQL_NULLED} SELECT col, row_number() OVER (ORDER BY pos) - 1 AS pos, lane FROM v WHERE lane IS NOT NULL")
def null_compact(spark, sf):
    return B.compact(nulled(spark, sf)).select("col", "pos", "lane")


@query(f"WITH {_SQL_NULLED} SELECT col, pos, coalesce(lane, 0) AS lane FROM v")
def null_scatter(spark, sf):
    x = nulled(spark, sf)
    dense = B.compact(x)
    where = x.select("col", "pos").join(dense.select("col", F.col("at").alias("pos"), F.col("pos").alias("at")), ["col", "pos"], "left")
    return B.scatter(where, dense.select("col", "pos", "lane"), fill=0)


@query(
    f"""WITH {_SQL_NULLED}, r AS (SELECT g, v, count(*) AS len FROM (SELECT *, sum(c) OVER (ORDER BY pos) AS g FROM (
  SELECT pos, (lane IS NOT NULL)::INTEGER AS v, CASE WHEN lag(lane IS NOT NULL) OVER (ORDER BY pos) = (lane IS NOT NULL) THEN 0 ELSE 1 END AS c FROM v)) GROUP BY g, v),
b AS (SELECT sum(len) AS n, sum(CASE WHEN v = 0 THEN len ELSE 0 END) AS nulls, sum({vl('len::HUGEINT')}) + arg_min(v, g) AS runs FROM r)
SELECT 'x' AS col, n::BIGINT AS n, nulls::BIGINT AS nulls, CASE WHEN nulls > 0 THEN ({vl('(1 + least(runs, (n + 7) // 8))::HUGEINT')} + 1 + least(runs, (n + 7) // 8))::BIGINT ELSE 0 END AS bytes FROM b"""
)
def validity_size(spark, sf):
    return sizes.validity(nulled(spark, sf))


@query(sql([sql_rows(("events", "orders", "customer", "part"))], "SELECT col, block, count(*) AS n, min(pos) AS first FROM rows GROUP BY col, block"))
def block_plan_fixed(spark, sf):
    return rows_of(spark, sf, tuple(TABLES), by_block=False).groupBy("col", "block").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(sql([sql_rows(floats=True), SQL_MOVED, SQL_FEATURES], "SELECT col, block, n, exp_range, distinct_low, repeats, noise FROM features"))
def block_features(spark, sf):
    return sizes.features(rows_of(spark, sf, floats=True)).drop("kind")


# --- sizes


def _size(name: str, floats: bool, parts: list[str], source: str, make) -> None:
    def run(spark, sf):
        return make(with_value(rows_of(spark, sf, floats=floats)) if name in ("FLOAT_MULT", "ALP", "ALP_RD") else rows_of(spark, sf, floats=floats)).select("col", "block", F.col(name).alias("bytes")).where("bytes is not null")

    run.__name__ = f"size_{name.lower()}"
    query(sql([sql_rows(floats=floats), *parts], f'SELECT col, block, "{name}" AS bytes FROM {source} WHERE "{name}" IS NOT NULL'))(run)


for _name in ("RAW", "CONST", "STRIDE", "XORZ", "FOR", "DELTA_BP"):
    _size(_name, True, [SQL_MOVED, SQL_STRETCH, SQL_SIMPLE], "simple", sizes.simple)
_size("RLE", True, [SQL_RUNS, SQL_RLE], "rle", sizes.rle)
_size("DICT", True, [SQL_CODES, SQL_DICT], "dict", sizes.dictionary)
_size("FLOAT_MULT", True, [SQL_MULT], "mult", sizes.scaled)
_size("ALP", True, [SQL_ALP], "alp", sizes.alp)
_size("ALP_RD", True, [SQL_RD], "alp_rd", sizes.alp_rd)


@query(sql([sql_rows(floats=True), SQL_MULT], "SELECT col, block, scale::BIGINT AS scale FROM mult WHERE scale IS NOT NULL"))
def float_mult_scale(spark, sf):
    return sizes.scaled(with_value(rows_of(spark, sf, floats=True))).select("col", "block", F.col("scale").cast("long").alias("scale")).where("scale is not null")


@query(sql([sql_rows(floats=True), SQL_MOVED, SQL_STRETCH], f"SELECT col, block, sub, n, ({bw('span')})::BIGINT AS width, ({bw('zspan')})::BIGINT AS zwidth FROM stretches"))
def for_stretches(spark, sf):
    return sizes.stretches(rows_of(spark, sf, floats=True)).select("col", "block", F.col("sub").cast("long").alias("sub"), "n", F.col("width").cast("long").alias("width"), F.col("zwidth").cast("long").alias("zwidth"))


# --- ordered computations


@query(sql([sql_rows(), SQL_MOVED], "SELECT col, pos, delta, z::BIGINT AS zz FROM moved"))
def delta_zigzag(spark, sf):
    return sizes.moved(rows_of(spark, sf)).select("col", "pos", "delta", "zz")


@query(sql([sql_rows()], "SELECT col, pos, lane FROM rows"))
def delta_roundtrip(spark, sf):
    """Prefix sums of differences give the lanes back."""
    x = sizes.moved(rows_of(spark, sf))
    back = L.wrap_add(F.first("lane").over(sizes.in_block()), L.wrap_sum(L.unzigzag(F.col("zz")), sizes.in_block()))
    return x.select("col", "pos", back.alias("lane"))


@query(
    sql(
        [sql_rows()],
        f"SELECT col, pos, (CASE WHEN i = 0 THEN lane WHEN i = 1 THEN lane - lag(lane) OVER {WIN} ELSE lane - (2 * lag(lane) OVER {WIN} - lag(lane, 2) OVER {WIN}) END)::BIGINT AS d2 FROM rows",
    )
)
def ordered_delta(spark, sf):
    lag = lambda k: F.lag("lane", k).over(sizes.in_block())
    pred = F.when(F.col("i") == 0, F.lit(0).cast("long")).when(F.col("i") == 1, lag(1)).otherwise(L.wrap_sub(L.wrap_add(lag(1), lag(1)), lag(2)))
    return rows_of(spark, sf).select("col", "pos", L.wrap_sub(F.col("lane"), pred).alias("d2"))


_DIFFS = {1: "v - l1", 2: "(v - l1) - (l1 - l2)", 3: "((v - l1) - (l1 - l2)) - ((l1 - l2) - (l2 - l3))", 4: "(((v - l1) - (l1 - l2)) - ((l1 - l2) - (l2 - l3))) - (((l1 - l2) - (l2 - l3)) - ((l2 - l3) - (l3 - l4)))"}
_LAGS = ", ".join(f"lag(value, {k}) OVER {WIN} AS l{k}" for k in range(1, 5))
#: A window of up to 1024 values in the middle of a block, and the order with the smallest mean difference there; blocks under 8 have 2.
SQL_ORDER = f"""lagged AS (SELECT *, value AS v, {_LAGS}, count(*) OVER (PARTITION BY {K}) AS n FROM rows),
means AS (SELECT {K}, any_value(n) AS n, {', '.join(f"avg(CASE WHEN place >= {k} AND place < least(n, 1024) THEN abs({d}) END) AS m{k}" for k, d in _DIFFS.items())}
  FROM (SELECT *, i - (n - least(n, 1024)) // 2 AS place FROM lagged) GROUP BY {K}),
orders_of AS (SELECT {K}, CASE WHEN n < 8 THEN 2 WHEN m1 <= m2 AND m1 <= m3 AND m1 <= m4 THEN 1 WHEN m2 <= m3 AND m2 <= m4 THEN 2 WHEN m3 <= m4 THEN 3 ELSE 4 END AS o FROM means)"""


def _extrapolated(order: str, i: str) -> str:
    """In SQL and in Spark: sums begin with 0 and go from the last value back; fewer values at the start of a block."""
    terms = {k: "0.0D" + "".join(f" + ({c!r}D * l{j + 1})" for j, c in enumerate(cs)) for k, cs in enumerate(kernels.NEWTON, 1)}
    return f"CASE WHEN {i} = 0 THEN 0.0D " + " ".join(f"WHEN least({order}, {i}) = {k} THEN {t}" for k, t in terms.items()) + " END"


_PREDICTED = _extrapolated("o", "i").replace("0D", "0::DOUBLE")


@query(sql([sql_rows(ints=False, floats=True), SQL_ORDER], "SELECT col, block, o::INTEGER AS poly_order FROM orders_of"))
def poly_order(spark, sf):
    """The order of extrapolation of each block."""
    return _ordered(spark, sf).select("col", "block", F.col("o").alias("poly_order")).distinct()


def _ordered(spark, sf) -> DataFrame:
    """Rows with the four values before and the block's order `o`, one shuffle for all."""
    x = with_value(rows_of(spark, sf, ints=False, floats=True)).withColumn("v", F.col("value"))
    block = Window.partitionBy(*sizes.KEY)
    for k in range(1, 5):
        x = x.withColumn(f"l{k}", F.lag("value", k).over(sizes.in_block()))
    x = x.withColumn("n", F.count("*").over(block)).withColumn("at", F.expr("i - (n - least(n, 1024)) div 2"))
    for k, d in _DIFFS.items():
        x = x.withColumn(f"m{k}", F.avg(F.when((F.col("at") >= k) & (F.col("at") < F.least("n", F.lit(1024))), F.abs(F.expr(d)))).over(block))
    return x.withColumn("o", F.expr("CASE WHEN n < 8 THEN 2 WHEN m1 <= m2 AND m1 <= m3 AND m1 <= m4 THEN 1 WHEN m2 <= m3 AND m2 <= m4 THEN 2 WHEN m3 <= m4 THEN 3 ELSE 4 END"))


@query(sql([sql_rows(ints=False, floats=True), SQL_ORDER], f"SELECT col, pos, ({_PREDICTED}) AS predicted FROM lagged JOIN orders_of USING ({K})"))
def poly_prediction(spark, sf):
    """Extrapolation of the block's order with its warm-up."""
    return _ordered(spark, sf).select("col", "pos", F.expr(_extrapolated("o", "i")).alias("predicted"))


_BITS = f"(({_PREDICTED})::BIT)::BIGINT"


@query(sql([sql_rows(ints=False, floats=True), SQL_ORDER], f"SELECT col, block, (1 + sum({vl(u('xor(lane, ' + _BITS + ')'))}))::BIGINT AS bytes FROM lagged JOIN orders_of USING ({K}) GROUP BY col, block"))
def size_delta2(spark, sf):
    """Residual bytes of extrapolation by exclusive or."""
    x = _ordered(spark, sf).withColumn("p", L.double_bits(F.expr(_extrapolated("o", "i"))))
    return x.groupBy("col", "block").agg((1 + F.sum(L.varint_len(F.col("lane").bitwiseXOR(F.col("p"))).cast("long"))).alias("bytes"))


@query(sql([sql_rows(ints=False, floats=True), SQL_ORDER, f"res AS (SELECT *, v - p AS r, p + (v - p) = v AS same FROM (SELECT *, {_PREDICTED} AS p FROM lagged JOIN orders_of USING ({K})))"], f"SELECT col, block, bool_and(same) AS exact, (1 + sum({vl(u('xor(bits, coalesce(prev, 0))'))}))::BIGINT AS bytes FROM (SELECT *, (r::BIT)::BIGINT AS bits, lag((r::BIT)::BIGINT) OVER {WIN} AS prev FROM res) GROUP BY col, block"))
def size_delta_dp(spark, sf):
    """Whether float residuals are exact, and their bytes by exclusive or with the one before."""
    x = _ordered(spark, sf).withColumn("p", F.expr(_extrapolated("o", "i"))).withColumn("r", F.col("v") - F.col("p"))
    x = x.withColumn("bits", L.double_bits(F.col("r"))).withColumn("before", F.coalesce(F.lag("bits").over(sizes.in_block()), F.lit(0).cast("long")))
    return x.groupBy("col", "block").agg(F.bool_and(F.col("p") + F.col("r") == F.col("v")).alias("exact"), (1 + F.sum(L.varint_len(F.col("bits").bitwiseXOR(F.col("before"))).cast("long"))).alias("bytes"))


@query(sql([sql_rows(), SQL_RUNS], "SELECT col, block, run::BIGINT AS run, value, len FROM runs"))
def rle_runs(spark, sf):
    return sizes.runs(rows_of(spark, sf)).drop("kind")


@query(sql([sql_rows()], "SELECT col, block, count(*) AS n, sum(lane)::DECIMAL(38,0)::VARCHAR AS total FROM rows GROUP BY col, block"))
def rle_expand(spark, sf):
    """Runs expanded to rows again, and summed."""
    r = sizes.runs(rows_of(spark, sf))
    x = r.select("col", "block", F.explode(F.expr("array_repeat(value, cast(len as int))")).alias("lane"))
    return x.groupBy("col", "block").agg(F.count("*").alias("n"), F.sum(F.col("lane").cast("decimal(28,0)")).cast("decimal(38,0)").cast("string").alias("total"))


@query(sql([sql_rows(), SQL_CODES], "SELECT col, pos, code FROM codes"))
def dict_codes(spark, sf):
    return sizes.codes(rows_of(spark, sf)).select("col", "pos", "code")


@query(sql([sql_rows()], "SELECT col, pos, lane FROM rows"))
def dict_decode(spark, sf):
    """Codes joined with their dictionary."""
    x = sizes.codes(rows_of(spark, sf))
    d = x.groupBy("col", "block", "code").agg(F.first("lane").alias("lane"))
    return x.select("col", "block", "pos", "code").join(d, ["col", "block", "code"]).select("col", "pos", "lane")


def _pred_sql(x: str, last: str) -> str:
    return f"coalesce(lag({x}) OVER (PARTITION BY {K}, ctx ORDER BY i), 0) AS pred FROM (SELECT *, coalesce(lag({x}) OVER {WIN}, 0) AS ctx FROM {last})"


@query(sql([sql_rows()], f"SELECT col, pos, {_pred_sql('lane', 'rows')}"))
def fcm_prediction(spark, sf):
    return sizes.predicted(rows_of(spark, sf)).select("col", "pos", "pred")


@query(sql([sql_rows(), SQL_MOVED, "dm AS (SELECT *, CASE WHEN i = 0 THEN lane ELSE delta END AS d FROM moved)"], f"SELECT col, pos, {_pred_sql('d', 'dm')}"))
def dfcm_prediction(spark, sf):
    return sizes.predicted(rows_of(spark, sf), deltas=True).select("col", "pos", "pred")


@query(sql([sql_rows(), f"p AS (SELECT *, {_pred_sql('lane', 'rows')})"], f"SELECT col, block, sum({vl(u('xor(lane, pred)'))})::BIGINT AS bytes FROM p GROUP BY col, block"))
def size_pred(spark, sf):
    x = sizes.predicted(rows_of(spark, sf))
    return x.groupBy("col", "block").agg(F.sum(L.varint_len(F.col("lane").bitwiseXOR(F.col("pred"))).cast("long")).alias("bytes"))


# --- floats: ALP


_FLOATS = sql_rows(ints=False, floats=True)


def _float_rows(spark, sf) -> DataFrame:
    return with_value(rows_of(spark, sf, ints=False, floats=True))


@query(sql([_FLOATS, SQL_ALP], "SELECT col, block, sub::INTEGER AS sub, e, f, bad, tried, exceptions, width FROM parts"))
def alp_search(spark, sf):
    """The best of all 190 pairs of exponent and factor in every stretch, and what they make of it."""
    return sizes.alp_stretches(_float_rows(spark, sf)).select("col", "block", "sub", "e", "f", "bad", "tried", "exceptions", "width")


@query(sql([_FLOATS, SQL_ALP], "SELECT col, pos, d AS digit FROM digits"))
def alp_digits(spark, sf):
    """Each value's integer at its stretch's exponent and factor; null for exceptions."""
    return sizes.alp_rows(_float_rows(spark, sf)).withColumn("pos", F.col("block") * SIZE + F.col("i")).select("col", "pos", "digit")


@query(sql([_FLOATS], "SELECT col, pos, value FROM rows"))
def alp_patch(spark, sf):
    """Digits decoded, with the exceptions joined in by position."""
    x = sizes.alp_rows(_float_rows(spark, sf))
    power = lambda t, k: F.element_at(F.array(*map(F.lit, t)), F.col(k) + 1)
    plain = x.select("col", "block", "i", (F.col("digit").cast("double") * power(kernels.UP, "f") * power(kernels.DOWN, "e")).alias("plain"))
    patches = x.where("digit is null").select("col", "block", "i", F.col("value").alias("patch"))
    out = plain.join(patches, ["col", "block", "i"], "left")
    return out.select("col", (F.col("block") * SIZE + F.col("i")).alias("pos"), F.coalesce("patch", "plain").alias("value"))


_THIRDS = sql_rows(("events",), only=["third", "value"])


def _thirds(spark, sf) -> DataFrame:
    """Values with a short decimal form and without one."""
    return with_value(rows_of(spark, sf, ("events",), only=["third", "value"]))


@query(sql([_THIRDS, SQL_RD], "SELECT col, block, cut, cost FROM rd_best"))
def alp_rd_cut(spark, sf):
    """The width of the left part, of 24, with the least estimated bits per value."""
    return sizes.alp_rd_cuts(_thirds(spark, sf)).select("col", "block", "cut", "cost")


@query(sql([_THIRDS, SQL_RD], "SELECT col, block, code, l::BIGINT AS l FROM rd_dict"))
def alp_rd_dict(spark, sf):
    """The eight most frequent left parts of a block at its cut, by count, then value."""
    x = sizes.alp_rd_codes(_thirds(spark, sf))
    return x.select("col", "block", F.posexplode_outer("top").alias("code", "l")).withColumn("code", F.col("code").cast("long"))


@query(sql([_THIRDS, SQL_RD], "SELECT col, pos, l::BIGINT AS l FROM rd_codes WHERE miss"))
def alp_rd_exceptions(spark, sf):
    """Left parts that miss the dictionary, with their positions."""
    x = sizes.alp_rd_codes(_thirds(spark, sf))
    x = x.select("col", "block", "cut", F.posexplode_outer(F.arrays_zip("a", "codes")).alias("i", "e")).where("e.codes < 0")
    return x.select("col", (F.col("block") * SIZE + F.col("i")).alias("pos"), F.call_function("shiftrightunsigned", F.col("e.a"), 64 - F.col("cut")).alias("l"))


@query(sql([_THIRDS, SQL_RD], f"""SELECT col, block, round(sum(c0 * log2(n::DOUBLE / c0)) / 8, 3) AS order0, round(any_value(o1) / 8, 3) AS order1 FROM (SELECT col, block, code, count(*) AS c0, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM rd_codes) GROUP BY col, block, code)
JOIN (SELECT col, block, sum(c * log2(m::DOUBLE / c)) AS o1 FROM (SELECT *, sum(c) OVER (PARTITION BY col, block, a) AS m FROM (SELECT col, block, a, code, count(*) AS c FROM (SELECT col, block, code, lag(code, 1, 0) OVER {WIN} AS a FROM rd_codes) GROUP BY col, block, a, code)) GROUP BY col, block) USING (col, block) GROUP BY col, block"""))
def cascade_lab(spark, sf):
    """What entropy coding would make of the codes of left parts: bytes of order 0 and of order 1, by block."""
    x = sizes.alp_rd_codes(_thirds(spark, sf))
    x = x.select("col", "block", "n", F.posexplode_outer(F.transform("codes", lambda c: F.greatest(c, F.lit(0)))).alias("i", "code"))
    x = x.withColumn("a", F.lag("code", 1, 0).over(Window.partitionBy("col", "block").orderBy("i")))
    c = x.groupBy("col", "block", "n", "a", "code").agg(F.count("*").alias("c"))
    c = c.withColumn("m", F.sum("c").over(Window.partitionBy("col", "block", "a"))).withColumn("c0", F.sum("c").over(Window.partitionBy("col", "block", "code")))
    # a code's order-0 count stands in every row of it: weighed by the row's own count
    out = c.groupBy("col", "block").agg(F.sum(F.col("c") * F.log2(F.col("n") / F.col("c0"))).alias("o0"), F.sum(F.col("c") * F.log2(F.col("m") / F.col("c"))).alias("o1"))
    return out.select("col", "block", F.round(F.col("o0") / 8, 3).alias("order0"), F.round(F.col("o1") / 8, 3).alias("order1"))


# --- bytes


@query(sql([sql_rows(("orders",), floats=True)], f"SELECT col, block, k AS plane, count(DISTINCT b) AS distinct_bytes, sum(b)::BIGINT AS total FROM (SELECT col, block, k, (({u('lane')} >> (8 * k)::INTEGER) % 256)::BIGINT AS b FROM rows, range(0, 8) t(k)) GROUP BY col, block, k"))
def byte_planes(spark, sf):
    x = rows_of(spark, sf, ("orders",), floats=True)
    planes = F.array(*(F.struct(F.lit(k).cast("long").alias("plane"), L.byte_plane(F.col("lane"), k).alias("b")) for k in range(8)))
    return x.select("col", "block", F.inline(planes)).groupBy("col", "block", "plane").agg(F.count_distinct("b").alias("distinct_bytes"), F.sum("b").alias("total"))


_BYTES = f"b AS (SELECT col, block, (({u('lane')} // (1::HUGEINT << (8 * k))) % 256)::BIGINT AS b, 8 * i + k AS place FROM rows, range(0, 8) t(k))"


@query(
    sql(
        [sql_rows(("orders",), floats=True), _BYTES],
        "SELECT col, block, CASE WHEN sum(c) < 64 THEN sum(c)::DOUBLE ELSE round(sum(c * log2(m::DOUBLE / c)) / 8, 4) END AS bytes FROM (SELECT *, sum(c) OVER (PARTITION BY col, block, a) AS m FROM (SELECT col, block, a, b, count(*) AS c FROM (SELECT col, block, b, lag(b, 1, 0) OVER (PARTITION BY col, block ORDER BY place) AS a FROM b) GROUP BY col, block, a, b)) GROUP BY col, block",
    )
)
def order1_entropy(spark, sf):
    """Conditional entropy of all bytes of a block given the byte before: the size of a context-modelling coder. Under 64 bytes count whole."""
    x = rows_of(spark, sf, ("orders",), floats=True)
    # the byte before is the lane's own, but for the first one, which follows the last one of the lane before: lanes are sorted, not bytes
    before = F.coalesce(L.byte_plane(F.lag("lane").over(sizes.in_block()), 7), F.lit(0).cast("long"))
    planes = F.array(*(F.struct((F.col("before") if k == 0 else L.byte_plane(F.col("lane"), k - 1)).alias("a"), L.byte_plane(F.col("lane"), k).alias("b")) for k in range(8)))
    x = x.withColumn("before", before).select("col", "block", F.inline_outer(planes))
    c = x.groupBy("col", "block", "a", "b").agg(F.count("*").alias("c"))
    c = c.withColumn("m", F.sum("c").over(Window.partitionBy("col", "block", "a")))
    out = c.groupBy("col", "block").agg(F.sum("c").alias("n"), F.round(F.sum(F.col("c") * F.log2(F.col("m") / F.col("c"))) / 8, 4).alias("bytes"))
    return out.select("col", "block", F.when(F.col("n") < 64, F.col("n").cast("double")).otherwise(F.col("bytes")).alias("bytes"))


@query(sql([sql_rows(("orders",), floats=True)], f"SELECT col, block, ({u('lane')} % 256)::BIGINT AS b, count(*) AS c FROM rows GROUP BY ALL"))
def byte_histogram(spark, sf):
    return rows_of(spark, sf, ("orders",), floats=True, by_block=False).groupBy("col", "block", L.byte_plane(F.col("lane"), 0).alias("b")).agg(F.count("*").alias("c"))


# --- samples


@query(sql([sql_rows(), f"c AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS n FROM rows)"], "SELECT DISTINCT col, pos, lane FROM c, range(0, 8) t(r) WHERE n <= 512 OR (i >= r * (n - 64) // 7 AND i < r * (n - 64) // 7 + 64)"))
def stratified_sample(spark, sf):
    """Eight runs of 64 values of each block: a predicate, not a random sample."""
    x = rows_of(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy(*sizes.KEY)))
    near = reduce(lambda a, b: a | b, [(F.col("i") >= F.expr(f"{r} * (n - 64) div 7")) & (F.col("i") < F.expr(f"{r} * (n - 64) div 7 + 64")) for r in range(8)])
    return x.where((F.col("n") <= 512) | near).select("col", "pos", "lane")


_SAMPLES = {
    "digits": "i % 1024 % greatest(sn div 32, 1) = 0 and i % 1024 div greatest(sn div 32, 1) < 32",
    "cuts": "i % greatest(n div 2048, 1) = 0",
    "distinct": "i % greatest(n div 4096, 1) = 0",
    "middle": "i >= (n - least(n, 1024)) div 2 and i < (n - least(n, 1024)) div 2 + least(n, 1024)",
}


@query(
    sql(
        [sql_rows(), f"c AS (SELECT *, count(*) OVER (PARTITION BY {K}) AS n, count(*) OVER (PARTITION BY {K}, i // 1024) AS sn FROM rows)"],
        " UNION ALL ".join(f"SELECT '{k}' AS sample, col, block, count(*) AS n, sum(pos)::BIGINT AS positions FROM c WHERE {v.replace(' div ', ' // ')} GROUP BY col, block" for k, v in _SAMPLES.items()),
    )
)
def strided_sample(spark, sf):
    """The four samples of a block by stride: 32 values a stretch, about 2048, about 4096, and 1024 in the middle."""
    x = rows_of(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy(*sizes.KEY))).withColumn("sn", F.count("*").over(Window.partitionBy(*sizes.KEY, F.expr("i div 1024"))))
    x = x.select("col", "block", "pos", F.explode(F.filter(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in _SAMPLES.items())), lambda s: s.isNotNull())).alias("sample"))
    return x.groupBy("sample", "col", "block").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


# --- selection


def _fast_rows(spark, sf, level):
    return with_value(rows_of(spark, sf, floats=level == "fast"))


for _level in ("fastest", "fast"):

    def _candidates(spark, sf, level=_level):
        return sizes.candidates(_fast_rows(spark, sf, level), level).select("col", "block", "mode", "payload", "score")

    _candidates.__name__ = f"candidates_{_level}"
    query(sql(_fast(_level, _level == "fast"), "SELECT col, block, mode, payload, score FROM entries"))(_candidates)

    def _select(spark, sf, level=_level):
        return sizes.winners(_fast_rows(spark, sf, level), level).select("col", "block", "mode", "payload", "score")

    _select.__name__ = f"select_{_level}"
    query(sql([*_fast(_level, _level == "fast"), SQL_WIN], "SELECT col, block, mode, payload, score FROM best"))(_select)

    def _streams(spark, sf, level=_level):
        return sizes.streams(sizes.winners(_fast_rows(spark, sf, level), level)).drop("raw")

    _streams.__name__ = f"stream_size_{_level}"
    query(sql([*_fast(_level, _level == "fast"), SQL_WIN], f"SELECT col, sum(n)::BIGINT AS n, (16 + sum(payload + 9))::BIGINT AS bytes, round(sum(n) * {LANE_BYTES} / (16 + sum(payload + 9)), 6) AS ratio FROM best GROUP BY col, kind"))(_streams)


for _level in ("fastest", "fast"):

    def _encoded(spark, sf, level=_level):
        """What the encoder writes: the same encodings and bytes that the size model says."""
        names = F.create_map(*[F.lit(x) for m in MODES for x in (m.id, m.name)])
        parts = []
        for t in ("events", "orders"):
            got = frames.encode(numbered(spark, sf, t), columns_of(t, floats=level == "fast"), Config(level, block_size=SIZE))
            parts.append(got.select(F.concat(F.lit(t + "."), "col").alias("col"), F.expr(f"first div {SIZE}").alias("block"), names[F.col("mode")].alias("mode"), F.col("n").cast("long").alias("n"), F.length("payload").cast("long").alias("payload")))
        return reduce(DataFrame.unionByName, parts)

    _encoded.__name__ = f"encode_{_level}"
    query(sql([*_fast(_level, _level == "fast"), SQL_WIN], "SELECT col, block, mode, n, payload FROM best"))(_encoded)


@query(sql([*_fast("fastest", False), SQL_WIN], "SELECT col, count(*) + 1 AS parts, (16 + sum(payload + 9))::BIGINT AS bytes FROM best WHERE col LIKE 'orders.%' GROUP BY col"))
def stream_bytes(spark, sf):
    """Streams as parts of bytes: a header and a part per frame."""
    got = frames.encode(numbered(spark, sf, "orders"), columns_of("orders"), Config("fastest", block_size=SIZE))
    return frames.stream_parts(got).groupBy(F.concat(F.lit("orders."), "col").alias("col")).agg(F.count("*").alias("parts"), F.sum(F.length("part")).alias("bytes"))


_NULLED_ROWS = f"rows AS (SELECT *, 'bigint' AS kind, pos // {SIZE} AS block, pos % {SIZE} AS i FROM (SELECT col, row_number() OVER (ORDER BY pos) - 1 AS pos, lane FROM v WHERE lane IS NOT NULL))"


def _validity_sql(select: str) -> str:
    return f"""r AS (SELECT g, v, count(*) AS len FROM (SELECT *, sum(c) OVER (ORDER BY pos) AS g FROM (
  SELECT pos, (lane IS NOT NULL)::INTEGER AS v, CASE WHEN lag(lane IS NOT NULL) OVER (ORDER BY pos) = (lane IS NOT NULL) THEN 0 ELSE 1 END AS c FROM v)) GROUP BY g, v),
b AS (SELECT sum(len) AS n, sum(CASE WHEN v = 0 THEN len ELSE 0 END) AS nulls, sum({vl('len::HUGEINT')}) + arg_min(v, g) AS runs FROM r),
validity AS (SELECT 'x' AS col, n::BIGINT AS n, nulls::BIGINT AS nulls, CASE WHEN nulls > 0 THEN ({vl('(1 + least(runs, (n + 7) // 8))::HUGEINT')} + 1 + least(runs, (n + 7) // 8))::BIGINT ELSE 0 END AS bytes FROM b){select}"""


@query(f"WITH {_SQL_NULLED}, " + ",\n".join([_NULLED_ROWS, SQL_MOVED, SQL_STRETCH, SQL_SIMPLE, SQL_FEATURES, _entries("fastest"), SQL_WIN, _validity_sql("")]) + " SELECT col, validity.n, b.bytes + validity.bytes AS bytes, round(validity.n * 8 / (b.bytes + validity.bytes), 6) AS ratio FROM (SELECT col, (16 + sum(payload + 9))::BIGINT AS bytes FROM best GROUP BY col) b JOIN validity USING (col)")
def stream_size_nulls(spark, sf):
    """A column with nulls: its valid lanes' frames and its validity."""
    x = nulled(spark, sf)
    best = sizes.winners(B.in_blocks(B.compact(x), SIZE), "fastest")
    return sizes.streams(best, sizes.validity(x)).drop("raw")


@query(sql([*_fast("fast", True), SQL_WIN], f"SELECT col, block, mode, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score, seq)::INTEGER AS rank FROM gated) WHERE rank <= 2"))
def runner_up(spark, sf):
    return sizes.runners_up(_fast_rows(spark, sf, "fast"), "fast").select("col", "block", "mode", "score", "rank")


@query(sql([*_fast("fast", True), SQL_WIN], "SELECT mode, count(*) AS blocks FROM best GROUP BY mode ORDER BY blocks DESC, mode LIMIT 3"))
def top_modes(spark, sf):
    """The three encodings that win most often."""
    return sizes.winners(_fast_rows(spark, sf, "fast"), "fast").groupBy("mode").agg(F.count("*").alias("blocks")).orderBy(F.desc("blocks"), "mode").limit(3)


@query(sql([*_fast("fast", True), SQL_WIN], f"SELECT (sum(n * {LANE_BYTES}))::BIGINT AS raw, (sum(payload + 9) + 16 * count(DISTINCT col))::BIGINT AS bytes, round(sum(n * {LANE_BYTES}) / (sum(payload + 9) + 16 * count(DISTINCT col)), 6) AS ratio FROM best"))
def level_totals(spark, sf):
    """All columns together: sums of bytes first, then their ratio, so that large columns count for more."""
    s = sizes.streams(sizes.winners(_fast_rows(spark, sf, "fast"), "fast"))
    out = s.agg(F.sum("raw").alias("raw"), F.sum("bytes").alias("bytes"))
    return out.select("raw", "bytes", F.round(F.col("raw") / F.col("bytes"), 6).alias("ratio"))


SWEEP = (64, 256, 1024, 4096, 16384, 65536)


def _sweep_sql(size: int) -> str:
    parts = [sql_rows(("orders",), floats=True, size=size), SQL_MOVED, SQL_STRETCH, SQL_SIMPLE, SQL_FEATURES, _entries("fastest"), SQL_WIN]
    return f"(WITH {', '.join(parts)} SELECT {size} AS block_size, col, count(*) AS blocks, (16 + sum(payload + 9))::BIGINT AS bytes FROM best GROUP BY col)"


@query(" UNION ALL ".join(f"SELECT * FROM {_sweep_sql(s)}" for s in SWEEP))
def small_block_sweep(spark, sf):
    """Bytes of each column at the fastest level by block size: where headers and narrow widths break even."""
    x, cols = numbered(spark, sf, "orders"), columns_of("orders", floats=True)
    parts = []
    for size in SWEEP:
        best = sizes.winners(B.dealt([("orders", x, cols)], size), "fastest")
        parts.append(best.groupBy("col").agg(F.count("*").alias("blocks"), (16 + F.sum(F.col("payload") + 9)).alias("bytes")).select(F.lit(size).alias("block_size"), "col", "blocks", "bytes"))
    return reduce(DataFrame.unionByName, parts)


@query(sql([sql_rows(floats=True)], f"SELECT col, count(*) AS n, 9 * count(*) + 1024 AS bound FROM rows GROUP BY col"))
def compress_bound(spark, sf):
    """Bytes that no stream of a column passes."""
    return rows_of(spark, sf, floats=True, by_block=False).groupBy("col").agg(F.count("*").alias("n")).select("col", "n", (F.col("n") * 9 + 1024).alias("bound"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{lv}', '{fam}', '{m.name}', {m.id}, {m.seq}, {m.weight})" for lv in LEVELS for fam in ("int", "float") for m in MODES if LEVELS.index(m.level) <= LEVELS.index(lv) and m.family in ("any", fam)) + ") t(level, family, mode, id, seq, weight)")
def level_pool(spark, sf):
    """Encodings that compete at each level for each family of types."""
    rows = [(lv, fam, m.name, m.id, m.seq, m.weight) for lv in LEVELS for fam in ("int", "float") for m in allowed(lv, fam)]
    return spark.createDataFrame(rows, "level string, family string, mode string, id int, seq int, weight int")


@query(sql([sql_rows(floats=True)], f"SELECT col, pos, {bw(u('lane'))}::INTEGER AS width, {vl(u('lane'))}::INTEGER AS leb, greatest(1, {bw(u('lane') + ' % 1000')})::INTEGER AS code_bits, ({u('lane')} % 1048576)::BIGINT AS masked, (({u('lane')} // 4503599627370496::HUGEINT) % 2048)::BIGINT AS exponent, {_bucket('lane')} AS bucket, ({u('lane')} // 8 % 2)::INTEGER AS bit3, ({zz('lane')} % 4294967296::HUGEINT)::BIGINT AS zz FROM rows"))
def scalar_functions(spark, sf):
    """Widths, lengths, masks, hashes and single bits of every lane."""
    lane = F.col("lane")
    thousand = F.expr("cast(cast(if(lane < 0, cast(lane as decimal(20,0)) + 18446744073709551616, lane) as decimal(20,0)) % 1000 as long)")
    return rows_of(spark, sf, floats=True, by_block=False).select(
        "col", "pos", L.bit_width(lane).cast("int").alias("width"), L.varint_len(lane).cast("int").alias("leb"), F.greatest(F.lit(1), L.bit_width(thousand)).cast("int").alias("code_bits"),
        lane.bitwiseAND(F.lit((1 << 20) - 1).cast("long")).alias("masked"), L.exponent(lane).alias("exponent"), L.bucket(lane).alias("bucket"), F.getbit(lane, F.lit(3)).cast("int").alias("bit3"), L.low(L.zigzag(lane)).alias("zz"),
    )


@query(sql([sql_rows()], "SELECT col, pos, lane FROM rows WHERE pos < 1000"))
def value_cap(spark, sf):
    """The first values of each column, by position."""
    return rows_of(spark, sf, by_block=False).where("pos < 1000").select("col", "pos", "lane")


@query(sql([*_fast("fast", True), SQL_WIN], "SELECT mode, count(*) AS blocks, sum(payload)::BIGINT AS bytes FROM best GROUP BY mode"))
def win_histogram(spark, sf):
    best = sizes.winners(_fast_rows(spark, sf, "fast"), "fast")
    return best.groupBy("mode").agg(F.count("*").alias("blocks"), F.sum("payload").alias("bytes"))


def _dominated(t: str, o: str) -> str:
    return f"{o}.payload <= {t}.payload and {o}.weight <= {t}.weight and ({o}.payload < {t}.payload or {o}.weight < {t}.weight)"


@query(
    sql(
        [*_fast("fast", True), "w(mode, weight) AS (VALUES " + ", ".join(f"('{m.name}', {m.weight})" for m in MODES) + ")", "t AS (SELECT col, mode, weight, sum(payload)::BIGINT AS payload FROM entries JOIN w USING (mode) GROUP BY col, mode, weight)"],
        f"SELECT col, mode, payload FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.col = t.col AND {_dominated('t', 'o')})",
    )
)
def pareto_frontier(spark, sf):
    """Encodings of a column that no other one beats in both bytes and decode cost. At most twenty rows per column meet, in an array:
    a join with themselves would size all blocks twice."""
    c = sizes.candidates(_fast_rows(spark, sf, "fast"), "fast").groupBy("col", "mode", "weight").agg(F.sum("payload").alias("payload"))
    of = c.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("mode", "payload", "weight"))).alias("all"))
    beats = lambda o, t: (o["payload"] <= t["payload"]) & (o["weight"] <= t["weight"]) & ((o["payload"] < t["payload"]) | (o["weight"] < t["weight"]))
    best = F.filter("all", lambda t: ~F.exists("all", lambda o: beats(o, t)))
    return of.select("col", F.inline_outer(best)).select("col", "mode", "payload")


# --- decimals


@query("SELECT o_orderkey AS k, v, ((v - lo) % 18446744073709551616::HUGEINT)::VARCHAR AS limb0, ((v - lo) // 18446744073709551616::HUGEINT)::VARCHAR AS limb1 FROM (SELECT o_orderkey, v, min(v) OVER () AS lo FROM (SELECT o_orderkey, (o_totalprice::DECIMAL(18,2) * 100)::HUGEINT AS v FROM orders))".replace("AS k, v,", "AS k, v::VARCHAR AS v,"))
def decimal_limbs(spark, sf):
    """Decimals less the column's smallest, as 64-bit limbs."""
    x = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("decimal(38,0)").alias("v"))
    lo = x.agg(F.min("v").alias("lo"))
    x = x.crossJoin(F.broadcast(lo))  # one row
    limb = F.lit(str(2**64)).cast("decimal(20,0)")
    off = F.col("v") - F.col("lo")
    high = F.floor(off / limb).cast("decimal(38,0)")
    return x.select("k", F.col("v").cast("string").alias("v"), F.pmod(off.cast("decimal(38,0)"), limb).cast("decimal(38,0)").cast("string").alias("limb0"), high.cast("string").alias("limb1"))


@query("SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,2)::VARCHAR AS v FROM orders")
def decimal_recombine(spark, sf):
    x = decimal_limbs(spark, sf).select("k", *(F.col(c).cast("decimal(38,0)").alias(c) for c in ("v", "limb0", "limb1")))
    lo = x.agg(F.min("v").alias("lo"))
    x = x.crossJoin(F.broadcast(lo))
    whole = F.col("limb1") * F.lit(str(2**64)).cast("decimal(20,0)") + F.col("limb0") + F.col("lo")
    return x.select("k", (whole.cast("decimal(30,0)") / 100).cast("decimal(18,2)").cast("string").alias("v"))


_WIDE = "cast(o_totalprice as decimal(18,2)) * cast(1000000007000000 as decimal(16,0)) - cast(o_orderkey as decimal(10,0))"


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice::DECIMAL(18,2) END AS price, o_orderkey::DECIMAL(20,0) AS k, (o_totalprice::DECIMAL(18,2)::DECIMAL(38,2) * 1000000007000000 - o_orderkey)::DECIMAL(37,2) AS wide FROM orders")
def roundtrip_decimal(spark, sf):
    """Decimals as limbs, nulls too, and back with precision and scale."""
    t = table(spark, sf, "orders").selectExpr("o_orderkey", "if(o_orderkey % 5 = 0, null, cast(o_totalprice as decimal(18,2))) as price", "cast(o_orderkey as decimal(20,0)) as k", f"cast({_WIDE} as decimal(37,2)) as wide")
    got = frames.encode(B.number(t, ["o_orderkey"]), ["price", "k", "wide"], Config("max"))
    return frames.restore(got, "price decimal(18,2), k decimal(20,0), wide decimal(37,2)")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id, ts, ts::DATE AS day, (user_id % 100)::TINYINT AS tiny, (user_id % 1000)::SMALLINT AS small, user_id::INTEGER AS u, user_id % 3 = 0 AS flag, value, value::FLOAT AS single, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS holes FROM events")
def roundtrip_typed(spark, sf):
    """Every type that has a lane, through frames and back to the type."""
    t = table(spark, sf, "events").selectExpr("event_id", "ts", "cast(ts as date) as day", "cast(user_id % 100 as tinyint) as tiny", "cast(user_id % 1000 as smallint) as small", "cast(user_id as int) as u", "user_id % 3 = 0 as flag", "value", "cast(value as float) as single", "if(user_id % 7 = 0, null, user_id) as holes")
    got = frames.encode(B.number(t, ["event_id"]), t.columns, Config("high"))
    return frames.restore(got, t.schema)


# --- round trips: the value-checked test of kernels


#: Columns that an encoding fits, in every block; where it fits any, all columns.
FITS = {
    "CONST": ["zero"], "STRIDE": ["event_id", "o_orderkey", "zero"], "FLOAT_MULT": ["value", "whole", "o_totalprice"], "ALP": ["value", "whole", "o_totalprice"], "ALP_RD": ["value", "third", "whole"],
    "DICT": ["user_id", "day", "zero"], "RLE": ["day", "zero"], "DELTA2": ["value", "third", "o_totalprice"], "DELTA_DP": ["whole"],
}


def _trip(mode: str) -> None:
    only = FITS.get(mode)
    names = tuple(t for t in ("events", "orders") if columns_of(t, floats=True, only=only))

    def run(spark, sf):
        """Forced, without a stand-in: on any block where the encoding holds any, else a block that it doesn't fit is an error."""
        parts = []
        for t in names:
            cols = columns_of(t, floats=True, only=only)
            level = "balanced" if mode in ("LZ", "TRANSPOSE", "NUM") else "high"
            got = frames.encode(numbered(spark, sf, t, cols), cols, Config(level, block_size=SIZE), forced=mode, strict=True)
            parts.append(frames.decode(got).select(F.concat(F.lit(t + "."), "col").alias("col"), "pos", "lane"))
        return reduce(DataFrame.unionByName, parts)

    run.__name__ = f"roundtrip_{mode.lower()}"
    query(sql([sql_rows(names, floats=True, only=only)], "SELECT col, pos, lane FROM rows"))(run)


for _m in MODES:
    _trip(_m.name)


@query(f"WITH {_SQL_NULLED} SELECT pos, lane FROM v")
def roundtrip_nulls(spark, sf):
    t = table(spark, sf, "events").select("event_id", F.expr(NULLED).alias("x"))
    got = frames.encode(B.number(t, ["event_id"]), ["x"], Config("balanced"))
    return frames.decode(got).select("pos", "lane")


@query(sql([sql_rows(("orders", "events"), floats=True)], "SELECT col, pos, lane FROM rows"))
def roundtrip_max(spark, sf):
    """Adaptive blocks, all encodings competing."""
    parts = []
    for t in ("orders", "events"):
        _, i, f = TABLES[t]
        got = frames.encode(numbered(spark, sf, t), i + f, Config("max"))
        parts.append(frames.decode(got).select(F.concat(F.lit(t + "."), "col").alias("col"), "pos", "lane"))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT 'o_orderkey' AS col, count(*) AS rows FROM orders UNION ALL SELECT 'o_totalprice', count(*) FROM orders")
def decoded_length(spark, sf):
    """Row counts from headers, without decoding."""
    return frames.length(frames.encode(numbered(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], Config("fastest", block_size=SIZE)))


@query("SELECT o_orderkey AS lane FROM orders WHERE o_orderkey BETWEEN 1000 AND 1999")
def block_skipping(spark, sf):
    """A range predicate on frames' bounds, then on the lanes of those left."""
    got = frames.encode(numbered(spark, sf, "orders"), ["o_orderkey"], Config("fast", block_size=SIZE))
    return frames.decode(frames.skipping(got, 1000, 1999)).where("lane between 1000 and 1999").select("lane")


@query()
def level_ladder(spark, sf):
    """Bytes of each column at each level and selection policy."""
    parts = []
    for level, selection in [("fastest", "full"), ("fast", "full"), ("balanced", "full"), ("high", "full"), ("max", "full"), ("max", "sample")]:
        got = frames.encode(numbered(spark, sf, "orders"), ["o_custkey", "o_totalprice", "o_orderdate"], Config(level, selection))
        parts.append(got.groupBy("col").agg(F.sum("n").alias("n"), F.sum(F.length("payload") + 9).alias("bytes")).withColumn("level", F.lit(f"{level}/{selection}")))
    return reduce(DataFrame.unionByName, parts)


@query()
def mode_wins(spark, sf):
    """Which encodings win over several tables at the top level."""
    parts = [frames.encode(numbered(spark, sf, t), TABLES[t][1] + TABLES[t][2], Config("max", block_size=SIZE)) for t in ("orders", "customer", "part")]
    return frames.histogram(reduce(DataFrame.unionByName, parts))


@query()
def codec_baselines(spark, sf):
    """What general byte codecs and Parquet make of the same columns."""
    return totals(baselines(B.lanes(numbered(spark, sf, "orders"), columns_of("orders", floats=True)), 65536))
