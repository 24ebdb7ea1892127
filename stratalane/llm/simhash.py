"""SimHash near-dedup: tiled exact comparison of fingerprints by exclusive-or and bit counts.

A text's words (cut at ASCII white space, A-Z lower-cased) give shingles; a fingerprint bit is set if
it is set in over half of the shingle hashes. Fingerprints at most `radius` bits apart are linked.
Equal fingerprints are one node. Nodes are cut into tiles; numpy compares tile with tile, sorted by
population count, and skips blocks whose counts differ by more than the radius.

Two layouts of the tiles, the first one exact:
* narrow (one 64-bit word, small radius): radius + 1 bands; nodes within the radius agree in a band, so
  tiles are cut inside the buckets of a band. A large bucket is cut by population count, and only pairs of
  tiles whose counts differ by no more than the radius are formed, before any rows are shuffled.
* wide (several words, large radius): tiles are ranges of the number of shingles; pairs of tiles whose
  sizes cannot be similar are never formed. A filter comes first: of a pair within the radius a quarter of the
  words may differ in no more bits than expected and 4.5 standard deviations (of draws with replacement); pairs
  whose differing bits are spread so unevenly are lost, by a normal estimate under 4 in a million at the radius.

near_dedup takes wide links as candidates only: sets of shingles are compared exactly before rows are linked.

Cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than
a shingle make one shingle; repeated rows are rows of their own with equal fingerprints; very long texts are
hashed whole; an empty table gives no rows; of equal ids, and of ties of id, the text's hash decides; a null id never
names a component unless all its ids are null; extra columns are ignored (narrow) or kept (dedup), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import buffers, stash, trimmed, tune
from ._graph import components, forest

TILE = 4096
#: Tiles of up to so many rows are compared together with others.
SMALL_TILE = 256
WIDE_TILE = 32768
#: Sets of up to FEW shingles find their candidates by a prefix filter instead of fingerprints; nodes and bytes of a tile of sets.
FEW, SET_TILE, SET_BYTES = 64, 1024, 8 << 20
#: Odd multipliers that turn a shingle's hash into one more word of a wide fingerprint.
WORDS = [1, *(int(x) * 2 + 1 for x in np.random.default_rng(42).integers(1, 2**63, 15))]


def hashes(text: bytes, shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return np.array([h(joined[a:b], 42) for a, b in zip(at[:-shingle].tolist(), (at[shingle:] - 1).tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def _prints(shingle: int, words: int, few_most: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        for batch in trimmed(batches):
            offsets, raw = buffers(batch.column(batch.num_columns - 1))
            raw = raw.tobytes()
            rows, sizes, sets = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                h = hashes(raw[a:b], shingle)
                if words > 1:
                    h = np.unique(h)
                    sets.append(h.tobytes())
                sizes.append(len(h))
                row = [majority(h)] if len(h) else [0]
                for k in WORDS[1:words]:
                    x = h * np.uint64(k)
                    row.append(majority((x ^ (x >> np.uint64(29))) * np.uint64(k)) if len(h) else 0)
                rows.append(row)
            out = list(batch.columns[:-1])
            if words == 1:
                out.append(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "fp"])
            else:
                nodes = np.array([xxh3_64_intdigest(x) for x in sets], np.uint64).view(np.int64)
                few = [np.frombuffer(x, np.int64) if len(x) <= 8 * few_most else None for x in sets]
                out += [pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(nodes), pa.array(few, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "size", "fp", "node", "few"])

    return run


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text", few_most: int = 0) -> DataFrame:
    """(id, fp), or of several words (id, size, fp, node, few): node names the set of shingles, few is a small set itself."""
    tune(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = "fp long" if words == 1 else "size long, fp array<long>, node long, few array<long>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(_prints(shingle, words, few_most), f"id {kind}, {tail}")


class _Links:
    """Collects links and keeps no more than a forest of them."""

    def __init__(self):
        self.u, self.v, self.n = [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.u.append(u)
            self.v.append(v)
            self.n += len(u)
            if self.n > 2_000_000:
                self.fold()

    def fold(self):
        u, v = forest(np.concatenate(self.u), np.concatenate(self.v)) if self.u else (np.zeros(0, np.int64),) * 2
        self.u, self.v, self.n = [u], [v], 0
        return u, v


def compare(a: np.ndarray, ids_a: np.ndarray, b: np.ndarray, ids_b: np.ndarray, radius: int, links: _Links, block: int = 512) -> None:
    """Link the rows of two tiles, (n, words) unsigned, that are within the radius. Tiles may be one and the same."""
    same = a is b
    pa, pb = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    oa, ob = np.argsort(pa, kind="stable"), np.argsort(pb, kind="stable")
    a, ids_a, pa, b, ids_b, pb = a[oa], ids_a[oa], pa[oa], b[ob], ids_b[ob], pb[ob]
    # of a wide fingerprint a quarter is compared first: a pair within the radius has few differing bits in it
    words = a.shape[1]
    part = max(1, words // 4)
    first = min(radius, int(radius * part / words + 4.5 * (radius * part / words) ** 0.5) + 1)
    for i in range(0, len(a), block):
        x, px = a[i : i + block], pa[i : i + block]
        lo, hi = np.searchsorted(pb, px[0] - radius, "left"), np.searchsorted(pb, px[-1] + radius, "right")
        lo = max(int(lo), i) if same else int(lo)
        for j in range(lo, int(hi), block):
            y = b[j : j + block]
            if words == 1:
                p, q = np.nonzero(np.bitwise_count(x[:, 0, None] ^ y[None, :, 0]) <= radius)
            else:
                d = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0])
                for k in range(1, part):
                    d += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
                p, q = np.nonzero(d <= first)
                d = np.bitwise_count(x[p] ^ y[q]).sum(1, dtype=np.int64)
                p, q = p[d <= radius], q[d <= radius]
            u, v = ids_a[i + p], ids_b[j + q]
            other = u != v
            links.add(u[other], v[other])


def _narrow(radius: int):
    def run(batches: Iterator) -> Iterator:
        """Rows (band, value, ta, tb, tile, fp), grouped in order; a group may go on in the next batch."""
        import pyarrow as pa

        links, rest = _Links(), None

        def work(t: np.ndarray) -> None:
            """t: (band, value, ta, tb, tile, fp) of whole groups in order."""
            edge = np.flatnonzero((t[1:, :4] != t[:-1, :4]).any(1)) + 1
            starts = np.concatenate([[0], edge])
            ends = np.concatenate([edge, [len(t)]])
            alone = (ends - starts) > SMALL_TILE
            bits = t[:, 5].view(np.uint64)
            count = np.bitwise_count(bits).astype(np.int64)
            group = np.repeat(np.arange(len(starts)), ends - starts)
            # small tiles, all at once: rows in order of group and count, each against the d-th next until counts differ too much
            pick = np.flatnonzero(~alone[group])
            pick = pick[np.lexsort((count[pick], group[pick]))]
            g, x, c, fp = group[pick], bits[pick], count[pick], t[pick, 5]
            of, other = t[pick, 4], t[pick, 2] != t[pick, 3]
            open_ = np.arange(len(pick))
            d = 1
            while len(open_):
                open_ = open_[open_ + d < len(pick)]
                open_ = open_[(g[open_ + d] == g[open_]) & (c[open_ + d] - c[open_] <= radius)]
                near = open_[np.bitwise_count(x[open_] ^ x[open_ + d]) <= radius]
                near = near[~other[near] | (of[near] != of[near + d])]  # of two tiles only across
                links.add(fp[near], fp[near + d])
                d += 1
            for s, e in zip(starts[alone].tolist(), ends[alone].tolist()):
                part = t[s:e]
                first = np.ascontiguousarray(part[part[:, 4] == part[0, 2], 5])
                second = first if part[0, 2] == part[0, 3] else np.ascontiguousarray(part[part[:, 4] == part[0, 3], 5])
                x = first.view(np.uint64)[:, None]
                compare(x, first, x if second is first else second.view(np.uint64)[:, None], second, radius, links)

        for batch in trimmed(batches):
            t = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(6)], 1)
            if not len(t):
                continue
            t = t if rest is None else np.concatenate([rest, t])
            last = np.flatnonzero((t[:, :4] != t[-1, :4]).any(1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                work(t[:cut])
            rest = t[cut:]
        if rest is not None and len(rest):
            work(rest)
        u, v = links.fold()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def tiles(entries: DataFrame, radius: int, most: int) -> DataFrame:
    """entries(band, value, fp) to (band, value, ta, tb, tile, fp): each fingerprint in every pair of tiles in which it is compared.

    Within a bucket of a band a tile is a population count, or where more than `most` share it one of several by hash. Tile
    pairs are formed for counts that differ by no more than the radius; others never exist, before any shuffle of rows.
    Tile numbers are 2**20 * count + part; a bucket of up to `most` rows is one tile."""
    entries = entries.withColumn("count", F.bit_count("fp").cast("int"))
    sizes = entries.groupBy("band", "value", "count").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("band", "value"))
    plan = sizes.withColumn("whole", whole).where(F.col("whole") > most).groupBy("band", "value").agg(F.map_from_entries(F.collect_list(F.struct("count", F.ceil(F.col("n") / most).cast("int")))).alias("parts"))
    plan = stash(plan, "buckets")  # at most 65 counts of a bucket, and only of buckets that are large
    dealt = entries.join(plan, ["band", "value"], "left")
    mine = F.col("parts")[F.col("count")]
    own = F.shiftleft(F.col("count").cast("long"), 20) + F.pmod(F.xxhash64("fp"), F.coalesce(mine, F.lit(1)).cast("long"))
    near = F.filter(F.map_keys("parts"), lambda c: F.abs(c - F.col("count")) <= radius)
    others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), F.col("parts")[c] - 1), lambda k: F.shiftleft(c.cast("long"), 20) + k)))
    dealt = dealt.withColumn("tile", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(own))
    dealt = dealt.select("band", "value", "fp", "tile", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)).alias("other"))
    return dealt.select("band", "value", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "fp")


def bands(nodes: DataFrame, radius: int) -> DataFrame:
    """(band, value, fp): the bits of each fingerprint in radius + 1 bands; those within the radius agree in one."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    keys = F.array(*(F.struct(F.lit(k).alias("band"), F.expr(f"shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L").alias("value")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))))
    return nodes.select("fp", F.inline(keys))


def narrow_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (fp) to a spanning forest (u, v) of all links within the radius."""
    keys = ["band", "value", "ta", "tb"]
    # every key is a pair of tiles of bounded size, so hashing them deals out evenly
    return tiles(bands(nodes, radius), radius, TILE).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_narrow(radius), "u long, v long")


def _wide(radius: int):
    def run(key, table):
        import pyarrow as pa

        links = _Links()
        tile = table.column("tile").to_numpy()
        node = table.column("node").to_numpy()
        flat = table.column("fp").combine_chunks()
        flat = flat.values.to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), -1)
        lo, hi = tile.min(), tile.max()
        a, ia = np.ascontiguousarray(flat[tile == lo]), node[tile == lo]
        if key[0].as_py() == key[1].as_py():
            compare(a, ia, a, ia, radius, links)
        elif lo != hi:
            compare(a, ia, np.ascontiguousarray(flat[tile == hi]), node[tile == hi], radius, links)
        u, v = links.fold()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def wide_links(nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """nodes(node, size, fp array): a forest of all links within the radius between sizes of that ratio."""
    n = nodes.count()
    tiles = max(1, -(-n // WIDE_TILE), min(8, n // 2048))
    key = F.shiftleft(F.least("size", F.lit(1 << 30)), 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    nodes = nodes.select("node", "fp", key.alias("key"))
    cuts = nodes.select(F.percentile_approx("key", [k / tiles for k in range(tiles + 1)], 100000)).first()[0] or [0, 0]
    inner = cuts[1:-1]
    spans = [(max(0, (a >> 20) - 1), (b >> 20) + 1) for a, b in zip([cuts[0], *inner], [*inner, cuts[-1]])]
    partners = [[j for j in range(tiles) if min(spans[i][1], spans[j][1]) >= similarity * max(spans[i][0], spans[j][0])] for i in range(tiles)]
    tile = F.size(F.filter(F.array(*map(F.lit, inner)).cast("array<long>"), lambda c: c <= F.col("key"))) if inner else F.lit(0)
    nodes = nodes.select("node", "fp", tile.alias("tile"))
    met = F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in partners)), F.col("tile") + 1)
    dealt = nodes.select("node", "fp", "tile", F.explode(met).alias("other"))
    dealt = dealt.select(F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "node", "fp")
    return dealt.groupBy("ta", "tb").applyInArrow(_wide(radius), "u long, v long")


def classes(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex, component_id): every row's fingerprint and the smallest id of its component."""
    prints = stash(fingerprints(docs, shingle, 1, id_col, text_col), "prints")
    nodes = stash(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    comp = stash(components(narrow_links(nodes.select("fp"), radius)), "components")
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stash(rooted.join(named, "root").select("fp", "component_id"), "names")
    # both sides are plain shuffles of written tables, so a hot fingerprint is split at run time
    return prints.join(names, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def few_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """nodes(node, few): (u, v) that bring any two sets of that similarity into one component.

    Sets of s elements that are similar share one of the first s - ceil(similarity * s) + 1 in one order of all
    elements, here from rare to common; whoever has an element there is linked to the smallest node that has it.
    """
    one = nodes.select("node", F.explode("few").alias("x"))
    common = stash(one.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), "common")
    known = one.join(common, "x", "left").select("node", "x", F.coalesce("n", F.lit(1)).alias("n"))
    s = F.size("all")
    most = s - F.ceil(s * F.lit(similarity) - 1e-9).cast("int") + 1
    head = known.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("all")).select("node", F.explode(F.slice("all", F.lit(1), most)).alias("e"))
    head = stash(head.where("e.n > 1").select("node", F.col("e.x").alias("x")), "heads")
    least = stash(head.groupBy("x").agg(F.min("node").alias("m")), "least")
    return head.join(least, "x").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v")).distinct()


def similar(first: list[int], second: list[int], flat: np.ndarray, starts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of sets, flat[starts[k] : starts[k + 1]] distinct, of first with second: of all pairs of exactly that similarity
    or more, those that components need. first and second may be the same."""
    codes = np.unique(flat, return_inverse=True)[1]
    sizes = np.diff(starts)
    second = np.array(second, np.int64)
    label = np.arange(len(sizes))
    mark = np.zeros(len(flat), bool)
    out = []
    for i in first:
        n = sizes[i]
        m = sizes[second]
        todo = second[(label[second] != label[i]) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6)]
        if not len(todo):
            continue
        mine = codes[starts[i] : starts[i + 1]]
        mark[mine] = True
        for j in todo.tolist():
            if label[j] != label[i]:
                both = int(np.count_nonzero(mark[codes[starts[j] : starts[j + 1]]]))
                if both / (n + sizes[j] - both) >= similarity:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
        mark[mine] = False
    return out


def _exact(similarity: float):
    def run(key, table):
        import pyarrow as pa

        root, tile, node = (table.column(k).to_numpy() for k in ("root", "tile", "node"))
        offsets, raw = buffers(table.column("set"))
        lo, hi = key[1].as_py(), key[2].as_py()
        sort = np.argsort(root, kind="stable")
        u, v = [], []
        for rows in np.split(sort, np.flatnonzero(np.diff(root[sort])) + 1) if len(sort) else []:
            starts = np.append(0, np.cumsum((offsets[rows + 1] - offsets[rows]) // 8))
            flat = np.frombuffer(b"".join(raw[offsets[k] : offsets[k + 1]].tobytes() for k in rows.tolist()), np.uint64)
            a, b = (np.flatnonzero(tile[rows] == x).tolist() for x in (lo, hi))
            for i, j in similar(a, b, flat, starts, similarity):
                u.append(node[rows[i]])
                v.append(node[rows[j]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _sets(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in trimmed(batches):
            offsets, raw = buffers(batch.column(3))
            raw = raw.tobytes()
            sets = [np.unique(hashes(raw[a:b], shingle)).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["root", "node", "size", "set"])

    return run


def exact_links(found: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """found(root, node, size, t): a forest of the links of exactly that similarity inside each root's candidates."""
    sets = stash(found.mapInArrow(_sets(shingle), "root long, node long, size long, set binary"), "sets")
    of = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    tiles = F.ceil(F.greatest(F.col("n") / SET_TILE, F.col("total") * 8 / SET_BYTES)).cast("int")
    of = stash(of.select(F.col("root").alias("r"), tiles.alias("tiles")), "roots")
    total = sets.select(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    dealt = sets.join(of, F.col("root") == F.col("r"))
    buckets = max(8, -(-total * 8 // SET_BYTES))
    dealt = dealt.select("root", "node", "set", "tiles", F.expr("cast(pmod(xxhash64(node), tiles) as int)").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    group = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.xxhash64("root"))
    dealt = dealt.select(group.alias("group"), F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "root", "tile", "node", "set")
    return dealt.groupBy("group", "ta", "tb").applyInArrow(_exact(similarity), "u long, v long")


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 8, spread: float = 4.5, id_col: str = "doc_id", text_col: str = "text", wordless: bool = False) -> DataFrame:
    """Documents with one row of each group of near copies: the one with the smallest (id, text hash).

    Documents are linked if the Jaccard similarity of their sets of shingles is `similarity` or more, and a group
    is a component. Candidates come from a wide SimHash: sets of similarity s have a cosine of 2s / (1 + s), and
    64 * words bits differ in acos(cosine) / pi of them on average; the radius is `spread` standard deviations
    more. Small sets find theirs by a prefix filter. The sets of candidates are compared exactly. Rows without words are left alone,
    or with `wordless` are one group, nulls too.
    """
    import math

    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = int(64 * words * share + spread * math.sqrt(64 * words * share * (1 - share)))
    few_most = int(FEW / similarity)
    hashed = docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("h")).alias("key"), text_col)
    prints = fingerprints(hashed, shingle, words, "key", text_col, few_most)
    prints = stash(prints if wordless else prints.where("size > 0"), "prints")
    order = F.struct(F.col("id.i").isNull(), "id.i", "id.h")
    nodes = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("few").alias("few"), F.min(order).alias("least"))
    nodes = stash(nodes, "nodes")
    wide = wide_links(nodes.where(F.col("size") >= FEW).select("node", "size", "fp"), radius, similarity)
    maybe = wide.union(few_links(nodes.where(F.col("size").between(1, few_most)).select("node", "few"), similarity))
    maybe = stash(components(maybe), "candidates")
    asked = stash(nodes.join(maybe, "node").select("root", "node", "size", F.col("least.i").alias("_i"), F.col("least.h").alias("_h")), "asked")
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    # texts meet what is asked of them by shuffles at every size
    found = texts.join(asked.hint("merge"), texts["i"].eqNullSafe(asked["_i"]) & (texts["h"] == asked["_h"])).select("root", "node", "size", "t")
    comp = stash(components(exact_links(found, shingle, similarity)), "components")
    rooted = nodes.join(comp, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    names = stash(rooted.join(best, "root").select("node", "best"), "names")
    drop = prints.join(names, "node").where(~F.col("id.i").eqNullSafe(F.col("best")["i"]) | (F.col("id.h") != F.col("best")["h"]))
    drop = stash(drop.select(F.col("id.i").alias("_i"), F.col("id.h").alias("_h")).distinct(), "drop")
    return docs.join(drop.hint("merge"), F.col(id_col).eqNullSafe(drop["_i"]) & (F.xxhash64(F.col(text_col)) == drop["_h"]), "left_anti")
