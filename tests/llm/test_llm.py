"""The training-data operators against brute force on small tables, with nulls, repeats, ties, empty and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalane.llm import bpe, decontaminate, licenses, line_dedup, pii, pretokens, quality, simhash, suffix, token_files, topk
from stratalane.llm._graph import components, forest

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row int, _i string, h string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ".", "\n"]) for _ in range(n))


def corpus():
    rng = random.Random(11)
    docs = [(k, words(rng, rng.randrange(5, 120))) for k in range(60)]
    passage = words(rng, 60)
    docs += [(100 + k, words(rng, 20) + "\n" + passage + "\n" + words(rng, 20)) for k in range(6)]
    docs += [(200 + k, docs[3][1]) for k in range(4)]
    docs += [(210 + k, docs[5][1] + f" tail{k}") for k in range(4)]
    docs += [(300, None), (301, ""), (302, " \n\t"), (303, "x" * 3000), (304, "É日本 don't  stop"), (305, "w1 w2"), (None, words(rng, 50)), (None, passage)]
    docs += [docs[7], docs[7], (400, words(rng, 9000))]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, k, "clash", "clash") for k, (i, t) in enumerate(corpus())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- op 1


def test_licenses(spark, empty):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("MIT License"))
    wrapped = "\n".join(" ".join(mit.split()[k : k + 9]) for k in range(0, len(mit.split()), 9))
    texts = [
        mit, "Copyright (c) 2020 Jane\n" + mit.upper().replace(".", " . "), mit.replace("License", "Licence"), mit[:-30], "text\n# Licensed under the MIT License.\nmore", None, "", "Copyright (c) 2001 A\n",
        "Copyright Jane Doe 2020\n" + mit, "Copyright Jane Doe\n" + mit, "Copyright by The Example Authors\r\nAll rights reserved.\r\n" + mit.replace("\n", "\r\n"), "© 1999 Someone\n" + wrapped, mit, mit,
        "word " * 60000 + "\nSPDX-License-Identifier: MIT\n" + "word " * 60000, "// My own notice, 7.\nother", "Copyright notice of ours\n" + mit,
    ]
    df = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in enumerate(texts)], "doc_id long, text string, digest string, license string, _text string")
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(df, more=[("Own", "my own notice 7")]).collect()}
    assert [got[k][0] for k in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, None]
    assert [got[k][0] for k in range(8, 17)] == ["MIT"] * 6 + [None] * 3
    assert got[4][1] == "MIT" and got[5][1] == "" and got[14][1] == "MIT" and got[15][1] == "Own"
    assert licenses.scan(df).columns == ["doc_id", "digest", "license", "notices"]
    assert licenses.scan(empty).count() == 0


# --- op 2


def fingerprint(text, n):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in nodes}


def test_simhash(docs, empty):
    got = rows(simhash.classes(docs), "doc_id", "fingerprint", "component_id")
    prints = [(i, fingerprint(t, 4)) for i, t in corpus()]
    nodes = {p for _, p in prints}
    comp = union([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4], nodes)
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    assert got == sorted(((i, f"{p:016x}", least.get(comp[p])) for i, p in prints), key=repr)
    assert simhash.classes(empty).count() == 0


def test_compare_tiles_is_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 1200, dtype=np.uint64)
    x[600:] = x[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    ids = x.view(np.int64)
    links = simhash._Links()
    simhash.compare(x[:700, None], ids[:700], x[700:, None], ids[700:], 3, links)
    want = {(int(ids[a]), int(ids[700 + b])) for a in range(700) for b in np.flatnonzero(np.bitwise_count(x[a] ^ x[700:]) <= 3)}
    assert {(int(a), int(b)) for a, b in zip(np.concatenate(links.u), np.concatenate(links.v))} == want


def test_large_buckets_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(5)
    base = np.uint64(0x123456789ABCDEF)
    x = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), rng.integers(0, 2**64, 200, dtype=np.uint64)])).view(np.int64)
    nodes = spark.createDataFrame([(int(v),) for v in x], "fp long")
    got = dict(rows(components(simhash.narrow_links(nodes, 4)), "node", "root"))
    u = x.view(np.uint64)
    comp = union([(int(x[a]), int(x[b])) for a in range(len(x)) for b in range(a) if (int(u[a]) ^ int(u[b])).bit_count() <= 4], [int(v) for v in x])
    assert {k: got.get(k, k) for k in comp} == comp


def test_tile_pairs_of_far_counts_are_not_formed(spark):
    rng = np.random.default_rng(6)
    x = np.unique((rng.integers(0, 2**50, 400, dtype=np.uint64) & rng.integers(0, 2**50, 400, dtype=np.uint64)) | (np.uint64(5) << np.uint64(51)))  # one bucket of the last band
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    entries = simhash.bands(nodes, 4).where(f"band = 4 and value = {int(x[0]) >> 51}")
    pairs = simhash.tiles(entries, 4, 16).select("ta", "tb").distinct().collect()
    counts = {int(v).bit_count() for v in x}
    tiles = {r.ta for r in pairs} | {r.tb for r in pairs}
    assert {t >> 20 for t in tiles} == counts and max(counts) - min(counts) > 8
    assert all(abs((r.ta >> 20) - (r.tb >> 20)) <= 4 for r in pairs)
    assert 0 < len(pairs) < len(tiles) * (len(tiles) + 1) // 2  # pairs were skipped


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(40)]
    got = dict(rows(components(spark.createDataFrame(pairs, "u long, v long")), "node", "root"))
    want = union(pairs, {x for p in pairs for x in p})
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want if k not in got)
    u, v = forest(np.array([5, 7, 9], np.int64), np.array([7, 9, 11], np.int64))
    assert dict(zip(u.tolist(), v.tolist())) == {7: 5, 9: 5, 11: 5}


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    import stratalane.llm._graph as graph

    pairs = [(k, k + 1) for k in range(0, 400) if k % 100] + [(900 - k, 901 - k) for k in range(60)] + [(7, 7), (-5, 2**62), (2**62, -5)]
    want = union(pairs, {x for p in pairs for x in p})
    links = spark.createDataFrame(pairs, "u long, v long").repartition(7)
    spark.sparkContext.setJobGroup("few links", "")
    got = dict(rows(components(links), "node", "root"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {k: v for k, v in want.items() if k != 7 or k in got}
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 16
    monkeypatch.setattr(graph, "AT_ONCE", 0)  # by rounds it is the same
    assert dict(rows(components(links), "node", "root")) == got


def test_near_dedup(spark, empty):
    rng = random.Random(8)
    fresh = [words(rng, 200, 5000) for _ in range(40)]
    near = []
    for k in range(10):
        w = fresh[k].split(" ")
        w[50] = "changed"
        near.append(" ".join(w))
    far = [" ".join(x if j % 4 else "other" for j, x in enumerate(fresh[20 + k].split(" "))) for k in range(10)]
    texts = fresh + near + far + [fresh[30]] * 5 + [None, "", None]
    df = spark.createDataFrame([(k, t, k, "c", "c") for k, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert kept == set(range(40)) | set(range(50, 60)) | {65, 66, 67}
    assert simhash.near_dedup(df).columns == df.columns and simhash.near_dedup(empty).count() == 0


# --- op 3


@pytest.mark.parametrize("block", [2048, 3])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    v = [(k, rng.normal(size=8).astype(float).tolist()) for k in range(120)]
    v += [(200 + k, v[4][1]) for k in range(30)] + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [1.0, 2.0]), (None, v[0][1]), (304, []), v[9], v[9], (350, [1e30] * 8), (400, v[4][1])]
    df = spark.createDataFrame([(i, x, 0) for i, x in v], "vec_id long, embedding array<double>, score int").repartition(4)
    got = rows(topk.search(df.where("vec_id % 50 = 0"), df, k=5), "query_id", "rank", "vec_id", "score")
    clean = [(i, tuple(min(2**63 - 1, max(-(2**63), int(np.floor(256 * c)))) for c in x)) for i, x in v if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for i, q in set(clean):
        if i % 50 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in clean if j != i and len(c) == len(q))
            want += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s[:5])]
    assert got == sorted(want, key=repr)
    assert topk.search(df.where("false"), df).count() == 0 and topk.search(df, df.where("false")).count() == 0


def test_topk_resolves_few_scores():
    rng = np.random.default_rng(3)
    c = rng.integers(-200, 200, (4000, 32))
    c[:, :16] *= 8
    q = c[:20]
    qid, ids, cuts = np.arange(20), np.arange(4000), [0, 16, 32]
    full = np.where(qid[:, None] == ids[None, :], -(10**9), q @ c.T)
    cutoff = np.sort(full, 1)[:, -5].astype(float)
    lists = [q[:, a:b] @ c[:, a:b].T for a, b in zip(cuts, cuts[1:])]
    lows, highs = (np.stack([f(p, 1) for p in lists], 1).astype(float) for f in (np.min, np.max))
    share = lows + np.floor((cutoff - lows.sum(1)) / 2)[:, None]
    counts = topk.Counts()
    a, b, total = topk.resolve(q, qid, c, ids, cutoff, share, highs, cuts, counts)
    assert {(int(x), int(y)) for x, y in zip(a, b)} == {(int(x), int(y)) for x, y in zip(*np.nonzero(full >= cutoff[:, None]))}
    assert (total == full[a, b]).all() and counts.made < 0.6 * counts.all


# --- op 4 and 5


def test_pretokens():
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", " ", "é", "日", "1", "²", "!", "A", "́", "😀", "\x1c", "\x85", "　", "'ve"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]
    encoder = bpe.RankEncoder(RANKS, public_tokenizers.PATTERN)
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, odd = pretokens.cuts(offsets, data)
    ends, at = np.append(starts, len(data)), np.searchsorted(starts, offsets)
    for k, t in enumerate(texts):
        got = [data[ends[j] : ends[j + 1]].tobytes() for j in range(at[k], at[k + 1])]
        assert b"".join(got) == raw[k]
        assert odd[k] or [i for x in encoder.words(got) for i in x] == encoder.text(t), repr(t)


def test_bpe(docs, empty):
    encoder = bpe.RankEncoder(RANKS, public_tokenizers.PATTERN)
    tokens = bpe.encode(docs, encoder)
    want = [(i, encoder.text(t or ""), t or "") for i, t in corpus()]
    back = bpe.decode(tokens, RANKS)
    assert sorted(((r.doc_id, r.ids, bytes(r.text).decode()) for r in back.collect()), key=repr) == sorted(want, key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = rows(bpe.digests(tokens, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(((i, len(x), sha(" ".join(map(str, x))), sha(t)) for i, x, t in want), key=repr)
    assert bpe.encode(empty, encoder).count() == 0


def test_token_files(spark, docs, empty):
    encoder = bpe.JsonEncoder(JSON)
    extra = spark.createDataFrame([(500, "a <|endoftext|> b", 0, "", "")], SCHEMA)
    manifest = token_files.write(docs.union(extra), encoder, sequence=16)
    table = [(i, encoder.text(t or "") + [0], t or "") for i, t in [*corpus(), (500, "a <|endoftext|> b")]]
    table.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[2].encode()))
    want, at = [], 0
    for i, x, _ in table:
        want.append((i, at, len(x), x))
        at += len(x)
    assert rows(token_files.read(manifest), "doc_id", "start", "n_tokens", "ids") == sorted(want, key=repr)
    crc = [(i, s, n, zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, n, x in want]
    assert rows(token_files.checksums(manifest), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(crc, key=repr)
    f = token_files.TokenFile(manifest.first()["file"])
    ids, mask = f[0]
    assert len(ids) == len(mask) == 16 and mask.sum() == min(16, f.n_ids) and ids.dtype == np.uint16
    assert token_files.write(empty, encoder).count() == 0
    named = docs.selectExpr("concat('doc-', lpad(cast(doc_id as string), 6, '0')) as doc_id", "text")
    manifest = token_files.write(named, encoder, sequence=16)
    ordered = sorted(((i is not None, b"" if i is None else b"doc-%06d" % i, (t or "").encode()) for i, t in corpus()))
    starts, at = [], 0
    for z, i, t in ordered:
        n = len(encoder.text(t.decode())) + 1
        starts.append((i.decode() if z else None, at, n))
        at += n
    assert rows(manifest, "doc_id", "start", "n_tokens") == sorted(starts, key=repr)
    assert token_files._filesystem("file:///tmp")[1] == "/tmp"


def test_words_are_encoded_as_lines():
    """An owner of words hands them to the library about a hundred at a time, with the ids that each has alone."""
    import pyarrow as pa

    rng = random.Random(6)
    parts = ["'", "s", "ll", " ", "  ", "\n", "\t", "é", "日", "1", "!", "A", "\u0301", "😀", "\x1c", "\x85", "\u3000", "\u180e", "\ufeff", "<|", "endoftext", "|>", "'ve"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, _ = pretokens.cuts(np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64), data)
    words = sorted(set(pretokens.dictionary(starts, data)[1].to_pylist()) | {b"w%d" % k for k in range(5000)})
    rng.shuffle(words)
    sizes = []

    class Counting(bpe.JsonEncoder):
        @property
        def lib(self):
            return self

        def encode_batch_fast(self, texts, **kw):
            sizes.append(len(texts))
            return plain.lib.encode_batch_fast(texts, **kw)

        def __getattr__(self, name):
            return getattr(plain.lib, name)

    plain = bpe.JsonEncoder(JSON)
    half = len(words) // 2
    blobs = [bpe._pack(np.array([len(w) for w in ws], "<u4"), np.frombuffer(b"".join(ws), np.uint8)) for ws in (words[:half], words[half // 2 :])]
    out = bpe._encode(Counting(JSON))((pa.scalar(0),), pa.table({"block": [0, 1], "owner": [0, 0], "words": pa.array(blobs, pa.binary())}))
    for blob, ws in zip(out.column("ids").to_pylist(), (words[:half], words[half // 2 :])):
        counts, ids = bpe._unpack(blob, 2)
        want = [plain.lib.encode(w.decode(), add_special_tokens=False).ids for w in ws]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert sum(sizes) < len(words) / 20
    # a line feed that some vocabulary joins to what stands before it: the piece goes word by word
    joined = Counting(JSON)
    joined.encode_batch_fast = lambda texts, **kw: plain.lib.encode_batch_fast([t.replace("b\n", "b ") for t in texts], **kw)
    counts, ids = joined.flat([b"a", b" b", b" ", b"c"])
    assert counts.tolist() == [len(plain.text(t)) for t in ("a", " b", " ", "c")] and ids.tolist() == [i for t in ("a", " b", " ", "c") for i in plain.text(t)]


def test_owners_of_words(monkeypatch):
    """Both ends find the same order and owners from the words alone, also where two words have one hash."""
    import pyarrow as pa

    words = [b"w%d" % k for k in range(4000)] + [b"x" * k for k in range(1, 200)] + [b"y" * 64 + b"z%d" % k for k in range(50)]
    mixed = random.Random(2).sample(words, len(words))
    for owners in (1, 4, 51):
        found = []
        for listed in (words, mixed):
            order, owner = bpe._owned(pa.array(listed, pa.large_binary()), owners)
            assert sorted(order.tolist()) == list(range(len(words))) and (np.diff(owner[order]) >= 0).all()
            found.append([(listed[k], int(owner[k])) for k in order])
        assert found[0] == found[1]
        share = np.bincount([o for _, o in found[0]], minlength=owners)
        assert len(share) == owners and share.max() < 2 * len(words) / owners
    monkeypatch.setattr(bpe, "_hashes", lambda words: np.array([len(w.as_py()) << 33 for w in words], np.uint64))
    same = [[listed[k] for k in bpe._owned(pa.array(listed, pa.large_binary()), 4)[0]] for listed in (words, mixed)]
    assert same[0] == same[1] == sorted(words, key=lambda w: (len(w), w))
    assert len(bpe._owned(pa.array([], pa.large_binary()), 4)[0]) == 0


def test_near_dedup_links_by_exact_similarity(spark):
    rng = random.Random(31)
    fresh = iter(rng.sample(range(10**6, 10**7), 200000))
    base = lambda n: [f"v{next(fresh)}" for _ in range(n)]
    texts, want = [], set()
    for n, extra in [(8, 1), (10, 1), (16, 3), (24, 5), (68, 16), (84, 20), (404, 100), (1004, 250)] * 6:  # 0.8 or more
        a = base(n)
        want.add(len(texts))
        texts += [" ".join(a), " ".join(a + base(extra))]
    for n, extra in [(8, 2), (24, 6), (68, 18), (404, 110), (404, 130)] * 6:  # less
        a = base(n)
        want |= {len(texts), len(texts) + 1}
        texts += [" ".join(a), " ".join(a + base(extra))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.near_dedup(df).collect()} == want


# --- op 6


def test_line_dedup(docs, empty):
    divisor = 3
    got = {(r.row, r.text) for r in line_dedup.clean(docs, divisor=divisor).collect()}
    texts = [t for _, t in corpus()]
    first = {}
    parsed = {}
    for k, (i, t) in enumerate(corpus()):
        lines = (t or "").encode().split(b"\n")
        parsed[k] = (lines, line_dedup.chunks(lines, divisor))
        for c, (a, b) in enumerate(parsed[k][1]):
            if b - a > 1 and sum(1 for x in lines[a:b] if x.strip()) > 1:
                first.setdefault(tuple(lines[a:b]), []).append((i is None, i or 0, i, t, c, k))
    hashed = {r.row: r.hh for r in docs.selectExpr("row", "xxhash64(text) hh").collect()}
    keep = {x: min((z, i0, hashed[k], c) for z, i0, _, _, c, k in v) for x, v in first.items()}
    want = set()
    for k, (i, t) in enumerate(corpus()):
        lines, cut = parsed[k]
        out = []
        for c, (a, b) in enumerate(cut):
            key = tuple(lines[a:b])
            if key in keep and b - a > 1 and keep[key] != (i is None, i or 0, hashed[k], c):
                continue
            out += lines[a:b]
        want.add((k, None if t is None else b"\n".join(out).decode()))
    assert got == want and any(len(t or "") < len(texts[k] or "") for k, t in got)
    assert line_dedup.clean(docs).columns == docs.columns and line_dedup.clean(empty).count() == 0


def repeated_lines(texts):
    """Of each text, in order: lines of two in a row, or long ones, that an earlier place has."""
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b in [*zip(full, full[1:]), *((k, k) for k in full if len(lines[k].split()) > 50)]:
            key = tuple(lines[a : b + 1])
            if key in seen:
                gone |= set(range(a, b + 1))
            seen.add(key)
        kept = [x for k, x in enumerate(lines) if k not in gone]
        out.append("\n".join(kept) if any(x.strip() for x in kept) or not gone else "")
    return out


def test_line_dedup_passages(spark):
    rng = random.Random(12)
    line = lambda n=8: words(rng, n, 5000).replace("\n", "")
    passages = [[line() for _ in range(n)] for n in range(2, 10)] + [[line(60)], [line(), "", line()]]
    texts = ["\n".join([line(), *p, line(), line()]) for p in passages]
    texts += ["\n".join([line(), line(), *p, line()]) for p in passages]
    texts += [texts[0], texts[8], texts[0] + "\n", "", "\n\n", "a a\na a\na a\na a", line() + "\n" + passages[3][0] + "\n" + line()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.text for r in line_dedup.clean(df, passages=True).orderBy("doc_id").collect()]
    assert got == repeated_lines(texts)
    assert all(len(t.split("\n")) == 3 for t in got[len(passages) : 2 * len(passages)]) and got[-7:-4] == ["", "", ""]


# --- op 7


def benchmark_of(spark):
    rng = random.Random(11)
    c = [t for _, t in corpus()]
    part = c[60].split("\n")[1] if "\n" in c[60] else c[60]
    items = [("a", " ".join(re.findall(r"\w+", c[61])[25:60])), ("b", "w1"), ("c", "W2, w3"), ("d", None), ("e", "... "), ("f", part), (None, "w5 w6"), ("a2", " ".join(f"w{rng.randrange(400)}" for _ in range(40))), ("b", "w1"), ("g", "x" * 3000)]
    return items, spark.createDataFrame(items, "item_id string, text string")


def test_decontamination(spark, docs, empty):
    items, benchmark = benchmark_of(spark)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    want = []
    for i, t in corpus():
        w, hit, names = word(t), set(), set()
        for name, text in items:
            p = word(text)
            n = min(13, len(p))
            grams = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    names.add(name or "")
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want.append((i, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    got = rows(decontaminate.report(docs, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(want, key=repr) and any(x[2] for x in want)
    assert decontaminate.clean(docs, benchmark).count() == sum(not x[5] and x[2] < 13 for x in want)
    assert decontaminate.clean(docs, benchmark).columns == docs.columns
    assert decontaminate.report(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, benchmark.where("false")).collect())
    found = decontaminate.items_of(benchmark, 13, "item_id", "text")
    near = decontaminate.proximity(decontaminate.index(docs, found), found, terms=2, span=5)
    assert "c" in {r.item_id for r in near.collect()}


def test_proximity(spark):
    rng = random.Random(17)
    texts = [" ".join(f"t{rng.randrange(12)}" if rng.random() < 0.2 else f"x{rng.randrange(900)}" for _ in range(rng.randrange(5, 160))) for _ in range(40)] + [None, "", "t1 t2 t3", "t3 t2 t1 t1"]
    items = [("p", "t1 t2 t3"), ("q", "t4 t5"), ("r", "t6"), ("s", "t7 t8 nowhere"), ("u", "t9 t9 t10 t11")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontaminate.items_of(spark.createDataFrame(items, "item_id string, text string"), 13, "item_id", "text")
    for terms, span in ((3, 7), (2, 20), (3, 50)):
        posted = collections.Counter(w for t in texts for w in (t or "").split())
        want = set()
        for name, text in items:
            order = list(dict.fromkeys(text.split()))
            rare = sorted(((min(posted[w], 10**9), w) for w in order if posted[w]))[:terms]
            if len(rare) < min(terms, len(order)):
                continue
            rare = {w for _, w in rare}
            for i, t in enumerate(texts):
                w = (t or "").split()
                for end, x in enumerate(w):
                    if x in rare:
                        last = [max((p for p in range(end + 1) if w[p] == y), default=-1) for y in rare]
                        if min(last) >= 0 and end - min(last) < span:
                            want.add((i, name, min(last), end))
        got = {(r.kid, r.item_id, r.start, r.end) for r in decontaminate.proximity(decontaminate.index(docs, found), found, terms, span).collect()}
        assert got == want and want


# --- op 8


def brute(text):
    r = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, f) in r.items() for m in re.finditer(p, text) if f(m[0])]


def test_pii_base():
    rng = random.Random(2)
    parts = ["a", "b1", "@", "@", "..", ".", "-", "+", "1", "22", "333", "4444", " ", "(", ")", "%", "255", "é", "4111111111111111", "+1 (2"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert pii.base(t) == brute(t), repr(t)
    for t in ("a" * 100000 + "@", "1" * 100000, "1." * 50000, "+1" * 30000, "@" * 50000):
        assert pii.base(t) == [] or all(k == "ip" for k, *_ in pii.base(t))


def test_pii(spark, empty):
    rng = random.Random(4)
    texts = []
    for k in range(150):
        phone = f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        texts.append(" ".join(["word"] * rng.randrange(8) + [rng.choice([phone, f"u{k}.x@mail{k}.org", f"{rng.randrange(256)}.{rng.randrange(256)}.7.{rng.randrange(256)}"])] + ["text"] * 5))
    texts += ["call (415) 555-2671 now", "plain words only", "version 10.2 of 2024", None, "", "key a8f9023bc8d7e", "mail jane at corp dot com please"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    got = {r.doc_id: r for r in pii.report(pii.find(df, model)).collect()}
    for k, t in enumerate(texts):
        want = ",".join(f"{a}:{b}:{c}" for a, b, c in brute(t or ""))
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[k].spans.split(","))
    assert got[150].spans.startswith("phone:")
    assert all(got[k].spans == "" for k in (151, 152, 153, 154, 155))
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_pii_long_regions_and_spans(spark):
    rng = random.Random(8)
    long = "," .join(f"k{k}=v{k}" for k in range(400)) + ",415-555-2671," + ",".join(f"k{k}=v{k}" for k in range(400))
    texts = [f"call +1 (415) 555-{k:04d} or mail a{k}@b{k}.org now" for k in range(200)] + [long, long, "x" * 200000 + " 10.0.0.1"]
    assert max(t[-1][1] - t[0][0] for t in pii.regions(long)) == len(long)  # a region reaches to white space, however far
    model = pii.train(texts[:200])
    df = spark.createDataFrame([(k, t, "c", "c") for k, t in enumerate(texts)], "doc_id long, text string, base string, spans string")
    got = {r.doc_id: r.spans for r in pii.report(pii.find(df, model)).collect()}
    for k, t in enumerate(texts):  # the field's spans against all segmentations' best, region by region
        known = brute(t)
        more = []
        for tokens in pii.regions(t):
            segs, out = pii._scored(model, t, tokens)
            value = {0: (0.0, [])}
            for j in range(1, len(tokens) + 1):
                options = [(value[j - 1][0] + out[j - 1], value[j - 1][1])] + [(value[s[0]][0] + s[4], [*value[s[0]][1], n]) for n, s in enumerate(segs) if s[1] == j]
                value[j] = max(options, key=lambda o: o[0])
            _, p, _ = pii.marginals(segs, out) if segs else (0, [], 0)
            for n in value[len(tokens)][1]:
                a, b = tokens[segs[n][0]][0], tokens[segs[n][1] - 1][1]
                if p[n] >= 0.9 and not any(a < y and x < b for _, x, y in known):
                    more.append((segs[n][2], a, b))
        want = sorted(known + more, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        assert got[k] == ",".join(f"{a}:{b}:{c}" for a, b, c in want), k


def test_semi_markov_is_exact():
    segs = [(0, 1, "a", [], 0.5), (0, 2, "b", [], 1.7), (1, 3, "a", [], 0.9), (2, 3, "b", [], -0.2)]
    out = [0.1, 0.3, -0.4]
    paths = []

    def walk(i, score, chosen):
        if i == 3:
            paths.append((score, chosen))
            return
        walk(i + 1, score + out[i], chosen)
        for k, s in enumerate(segs):
            if s[0] == i:
                walk(s[1], score + s[4], [*chosen, k])

    walk(0, 0.0, [])
    z, p, _ = pii.marginals(segs, out)
    total = sum(np.exp(s) for s, _ in paths)
    assert np.isclose(np.exp(z), total)
    for k in range(4):
        assert np.isclose(p[k], sum(np.exp(s) for s, c in paths if k in c) / total)
    assert pii.best(segs, out) == max(paths)[1]


# --- op 9


def test_quality(spark, empty):
    rng = random.Random(6)
    good = [" ".join(f"{a}{b}" for a, b in zip(rng.choices("bcdfgl", k=80), rng.choices(["ato", "ine", "oru", "ela", "umi"], k=80))) + "." for _ in range(400)]
    junk = ["SALE!! " * 60 if k % 2 else "spam " * 90 for k in range(100)]
    rude = [f"{g} idiot {g[:40]}" for g in good[:60]]
    texts = good + junk + rude + [None, ""]
    docs = spark.createDataFrame([(k, t, k, "x", "y") for k, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(k, int(not 400 <= k < 500), int(k >= 500)) for k in range(0, 560, 2)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    w = quality.fit(docs, labels)
    s = {r.row.doc_id: r.score for r in quality.score(docs, w).collect()}
    held = range(1, 560, 2)
    right = sum((s[k] >= 0.5) == (k >= 400) for k in held)
    assert right / len(held) > 0.97
    assert quality.clean(docs, labels).columns == docs.columns
    assert quality.clean(empty, labels).count() == 0
    assert (quality.fit(docs, labels) == w).all()
    assert len(quality.fit(docs, None)) == len(w)


def test_measures_are_alike_at_every_length():
    for letters in ("СТОП ", "STOP ", "ÉÀ日本 "):
        caps = {quality.measures(letters * k)["capitals"] for k in (39, 40, 41, 400, 4000)}
        assert len(caps) == 1 and (max(caps) == 1.0 or letters[-3] == "日" or max(caps) == 0.5)
    for n in (199, 200, 201):
        assert quality.measures(("Абв" * n)[:n])["capitals"] == pytest.approx(1 / 3, abs=0.01)


def plain_look(text):
    """Measures and words as they are defined."""
    parts, letters = text.split(), [c for c in text if c.isalpha()]
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(parts))
    return {
        "repeats": sum(a == b for a, b in zip(parts, parts[1:])) / n,
        "capitals": sum(c.isupper() for c in letters) / max(1, len(letters)),
        "symbols": len(re.findall(r"[*%$#&^~@=+]{2,}", text)) / n,
        "bangs": text.count("!!") / n,
        "pipes": text.count("|") / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters": len(letters) / max(1, len(text)),
        "distinct": len(set(parts)) / n,
    }, {x.lower() for x in re.findall(r"[^\W\d_]+", text)}


def test_look_is_as_defined():
    rng = random.Random(19)
    odd = ["", " ", "\n\n", "ΑΣ'Α ΟΔΟΣ ΣΑΣ", "İstanbul İ I", "a²b ½x Ⅷ Ⓐ x_y 12ab ٣٤", "!!! || ** %$# @= =", " a\u0085b\x1cc\u3000d", "ǅ ß ẞ", "𝔘𝔫 𐐀𐐨", "\r\n \x0b\n a\n a", "a\0B", "日本 STOP", "e\u0301E\u0301"]
    odd += ["".join(rng.choices("aAbéÉσΣς0²_ \n!|*=日\u0301İ", k=rng.randrange(60))) for _ in range(500)] + ["".join(rng.choices("aAbB0_ \n!|*=\t@", k=rng.randrange(60))) for _ in range(500)]
    for text in odd + ["".join(chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000)]:
        assert quality.look(text) == plain_look(text), text[:60]


def test_look_is_cheap():
    import time

    rng = random.Random(20)
    some = [words(rng, 3000, 800) for _ in range(20)]

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            for t in some:
                f(t)
            took.append(time.process_time() - began)
        return min(took)

    before = lambda t: (collections.Counter(t), re.findall(r"[*%$#&^~@=+]{2,}", t), {*map(str.lower, re.findall(r"[^\W\d_]+", t))})  # noqa: E731  part of what it did
    assert seconds(quality.measures) < seconds(before)


def test_telling_words_give_the_score(monkeypatch):
    monkeypatch.setattr(quality.Telling, "MOST", 50)  # so that what is kept goes now and then
    rng = np.random.default_rng(3)
    w = np.zeros(1 << quality.BITS, np.float32)
    some = [words(random.Random(k), 120, 400) + " Ünï" * (k % 2) + " x" * k + "y" * 3 * k for k in range(30)]
    full = [quality.features(*quality.look(t)) for t in some]
    met = np.unique(np.concatenate(full))
    w[rng.choice(met, len(met) // 5, replace=False)] = 0.5  # halves add up exactly
    weighs = set(np.flatnonzero(w).tolist())
    told = [quality.Telling(kind, weighs) for kind in "wpq"]
    for t, f in zip(some * 2, full * 2):
        short = quality.weighing(*quality.look(t), told)
        assert len(short) < len(f) and w[short].sum() == w[f].sum()


def test_fit_counts_without_a_copy_of_all_features():
    import tracemalloc

    rng = np.random.default_rng(4)
    feats = [np.unique(rng.integers(0, 1 << quality.BITS, 2000)).astype(np.int32) for _ in range(1500)]
    post = rng.random(len(feats))
    tracemalloc.start()
    quality.screen(feats, post)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < sum(map(len, feats)) * 8
    flat, row = np.concatenate(feats), np.repeat(np.arange(len(feats)), list(map(len, feats)))
    assert (quality.summed(feats, post) == np.bincount(flat, post[row], 1 << quality.BITS)).all()


def test_quality_cases(spark):
    texts = [None, "", "same text", "same text", "word " * 100000, "СТОП " * 50]
    docs = spark.createDataFrame([(k, t, 0.5, "c") for k, t in enumerate(texts)] + [(None, "x", 0.1, "c")], "doc_id long, text string, score double, row string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (4, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    w = quality.fit(docs, labels)
    got = {r.row.doc_id: r.score for r in quality.score(docs, w).collect()}
    assert got[2] == got[3] and len(got) == 7 and quality.clean(docs, labels).columns == docs.columns
    assert quality.smallest(docs.where("doc_id is not null"), 3, "doc_id").count() == 3


def test_counts_stand_for_rows():
    rng = np.random.default_rng(1)
    v = rng.integers(-1, 2, (500, 4))
    u, n = np.unique(v, axis=0, return_counts=True)
    a, ta = quality.maximise(v)
    b, tb = quality.maximise(u, n.astype(float))
    assert np.allclose(ta, tb, atol=1e-6)


def test_label_model():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    acc = [0.9, 0.75, 0.6, 0.85]
    v = np.stack([np.where(rng.random(3000) < 0.7, np.where(rng.random(3000) < a, 2 * y - 1, 1 - 2 * y), 0) for a in acc] + [np.zeros(3000, int)], 1)
    post, table = quality.maximise(v)
    assert ((post > 0.5) == y).mean() > 0.88
    found = [table[j, 1, 2] / (table[j, 1, 0] + table[j, 1, 2]) for j in range(4)]
    assert np.allclose(found, acc, atol=0.08)


# --- op 10


def covered(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        c = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                c[k : k + length] = b"\1" * length
        out.append(c)
    return raw, out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT_RUNS", hot)
    got = rows(suffix.dedup(docs), "doc_id", "kept", "n_bytes", "n_removed", "n_spans")
    raw, cov = covered([t for _, t in corpus()], 200)
    want = []
    for (i, _), b, c in zip(corpus(), raw, cov):
        kept = bytes(x for x, k in zip(b, c) if not k)
        want.append((i, kept, len(b), sum(c), sum(1 for k in range(len(c)) if c[k] and (not k or not c[k - 1]))))
    got = sorted(((a, bytes(b), *r) for a, b, *r in got), key=repr)
    assert got == sorted(want, key=repr) and any(x[3] for x in want)
    assert suffix.dedup(empty).count() == 0


def test_suffix_dedup_hot_minimizer_twice(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_RUNS", 2)
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    # the gram with the smallest hash of many is the minimizer of all windows around it
    grams = [text(32) for _ in range(20000)]
    h, _ = suffix.minimizers(np.frombuffer("".join(grams).encode(), np.uint8), 32, 32)
    gram = grams[int(np.argmin(h[::32]))]
    passage = text(134) + gram + text(134)
    texts = [text(50) + passage + gram + text(150), text(50) + passage + text(200), "ab" * 400, "ab" * 300 + text(300)]
    texts += [text(100) + gram + text(200) for _ in range(4)] + [gram * 20, text(90) + gram * 15 + text(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw, cov = covered(texts, 200)
    want = [(k, sum(c)) for k, c in enumerate(cov)]
    assert rows(suffix.dedup(df), "doc_id", "n_removed") == want and want[0][1] >= 300


def test_suffix_runs_of_long_texts(spark, monkeypatch):
    """Work on a text of several slices needs memory of one slice, and windows across their edges are found."""
    import tracemalloc

    raw = np.random.default_rng(8).integers(97, 123, 12 << 20).astype(np.uint8)
    tracemalloc.start()
    suffix.runs(np.array([0, len(raw)]), raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    text = raw[: 1 << 20].tobytes().decode()
    edge = suffix.SLICE
    other = raw[2 << 20 :][:900].tobytes().decode()
    df = spark.createDataFrame([(1, text), (2, other + text[edge - 170 : edge + 130] + other[:150])], "doc_id long, text string")
    assert rows(suffix.dedup(df), "doc_id", "n_removed", "n_spans") == [(1, 300, 1), (2, 300, 1)]

    raw, offsets = raw[:9000], np.array([0, 300, 350, 5000, 5900, 9000])

    def hashes():
        doc, order, first, last, h, _, (of, f, l, step, _) = suffix.runs(offsets, raw)
        assert all(order[doc == d].tolist() == list(range((doc == d).sum())) for d in range(5))
        return {k: x for a, b, x in zip(first, last, h) for k in range(a, b + 1)}, {k: (h[r], q) for r, a, b, q in zip(of, f, l, step) for k in range(a, b + 1)}

    whole = hashes()
    monkeypatch.setattr(suffix, "SLICE", 1000)
    assert hashes() == whole and len(whole[0]) == 101 + 4451 + 701 + 2901


def test_shards_in_parts():
    rng = random.Random(9)
    base = bytes(rng.randrange(97, 101) for _ in range(700))
    segs = [base[rng.randrange(0, 300) :][: rng.randrange(60, 300)] for _ in range(30)] + [b"a" * 200, bytes(rng.randrange(256) for _ in range(150))]
    seen = collections.Counter(x[k : k + 40] for x in segs for k in range(len(x) - 39))
    want = [[seen[x[k : k + 40]] > 1 for k in range(len(x) - 39)] for x in segs]
    for most in (1 << 20, 900):
        assert [f.tolist() for f in suffix.shard_repeats(segs, 40, most)] == want


def test_kasai():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    sa, rank = suffix.refine(raw, 60)
    b = raw.tobytes()
    live = sorted(range(341), key=lambda k: b[k : k + 60])
    assert [b[k : k + 60] for k in sa if k <= 340] == [b[k : k + 60] for k in live]
    at = np.arange(1, 300)
    before = at - 1
    got = suffix.kasai(raw, at, before, 60)
    for a, p, g in zip(at, before, got):
        n = 0
        while n < 60 and a + n < 400 and b[a + n] == b[p + n]:
            n += 1
        assert g == n


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        df = stage(spark, docs, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or df.columns == columns
        df.write.parquet(out)
        docs = spark.read.parquet(out)
    assert rows(docs, "doc_id", "ids_sha256") == rows(corpus_pipeline.run(spark, sf), "doc_id", "ids_sha256") and docs.count() > 100


def test_pipeline_cases(spark, empty):
    """Nulls, repeats, ties, clashing and extra columns, and empty tables through every stage but the first, which learns."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (None, "a b"), (7, None), (7, ""), (8, "same text here"), (8, "same text here"), (9, "x " * 30000)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", *(F.lit("c").alias(c) for c in ("row", "_i", "_h", "h", "id", "key", "th", "kid", "root", "node")))
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, sf)
        none = stage(spark, docs.where("false"), sf)
        assert none.count() == 0 and none.columns == out.columns
        n = out.count()
        assert out.columns == docs.columns if name != corpus_pipeline.STAGES[-1][0] else n == docs.count()
        assert n >= 4 and out.where("doc_id = 9").count() == 1
    assert base.columns == corpus_pipeline.classify(spark, base, sf).columns


def test_near_stage_recall(spark):
    """The near-dedup stage against all pairs by brute force on texts of one vocabulary: every pair of 0.8 or more is in one group."""
    import corpus_pipeline

    rng = random.Random(41)
    texts = []
    for _ in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(12, 400))]
        texts.append(" ".join(w))
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randrange(1, 2 + len(w) // 40)):
                x[rng.randrange(len(x))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(x))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = union(pairs, range(len(sets)))
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "").collect()}
    want = {min(k for k in comp if comp[k] == root) for root in set(comp.values())}
    assert len(pairs) > 40 and kept == want


def test_copies_through_both_dedups(spark):
    import corpus_pipeline

    rng = random.Random(5)
    texts = []
    while len(texts) < 3:  # texts that line dedup empties: every chunk has several lines
        lines = [words(rng, 12).replace("\n", "") for _ in range(6)]
        if all(b - a > 1 for a, b in line_dedup.chunks([x.encode() for x in lines], 3)):
            texts.append("\n".join(lines))
    df = spark.createDataFrame([(k, texts[k % 3]) for k in range(30)] + [(40, None), (41, ""), (42, " \n"), (43, words(rng, 30))], "doc_id long, text string")
    got = corpus_pipeline.dedup_near(spark, corpus_pipeline.dedup_lines(spark, df, ""), "").collect()
    assert sorted(r.doc_id for r in got if (r.text or "").strip()) == [0, 1, 2, 43]
    assert [r.doc_id for r in got if not (r.text or "").strip()] == [3]
