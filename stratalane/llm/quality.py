"""Quality classifier from weak labels.

Overlapping heuristic labellers vote reject, keep or nothing on every text. How often each pattern of votes
occurs is counted over all documents; these counts and the labelled sample, on which curated labels vote as one
labeller more, go into an expectation-maximisation that estimates each labeller's vote probabilities given the
hidden class. The posteriors of the labelled sample train a linear scorer over hashed words, word beginnings and
bucketed measures of the text (FTRL with an L1 penalty, so that words without a say have no weight). Words that
only rejected labelled texts have make the list of one more labeller.

The sample of labelled rows is bounded: `labelled` rows, those with the smallest hash of their id, and of equal
ids one. The counts of all documents weigh as `weight` rows together, whatever their number, so that the label
model is alike at every size. Without labels the sample is `labelled` rows of the documents, on their posteriors.
The model is one array of 2**BITS floats, so its broadcast has a fixed size.

Both passes over all documents look up a text's distinct words by set differences, and go on only with those that can change
a vote or the score (`Telling`).

Cases: a null or empty text has no words and is rejected by the scorer's measures like any text; very long texts
are read whole, by the same measures as short ones; without labels the heuristics decide alone; without documents
nothing is trained and nothing returned; null labels don't vote; of several labels of an id a rejecting one counts;
rows that repeat get equal scores; other columns are kept, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_udf, trim, trimmed, tune

BITS = 18
#: Most labelled rows that are fitted on, and the weight of all documents' votes beside them.
LABELLED, WEIGHT = 10000, 2000
#: Words that insult.
INSULTS = {"loser", "idiot", "pathetic", "scum", "worthless", "moron", "trash", "clown", "disgusting", "stupid"}
LABELLERS = ["repeats", "capitals", "symbols", "bangs", "pipes", "lines", "insults", "prose", "listed", "curated"]
_SYMBOLS = re.compile(r"[*%$#&^~@=+]{2,}")
#: Bytes that aren't ASCII letters, capitals, symbols.
_NO_LETTER, _NO_CAPITAL = (bytes(x for x in range(256) if not (x < 128 and f(chr(x)))) for f in (str.isalpha, str.isupper))
_NO_SYMBOL = bytes(x for x in range(256) if x not in b"*%$#&^~@=+")


#: Of ASCII text letters in lower case, white space for all else.
_LETTERS = bytes(ord(chr(x).lower()) if x < 128 and chr(x).isalpha() else 32 for x in range(256))


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: 1 for a letter, 2 if in upper case too, 4 if it can stand in a word."""
    chars = map(chr, range(sys.maxunicode + 1))
    return np.fromiter((c.isalnum() and c.isalpha() * (1 + 2 * c.isupper()) + 4 * (not c.isdecimal()) for c in chars), np.uint8, sys.maxunicode + 1)


def _letters(text: str, raw: bytes) -> tuple[int, int, set[str]]:
    """Letters of a text, those in upper case, and its distinct words, [^\\W\\d_]+, in lower case. raw: the text in UTF-8."""
    if text.isascii():
        return len(raw.translate(None, _NO_LETTER)), len(raw.translate(None, _NO_CAPITAL)), set(raw.translate(_LETTERS).decode().split())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _kinds()[codes]
    words = np.where(kinds > 3, codes, np.uint32(32)).tobytes().decode("utf-32-le").split()
    return int(np.count_nonzero(kinds & 1)), int(np.count_nonzero(kinds & 2)), set(map(str.lower, set(words)))


def look(text: str) -> tuple[dict[str, float], set[str]]:
    """Measures of a text, and its distinct words in lower case."""
    parts = text.split()
    n = max(1, len(parts))
    raw = text.encode("utf-8", "surrogatepass")
    letters, upper, words = _letters(text, raw)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return {
        "repeats": sum(map(operator.eq, parts, parts[1:])) / n,
        "capitals": upper / max(1, letters),
        "symbols": (len(_SYMBOLS.findall(text)) if len(raw.translate(None, _NO_SYMBOL)) > 1 else 0) / n,
        "bangs": text.count("!!") / n,
        "pipes": text.count("|") / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "letters": letters / max(1, len(text)),
        "distinct": len(set(parts)) / n,
    }, words


def measures(text: str) -> dict[str, float]:
    return look(text)[0]


class Telling:
    """Hashed features of one kind, w, p or q, that are among those `wanted`. Strings that were met are kept, so many at most;
    most have no such feature, and one set difference leaves these out."""

    MOST, LONGEST = 300_000, 40

    def __init__(self, kind: str, wanted: set[int]):
        self.kind, self.wanted, self.silent, self.known = kind, wanted, set(), {}

    def __call__(self, strings: set[str]) -> list[int]:
        out = []
        for x in strings - self.silent:
            got = self.known.get(x)
            if got is None:
                got = hashed(self.kind + x)
                if len(x) <= self.LONGEST and len(self.silent) + len(self.known) >= self.MOST:
                    self.silent.clear()
                    self.known.clear()
                if got not in self.wanted:
                    if len(x) <= self.LONGEST:
                        self.silent.add(x)
                    continue
                if len(x) <= self.LONGEST:
                    self.known[x] = got
            out.append(got)
        return out


#: Hashed features of words that were met, of so many words at most.
_KNOWN: dict[str, tuple[int, ...]] = {}
_KNOWN_MOST = 500_000


def word_features(word: str) -> tuple[int, ...]:
    """A word's hashed features, the word's own first: itself and its beginnings of four and five letters."""
    got = _KNOWN.get(word)
    if got is None:
        names = [f"w{word}"] + [f"p{word[:4]}"] * (len(word) > 4) + [f"q{word[:5]}"] * (len(word) > 5)
        got = tuple(hashed(x) for x in names)
        if len(_KNOWN) >= _KNOWN_MOST:
            _KNOWN.clear()
        _KNOWN[word] = got
    return got


def hashed(name: str) -> int:
    from xxhash import xxh32_intdigest as h

    return h(name.encode()) & ((1 << BITS) - 1)


def features(m: dict[str, float], words: set[str]) -> np.ndarray:
    """Hashed features of a text's measures and words, in order."""
    return _sorted(m, {i for x in words for i in word_features(x)})


def weighing(m: dict[str, float], words: set[str], told: list[Telling]) -> np.ndarray:
    """`features` without those of words that have no weight, which add nothing."""
    w, p, q = told
    return _sorted(m, {*w(words), *p({x[:4] for x in words if len(x) > 4}), *q({x[:5] for x in words if len(x) > 5})})


def _sorted(m: dict[str, float], found: set[int]) -> np.ndarray:
    for k, v in m.items():
        found.update(_measure_features(k, int(min(1.0, v) * 20)))
    return np.sort(np.fromiter(found, np.int32, len(found)))


@functools.cache
def _measure_features(name: str, bucket: int) -> tuple[int, ...]:
    return tuple(hashed(x) for x in [f"m{name}={bucket}", *(f"m{name}>{b}" for b in range(1, bucket + 1))])


def votes(m: dict[str, float], words: set[str]) -> list[int]:
    """Of the labellers that look at the text: 1 reject, -1 keep, 0 nothing."""
    bad = [m["repeats"] > 0.1, m["capitals"] > 0.3, m["symbols"] > 0.1, m["bangs"] > 0.05, m["pipes"] > 0.1, m["lines"] > 0.3, bool(words & INSULTS)]
    prose = not any(bad) and m["letters"] > 0.75 and m["distinct"] > 0.2
    return [int(x) for x in bad] + [-int(prose)]


def _sampled(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in trimmed(batches):
        v, f = [], []
        for t in batch.column(0).to_pylist():
            m, words = look(t or "")
            v.append(votes(m, words))
            f.append(features(m, words))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.int32())), pa.array(f, pa.list_(pa.int32())), batch.column(1)], names=["votes", "features", "y"])


def maximise(votes: np.ndarray, times: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of reject for each row of votes, that counts `times`, and P(vote | class) as (labeller, class, vote + 1)."""
    n, m = votes.shape
    times = np.ones(n) if times is None else times
    weight = np.where(np.arange(m) == m - 1, 3.0, 1.0)  # curated labels start with more say
    post = 1 / (1 + np.exp(-2 * (votes * weight).sum(1)))
    table = np.zeros((m, 2, 3))
    for _ in range(rounds):
        share = (post * times).sum() / times.sum() if n else 0.5
        prior = np.clip(np.array([1 - share, share]), 0.02, 0.98)
        logp = np.log(prior)[None, :].repeat(n, 0)
        for j in range(m):
            for v in range(3):
                hit = votes[:, j] == v - 1
                table[j, 1, v], table[j, 0, v] = (post * times)[hit].sum() + 0.1, ((1 - post) * times)[hit].sum() + 0.1
            table[j] /= table[j].sum(1, keepdims=True)
            logp += np.log(table[j][:, votes[:, j] + 1]).T
        new = 1 / (1 + np.exp(np.clip(logp[:, 0] - logp[:, 1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            return new, table
        post = new
    return post, table


def train(features: list[np.ndarray], target: np.ndarray, epochs: int = 15, batch: int = 64, alpha: float = 0.3, l1: float = 0.3, l2: float = 1.0) -> np.ndarray:
    """FTRL-proximal logistic regression; the bias is the last weight."""
    size = (1 << BITS) + 1
    z, s, w = np.zeros(size), np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            lens = np.array([len(features[r]) + 1 for r in rows])
            flat = np.concatenate([np.append(features[r], size - 1) for r in rows])
            row = np.repeat(np.arange(len(rows)), lens)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(rows)), -30, 30)))
            at, inverse = np.unique(flat, return_inverse=True)
            g = np.bincount(inverse, (p - target[rows])[row], len(at))
            sigma = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / alpha
            z[at] += g - sigma * w[at]
            s[at] += g * g
            zz = z[at]
            w[at] = np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((1 + np.sqrt(s[at])) / alpha + l2))
    return w.astype(np.float32)


def summed(feats: list[np.ndarray], by_row: np.ndarray) -> np.ndarray:
    """For each feature the sum of `by_row` over the rows that have it, without an array of all rows' features beside them."""
    out = np.zeros(1 << BITS)
    for f, x in zip(feats, by_row.tolist()):
        out[f] += x  # a row's features are distinct
    return out


def screen(feats: list[np.ndarray], post: np.ndarray, least: float = 4.0) -> np.ndarray:
    """Features whose share of rejected texts is `least` standard errors off the sample's: words that only
    happen to stand in a few rejected texts would otherwise explain these, in place of the words that matter."""
    bad, good = summed(feats, post), summed(feats, 1 - post)
    n, share = bad + good, post.mean()
    expected = n * share
    z = (bad - expected) / np.sqrt(expected * (1 - share) + 1e-9)
    return (n >= 4) & (np.abs(z) >= least)


def _voted(listed: np.ndarray):
    """Batches of texts to their votes, the listed words' vote last."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bad = set(np.flatnonzero(listed).tolist())
        told = Telling("w", bad)
        for batch in trimmed(batches):
            out = []
            for t in batch.column(0).to_pylist():
                m, words = look(t or "")
                out.append([*votes(m, words), int(bool(bad and told(words)))])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["votes"])

    return run


def smallest(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """The n rows with the smallest hash of the columns `by`. Rows over a bound that keeps about 3n are left out first, so
    that tasks don't all send n."""
    h = F.xxhash64(*by)
    total = rows.count()
    bound = int(min(1.0, 3 * (n + 100) / max(1, total)) * 2**64) - 2**63 - 1
    return rows.where(h <= F.lit(min(bound, 2**63 - 1)).cast("long")).orderBy(h, *by).limit(n)


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, weight: int = WEIGHT) -> np.ndarray:
    """Weights of the scorer. labels(id, quality, toxic); a row is to be rejected for quality 0 or toxic 1."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    if labels is not None:
        y = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), -1)
        known = labels.select(F.col(id_col).alias("i"), y.alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
        sample = texts.join(F.broadcast(smallest(known, labelled, "i")), "i").groupBy("i").agg(F.min_by(F.struct("t", "y"), F.struct(F.xxhash64("t"), "t")).alias("one")).select("one.*")
    else:
        sample = smallest(texts, labelled, "i", "t").select("t", F.lit(0).alias("y"))
    got = sample.mapInArrow(_sampled, "votes array<int>, features array<int>, y int").toArrow()
    n = got.num_rows
    if not n:
        return np.zeros((1 << BITS) + 1, np.float32)
    heur = np.array(got.column("votes").to_pylist(), np.int64)
    y = got.column("y").to_numpy().astype(np.int64)
    lists = got.column("features").combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    feats = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    # rows in an order of their own, so that training doesn't depend on the order of tasks
    size = lambda k: (len(feats[k]), int(y[k]))
    order = [k for _, same in itertools.groupby(sorted(range(n), key=size), size) for k in sorted(same, key=lambda k: feats[k].tobytes())]
    heur, y, feats = heur[order], y[order], [feats[k] for k in order]
    bad, good = summed(feats, y == 1), summed(feats, y == -1)
    listed = (bad >= 5) & (bad >= 50 * good)  # of features that the sample has: others have no bad
    matrix = np.column_stack([heur, [int(listed[f].any()) for f in feats], y])
    # of all documents the patterns of votes are counted: at most as many rows as there are patterns
    counts = texts.select("t").mapInArrow(_voted(listed), "votes array<int>").groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    patterns = np.array([[*r.votes, 0] for r in counts], np.int64).reshape(-1, matrix.shape[1])
    times = np.array([r.n for r in counts], float)
    post, _ = maximise(np.concatenate([matrix, patterns]), np.concatenate([np.ones(n), times * weight / max(1.0, times.sum())]))
    post = post[:n]
    telling = screen(feats, post)
    weights = train([f[telling[f]] for f in feats], post)
    trim()
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """(row, score): each row as a struct with its probability of rejection."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    told: list[Telling] = []  # the same for all batches of a task

    @arrow_udf("double")
    def scored(text):
        import pyarrow as pa

        w = sent.value
        if not told:
            weighs = set(np.flatnonzero(w[:-1]).tolist())
            told.extend(Telling(kind, weighs) for kind in "wpq")
        out = []
        for t in text.to_pylist():
            x = float(w[weighing(*look(t or ""), told)].sum(dtype=np.float64) + w[-1])
            out.append(round(1 / (1 + np.exp(-max(-30.0, min(30.0, x)))), 6))
        got = pa.array(out, pa.float64())
        trim()
        return got

    return docs.select(F.struct("*").alias("row"), scored(F.col(text_col).cast("string")).alias("score"))


def clean(docs: DataFrame, labels: DataFrame | None, threshold: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """Documents that the classifier keeps."""
    return score(docs, fit(docs, labels, text_col=text_col, **options), text_col).where(F.col("score") < threshold).select("row.*")
