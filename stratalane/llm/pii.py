"""PII by base patterns and a semi-Markov conditional random field.

Base spans of emails, addresses, cards and phones come from fixed patterns. The random field adds spans
that these miss: whole candidate segments of up to `LONGEST` tokens are scored by features of the span
(digits and their groups, separators, checksums, neighbours), and a dynamic programme over a region's
tokens, bounded by that length, chooses boundaries and types of all its segments together. It is trained
on a bounded sample of texts, with their base spans, and on copies in which these are disguised (a plus
left out, an at sign spelled out).
Only tokens near a digit, an at sign or a spelled-out one can belong to a segment, so that a text falls
into regions, which are solved each for itself, exactly. An added span keeps off base spans.

Cases: null and empty texts have no spans; repeated rows get equal results; positions are code points, ends
exclusive; very long texts are read whole, also where they have no white space, in time that grows with their length;
without a text to train on, and so for an empty table, nothing is added; of ties the segmentation that comes first in
the order of ends and kinds is taken; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import trimmed, tune

KINDS = ["email", "ip", "card", "phone"]
LONGEST = 16
#: The model is fitted on windows around triggers: so many at most, each of so many characters at most.
TRAIN_WINDOWS, WINDOW_CHARS = 1500, 2000
#: The base patterns, in forms that take linear time.
_AT_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]|\bat\b[^\n]{1,40}?\bdot\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end), by kind and start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = _AT_TAIL.match(text, at + 1)
        if m:
            # the local part: the longest run before the sign, not reaching into the last match
            start = at
            while start > end:
                step = max(end, start - 256)
                part = text[step:start]
                bad = [x.end() for x in _NOT_LOCAL.finditer(part)]
                start = step + bad[-1] if bad else step
                if bad:
                    break
            if start < at:
                out.append(("email", start, m.end()))
                end = m.end()
                at = text.find("@", end)
                continue
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Tokens (start, end) within reach of a trigger, by region."""
    out: list[list[tuple[int, int]]] = []
    lo = hi = -1
    spans = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - 40), min(len(text), m.end() + 40)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for lo, hi in spans:
        while lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        if tokens:
            out.append(tokens)
    return out


#: The feature without which a segment cannot be of a kind.
_FORM = {"email": "mailTrue", "ip": "octetsTrue", "card": "cardTrue", "phone": "l0"}


def _class(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c if c in ".,;:@/=\"-_+" else "o"


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Segments (first token, end token) that may be an entity."""
    out = []
    n = len(tokens)
    for i in range(n):
        a = tokens[i][0]
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        if a and text[a - 1].isalnum():
            continue
        digits = sign = 0
        for j in range(i, min(n, i + LONGEST)):
            x, y = tokens[j]
            t = text[x:y]
            if j > i and x - tokens[j - 1][1] > 1:
                break
            digits += y - x if t[0].isdigit() else 0
            sign += t == "@" or t.lower() in ("at", "dot")
            if (digits >= 6 or sign) and t[0].isalnum() and not (y < len(text) and text[y].isalnum()):
                out.append((i, j + 1))
    return out


def features(text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    digits = re.sub(r"\D", "", s) if s.isascii() else ""
    groups = re.findall(r"[0-9]+", s)
    letters = re.findall(r"[^\W\d_]+", s)
    marks = "".join(sorted(set(re.sub(r"[\w]", "", s))))
    low = [x.lower() for x in letters]
    n = len(digits)
    size = "0" if n == 0 else "<7" if n < 7 else "<9" if n < 9 else "<13" if n < 13 else "<16" if n < 16 else "<20" if n < 20 else "20+"
    octets = len(groups) == 4 and s.count(".") == 3 and not letters and all(len(g) < 4 and int(g) < 256 for g in groups)
    card = 13 <= n <= 19 and not letters and set(marks) <= set(" -") and luhn(digits)
    mail = bool(re.fullmatch(r"[\w.%+-]+ ?(@|[\[(]at[\])]|at) ?[\w-]+( ?(\.|dot) ?[\w-]+)+", s, re.I))
    plus = s.startswith("+")
    phone = not letters and set(marks) <= set("+ ().-") and 9 <= n <= 15 and (plus or "(" in s or len(groups) in (3, 4)) and max(map(len, groups), default=0) <= 11
    shape = "-".join(str(min(len(g), 5)) for g in groups[:6])
    f = ["bias", f"n{size}", f"g{min(len(groups), 6)}", f"l{min(len(letters), 6)}", f"m{marks}", f"shape{bool(letters)}{shape}"]
    f += [f"octets{octets}", f"card{card}", f"mail{mail}", f"phone{phone}", f"plus{plus}", f"at{'@' in s}{'at' in low}{'dot' in low}"]
    f += [f"left{_class(text[a - 1]) if a else '^'}", f"right{_class(text[b]) if b < len(text) else '$'}"]
    f += [f"right2{_class(text[b]) if b < len(text) else '$'}{_class(text[b + 1]) if b + 1 < len(text) else '$'}"]
    return f


class Model:
    """Weights of (kind, feature), and of tokens outside of segments by their class."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = {}

    def segment(self, kind: str, feats: list[str]) -> float:
        get = self.w.get
        return sum(get((kind, f), 0.0) for f in feats)

    def outside(self, text: str, token: tuple[int, int]) -> tuple[str, str]:
        return ("-", f"o{_class(text[token[0]])}")


def _scored(model: Model, text: str, tokens):
    segs = []
    for i, j in candidates(text, tokens):
        f = features(text, tokens[i][0], tokens[j - 1][1])
        for k in KINDS:
            # a segment competes only for kinds whose form it has: checksum, octets, an at sign, no letters
            if _FORM[k] not in f:
                continue
            segs.append((i, j, k, f, model.segment(k, f)))
    out = [model.w.get(model.outside(text, t), 0.0) for t in tokens]
    return segs, out


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def marginals(segs, out: list[float]):
    """Log partition function, probability of each segment and of each token's being outside."""
    n = len(out)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, s in enumerate(segs):
        by_end[s[1]].append(k)
        by_start[s[0]].append(k)
    alpha = [0.0] * (n + 1)
    for j in range(1, n + 1):
        v = alpha[j - 1] + out[j - 1]
        for k in by_end[j]:
            v = _add(v, alpha[segs[k][0]] + segs[k][4])
        alpha[j] = v
    beta = [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        v = beta[i + 1] + out[i]
        for k in by_start[i]:
            v = _add(v, beta[segs[k][1]] + segs[k][4])
        beta[i] = v
    z = alpha[n]
    return z, [math.exp(alpha[s[0]] + s[4] + beta[s[1]] - z) for s in segs], [math.exp(alpha[i] + out[i] + beta[i + 1] - z) for i in range(n)]


def best(segs, out: list[float]) -> list[int]:
    """Segments of the best segmentation of a region."""
    n = len(out)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    for k, s in enumerate(segs):
        by_end[s[1]].append(k)
    value, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1] + out[j - 1]
        for k in by_end[j]:
            v = value[segs[k][0]] + segs[k][4]
            if v > value[j]:
                value[j], back[j] = v, k
    chosen, j = [], n
    while j:
        if back[j] < 0:
            j -= 1
        else:
            chosen.append(back[j])
            j = segs[back[j]][0]
    return chosen[::-1]


def disguised(text: str, spans: list[tuple[str, int, int]], turn: int) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its base spans in other guises, and where these are."""
    out, at, found = [], 0, []
    size = 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        s = text[a:b]
        if kind == "phone":
            s = s[1:].lstrip() if turn % 2 else re.sub(r"^\+[0-9]+[ -]*", "", s) if "(" in s else s[1:]
        elif kind == "email":
            s = s.replace("@", " at ").replace(".", " dot ") if turn % 2 else s.replace("@", " [at] ")
        elif kind == "card":
            s = " ".join(re.sub(r"\D", "", s)[k : k + 4] for k in range(0, 19, 4)).strip()
        out += [text[at:a], s]
        size += a - at
        found.append((kind, size, size + len(s)))
        size += len(s)
        at = b
    out.append(text[at:])
    return "".join(out), found


def train(texts: list[str], rounds: int = 8, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Maximum likelihood by AdaGrad over regions."""
    model = Model()
    data = []
    for n, text in enumerate(texts):
        spans = base(text)
        for t, gold in [(text, spans)] + ([disguised(text, spans, n)] if spans else []):
            where = {(a, b): k for k, a, b in gold}
            for tokens in regions(t):
                segs, _ = _scored(model, t, tokens)
                if segs:
                    goal = {(i, j): where[tokens[i][0], tokens[j - 1][1]] for i, j, *_ in segs if (tokens[i][0], tokens[j - 1][1]) in where}
                    data.append(([s[:4] for s in segs], [model.outside(t, x) for x in tokens], goal))
    squares: dict = {}
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for at in rng.permutation(len(data)):
            segs, names, goal = data[at]
            scored = [(*s, model.segment(s[2], s[3])) for s in segs]
            _, p, q = marginals(scored, [model.w.get(x, 0.0) for x in names])
            grad: dict = {}
            covered = {t for (i, j) in goal for t in range(i, j)}
            for s, v in zip(segs, p):
                d = v - (goal.get((s[0], s[1])) == s[2])
                if abs(d) > 1e-4:
                    for f in s[3]:
                        grad[s[2], f] = grad.get((s[2], f), 0.0) + d
            for t, (x, v) in enumerate(zip(names, q)):
                d = v - (t not in covered)
                if abs(d) > 1e-4:
                    grad[x] = grad.get(x, 0.0) + d
            for x, g in grad.items():
                g += l2 * model.w.get(x, 0.0)
                squares[x] = squares.get(x, 0.0) + g * g
                model.w[x] = model.w.get(x, 0.0) - rate * g / math.sqrt(squares[x] + 1e-8)
    return model


def added(model: Model, text: str, known: list[tuple[str, int, int]], least: float = 0.9) -> list[tuple[str, int, int]]:
    """Spans that the field finds beside the base ones, each at least that probable."""
    out = []
    for tokens in regions(text):
        segs, outside = _scored(model, text, tokens)
        if not segs:
            continue
        chosen = best(segs, outside)
        if not chosen:
            continue
        _, p, _ = marginals(segs, outside)
        for k in chosen:
            a, b = tokens[segs[k][0]][0], tokens[segs[k][1] - 1][1]
            if p[k] >= least and not any(a < y and x < b for _, x, y in known):
                out.append((segs[k][2], a, b))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TRAIN_WINDOWS, longest: int = WINDOW_CHARS) -> Model:
    """Trains on `sample` windows around triggers at most, those with the smallest hash; windows of over `longest` characters
    aren't trained on. Only documents under a bound on their hash, of which about three times as many as needed are expected,
    are cut into windows, so that what comes to the driver doesn't grow with the corpus."""
    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).cast("string").alias("t")).where(F.rlike("t", F.lit("[0-9][0-9 ().-]{5,}[0-9]|@")))
    total = texts.count()
    bound = int(min(1.0, 3 * (sample + 100) / max(1, total)) * 2**64) - 2**63 - 1
    texts = texts.where(F.col("h") <= F.lit(min(bound, 2**63 - 1)).cast("long"))

    def windows(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in trimmed(batches):
            hs, ts = [], []
            for t in batch.column(1).to_pylist():
                for r in regions(t):
                    part = t[max(0, r[0][0] - 20) : r[-1][1] + 20]
                    if len(part) <= longest:
                        hs.append(xxh64_intdigest(part.encode()) >> 1)
                        ts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ts, pa.string())], names=["h", "t"])

    rows = texts.mapInArrow(windows, "h long, t string").orderBy("h", "t").limit(sample).collect()
    return train([r.t for r in rows])


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of (kind, start, end); spans are the base ones and those added."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = sent.value
        to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda x: [{"kind": k, "start": a, "end": b} for k, a, b in x]
        for batch in trimmed(batches):
            found, whole = [], []
            for t in batch.column(1).to_pylist():
                known = base(t) if t else []
                more = added(model, t, known) if t and model.w and _TRIGGER.search(t) else []
                found.append(rows(known))
                whole.append(rows(sorted(known + more, key=lambda x: (KINDS.index(x[0]), x[1])) if more else known))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, to), pa.array(whole, to)], names=["i", "base", "spans"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, base {spans}, spans {spans}").withColumnRenamed("i", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    is_kind = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
