"""Benchmark decontamination on a distributed positional inverted index. DataFrame functions only.

The index stores a posting (term, document, position) for every occurrence of a benchmark term in the
corpus, and one of the empty term for each document's length. An item is cut into windows of words; each
window is sought from its two rarest terms: their postings, less a term's offset in the item, are lists of
alignments of item and document, and those in both lists are candidates. The positions at which an alignment needs each of the item's
terms are intersected with the postings; runs of hits as long as a window are exact phrase matches.
Proximity matches ask for an item's rarest terms within a span of words, in any order.

Cases: a null or empty text has no words and no hits; an item without words is never found; a null item
id counts as the empty string; repeated rows of either side give what single rows give, once per
document row; documents are told apart by id and text, so ids may be null or repeated; very long texts are indexed
whole; empty tables give no rows or no hits; of ties between rare terms the earlier in the item is taken; extra columns,
whatever their names, are left out of the report and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, stash

#: Characters other than digits, letters and all beyond ASCII; A-Z is lower-cased before.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that a table's values may take to be broadcast; larger ones are joined by shuffles.
BROADCAST_BYTES = 16 << 20


def words(text):
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if its values, written out, and 16 bytes a value more take no more than BROADCAST_BYTES."""
    size = F.octet_length(F.to_json(F.struct("*"))) + 16 * len(df.columns)
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0] <= BROADCAST_BYTES else df


def items_of(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms, w): distinct items that have words, and the length of their windows."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("terms")).where(F.size("terms") > 0)
    return stash(rows.distinct().select(F.xxhash64("item_id", "terms").alias("item"), "item_id", "terms", F.least(F.size("terms"), F.lit(window)).alias("w")), "items")


def index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, kid, nul, th, pos) of the items' terms, and of '' at each document's end."""
    vocabulary = items.select(F.explode("terms").alias("term")).union(items.sparkSession.sql("select '' as term")).distinct()
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    key = [F.coalesce(id_col, zero).alias("kid"), F.col(id_col).isNull().alias("nul"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("th")]
    tokens = docs.select(*key, F.posexplode(F.concat(words(F.col(text_col)), F.array(F.lit("")))).alias("pos", "term"))
    return stash(tokens.join(_small(vocabulary), "term").select("term", "kid", "nul", "th", "pos"), "postings")


def rarest(postings: DataFrame, items: DataFrame) -> DataFrame:
    """items with `dfs`: for each offset, how often its term is posted; items with an unposted term in every window have none to seek."""
    counts = postings.where("term <> ''").groupBy("term").count()
    each = items.select("item", F.posexplode("terms").alias("o", "term")).join(counts, "term", "left")
    dfs = each.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.coalesce("count", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("dfs"))
    return stash(items.join(dfs, "item"), "rarest")


def phrases(postings: DataFrame, items: DataFrame) -> DataFrame:
    """(kid, th, item_id, start, end): maximal exact runs, ends included, of at least a window's length."""
    items = rarest(postings, items)
    starts = F.sequence(F.lit(0), F.size("terms") - F.col("w"))
    windows = items.select("item", "terms", "dfs", "w", F.explode(starts).alias("s")).select("item", "terms", "s", F.slice("dfs", F.col("s") + 1, F.col("w")).alias("part"))
    # the two rarest offsets of each window (one, if the window is one word)
    two = F.slice(F.array_sort(F.transform("part", lambda n, i: F.struct(n.alias("n"), i.alias("i")))), 1, 2)
    windows = windows.select("item", "terms", "s", two.alias("two")).where(F.col("two")[0]["n"] > 0)
    windows = windows.select("item", "terms", F.transform("two", lambda x: x["i"] + F.col("s")).alias("pair")).distinct()
    anchors = windows.select("item", "terms", F.explode("pair").alias("o")).select("item", "o", F.element_at("terms", F.col("o") + 1).alias("term")).distinct()
    pairs = stash(windows.groupBy("item").agg(F.collect_set("pair").alias("pairs")), "pairs")
    lists = postings.join(_small(stash(anchors, "anchors")), "term").select("kid", "th", "item", (F.col("pos") - F.col("o")).alias("diag"), "o")
    aligned = lists.groupBy("kid", "th", "item", "diag").agg(F.collect_set("o").alias("os")).join(_small(pairs), "item")
    aligned = aligned.where(F.exists("pairs", lambda p: F.forall(p, lambda o: F.array_contains("os", o)))).select("kid", "th", "item", "diag")
    aligned = stash(aligned, "aligned")
    shown = _small(items.select("item", "item_id", "w", F.posexplode("terms").alias("o", "term")))
    need = aligned.join(shown, "item").select("kid", "th", (F.col("diag") + F.col("o")).alias("pos"), "term", "item", "item_id", "w", "diag", "o").where("pos >= 0")
    near = postings.join(_small(aligned.select("kid", "th").distinct()), ["kid", "th"], "left_semi").select("kid", "th", "pos", "term")
    met = need.join(near, ["kid", "th", "pos", "term"]).select("kid", "th", "item", "item_id", "w", "diag", "o").distinct()
    run = F.col("o") - F.row_number().over(Window.partitionBy("kid", "th", "item", "diag").orderBy("o"))
    met = met.select("kid", "th", "item", "item_id", "w", "diag", "o", run.alias("run"))
    runs = met.groupBy("kid", "th", "item", "item_id", "w", "diag", "run").agg(F.min("o").alias("a"), F.max("o").alias("b"))
    return stash(runs.where(F.col("b") - F.col("a") + 1 >= F.col("w")).select("kid", "th", "item_id", (F.col("diag") + F.col("a")).alias("start"), (F.col("diag") + F.col("b")).alias("end")), "phrases")


def proximity(postings: DataFrame, items: DataFrame, terms: int = 3, span: int = 50) -> DataFrame:
    """(kid, th, item_id, start, end): places where an item's rarest distinct terms, `terms` of them at most, all stand within
    `span` words, in any order: of each position at which one stands the shortest stretch that ends there and has all.

    Cells of span words overlap by as much, so that every stretch lies in one; within a cell the last position of each
    term before a row is a running maximum, and the stretch begins at the least of these."""
    items = rarest(postings, items)
    pairs = F.array_distinct(F.transform("terms", lambda t, i: F.struct(F.element_at("dfs", i + 1).alias("n"), t.alias("t"))))
    chosen = items.select("item", "item_id", F.size(F.array_distinct("terms")).alias("distinct"), F.slice(F.array_sort(F.filter(pairs, lambda x: x["n"] > 0)), 1, terms).alias("c"))
    chosen = chosen.where(F.size("c") == F.least("distinct", F.lit(terms))).select("item", "item_id", F.size("c").alias("m"), F.posexplode("c").alias("k", "x")).select("item", "item_id", "m", "k", F.col("x.t").alias("term"))
    hits = postings.join(_small(stash(chosen, "chosen")), "term").select("kid", "th", "item", "item_id", "m", "k", "pos")
    cells = hits.withColumn("cell", F.explode(F.expr(f"array(pos div {span}, pos div {span} + 1)")))
    before = Window.partitionBy("kid", "th", "item", "cell").orderBy("pos")
    last = [F.max(F.when(F.col("k") == j, F.col("pos"))).over(before).alias(f"last{j}") for j in range(terms)]
    out = cells.select("kid", "th", "item", "item_id", "m", "pos", "cell", *last).where(F.expr(f"pos div {span} = cell - 1 or pos div {span} = cell"))
    have = F.array_compact(F.array(*(F.col(f"last{j}") for j in range(terms))))
    out = out.select("kid", "th", "item_id", F.array_min(have).alias("start"), F.col("pos").alias("end"), (F.size(have) == F.col("m")).alias("all"))
    return out.where(F.col("all") & (F.col("end") - F.col("start") < span)).select("kid", "th", "item_id", "start", "end").distinct()


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: n_words, n_hit, n_items, the digest of the item ids and whether it is contaminated
    (hits are at least 1 / share of its words). Also `th`, the hash that tells documents of one id apart."""
    items = items_of(benchmark, window, item_col, item_text)
    postings = index(docs, items, id_col, text_col)
    found = phrases(postings, items)
    hit = found.select("kid", "th", F.explode(F.sequence("start", "end")).alias("pos")).distinct().groupBy("kid", "th").agg(F.count("*").alias("n_hit"))
    names = found.groupBy("kid", "th").agg(F.array_sort(F.collect_set("item_id")).alias("names"))
    rows = postings.where("term = ''").select("kid", "nul", "th", F.col("pos").cast("long").alias("n_words"))
    rows = rows.join(hit.join(names, ["kid", "th"]), ["kid", "th"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return rows.select(
        F.when(~F.col("nul"), F.col("kid")).alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "th",
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, **options) -> DataFrame:
    """Documents without the contaminated ones and without those that hold a whole window of an item, however long they are:
    a row goes if it is flagged or `window` of its words are hit. Hits of items shorter than a window alone count by their share."""
    found = report(docs, benchmark, id_col=id_col, text_col=text_col, window=window, **options)
    bad = found.where(F.col("contaminated") | (F.col("n_hit") >= window)).select(F.col(id_col).alias("_i"), F.col("th").alias("_h")).distinct()
    bad = stash(bad, "contaminated")
    return docs.join(bad, F.col(id_col).eqNullSafe(bad["_i"]) & (F.xxhash64(F.col(id_col), F.col(text_col)) == bad["_h"]), "left_anti")
