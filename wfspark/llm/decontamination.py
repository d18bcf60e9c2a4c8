"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

Texts become word 5-gram shingles, each weighing as much as its words have letters; an item of m < 5 words is one m-gram, and its windows are
m-grams. A document's window for an item is as long as the item. Every start is looked at: a running sum over the places of items' shingles gives
what each window shares with the items of its length, and only windows that can't be similar enough to any of them, by that weight and their own,
are left out. Each distinct window and each item gets a 64-bit weighted SimHash. The
fingerprint is cut into 4 blocks of 16 bits; items are listed under every value within ``FLIPS`` bits of each of their blocks, and
windows ask with every value within ``ASKED`` bits of theirs. By the pigeonhole principle that join finds every pair within Hamming
distance ``RADIUS``. The pairs that are that close are compared exactly: shared shingle weight by the weight of the union.

A window of similarity 0.8 is 10 bits away on average, with a deviation of 3, so ``RADIUS`` = 19 leaves out about one in a thousand at
just 0.8, fewer above. Texts of any length are read whole, once for the shared shingles; only texts that have one are read again. Null and empty
texts match nothing. Rows that share a doc_id (or item_id) are taken each, and the best match stands for the id, so repeated rows
give one result. A window laid for one item is compared with items of other lengths too. Of equally similar windows the one with the least
distance, then the first, is given. Extra columns are ignored, whatever their names; an empty table on either side gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wfspark.llm.native_words import grams, joined, shifted, small_enough, words
from wfspark.llm.sources import discard, written

N = 5
BITS, BLOCK_BITS, FLIPS, ASKED = 64, 16, 3, 1
#: Every pair of fingerprints this close shares a block up to FLIPS + ASKED bits.
RADIUS = BITS // BLOCK_BITS * (FLIPS + ASKED + 1) - 1
LEAST = 0.8
#: Room for rounding where windows are left out before they are compared.
SLACK = 1e-9
#: Starts of one document that a task lays out at a time.
SEGMENT = 4096
#: Rows of documents' ids that may go to every task.
MOST_IDS = 2_000_000


def _masks(most: int) -> list[int]:
    """Block values with at most ``most`` bits set."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(BLOCK_BITS), k)]


def weighted(words_: Column, n: int) -> Column:
    """Every n consecutive words: their hash and how many letters they have. ``words_``: a column."""
    letters = F.transform(words_, lambda w: F.length(w))
    weights = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), shifted(letters, n))
    return F.zip_with(grams(words_, n), weights, lambda h, w: F.struct(h.alias("h"), w.alias("w")))


def _by_size(words_: Column, sizes: Column, make) -> Column:
    """``make(words_, n)`` for the n named by ``sizes`` (1 to N)."""
    out = make(words_, N)
    for n in range(1, N):
        out = F.when(sizes == n, make(words_, n)).otherwise(out)
    return out


def fingerprint(window: Column) -> Column:
    """Weighted SimHash: bit b is the sign of the weights whose shingle hash has the bit, less those whose hash has it not."""
    vote = lambda b: F.aggregate(window, F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.getbit(x["h"], b) == 1, x["w"]).otherwise(-x["w"]))
    return F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(vote(b) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda a, x: a.bitwiseOR(x),
    )


def _block(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _weight(window: Column) -> Column:
    return F.aggregate(window, F.lit(0).cast("bigint"), lambda a, x: a + x["w"])


def _seeds(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """doc_id, n, item_size, the first and last start of windows of that size that hold as much weight (``held``) of shingles of items of that size, and the
    least and greatest weight of those items (low, high). Starts whose windows hold less than ``least`` of the lightest item are no part of it."""
    sizes = items.groupBy("n", "item_size").agg(F.min("item_weight").alias("low"), F.max("item_weight").alias("high"))
    places = items.select("n", "item_size", F.explode("item").alias("x")).select("n", "item_size", "x.h", "x.w").join(sizes, ["n", "item_size"])
    places = places.groupBy("n", "h").agg(F.max("w").alias("w"), F.collect_set(F.struct("item_size", "low", "high")).alias("sizes"))
    lengths = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]  # at most five
    read = docs.select("doc_id", words(F.col("text")).alias("words"))
    each = [read.select("doc_id", F.lit(n).alias("n"), F.posexplode(grams(F.col("words"), n)).alias("pos", "h")) for n in lengths]
    if not each:
        return docs.select("doc_id").where("false").selectExpr("doc_id", "0 as n", "0 as item_size", "0 as start", "0 as stop", "0L as held", "0L as low", "0L as high")
    met = joined(reduce(DataFrame.union, each), places, ["n", "h"], "inner")
    # a window counts a shingle once, at its first place
    before = F.lag("pos").over(Window.partitionBy("doc_id", "n", "h").orderBy("pos"))
    met = met.select("doc_id", "n", "pos", "w", "sizes", before.alias("before")).select("doc_id", "n", "pos", "w", "before", F.explode("sizes").alias("of"))
    since = F.greatest(F.col("before") + 1, F.col("pos") - F.col("of.item_size") + 1, F.lit(0))
    met = met.select("doc_id", "n", "of.*", "w", since.alias("since"), (F.col("pos") + 1).alias("until")).where("since < until")
    change = F.explode(F.array(F.struct(F.col("since").alias("start"), F.col("w").cast("bigint").alias("by")), F.struct(F.col("until").alias("start"), (-F.col("w")).cast("bigint").alias("by"))))
    steps = met.select("doc_id", "n", "item_size", "low", "high", change.alias("step")).select("doc_id", "n", "item_size", "low", "high", "step.*")
    # changes at one start are added up together, and only the last of them has a start after it
    along = Window.partitionBy("doc_id", "n", "item_size").orderBy("start")
    held = steps.select("doc_id", "n", "item_size", "start", (F.lead("start").over(along) - 1).alias("stop"), F.sum("by").over(along).alias("held"), "low", "high")
    return held.where((F.col("stop") >= F.col("start")) & (F.col("held") > 0) & (F.col("held") >= F.col("low") * (least - SLACK)))


def _windows(docs: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """doc_id, start, n, window (shingles and weights) and a 128-bit name of it, of all windows that may be similar enough."""
    segment = F.floor(F.col("start") / SEGMENT).cast("int").alias("segment")
    laid = seeds.groupBy("doc_id", "n", segment).agg(F.max("item_size").alias("longest"), F.collect_list(F.struct("start", "stop", "item_size", "held", "low", "high")).alias("laid"))
    ids = seeds.select("doc_id").distinct()
    wanted = docs.select("doc_id", "text").join(F.broadcast(ids) if small_enough(ids, MOST_IDS) else ids, "doc_id", "left_semi")
    full = wanted.select("doc_id", words(F.col("text")).alias("words")).join(laid, "doc_id").where(F.size("words") >= F.col("n"))
    # what one segment's windows cover: held weight changes at least once an item's length, so no range of starts is longer
    begin = F.col("segment") * SEGMENT
    full = full.select("doc_id", "n", "laid", begin.alias("begin"), (F.size("words") - F.col("n") + 1).alias("total"), F.slice("words", begin + 1, SEGMENT + 2 * F.col("longest") + F.col("n")).alias("words"))
    cut = full.select("doc_id", "n", "begin", "total", _by_size(F.col("words"), F.col("n"), weighted).alias("all"), "laid")
    cut = cut.select("doc_id", "n", "begin", "total", "all", F.explode("laid").alias("place"))
    # a start beyond the last whole window holds no more than that window does
    size = F.least(F.col("place.item_size"), F.col("total"))
    last = F.least(F.col("place.stop"), F.col("total") - size)
    cut = cut.where(F.col("place.start") <= last)
    # each range takes its own part of the text along, not all of it
    part = F.slice("all", F.col("place.start") - F.col("begin") + 1, last - F.col("place.start") + size)
    cut = cut.select("doc_id", "n", "place.start", "place.held", "place.low", "place.high", size.alias("size"), (last - F.col("place.start")).alias("most"), part.alias("part"))
    cut = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("on"))
    windows = cut.select("doc_id", "n", (F.col("start") + F.col("on")).alias("start"), F.slice("part", F.col("on") + 1, F.col("size")).alias("window"), "held", "low", "high")
    windows = windows.withColumn("weight", _weight(F.array_distinct("window")))
    # the item most like a window weighs what the two share, or as near to that as items do
    item = F.greatest(F.col("low"), F.least("held", "high"))
    shared = F.least(F.col("held"), item)
    windows = windows.where(shared >= (item + F.col("weight") - shared) * (least - SLACK))
    named = windows.select("doc_id", "n", "start", F.xxhash64("n", "window.h").alias("name_a"), F.xxhash64("window.h", F.lit(1)).alias("name_b"), "window")
    return named.dropDuplicates(["doc_id", "start", "name_a", "name_b"])


def decontamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words (of the window) and distance for each document and item that match."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where((F.size("words") > 0) & F.col("item_id").isNotNull()).distinct()
    items = items.select("item_id", F.xxhash64("item_id", "words").alias("item_key"), F.least(F.size("words"), F.lit(N)).alias("n"), "words")
    items = items.select("item_id", "item_key", "n", _by_size(F.col("words"), F.col("n"), weighted).alias("item")).withColumn("item_size", F.size("item"))
    items = items.withColumn("item_weight", _weight(F.array_distinct("item")))
    known = docs.where("doc_id is not null")
    seeds = written(_seeds(known, items, least), "seeds", light=True)
    windows = written(_windows(known, seeds, least), "windows")
    prints = windows.groupBy("name_a", "name_b").agg(F.first("window").alias("window")).withColumn("print", fingerprint(F.col("window")))
    prints = written(prints, "prints")
    item_prints = items.withColumn("item_print", fingerprint(F.col("item")))
    blocks = range(BITS // BLOCK_BITS)

    def listed(df: DataFrame, value: str, most: int) -> DataFrame:
        """Each row under the values within ``most`` bits of each of its blocks."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col(value), k).alias("value")) for k in blocks])).alias("b")
        rows = df.select("*", each).withColumn("mask", F.explode(F.lit(_masks(most))))
        return rows.select(*df.columns, "b.block", F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"))

    index = listed(item_prints.select("item_id", "item_key", "item_print"), "item_print", FLIPS)
    asked = listed(prints.select("name_a", "name_b", "print"), "print", ASKED)
    near = (
        joined(asked, index, ["block", "value"], "inner")
        .withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
        .where(F.col("distance") <= RADIUS)
        .select("name_a", "name_b", "item_key", "distance")
        .distinct()
    )
    both = near.join(prints.select("name_a", "name_b", "window"), ["name_a", "name_b"])
    both = joined(both, items.select("item_id", "item_key", "n", "item"), ["item_key"], "inner")
    own, other = F.array_distinct("window"), F.array_distinct("item")
    shared = _weight(F.array_intersect("window", "item"))
    alike = both.withColumn("similarity", shared / (_weight(own) + _weight(other) - shared)).where(F.col("similarity") >= least)
    alike = written(alike.select("name_a", "name_b", "item_id", F.col("n").alias("item_n"), "similarity", "distance"), "alike", light=True)
    found = joined(windows.select("doc_id", "n", "start", "name_a", "name_b", F.size("window").alias("size")), alike, ["name_a", "name_b"], "inner")
    found = found.where("n = item_n")
    best = F.max_by(F.struct("start", "size", "n", "distance"), F.struct("similarity", -F.col("distance"), -F.col("start")))
    result = (
        found.groupBy("doc_id", "item_id")
        .agg(F.max("similarity").alias("similarity"), best.alias("best"))
        .select(
            "doc_id", "item_id", "similarity",
            F.col("best.start").cast("bigint").alias("start_word"),
            (F.col("best.size") + F.col("best.n") - 1).cast("bigint").alias("n_words"),
            F.col("best.distance").cast("int").alias("distance"),
        )
    )
    result = written(result, "leaks", light=True)
    discard(seeds, windows, prints, alike)
    return result
