"""Benchmark decontamination by spaced-seed hashing, in built-in DataFrame functions only.

A seed hashes six of ten neighbouring words, chosen by a fixed mask, so it survives changes to the words its mask leaves out. Seeds of all
positions and masks of test items and training documents are joined by hash. A hit names a document, an item and the
distance between them; along that distance the words are compared, and a hit counts only if enough of some window of the item agree.
The test items' seeds are broadcast in blocks of a fixed number of items' words, so the documents don't shuffle for the
search; they shuffle for the comparison only if the hits are too many to broadcast.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded, table

SPAN, WINDOW, SHARE = 10, 20, 0.8
MEDIUM, SHORTEST = 15, 5  # items of fewer words than MEDIUM get further masks; of fewer than SPAN must agree in all words; of fewer than SHORTEST match nothing


def covering_masks(span: int, ignored: int, changed: int) -> tuple[tuple[int, ...], ...]:
    """Masks that ignore `ignored` of `span` words each, such that any `changed` words are ignored by some mask: greedily, the one that
    covers most of what is left."""
    left = set(combinations(range(span), changed))
    masks = []
    while left:
        best = max(combinations(range(span), ignored), key=lambda gaps: len(left.intersection(combinations(gaps, changed))))
        left -= set(combinations(best, changed))
        masks.append(tuple(k for k in range(span) if k not in best))
    return tuple(masks)


# Word offsets that each mask keeps; together they hit nearly every 16-word passage with three words changed.
MASKS = ((0, 1, 6, 7, 8, 9), (0, 4, 5, 7, 8, 9), (0, 1, 3, 5, 6, 9), (0, 1, 3, 4, 7, 9))
# By the least and most words of an item. Of ten to fourteen words two may be changed, and some of these masks ignores them both.
FAMILIES = ((MEDIUM, None, MASKS), (SPAN, MEDIUM - 1, covering_masks(SPAN, 4, 2)), *((n, n, (tuple(range(n)),)) for n in range(SHORTEST, SPAN)))
BLOCK_WORDS = 1_000_000  # of test items a broadcast: their seeds take about 100 MB
HIT_WORDS = 4_000_000  # of the items of all hits, for these to be broadcast: 32 MB


def words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(text: str) -> Column:
    return F.coalesce(F.transform(words(text), lambda w: F.xxhash64(w)), F.array().cast("array<long>"))


def _seeds(hashes: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """Seeds by position, then mask."""
    span = 1 + max(max(m) for m in masks)

    def of(h: Column) -> Column:
        by_mask = lambda i: F.array(*[F.xxhash64(F.lit(m), *[F.get(h, i + k) for k in mask]) for m, mask in enumerate(masks)])
        return F.when(F.size(h) >= span, F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - span), by_mask))).otherwise(F.array().cast("array<long>"))

    # Bound to a lambda's variable, so that the optimiser can't put the hashing of all words in each place where they are used.
    return F.get(F.transform(F.array(hashes), of), 0)


def _exploded(rows: DataFrame, key: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """A row for each seed; the outer form, as the inner one has all seeds computed once more, by a filter for empty arrays."""
    placed = rows.select(key, "h").withColumn("seeds", _seeds(F.col("h"), masks)).select(key, F.posexplode_outer("seeds").alias("at", "seed"))
    return placed.select(key, "seed", F.floor(F.col("at") / len(masks)).cast("int").alias("place"))


def _hits(train: DataFrame, tests: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """key, item and distance of the places where seeds are equal."""
    seeds = _exploded(tests, "item", masks).withColumnRenamed("place", "item_place")
    met = _exploded(train, "key", masks).join(F.broadcast(seeds), "seed")
    return met.select("key", "item", (F.col("place") - F.col("item_place")).alias("distance")).distinct()


def _needed(words: Column) -> Column:
    """How many words of a window of an item of so many words must agree."""
    return F.when(words < SPAN, words).otherwise(F.ceil(F.least(F.lit(WINDOW), words) * SHARE))


def _agreed(g: Column, h: Column, distance: Column) -> Column:
    """The most words that agree in a window of the item."""
    same = F.transform(g, lambda x, j: F.coalesce((x == F.get(h, distance + j)).cast("int"), F.lit(0)))
    width = F.least(F.lit(WINDOW), F.size(g))
    best = lambda f: F.array_max(F.transform(F.sequence(F.lit(0), F.size(g) - width), lambda k: F.aggregate(F.slice(f, k + 1, width), F.lit(0), lambda n, x: n + x)))
    return F.get(F.transform(F.array(same), best), 0)


def _key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def contaminated(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, agreed, compared): each document and test item with a verified overlap, and the best agreement.

    A hit is verified if in some window of WINDOW words of the item (all of a shorter one) a share of SHARE agree with
    the document's words at the hit's distance; of items of fewer than SPAN words all must agree. Items of fewer than SHORTEST words, and null texts, match nothing; tables may be empty. Rows
    that share a doc_id or an item_id are one document or item in the result; null ids are kept. Other columns are ignored.
    Items beyond `block_words` words together are searched for block by block, each over all documents.
    """
    judged = _overlaps(docs, items, block_words)
    return judged.groupBy("doc_id", "item_id").agg(F.max("agreed").cast("long").alias("agreed"), F.max("compared").cast("long").alias("compared"))


def _overlaps(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, doc_id, item_id, agreed, compared) of each verified hit; key: of the row of `docs`."""
    train = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), _key(docs).alias("key"))
    tests = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    tests = table(tests.select("item_id", F.xxhash64("item_id", "text").alias("item"), _hashed("text").alias("h")), "items")
    hashed = train.select("key", _hashed("text").alias("h"))
    sizes = {low: tests.where(F.size("h").between(low, high or (1 << 30))) for low, high, _ in FAMILIES}
    weights = tests.agg(*[F.sum(F.when(F.size("h").between(low, high or (1 << 30)), F.size("h") * len(masks))).alias(f"f{low}") for low, high, masks in FAMILIES]).first()
    found = []
    for low, _, masks in FAMILIES:
        if weights[f"f{low}"]:  # a family without items needs no pass over the documents
            blocks = -(-weights[f"f{low}"] // (block_words * len(MASKS)))
            found += [_hits(hashed, sizes[low] if blocks == 1 else sizes[low].where(F.pmod("item", F.lit(blocks)) == k), masks) for k in range(blocks)]
    if not found:
        found = [_hits(hashed, tests.limit(0), MASKS)]
    words_of = tests.groupBy("item").agg(F.first("item_id").alias("item_id"), F.first("h").alias("g"))
    hits = table(reduce(DataFrame.unionByName, found).join(words_of, "item"), "hits")
    by_key = hits.groupBy("key").agg(F.collect_list(F.struct("item_id", "distance", "g")).alias("hits"))
    if (hits.agg(F.sum(F.size("g") + 4)).first()[0] or 0) <= HIT_WORDS:
        by_key = F.broadcast(by_key)
    rows = train.join(by_key, "key").select("key", "doc_id", "hits", _hashed("text").alias("h"))
    judged = F.transform("hits", lambda x: F.struct(x["item_id"].alias("item_id"), _agreed(x["g"], F.col("h"), x["distance"]).alias("agreed"), F.least(F.lit(WINDOW), F.size(x["g"])).alias("compared"), _needed(F.size(x["g"])).alias("needed")))
    judged = rows.select("key", "doc_id", F.explode_outer(judged).alias("x")).select("key", "doc_id", "x.item_id", "x.agreed", "x.compared", "x.needed")
    return judged.where("agreed >= needed").drop("needed")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that overlap no test item; each row is judged by its own text, also where rows share a doc_id or have none."""
    bad = bounded(_overlaps(docs, items).select(F.col("key").alias("_lodestrata_bad")).distinct(), "contaminated")
    return docs.join(bad, F.col("_lodestrata_bad") == _key(docs), "left_anti")
