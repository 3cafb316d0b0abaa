"""Language identification by a linear-chain conditional random field over the words of code-switched text.

A word's features are its prefixes and suffixes, its byte bigrams and trigrams, and itself as an entry of a hashed
lexicon; moves between languages are learned too. Forward-backward gives each word's language probabilities; a document's
language is the one with the most expected words. Words are scored once for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .crf import Field, chains, forward_backward, token_scores, train
from .quality import remainder
from .session import batches, trim
from .words import U64, as_strings, mix, release, slices

BITS, CHAIN, PIECE, FEATURED = 16, 128, 32, 4096
DEALT = (256, 16, 1)  # groups of partitions that choose training documents together, step by step
UNKNOWN = "und"
_OUT = "doc_id long, lang_pred string, score double, n_words long, n_switches long"


def word_kinds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words that hold a letter, as numbers of distinct bare words; where each text's begin; and those bare words.

    A bare word is lower-case and has lost what isn't a letter at its ends.
    """
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(words.dictionary), r"^[^\p{L}]+|[^\p{L}]+$", "")
    lettered = pc.match_substring_regex(bare, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    bare = bare.dictionary_encode()
    kind = bare.indices.to_numpy()[words.indices.to_numpy()]
    keep = lettered[words.indices.to_numpy()]
    ends = np.concatenate([[0], np.cumsum(keep)])
    first = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
    return kind[keep], first, bare.dictionary


def word_features(words: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, and where each word's begin (one more at the end)."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    body = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    first = offsets + 2 * np.arange(len(offsets))  # of the padded words
    padded = np.ones(int(first[-1]) + 4, dtype=np.uint8)
    inner = np.arange(len(body)) + 2 * np.repeat(np.arange(len(words)), size) + 1
    padded[inner] = body
    padded[first[1:] - 1] = 2
    row = np.repeat(np.arange(len(words)), size + 2)
    at = np.arange(len(row))
    b = padded.astype(U64)
    room = first[1:][row] - at
    two = b[:-1] << U64(8) | b[1:]
    three = two[:-1] << U64(8) | b[2:]
    found, rows = [], []

    def keep(values: np.ndarray, code: int, which: np.ndarray) -> None:
        found.append(mix(values + (U64(code) << U64(56))))
        rows.append(which)

    keep(two[at][room >= 2], 1, row[room >= 2])
    keep(three[at][room >= 3], 2, row[room >= 3])
    for k in (2, 3, 4):
        long = np.flatnonzero(size >= k)
        head, tail = np.zeros(len(long), dtype=U64), np.zeros(len(long), dtype=U64)
        for j in range(k):
            head = head << U64(8) | b[first[:-1][long] + 1 + j]
            tail = tail << U64(8) | b[first[1:][long] - 1 - k + j]
        keep(head, 10 + k, long)
        keep(tail, 20 + k, long)
    power = np.multiply.accumulate(np.full(int(size.max(initial=0)) + 1, 0x100000001B3, dtype=U64))
    whole = np.zeros(len(words), dtype=U64)
    filled = size > 0
    if filled.any():
        place = np.arange(len(body)) - np.repeat(offsets[:-1], size)
        whole[filled] = np.add.reduceat(body.astype(U64) * power[place], offsets[:-1][filled])
    keep(whole, 30, np.arange(len(words)))
    rows_, found_ = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows_, kind="stable")
    return (found_[order] >> U64(64 - bits)).astype(np.int64), np.searchsorted(rows_[order], np.arange(len(words) + 1))


class Model:
    def __init__(self, languages: list[str], field: Field):
        self.languages, self.field = languages, field


def fit(docs: DataFrame, per_language: int = 250, most_rows: int = 16_000, pieces: int = 3_000, rounds: int = 2, bits: int = BITS) -> Model:
    """Learn from (doc_id, text, lang): of each language the `per_language` documents whose doc_id hashes lowest, fewer where all would be more than
    `most_rows` (but one at least, so every language can be told), and of their pieces `pieces` of each language.

    Every word of such a document bears the document's language. Its words are cut into pieces, the last of which overlaps the one before it;
    half of the pieces get their ends from pieces of other documents, so that moves between languages are seen.
    """
    known = docs.where("lang is not null and doc_id is not null")
    per_language = max(1, min(per_language, most_rows // max(1, known.select("lang").distinct().count())))
    chosen = known.select("lang", "doc_id", F.spark_partition_id().alias("part"))
    for groups in DEALT:  # of fewer partitions each time, so that no task gets the choices of all partitions
        by_hash = Window.partitionBy("lang", F.pmod("part", F.lit(groups))).orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = chosen.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= per_language).drop("rank")
    chosen = chosen.select("doc_id", "lang").distinct()
    found = known.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])
    sample = found.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "lang"])
    languages = sorted(set(sample["lang"]))
    field = Field(1 << bits, max(1, len(languages)))
    kind, first, words = word_kinds(as_strings(pa.array(sample["text"].tolist(), pa.string())))
    number = {x: k for k, x in enumerate(languages)}
    made, marks = [], []
    for k, lang in enumerate(sample["lang"]):
        own = kind[first[k] : first[k + 1]]
        for low in range(0, len(own), PIECE):
            low = max(0, min(low, len(own) - PIECE))
            made.append(np.resize(own[low : low + PIECE], PIECE))  # a short text is repeated to a piece
            marks.append(number[lang])
    if len(languages) < 2 or not made:
        return Model(languages, field)
    draw = np.random.default_rng(7)
    tokens, tags = np.array(made), np.repeat(np.array(marks)[:, None], PIECE, axis=1)
    other = draw.permutation(len(tokens))
    for r in np.flatnonzero(draw.random(len(tokens)) < 0.5).tolist():
        cut = int(draw.integers(4, PIECE - 4))
        tokens[r, cut:], tags[r, cut:] = made[other[r]][cut:], marks[other[r]]
    flat, at = _features_of_many(words, bits)
    drawn = draw.permutation(len(tokens))
    own = np.array(marks)[drawn]
    order = drawn[np.sort(np.concatenate([np.flatnonzero(own == x)[:pieces] for x in range(len(languages))]))]
    model = Model(languages, train(flat, at, tokens[order], tags[order], field, rounds))
    release()
    trim(docs.sparkSession)
    return model


def _features_of_many(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """word_features(), found FEATURED words at a time: what it holds meanwhile is many times the result, and the driver has little memory."""
    found, sizes = [], []
    for low in range(0, len(words), FEATURED):
        flat, at = word_features(words.slice(low, FEATURED), bits)
        found.append(flat.astype(np.int32))
        sizes.append(np.diff(at))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _predicted(texts: pa.Array, languages: list[str], weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each text: language, its score, number of words, number of switches."""
    kind, first, words = word_kinds(texts)
    n = np.diff(first)
    if not len(kind) or not languages:
        return np.full(len(n), UNKNOWN, dtype=object), np.zeros(len(n)), n, np.zeros(len(n), np.int64)
    bits = (len(weights) - 1).bit_length()
    scores = token_scores(weights, *word_features(words, bits))[kind]
    rows, before = chains(first, CHAIN)
    marginal, _ = forward_backward(scores, moves, rows, before=before)
    total = np.concatenate([np.zeros((1, len(languages))), np.cumsum(marginal, axis=0, dtype=np.float64)])
    share = (total[first[1:]] - total[first[:-1]]) / np.maximum(1, n)[:, None]
    best = share.argmax(axis=1)
    tag = marginal.argmax(axis=1)
    turn = np.concatenate([[0, 0], np.cumsum(tag[1:] != tag[:-1])])
    switches = np.where(n > 1, turn[first[1:]] - turn[np.minimum(first[:-1] + 1, len(tag))], 0)
    named = np.where(n > 0, np.array(languages, dtype=object)[best], UNKNOWN)
    return named, np.where(n > 0, np.clip(share[np.arange(len(n)), best], 0, 1), 0.0), n, switches


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches) of every row.

    score: the mean probability of that language over the words with a letter; n_switches: how often the likeliest
    language changes from a word to the next. No such word, or null text: `und`, 0. Repeated rows are labelled each.
    Long texts are worked on in chains of CHAIN words, with messages carried over the cuts.
    """
    spark = docs.sparkSession
    batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.field.weights, model.field.moves))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, ids = as_strings(frame.column("text")), frame.column("doc_id")
            for low, high in slices(texts, 2 << 20):
                named, score, n, switches = _predicted(texts.slice(low, high - low), *shared.value)
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(named.tolist(), pa.string()), pa.array(score), pa.array(n.astype(np.int64)), pa.array(switches.astype(np.int64))], [c.split()[0] for c in _OUT.split(", ")])
        release()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, _OUT)


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is known with a score of `least` or more. No row moves to another task."""
    spark = docs.sparkSession
    batches(spark)
    shared = spark.sparkContext.broadcast((model.languages, model.field.weights, model.field.moves))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = as_strings(frame.column("text"))
            for low, high in slices(texts, 2 << 20):
                named, score, _, _ = _predicted(texts.slice(low, high - low), *shared.value)
                yield frame.slice(low, high - low).filter(pa.array((named != UNKNOWN) & (score >= least)))
        release()

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang) of the rows outside the held-out third."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    return rows.where(remainder("doc_id", 3) != 1)


def identify(docs: DataFrame) -> DataFrame:
    """Predict every document's language, learning from those outside the held-out third.

    One row per row of `docs`: doc_id, held_out, lang_pred, score, n_words, n_switches. A null doc_id isn't held out and
    teaches nothing; with no labelled document every row is `und`. An empty table gives no rows; other columns are ignored.
    """
    found = predict(docs, fit(training_rows(docs)))
    return found.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)))
