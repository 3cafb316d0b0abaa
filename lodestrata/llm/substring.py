"""Repeated-phrase automata: find passages that documents share, and cut the later copies.

1. Phrases. Of each 50-word window, the 16-word phrase with the least hash is its anchor: equal windows have equal anchors,
   so a window can recur only if its anchor occurs in two documents. Neighbouring windows of one anchor are a run, about
   eighteen windows. A light row holds a run's anchor and the hash of all its words.
2. The book. Anchors in two documents recur. The first document of each run with such an anchor offers it to the book; where an anchor has
   runs of different words, the offered runs' single windows are hashed, and only windows of two documents or more stay, each in its first document only.
   That takes aggregates by hash only, so a passage in a third of all documents is no hot group.
3. Automata. The book is dealt by anchor into shards of bounded size; each is compiled to an Aho-Corasick automaton of its
   anchors. All documents are streamed: every run of every document whose anchor recurs goes, as text, to the shard of that anchor. Where the automaton
   meets a phrase, the run is compared, as a whole, with the passage of that phrase; where it differs, or several passages have the phrase, the windows around the
   phrase are looked up in these passages by a 128-bit digest of all their words. Nothing but that says which words go.
   An anchor that streams much is dealt to several tasks, and one whose passages alone outgrow a shard is dealt on by single windows.
4. The words covered by windows that an earlier document has are cut.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import batches, drop, join_dealt, join_ones, table
from .words import U64, Words, _spread, as_strings, mix, release, slices, window_hashes

WINDOW, ANCHOR = 50, 16
SHARD_BYTES, STREAM_BYTES = 4 << 20, 32 << 20
_PIECE = "kind int, anchor long, doc_id long, key long, start long, owned boolean, last long, mixed boolean, body string, n_words long, kept_sha256 string"
_RUN, _WHOLE, _DONE = 0, 1, 2
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if n > size and len(values) > n - size else values if n == size else values[:0]


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each window within one text: its first word and its text's number."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(np.arange(len(row)) + WINDOW <= words.first[1:][row]) if len(row) else np.zeros(0, np.int64)
    return at, row[at]


def anchored(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within one text: its first word, its text's number and its anchor."""
    least = _least(window_hashes(words.hashes(), ANCHOR), WINDOW - ANCHOR + 1)
    at, row = _windows(words)
    return at, row, least[at] if len(at) else np.zeros(0, U64)


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: its text's number, first window's first word, number of windows, anchor and hash of all its words."""
    at, row, anchor = anchored(words)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])]))
    size = np.diff(np.concatenate([cut, [len(at)]]))
    begin = at[cut]
    whole = mix(_spread(words.hashes(), begin, begin + size + WINDOW - 1, 0xD1342543DE82EF95) + size.astype(U64))
    return row[cut], begin, size, anchor[cut].view(np.int64), whole.view(np.int64)


def _all_runs(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts, ids = as_strings(frame.column("text")), frame.column("doc_id").to_numpy(zero_copy_only=False)
        for low, high in slices(texts):
            row, _, _, anchor, whole = _runs(Words(texts.slice(low, high - low)))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(whole), pa.array(ids[low:high][row].astype(np.int64))], ["anchor", "whole", "doc_id"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _marked(marks: pa.ListArray, row: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs with these texts' numbers, anchors and hashes, those that their texts' marks name, and the mark of each: the one with `last`, if any."""
    fields = marks.flatten()
    size = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pairs = ((np.repeat(np.arange(len(marks)), size), row), *((fields.field(c).to_numpy(zero_copy_only=False), x) for c, x in (("anchor", anchor), ("whole", whole))))
    keys = [np.concatenate(x) for x in pairs]
    n = len(fields)
    rank = np.full(n + len(row), 2, np.int8)  # with equal keys: marks with `last`, other marks, runs
    rank[:n] = fields.field("last").is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((rank, *keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys])
    source = np.empty(len(order), np.int64)
    source[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    found = np.flatnonzero(source[n:] < n)
    return found, source[n:][found]


def _pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the runs that are marked, and whole texts that may lose words; of other texts only what they come to."""
    schema = pa.schema([(c, _TYPES[k]) for c, k in (x.split() for x in _PIECE.split(", "))])

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in schema], schema=schema)

    for frame in frames:
        texts = as_strings(frame.column("text"))
        for low, high in slices(texts):
            ids, keys, marks = (frame.column(c).slice(low, high - low) for c in ("doc_id", "key", "marks"))
            some = Words(texts.slice(low, high - low))
            row, begin, size, anchor, whole = _runs(some)
            found, mark = _marked(marks, row, anchor, whole)
            data, of = some.data.tobytes(), row[found]
            ends = some.end[begin[found] + size[found] + WINDOW - 2]
            bodies = [b" ".join(data[a:b].split()) for a, b in zip(some.start[begin[found]].tolist(), ends.tolist())]
            last, mixed = (marks.flatten().field(c).take(pa.array(mark)) for c in ("last", "mixed"))
            yield batch(
                len(found), kind=pa.array(np.full(len(found), _RUN)), anchor=pa.array(anchor[found]), doc_id=ids.take(pa.array(of)), key=keys.take(pa.array(of)), start=pa.array(begin[found] - some.first[of]),
                owned=last.is_valid(), last=last, mixed=mixed, body=pa.array(bodies, pa.binary()), n_words=pa.array(np.zeros(len(found), np.int64)),
            )
            may = np.zeros(high - low, dtype=bool)
            may[of] = True
            digests = [None if m else _digest(data[a:b].split()) for m, a, b in zip(may.tolist(), some.bytes.tolist(), some.bytes[1:].tolist())]
            body = texts.take(pa.array(np.arange(low, high), mask=~may))
            kinds, zeros = pa.array(np.where(may, _WHOLE, _DONE)), pa.array(np.zeros(high - low, np.int64))
            yield batch(high - low, kind=kinds, doc_id=ids, key=keys, start=zeros, body=body, n_words=pa.array(np.diff(some.first)), kept_sha256=pa.array(digests, pa.string()))


def _single(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the single windows of runs, by place in the run."""
    for frame in frames:
        bodies = as_strings(frame.column("body"))
        for low, high in slices(bodies):
            some = Words(bodies.slice(low, high - low))
            windows = np.diff(some.first) - WINDOW + 1
            row = np.repeat(np.arange(high - low), windows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            window = window_hashes(some.hashes(), WINDOW)[some.first[:-1][row] + place] if len(row) else np.zeros(0, U64)
            names = ("doc_id", "key", "start", "last")
            kept = [pa.array(frame.column(c).to_numpy(zero_copy_only=False)[low:high][row].astype(np.int64)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(window.view(np.int64)), *kept, pa.array(place.astype(np.int32))], ["window", *names, "place"])


def _stretches(places: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers, as first and last."""
    found: list[tuple[int, int]] = []
    for p in sorted(places):
        if found and found[-1][1] == p - 1:
            found[-1] = (found[-1][0], p)
        else:
            found.append((p, p))
    return found


_PASSAGE = "anchor long, owner long, body string"


def _passages(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of runs that are made of the given windows."""
    for frame in frames:
        out = []
        for anchor, owner, body, places in zip(*(frame.column(c).to_pylist() for c in ("anchor", "doc_id", "body", "places"))):
            words = body.split(" ")
            out += [(anchor, owner, " ".join(words[a : b + WINDOW])) for a, b in _stretches(places)]
        yield _batch(out, _PASSAGE)


_DEALT = "shard long, kind int, owner long, doc_id long, key long, start long, body string"


def _by_window(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors with very many passages, window by window; equal windows get equal shards."""
    for frame in frames:
        out = []
        for shard, kind, owner, doc_id, key, start, body in zip(*(frame.column(c.split()[0]).to_pylist() for c in _DEALT.split(", "))):
            words = body.split(" ")
            hashes = window_hashes(Words(pa.array([body])).hashes(), WINDOW).view(np.int64).tolist()
            out += [(shard ^ h, kind, owner, doc_id, key, start + p, " ".join(words[p : p + WINDOW])) for p, h in enumerate(hashes)]
        yield _batch(out, _DEALT)


class PhraseBook:
    """An Aho-Corasick automaton of the anchors of some passages, each (owner, words)."""

    def __init__(self, passages: list[tuple[int, str]]):
        import ahocorasick

        self.passages = passages
        having: dict[str, list[int]] = {}  # of each anchor, the passages that have it
        for k, phrase in self._anchors([body for _, body in passages]):
            found = having.setdefault(phrase, [])
            if k not in found[-1:]:
                found.append(k)
        # Equal windows have equal anchors, so no other passage has a window of one that shares no anchor.
        some, shared = ({k for found in having.values() if len(found) > least for k in found} for least in (0, 1))
        self.alone = {passages[k][1]: passages[k][0] for k in some - shared}
        self.owners: dict[bytes, int] = {}  # of each window, by a 128-bit digest of its words, the first document that has it; of passages as they are met
        self.automaton = ahocorasick.Automaton()
        for phrase, found in having.items():
            self.automaton.add_word(f" {phrase} ", found)
        self.automaton.make_automaton()
        self.seen: dict[str, list[tuple[int, int]]] = {}

    @staticmethod
    def _mark(window: str) -> bytes:
        return hashlib.blake2b(window.encode(), digest_size=16).digest()

    @staticmethod
    def _anchors(bodies: list[str]) -> Iterator[tuple[int, str]]:
        """Number and words of the anchors of each passage: in each window the first place of its least hash."""
        texts = pa.array(bodies, pa.string())
        for low, high in slices(texts, 1 << 20):
            some = Words(texts.slice(low, high - low))
            at, row = _windows(some)
            if not len(at):
                continue
            near = np.lib.stride_tricks.sliding_window_view(window_hashes(some.hashes(), ANCHOR), WINDOW - ANCHOR + 1)
            place = at + np.concatenate([near[part].argmin(axis=1) for part in np.split(at, range(1 << 16, len(at), 1 << 16))])
            place, first = np.unique(place, return_index=True)
            data = some.data.tobytes()
            for k, a, b in zip((low + row[first]).tolist(), some.start[place].tolist(), some.end[place + ANCHOR - 1].tolist()):
                yield k, data[a:b].decode()

    @staticmethod
    def _ends(body: str) -> list[int]:
        """Where each word begins, and one place beyond the last word's following space."""
        return [0, *accumulate([len(w) + 1 for w in body.split(" ")])]

    def _learn(self, owner: int, body: str) -> None:
        ends = self._ends(body)
        for text in {body[a : b - 1] for a, b in zip(ends, ends[WINDOW:])}:
            window = self._mark(text)
            self.owners[window] = min(owner, self.owners.get(window, owner))

    def _met(self, body: str) -> list[tuple[int, int]]:
        """Place and owner of each window of `body` around a phrase of the book that is in the book as a whole."""
        hits = list(self.automaton.iter(f" {body} "))
        for _, having in hits:
            while having:
                self._learn(*self.passages[having.pop()])
        ends = self._ends(body) if hits else []
        last, found, open_from = len(ends) - 1 - WINDOW, [], 0
        known: dict[str, int | None] = {}
        for end, _ in hits:
            at = bisect_left(ends, end) - ANCHOR  # the word that the phrase begins with
            for p in range(max(open_from, at + ANCHOR - WINDOW), min(at, last) + 1):
                window = body[ends[p] : ends[p + WINDOW] - 1]
                owner = known[window] if window in known else known.setdefault(window, self.owners.get(self._mark(window)))
                if owner is not None:
                    found.append((p, owner))
            open_from = max(open_from, at + 1)
        return found

    def locate(self, doc_id: int, body: str) -> list[tuple[int, int]]:
        """Word ranges of `body` that are passages of documents before doc_id, WINDOW words or more each."""
        owner = self.alone.get(body)
        if owner is not None:
            return [(0, body.count(" ") + 1)] if owner < doc_id and next(self.automaton.iter(f" {body} "), None) else []
        found = self.seen.get(body)
        if found is None:
            if len(self.seen) >= 4096:
                self.seen.clear()
            found = self.seen[body] = self._met(body)
        return [(a, b + WINDOW) for a, b in _stretches([p for p, owner in found if owner < doc_id])]


_RANGE = "doc_id long, key long, low long, high long"
_BOOK, _STREAM = 0, 1


def _located(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, passages first: compile, then stream the runs."""
    shard, book, passages = None, None, []
    for frame in frames:
        out = []
        for s, kind, owner, doc_id, key, start, body in zip(*(frame.column(c.split()[0]).to_pylist() for c in _DEALT.split(", "))):
            if s != shard:
                if book is not None:
                    book = None
                    release()
                shard, passages = s, []
            if kind == _BOOK:
                passages.append((owner, body))
                continue
            if book is None:
                book, passages = PhraseBook(passages), []
            out += [(doc_id, key, start + low, start + high) for low, high in book.locate(doc_id, body)]
        yield _batch(out, _RANGE)


def _cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        out = []
        for doc_id, text, ranges in zip(*(frame.column(c).to_pylist() for c in ("doc_id", "body", "ranges"))):
            words = (text or "").encode().split()
            kept = np.ones(len(words), dtype=bool)
            for x in ranges or ():
                kept[x["low"] : x["high"]] = False
            body = b" ".join([w for w, k in zip(words, kept.tolist()) if k])
            out.append((doc_id, len(words), int(len(words) - kept.sum()), hashlib.sha256(body).hexdigest(), body.decode()))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("text"))


def _candidates(docs: DataFrame) -> DataFrame:
    """Pieces of all documents, see _PIECE: runs whose anchors recur, whole texts of documents with such runs, and the others' results."""
    keyed = _keyed(docs)
    named = keyed.where("doc_id is not null")
    all_runs = table(named.select("doc_id", "text").mapInArrow(_all_runs, "anchor long, whole long, doc_id long"), "runs")
    anchors = all_runs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("whole") != F.max("whole")).alias("mixed"), F.count("*").alias("_n"))
    anchors = table(anchors.where("a < b").select("anchor", "mixed", "_n"), "anchors")
    shared = table(join_dealt(all_runs, anchors.select("anchor", "mixed"), ["anchor"], anchors.select("anchor", "_n")), "shared-runs")
    firsts = shared.groupBy("anchor", "whole").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.max("mixed").alias("mixed"))
    marks = firsts.select("doc_id", "anchor", "whole", "last", "mixed").unionByName(shared.select("doc_id", "anchor", "whole"), allowMissingColumns=True)
    lists = marks.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "whole", "last", "mixed")).alias("marks"))
    pieces = named.join(lists, "doc_id", "left").select("doc_id", "key", "text", "marks")
    nameless = keyed.where("doc_id is null").withColumn("marks", F.lit(None).cast(pieces.schema["marks"].dataType))
    written = table(pieces.unionByName(nameless.select(pieces.columns)).mapInArrow(_pieces, _PIECE), "pieces")
    drop(all_runs, anchors, shared)
    return written


def _book(runs: DataFrame) -> DataFrame:
    """(anchor, owner, body): the passages that recur, each of their windows in its first document only."""
    offered = runs.where("owned")
    single = offered.where("mixed").select("doc_id", "key", "start", "last", "body").mapInArrow(_single, "window long, doc_id long, key long, start long, last long, place int")
    first = single.groupBy("window").agg(F.min(F.struct("doc_id", "key", "start", "place")).alias("x"), F.max("last").alias("last")).where("x.doc_id < last")
    places = first.select("x.*").groupBy("doc_id", "key", "start").agg(F.collect_set("place").alias("places"))
    mixed = offered.where("mixed").join(places, ["doc_id", "key", "start"]).dropDuplicates(["doc_id", "key", "start"]).select("anchor", "doc_id", "body", "places").mapInArrow(_passages, _PASSAGE)
    plain = offered.where("not mixed and doc_id < last").select("anchor", F.col("doc_id").alias("owner"), "body")
    return table(mixed.unionByName(plain).dropDuplicates(["anchor", "owner", "body"]), "book")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """Cut each word covered by a window that also starts in a document with a smaller doc_id.

    One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256. Null text has no words. Rows with a null
    doc_id are kept whole and are no one's predecessor; rows that share a doc_id don't cut one another. An empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark)
    pieces = _candidates(docs)
    runs = pieces.where(F.col("kind") == _RUN)
    book = _book(runs)
    sizes = book.groupBy("anchor").agg(F.sum(F.length("body")).alias("bytes"))
    shards = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))
    # Few anchors: their texts weigh STREAM_BYTES or SHARD_BYTES each.
    hot = runs.groupBy("anchor").agg(F.sum(F.length("body")).alias("bytes")).where(F.col("bytes") > STREAM_BYTES).select("anchor", F.ceil(F.col("bytes") / STREAM_BYTES).cast("int").alias("salts"))
    wide = sizes.where(F.col("bytes") > SHARD_BYTES).select("anchor", F.lit(True).alias("wide"))
    rows = book.select("anchor", F.lit(_BOOK).alias("kind"), "owner", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), F.lit(0).cast("long").alias("start"), "body")
    rows = rows.unionByName(runs.select("anchor", F.lit(_STREAM).alias("kind"), F.lit(None).cast("long").alias("owner"), "doc_id", "key", "start", "body"))
    rows = rows.join(F.broadcast(table(hot, "hot")), "anchor", "left").join(F.broadcast(table(wide, "wide")), "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salts = F.when(F.col("kind") == _BOOK, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), "salts").cast("int")))
    rows = rows.withColumn("salt", F.explode(salts))
    columns = [c.split()[0] for c in _DEALT.split(", ")]
    narrow = rows.where("wide is null").withColumn("shard", F.xxhash64(F.pmod(F.xxhash64("anchor"), F.lit(shards)), "salt")).select(columns)
    by_window = rows.where("wide").withColumn("shard", F.xxhash64("anchor", "salt")).select(columns).mapInArrow(_by_window, _DEALT)
    by_window = by_window.withColumn("shard", F.pmod("shard", F.lit(16 * shards)))
    dealt = narrow.unionByName(by_window).repartition("shard").sortWithinPartitions("shard", "kind")
    ranges = dealt.mapInArrow(_located, _RANGE)
    ranges = ranges.groupBy("doc_id", "key").agg(F.collect_set(F.struct("low", "high")).alias("ranges")).select(F.xxhash64("doc_id", "key").alias("row"), "ranges")
    whole = pieces.where(F.col("kind") == _WHOLE).select("doc_id", F.xxhash64("doc_id", "key").alias("row"), "body")
    cut = join_ones(whole, ranges, "row", F.size("ranges") * 16 + 32, how="left").select("doc_id", "body", "ranges").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    done = pieces.where(F.col("kind") == _DONE).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(done)
