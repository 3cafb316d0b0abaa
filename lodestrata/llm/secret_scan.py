"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags tokens as secret begin, inside or outside.

A token is a run of letters, digits and +/_.- or one other visible ASCII character. Its features are its shape (length, share of
digits, case, hexadecimal or not, changes between letters and digits), the shapes beside it, itself and the three tokens
before it, and two features of its file: whether a word for a credential occurs there, and its share of digits. Decoding is by Viterbi.
A token that is outside whatever stands beside it cuts the chain there without changing the best path, so only the
short stretches between such tokens are decoded step by step.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Field, train, viterbi
from .session import batches
from .words import U64, _spread, as_strings, mix, slices

OUT, BEGIN, INSIDE = 0, 1, 2
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 or more
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"

_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[128:] = 1
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-"]] = 1
_IS = {name: np.isin(np.arange(256), [ord(c) for c in chars]).astype(np.int32) for name, chars in (("digit", "0123456789"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("hex", "0123456789abcdefABCDEF"))}
_IS["lower"] = (np.isin(np.arange(256), [ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]) | (np.arange(256) >= 128)).astype(np.int32)

SHAPES, VOCABULARY = 1024 + 256 + 1, (1 << 12) + 1
_NO_SHAPE, _NO_WORD = SHAPES - 1, VOCABULARY - 1
_PARTS = (SHAPES, SHAPES, SHAPES, VOCABULARY, VOCABULARY, VOCABULARY, VOCABULARY, 8)
_STARTS = np.concatenate([[0], np.cumsum(_PARTS)])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns' matches, by start, then kind; code points."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


class Tokens:
    """The tokens of some rows: bytes start[k]:end[k] of data; row r has the tokens first[r]:first[r + 1]."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.bytes = offsets - low
        kind = _CLASS[self.data]
        edge = np.ones(len(kind) + 1, dtype=bool)  # a token may begin or end before this byte
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        edge[self.bytes] = True
        solid = kind != 0
        self.start = np.flatnonzero(edge[:-1] & solid)
        self.end = np.flatnonzero(edge[1:] & solid) + 1
        self.first = np.searchsorted(self.start, self.bytes)

    def features(self) -> np.ndarray:
        """Tokens x 8 feature numbers."""
        n = len(self.start)
        size = self.end - self.start

        def count(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table, dtype=np.int32)])
            return total[self.end] - total[self.start]

        digits, upper, lower, hexes = (count(_IS[k][self.data]) for k in ("digit", "upper", "lower", "hex"))
        is_digit = _IS["digit"][self.data]
        turn = np.zeros(len(self.data), dtype=np.int32)
        turn[1:] = is_digit[1:] != is_digit[:-1]
        turns = count(turn) - turn[self.start]
        title = _IS["upper"][self.data[self.start]] if n else upper
        shape = np.searchsorted([2, 4, 8, 12, 16, 24, 40], size, side="right") * 4 + np.where(digits == 0, 0, np.where(4 * digits < size, 1, np.where(5 * digits < 3 * size, 2, 3)))
        case = np.where(upper - title > 0, np.where(lower > 0, 3, 2), np.where(lower + title > 0, 1, 0))
        shape = ((shape * 4 + case) * 2 + (hexes == size)) * 4 + np.searchsorted([1, 2, 4], turns, side="right")
        byte = self.data[self.start] if n else np.zeros(0, np.uint8)
        shape = np.where(_CLASS[byte] == 3, 1024 + byte.astype(np.int64), shape)
        small = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data)
        word = (mix(_spread(small.astype(U64) + U64(1), self.start, self.end, 0x9E3779B97F4A7C15)) >> U64(52)).astype(np.int64)
        rows = np.diff(self.first)
        begin, stop = np.repeat(self.first[:-1], rows), np.repeat(self.first[1:], rows)
        at = np.arange(n)

        def beside(values: np.ndarray, by: int, none: int) -> np.ndarray:
            out = np.full(n, none, dtype=np.int64)
            ok = (at + by >= begin) & (at + by < stop)
            out[ok] = values[at[ok] + by]
            return out

        told = np.isin(word, _CREDENTIAL)
        total = np.concatenate([[0], np.cumsum(told)])
        named = total[self.first[1:]] > total[self.first[:-1]]
        number = np.concatenate([[0], np.cumsum(is_digit)])
        share = (number[self.bytes[1:]] - number[self.bytes[:-1]]) / np.maximum(1, np.diff(self.bytes))
        file = np.repeat(named * 4 + np.searchsorted([0.002, 0.02, 0.1], share, side="right"), rows)
        parts = [shape, beside(shape, -1, _NO_SHAPE), beside(shape, 1, _NO_SHAPE), word, beside(word, -1, _NO_WORD), beside(word, -2, _NO_WORD), beside(word, -3, _NO_WORD), file]
        return np.stack([p + s for p, s in zip(parts, _STARTS)], axis=1)


def _word_number(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(mix(_spread(data.astype(U64) + U64(1), np.array([0]), np.array([len(data)]), 0x9E3779B97F4A7C15))[0] >> U64(52))


_CREDENTIAL = np.array([_word_number(w) for w in (*_WORDS, "key", "bearer", "credential", "auth")])


def _secrets(draw: np.random.Generator) -> tuple[str, str, str]:
    """What stands before a made-up secret, the secret, and what stands after it."""

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(draw.choice(list(alphabet), int(draw.integers(low, high + 1))))

    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = lower + upper + digits
    forms = (
        lambda: (f"{draw.choice(['password', 'passwd', 'secret', 'token', 'api_key', 'apikey', 'Password', 'auth'])}{draw.choice([' = ', ': ', '=', ':', ' is '])}{draw.choice(['', chr(34), chr(39)])}", some(mixed, 12, 40), draw.choice(["", '"', "'", ";"])),
        lambda: (draw.choice(["key ", "Bearer ", "Authorization: Bearer ", "credential ", "credential: "]), some(mixed + "-_", 24, 64), ""),
        lambda: ("", "AKIA" + some(upper + digits, 16, 16), ""),
        lambda: ("", some("0123456789abcdef", 32, 64), ""),
        lambda: ("", draw.choice(["ghp_", "sk_live_", "sk-", "glpat-", "xoxb-", "npm_"]) + some(mixed, 24, 40), ""),
        lambda: (draw.choice(["aws_secret_access_key = ", "client_secret: "]), some(mixed + "+/", 40, 40), ""),
    )
    return forms[int(draw.integers(len(forms)))]()


def fit(docs: DataFrame, most: int = 500, rounds: int = 8, piece: int = 40, plain: int = 2500) -> Field:
    """Learn the field from the `most` documents (doc_id, text) whose doc_id hashes lowest.

    Secrets in them are what the fixed patterns find; made-up ones of several forms are put between their words, so
    that other forms are learned than the patterns know. Everything else is outside.
    """
    chosen = docs.where("doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
    texts = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")["text"]
    draw = np.random.default_rng(11)
    made, golds = [], []
    for text in texts:
        gold = []
        for start, end, kind in base_spans(text):
            m = _ASSIGN.match(text, start) if kind == 0 else None
            gold.append((m.start(2), m.end(2)) if m else (start, end))
        cuts = sorted({m.end() for m in re.finditer(r"[a-z][ \n]", text)})
        for at in sorted(draw.choice(cuts, min(len(cuts), 3), replace=False).tolist() if cuts else [], reverse=True):
            if any(a < at + 1 and at - 1 < b for a, b in gold):
                continue
            before, secret, after = _secrets(draw)
            put = f"{before}{secret}{after} "
            text = text[:at] + put + text[at:]
            gold = [(a + len(put), b + len(put)) if a >= at else (a, b) for a, b in gold] + [(at + len(before), at + len(before) + len(secret))]
        made.append(text)
        golds.append(gold)
    field = Field(int(_STARTS[-1]), 3)
    if not made:
        return field
    tokens = Tokens(pa.array(made, pa.string()))
    found = tokens.features()
    tags = np.zeros(len(found), dtype=np.int64)
    for r, gold in enumerate(golds):
        own, low = slice(tokens.first[r], tokens.first[r + 1]), tokens.bytes[r]
        for a, b in gold:
            x, y = low + len(made[r][:a].encode()), low + len(made[r][:b].encode())
            inside = np.flatnonzero((tokens.start[own] >= x) & (tokens.end[own] <= y)) + tokens.first[r]
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
    pieces = []
    for low, high in zip(tokens.first[:-1].tolist(), tokens.first[1:].tolist()):
        for at in range(low, high, piece):
            at = max(low, min(at, high - piece))
            pieces.append(np.resize(np.arange(at, min(at + piece, high)), piece))  # a short text is repeated to a piece
    if not pieces:
        return field
    rows = np.array(pieces)
    secret = (tags[rows] > 0).any(axis=1)
    without = draw.permutation(np.flatnonzero(~secret))[: plain + 2 * int(secret.sum())]
    rows = rows[np.sort(np.concatenate([np.flatnonzero(secret), without]))]
    width = found.shape[1]
    return train(found.reshape(-1), np.arange(len(found) + 1) * width, rows, tags[rows], field, rounds, size=64, rate=0.2, decay=3e-4)


def decode(tokens: Tokens, field_weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tag of each token, each row a chain of its own that begins and ends outside."""
    found = tokens.features()
    scores = np.zeros((len(found), 3), dtype=np.float32)
    for k in range(found.shape[1]):
        scores += field_weights[found[:, k]]
    tags = np.zeros(len(found), dtype=np.int8)
    sure = np.ones(len(found), dtype=bool)
    for x in (BEGIN, INSIDE):
        gain = (moves[:, x][:, None] + moves[x][None, :] - moves[:, OUT][:, None] - moves[OUT][None, :]).max()
        sure &= scores[:, OUT] - scores[:, x] > gain
    row = np.repeat(np.arange(len(tokens.first) - 1), np.diff(tokens.first))
    open_ = np.flatnonzero(~sure)
    if len(open_):
        cut = np.concatenate([[0], np.flatnonzero((np.diff(open_) != 1) | (np.diff(row[open_]) != 0)) + 1, [len(open_)]])
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist()):
            tags[open_[low:high]] = viterbi(scores[open_[low:high]], moves, OUT, OUT)
    return tags


def scan(docs: DataFrame, field: Field, shortest: int = 8) -> DataFrame:
    """Secrets of every document, its whole text read: counts by kind, the fixed patterns' digest, and all spans.

    One row per row of `docs` (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans, n_crf. A tagged stretch of
    `shortest` or more characters that lies in no pattern's match is a span of kind crf, also where it overlaps one. Null text is empty; an
    empty table gives no rows; repeated rows are scanned each; other columns are ignored.
    """
    spark = docs.sparkSession
    batches(spark)
    shared = spark.sparkContext.broadcast((field.weights, field.moves))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves = shared.value
        for frame in frames:
            texts, ids = as_strings(frame.column("text")), frame.column("doc_id").to_pylist()
            out = []
            for low, high in slices(texts):
                part = texts.slice(low, high - low)
                tokens = Tokens(part)
                tags = decode(tokens, weights, moves)
                heads = np.flatnonzero((tags == BEGIN) | ((tags == INSIDE) & (np.concatenate([[OUT], tags[:-1]]) == OUT)))
                begin = np.searchsorted(heads, tokens.first)
                for r, text in enumerate(part.to_pylist()):
                    base = base_spans(text)
                    spans = [(a, b, k, KINDS[k]) for a, b, k in base]
                    for h in heads[begin[r] : begin[r + 1]].tolist():
                        last = h
                        while last + 1 < tokens.first[r + 1] and tags[last + 1] == INSIDE:
                            last += 1
                        a = len(tokens.data[tokens.bytes[r] : tokens.start[h]].tobytes().decode())
                        b = a + len(tokens.data[tokens.start[h] : tokens.end[last]].tobytes().decode())
                        if b - a >= shortest and not any(x <= a and b <= y for x, y, _ in base):
                            spans.append((a, b, len(KINDS), "crf"))
                    spans.sort(key=lambda x: (x[0], x[2]))
                    named = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in base)
                    counts = [sum(k == x for _, _, k in base) for x in range(3)]
                    out.append((ids[low + r], *counts, hashlib.sha256(named.encode()).hexdigest(), ",".join(f"{n}:{a}:{b}" for a, b, _, n in spans), len(spans) - len(base)))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in _OUT.split(", ")])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, _OUT)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Fit the field, then scan; see fit() and scan()."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return scan(rows, fit(rows))
