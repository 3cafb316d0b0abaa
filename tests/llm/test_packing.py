from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodestrata.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces: pd.DataFrame, ids: dict[int, np.ndarray], window: int) -> float:
    """Every id lies in one piece, sequences are gapless and within the window, and short ones have a power of two."""
    for doc_id, own in pieces.sort_values("start").groupby("doc_id"):
        at = 0
        for p in own.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[doc_id])
            assert p.ids_crc32 == zlib.crc32(ids[doc_id][at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(ids[doc_id])
    sizes = []
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all()
        sizes.append(int(own["length"].sum()))
    assert max(sizes) <= window and all(s == window or s & (s - 1) == 0 for s in sizes)
    return sum(sizes) / (len(sizes) * window)


def test_documents_are_packed_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r["doc_id"]: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], dtype=np.uint32) for r in docs.collect()}
    pieces = packing.pack(docs, PATH).toPandas()
    assert set(pieces["doc_id"]) == set(ids)
    assert check(pieces, ids, 2048) > 0.9


def test_ids_are_the_tokenizers():
    draw = random.Random(1)
    parts = [*"abAB.,'!st́éÉ1 2  \n\t|<>-Kİs'd", " ", "　", "\x1c", "\x85", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'ll", "<|"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(3000)]
    words = packing.WordTokens(PATH, most=500)
    tokenizer = Tokenizer.from_file(PATH)
    for text, got in zip(texts, words.encode(pa.array(texts))):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_placement_minimises_the_sum_of_squares():
    draw = np.random.default_rng(3)
    packer = packing.SumOfSquares(16, 1000, 0)
    for k in range(300):
        size = int(draw.integers(1, 16))
        count = np.array([len(x) for x in packer.open] + [0])
        packer._place((k, 0, np.zeros(size, np.uint32), size))
        after = sum(len(x) ** 2 for x in packer.open)
        best = min(
            int((c**2).sum()) for level in range(0, 17 - size) if level == 0 or count[level] for c in [np.array([count[x] - (x == level and level > 0) + (x == level + size and x < 16) for x in range(16)])]
        )
        assert after == best


def test_levels_of_several_tokens_minimise_it_too():
    """Whatever is placed, no other window that is offered (each level's last, or a new one) would have left a lesser sum."""
    draw = np.random.default_rng(4)
    packer = packing.SumOfSquares(2048, 10_000, 0)
    for k in range(2000):
        size = int(draw.integers(1, 2048))
        held, packer.nearly = packer.nearly, None
        if held is not None:
            packer._close(held[1])
        before = [list(x) for x in packer.open]
        packer._place((k, 0, np.zeros(size, np.uint32), size))
        offered = [(-1, 0), *[(level, x[-1][0]) for level, x in enumerate(before) if x]]
        sums = []
        for level, fill in offered:
            if fill + size <= 2048:
                counts = [len(x) for x in before]
                if level >= 0:
                    counts[level] -= 1
                if fill + size <= 2048 - packer.step:
                    counts[(fill + size) // packer.step] += 1
                sums.append(sum(c * c for c in counts))
        assert sum(len(x) ** 2 for x in packer.open) == min(sums)


def test_the_rule_places_nearly_all_tokens_also_in_small_tasks():
    sizes = pd.read_parquet("/root/testdata/sf0.1/documents.parquet", columns=["n_chars"])["n_chars"].to_numpy() // 4 + 1
    for tasks in (1, 8, 32):
        refilled = 0
        for own in np.array_split(sizes, tasks):
            packer = packing.SumOfSquares(2048, 4096, 0)
            for k, n in enumerate(own.tolist()):
                packer.add(k, np.zeros(n, np.uint32))
            packer.finish()
            refilled += packer.refilled
        print(tasks, refilled / sizes.sum())
        assert refilled < 0.2 * sizes.sum()


def test_few_open_windows_and_many_give_whole_sequences():
    draw = np.random.default_rng(5)
    for most in (2, 10_000):
        packer, ids = packing.SumOfSquares(64, most, 0), {}
        for k in range(500):
            ids[k] = draw.integers(0, 9999, int(draw.integers(1, 200))).astype(np.uint32)
            packer.add(k, ids[k])
        packer.finish()
        assert check(packer.take().to_pandas(), ids, 64) > 0.95


def test_hard_rows(hard, none):
    pieces = packing.pack(hard, PATH).toPandas()
    assert len(pieces[pieces["doc_id"] == 2]) == 1 and (pieces[pieces["doc_id"] == 3]["doc_tokens"] == 1).all()
    assert len(pieces[(pieces["doc_id"] == 6) & (pieces["start"] == 0)]) == 2 and pieces["doc_id"].isna().sum() >= 2
    assert packing.pack(none, PATH).count() == 0
