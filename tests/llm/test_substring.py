from __future__ import annotations

import hashlib
import random
import re

import pytest

from lodestrata.llm import session, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    starts: dict[tuple, int] = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for p in range(len(w) - 49) if d is not None else ():
            k = tuple(w[p : p + 50])
            starts[k] = min(starts.get(k, d), d)
    out = []
    for d, w in split:
        gone = {q for p in range(len(w) - 49) if d is not None and starts[tuple(w[p : p + 50])] < d for q in range(p, p + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "x y", "日本"]
    some = lambda n: [draw.choice(words) for _ in range(n)]
    passages = [some(draw.randrange(30, 200)) for _ in range(8)] + [["und"] * 120, ["a", "b"] * 70]
    rows = []
    for k in range(120):
        body = []
        for _ in range(draw.randrange(0, 5)):
            p = draw.choice(passages)
            at = draw.randrange(max(1, len(p) - 20))
            body += p[at : at + draw.randrange(10, 150)] if draw.random() < 0.6 else some(draw.randrange(40))
        rows.append((draw.choice([k, k // 2, None]) if k % 9 == 0 else k, draw.choice([" ", "\n", "  \t"]).join(body) if k % 17 else None))
    rows += rows[5:9]
    got = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("shard", [300, 3_000])
def test_hot_and_wide_anchors_are_dealt_to_several_tasks(spark, monkeypatch, shard):
    monkeypatch.setattr(substring, "STREAM_BYTES", 500)
    monkeypatch.setattr(substring, "SHARD_BYTES", shard)
    monkeypatch.setattr(session, "HOT_ROWS", 3)
    rows = [(k, " ".join(f"p{j}" for j in range(k % 3, 70)) + f" tail{k}") for k in range(30)]
    line = " ".join(f"l{j}" for j in range(30))
    rows += [(100 + k, " ".join(f"x{k // 2}-{j}" for j in range(30)) + f" {line} " + " ".join(f"y{k // 2}-{j}" for j in range(30))) for k in range(24)]
    got = substring.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_only_the_automaton_finds_passages():
    passage = " ".join(f"p{j}" for j in range(70))
    book = substring.PhraseBook([(3, passage)])
    body = f"a b {passage} c"
    assert book.locate(5, body) == [(2, 72)] and book.locate(3, body) == []
    import ahocorasick

    book.automaton = ahocorasick.Automaton()
    book.automaton.add_word("another phrase", True)
    book.automaton.make_automaton()
    book.seen.clear()
    assert book.locate(5, body) == []


def test_copies_are_told_by_their_passage_and_not_window_by_window(monkeypatch):
    mark, calls = substring.PhraseBook._mark, []
    monkeypatch.setattr(substring.PhraseBook, "_mark", staticmethod(lambda window: calls.append(window) or mark(window)))
    passages = [" ".join(f"p{j}" for j in range(70)), "a b " * 99 + "a b", " ".join(f"q{j % 7}" for j in range(300))]
    book = substring.PhraseBook([(3 + k, body) for k, body in enumerate(passages)])
    for doc_id in range(40):
        for k, body in enumerate(passages):
            assert book.locate(doc_id, body) == ([(0, body.count(" ") + 1)] if doc_id > 3 + k else [])
    assert not calls
    other = "a b " * 60 + "c"
    assert book.locate(9, other) == [(0, 120)] and len(calls) == 5  # two windows of the passage, three of the other text, each once


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_book_of_passages_that_share_phrases(seed):
    draw = random.Random(seed)
    lines = [[f"w{draw.randrange(30)}" for _ in range(draw.randrange(16, 60))] for _ in range(6)] + [["und"] * 60, ["é", "b"] * 30]
    some = lambda: sum((draw.choice(lines) if draw.random() < 0.7 else [f"x{draw.randrange(9)}"] * draw.randrange(1, 20) for _ in range(3)), [])
    passages = [(draw.randrange(50), some()) for _ in range(40)]
    owners: dict[tuple, int] = {}
    for owner, w in passages:
        for p in range(len(w) - 49):
            owners[tuple(w[p : p + 50])] = min(owner, owners.get(tuple(w[p : p + 50]), owner))
    book = substring.PhraseBook([(owner, " ".join(w)) for owner, w in passages])
    for w in [w for _, w in passages] + [some() for _ in range(60)]:
        for doc_id in (0, 10, 25, 60):
            places = [p for p in range(len(w) - 49) if owners.get(tuple(w[p : p + 50]), doc_id) < doc_id]
            assert book.locate(doc_id, " ".join(w)) == [(a, b + 50) for a, b in substring._stretches(places)]


def test_hard_rows(hard, none):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert sorted((tuple(r) for r in substring.cut_repeats(hard).collect()), key=repr) == brute(rows)
    assert substring.cut_repeats(none).count() == 0
