from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np

from lodestrata.llm import crf, secret_scan
from lodestrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op6_secret_scan"](spark, SF).collect():
        spans = base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(spans.count(k + ":") for k in ("assign", "access", "hex"))
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("crf")) == spans


def test_the_field_finds_forms_the_patterns_lack_and_spares_plain_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    field = secret_scan.fit(docs)
    draw = np.random.default_rng(99)
    rows, kinds = [], {}
    plain = [r["text"] for r in docs.where("doc_id between 500 and 700").collect() if not base(r["text"])]
    for k, text in enumerate(plain):
        before, secret, after = secret_scan._secrets(draw)
        at = text.rfind(" ", 0, len(text) // 2) + 1
        rows.append((k, text[:at] + f"{before}{secret}{after} " + text[at:] if k % 2 else text))
        kinds[k] = (at + len(before), at + len(before) + len(secret)) if k % 2 else None
    hit = false = made = 0
    for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), field).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x]
        if kinds[r["doc_id"]]:
            made += 1
            hit += any(a < kinds[r["doc_id"]][1] and kinds[r["doc_id"]][0] < b for a, b in spans)
        else:
            false += bool(spans)
    assert made > 60 and hit / made > 0.85 and false / (len(rows) - made) < 0.05


def test_viterbi_and_forward_backward_against_enumeration():
    draw = np.random.default_rng(2)
    for n in (1, 2, 5):
        scores, moves = draw.normal(size=(n, 3)).astype(np.float32), draw.normal(size=(3, 3)).astype(np.float32)
        paths = list(itertools.product(range(3), repeat=n))
        weight = lambda p: sum(scores[k, t] for k, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))
        best = max(paths, key=lambda p: weight(p) + moves[0, p[0]] + moves[p[-1], 0])
        assert tuple(crf.viterbi(scores, moves, 0, 0)) == best
        total = sum(np.exp(weight(p)) for p in paths)
        exact = [[sum(np.exp(weight(p)) for p in paths if p[k] == t) / total for t in range(3)] for k in range(n)]
        found, _ = crf.forward_backward(scores, moves, crf.chains(np.array([0, n]), 100)[0])
        assert np.allclose(found, exact, atol=1e-4)


def test_messages_are_carried_over_cuts():
    draw = np.random.default_rng(8)
    first = np.cumsum([0, 7, 0, 1, 12, 3, 40])
    scores, moves = draw.normal(size=(first[-1], 4)).astype(np.float32), 2 * draw.normal(size=(4, 4)).astype(np.float32)
    whole, _ = crf.forward_backward(scores, moves, crf.chains(first, 100)[0])
    for most in (1, 3, 5, 40):
        rows, before = crf.chains(first, most)
        assert np.allclose(crf.forward_backward(scores, moves, rows, before=before)[0], whole, atol=1e-4)


def test_secrets_of_forms_that_were_never_made_up(spark):
    """Forms that fit() doesn't make: other prefixes, alphabets and surroundings. A fixed pattern may match a part, but must not be what counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    draw = np.random.default_rng(17)
    some = lambda alphabet, n: "".join(draw.choice(list(alphabet), n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    forms = [
        lambda: ("", "eyJ" + some(lower + upper + digits, 30) + "." + some(lower + upper + digits + "-_", 60)), lambda: ("AccountKey=", some(lower + upper + digits + "+/", 86) + "=="),
        lambda: ("", "SG." + some(lower + upper + digits, 22) + "." + some(lower + upper + digits, 43)), lambda: ("pin code ", some(upper + digits, 32)),
        lambda: ("", "AIza" + some(lower + upper + digits + "-_", 35)), lambda: ("export X=", "pk_test_" + some(lower + upper + digits, 24)),
    ]
    plain = [r["text"] for r in docs.where("doc_id between 700 and 900").collect() if not base(r["text"])]
    rows, placed = [], {}
    for k, text in enumerate(plain):
        before, secret = forms[k % len(forms)]()
        at = text.rfind(" ", 0, len(text) // 2) + 1
        rows.append((k, f"{text[:at]}{before}{secret} {text[at:]}"))
        placed[k] = (at + len(before), at + len(before) + len(secret))
    found = [set() for _ in forms]
    for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), secret_scan.fit(docs)).collect():
        a, b = placed[r["doc_id"]]
        spans = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("crf")]
        found[r["doc_id"] % len(forms)].add((r["doc_id"], any(x < b and a < y for x, y in spans)))
    recall = [sum(hit for _, hit in f) / len(f) for f in found]
    print("recall by form", [round(x, 2) for x in recall])
    assert np.mean(recall) > 0.7


def test_cutting_at_sure_tokens_keeps_the_best_path(spark):
    import pyarrow as pa

    draw = np.random.default_rng(4)
    texts = ["token = abc123 DEF! ghi 0xFFee99 a b c", "", "x", "one two three four five six"]
    tokens = secret_scan.Tokens(pa.array(texts))
    for _ in range(20):
        weights, moves = draw.normal(size=(int(secret_scan._STARTS[-1]), 3)).astype(np.float32), draw.normal(size=(3, 3)).astype(np.float32)
        scores = weights[tokens.features()].sum(axis=1)
        whole = np.concatenate([crf.viterbi(scores[a:b], moves, 0, 0) for a, b in zip(tokens.first[:-1], tokens.first[1:]) if b > a])
        got = secret_scan.decode(tokens, weights, moves)
        assert np.array_equal(got, whole)


def test_hard_rows(hard, none):
    assert secret_scan.find_secrets(hard).count() == hard.count()
    assert secret_scan.find_secrets(none).count() == 0
