"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Only built-in DataFrame functions are used. The patterns' matches are the protected entities. Which words stand near an
entity, and in how many documents, against how many documents hold the word at all, says how much of the entity's
information the word discloses: PMI(entity; word) = log(N co / (df(entity) df(word))), of at most IC(entity) = log(N / df(entity)).
A word whose PMI reaches `share` of the entity's IC, and which meets it too often for an accident (Chernoff's bound is at
most `chance`), is a disclosing term, however few documents hold the entity. In documents with that entity the term is generalised to a label, and
removed where it discloses everything (it occurs beside the entity only).

Near are the `near` words of `shortest` letters or more before a match and as many after it, in the whole text; matches of the same kind
in between are stepped over.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import join_ones, table

KINDS = ("email", "ip", "card", "phone")
# In Java's syntax. Possessive repeats and the look-behind (or the end of the last match) keep long runs from being tried at each of
# their characters; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SHARE, CHANCE, NEAR, SHORTEST = 0.9, 0.001, 5, 3
_LETTERS = r"\p{L}+"
_STEP, _BLOCK = 64, 1024
_CLOSE = 1e-9  # logarithms are compared to within this


def _valid(kind: str, match: str) -> str:
    digits = f"regexp_replace({match}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"{match} RLIKE r'^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\\.|$)){{4}}$'",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND luhn_check({digits})",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }[kind]


# Higher-order expressions are written as SQL text: one call to the parser, where the functions of pyspark take one for each node.


def _bound(value: str, name: str, inner: str) -> str:
    """`inner` with `name` standing for the value, which is worked out once, however often it is named, also within lambdas."""
    return f"get(transform(array({value}), {name} -> {inner}), 0)"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0, (acc, e) -> acc + e)"


def _most(values: str) -> str:
    return f"coalesce(array_max({values}), 0)"


def _before(values: str, total: Callable[[str], str] = _sum, both: str = "{0} + {1}") -> str:
    """The total of the elements before each, by steps of _STEP elements, so that long arrays don't cost their square."""
    steps = f"transform(sequence(0, CAST(floor((size(va) - 1) / {_STEP}) AS INT)), vk -> slice(va, vk * {_STEP} + 1, {_STEP}))"
    begun = f"transform(vt, (vx, vk) -> {total('slice(vt, 1, vk)')})"
    inner = f"flatten(zip_with(vs, {begun}, (vx, vp) -> transform(vx, (vy, vj) -> {both.format('vp', total('slice(vx, 1, vj)'))})))"
    placed = _bound(steps, "vs", _bound(f"transform(vs, vx -> {total('vx')})", "vt", inner))
    return _bound(values, "va", f"CASE WHEN size(va) > 0 THEN {placed} ELSE CAST(array() AS ARRAY<INT>) END")


def _placed(rows: DataFrame, pattern: str, where: str, out: str, keep: str, text: str = "text") -> DataFrame:
    """Add `out`: start, end and value of each match of the pattern that `keep`, an expression on x.value, keeps, and its number among all matches."""
    m, b = f"_{out}_m", f"_{out}_b"
    rows = rows.withColumn(m, F.expr(f"CASE WHEN {where} THEN regexp_extract_all({text}, {pattern}, 0) ELSE CAST(array() AS ARRAY<STRING>) END"))
    begun = _before(f"transform({m}, (x, k) -> length(x) + get(between, k))")
    starts = _bound(f"transform(split({text}, {pattern}, -1), x -> length(x))", "between", f"zip_with({begun}, slice(between, 1, size({m})), (a, x) -> a + x)")
    rows = rows.withColumn(b, F.expr(f"CASE WHEN size({m}) > 0 THEN {starts} END"))
    found = f"transform({m}, (x, k) -> named_struct('start', get({b}, k), 'end', get({b}, k) + length(x), 'value', x, 'nth', k))"
    return rows.withColumn(out, F.expr(f"filter({found}, x -> {keep})")).drop(m, b)


def _quoted(pattern: str) -> str:
    return f"r'{pattern}'"


# Cheap tests that must hold where a kind occurs at all.
_CONDITIONS = {"email": "contains(text, '@')", "ip": "text RLIKE '[0-9]'", "card": "text RLIKE '[0-9]'", "phone": "contains(text, '+')"}


def entities(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with rid, a number of the row, and each kind's valid matches as an array column."""
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("rid", F.monotonically_increasing_id())
    for kind, where in _CONDITIONS.items():
        rows = _placed(rows, _quoted(PATTERNS[kind]), where, kind, _valid(kind, "x.value"))
    return rows


def _names(kind: str) -> str:
    return f"transform({kind}, x -> concat('{kind}:', lower(x.value)))"


def _near(kind: str, near: int, shortest: int) -> str:
    """Each match's entity and the words (of letters only, lower-case) nearest to it."""
    pieces = f"transform(split(text, {_quoted(PATTERNS[kind])}, -1), p -> regexp_extract_all(lower(p), r'\\p{{L}}{{{shortest},}}', 0))"
    beside = f"array_distinct(concat(slice(words, greatest(n - {near - 1}, 1), least(n, {near})), slice(words, n + 1, {near})))"
    told = f"transform({kind}, x -> named_struct('entity', concat('{kind}:', lower(x.value)), 'words', {_bound('get(upto, x.nth)', 'n', beside)}))"
    sizes = "transform(pieces, x -> size(x))"
    upto = f"zip_with({_before(sizes)}, {sizes}, (a, x) -> a + x)"  # words before the end of each piece
    found = _bound(pieces, "pieces", _bound("flatten(pieces)", "words", _bound(upto, "upto", told)))
    return f"CASE WHEN size({kind}) > 0 THEN {found} ELSE CAST(array() AS ARRAY<STRUCT<entity: STRING, words: ARRAY<STRING>>>) END"


def disclosing(found: DataFrame, docs: DataFrame, share: float = SHARE, chance: float = CHANCE, near: int = NEAR, shortest: int = SHORTEST) -> DataFrame:
    """(entity, term, whole): terms that disclose `share` of an entity's information; whole: all of it.

    An entity in a single document is judged like any other. Counts are of documents, over all of `docs`. Only partial aggregates and joins by
    entity or term, so that an entity or a term in a third of all documents is one row a task.
    """
    contexts = found.select("rid", F.explode(F.expr(f"concat({', '.join(_near(k, near, shortest) for k in KINDS)})")).alias("x")).select("rid", "x.entity", "x.words")
    seen = table(contexts, "contexts")
    pairs = seen.select("rid", "entity", F.explode("words").alias("term")).distinct()
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("co"))
    rows = seen.select("rid", "entity").distinct().groupBy("entity").agg(F.count("*").alias("df_entity"))
    total = docs.count()

    def reaches(df_term: str) -> Column:
        information = F.log(F.lit(float(total)) / F.col("df_entity"))
        mutual = F.log(F.lit(float(total)) * F.col("co") / (F.col("df_entity").cast("double") * F.col(df_term)))
        # Of the entity's documents, those without the term; none: no further evidence.
        rest = (F.col("df_entity") - F.col("co")) * (F.log((F.col("df_entity") - F.col("co")) * float(total)) - F.log(F.col("df_entity") * (F.lit(float(total)) - F.col(df_term))))
        return (mutual >= share * information - _CLOSE) & (F.col("co") * mutual + F.coalesce(rest, F.lit(0.0)) >= math.log(1 / chance) - _CLOSE)

    # A word is in as many documents as it is beside entities in, at least. What fails by that count fails by the true one,
    # so common words need not be counted in all texts.
    beside = pairs.select("rid", "term").distinct().groupBy("term").agg(F.count("*").alias("df_beside"))
    candidates = table(together.join(rows, "entity").join(beside, "term").where((F.col("df_entity") < total) & reaches("df_beside")), "terms")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(_LETTERS), F.lit(0)))).alias("term"))
    counted = join_ones(words, candidates.select("term").distinct(), "term", F.octet_length("term") + 16, count_as="df_term")
    judged = candidates.join(counted, "term").where(reaches("df_term"))
    return judged.select("entity", "term", (F.col("co") == F.col("df_term")).alias("whole"))


def _told(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(rid, terms, wholes): the disclosing terms of the entities that each document holds."""
    held = found.select("rid", F.explode(F.expr(f"concat({', '.join(map(_names, KINDS))})")).alias("entity")).distinct()
    by_entity = terms.groupBy("entity").agg(F.collect_list(F.struct("term", "whole")).alias("terms"))
    told = join_ones(held, by_entity, "entity", F.octet_length("entity") + F.size("terms") * 48)
    each = told.select("rid", F.explode("terms").alias("x")).groupBy("rid").agg(F.collect_set("x.term").alias("terms"), F.collect_set(F.when(F.col("x.whole"), F.col("x.term"))).alias("wholes"))
    return table(each, "told")


def _any() -> Column:
    return sum((F.size(k) for k in KINDS), F.lit(0)) > 0


def _with_terms(found: DataFrame, told: DataFrame) -> DataFrame:
    """The rows that hold an entity, with the places of their disclosing terms as `term`.

    Rows meet `told` where they are if it is small enough to broadcast; otherwise they are dealt by rid, so that few long texts
    don't end in one task.
    """
    rich = join_ones(found.where(_any()), told, "rid", F.size("terms") * 48 + 32, how="left")
    rich = rich.withColumn("low", F.when(F.size("terms") > 0, F.lower("text")))
    # A term is placed by the lower-case text where that has as many characters; where lower-casing changes their number, in the text itself.
    rich = rich.withColumn("words_in", F.when(F.length("low") == F.length("text"), F.col("low")).otherwise(F.col("text")))
    rich = rich.withColumn("either", F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(r")(?!\p{L})")))
    return _placed(rich, "either", "size(terms) > 0", "term", "true", "words_in").drop("low", "words_in", "either")


def find(docs: DataFrame, share: float = SHARE, chance: float = CHANCE, near: int = NEAR, shortest: int = SHORTEST) -> DataFrame:
    """Personal data of every document, its whole text read.

    One row per row of `docs` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. Spans of
    disclosing terms have the kind `term` and follow those of the patterns. Null text is empty; an empty table gives no
    rows; repeated rows are searched each, and count as documents of their own; other columns are ignored. The other parameters are those of disclosing().
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = entities(rows)
    found = table(found.withColumn("text", F.when(_any(), F.col("text"))), "entities")
    rich = _with_terms(found, _told(found.where(_any()), disclosing(found.where(_any()), rows, share, chance, near, shortest)))
    poor = found.where(~_any()).withColumn("term", F.array().cast(rich.schema["term"].dataType))
    columns = ["doc_id", *KINDS, "term"]
    return _digest(rich.select(columns).unionByName(poor.select(columns)))


def _digest(rows: DataFrame) -> DataFrame:
    order = (*KINDS, "term")

    def shown(kinds: tuple[str, ...]) -> Column:
        spans = ", ".join(f"transform({k}, x -> named_struct('start', x.start, 'kind', {order.index(k)}, 'end', x.end))" for k in kinds)
        names = ", ".join(f"'{k}'" for k in order)
        return F.expr(f"array_join(transform(array_sort(concat({spans})), x -> concat_ws(':', get(array({names}), x.kind), CAST(x.start AS STRING), CAST(x.end AS STRING))), ',')")

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(shown(KINDS), 256).alias("base_sha256"), shown(order).alias("spans"))


def _cut(spans: str) -> str:
    """The text with each run of overlapping spans (start, kind, end, label; sorted) replaced by one label."""

    def piece(a: str, b: str) -> str:
        first = f"CAST(floor({a} / {_BLOCK}) AS INT)"
        near = f"array_join(slice(blocks, {first} + 1, CAST(floor({b} / {_BLOCK}) AS INT) - {first} + 1), '')"
        return f"substring({near}, {a} - {first} * {_BLOCK} + 1, {b} - {a})"

    # A term that runs into a match of a pattern is part of that match's label.
    label = f"CASE WHEN x.kind = {len(KINDS)} AND coalesce(get(spans, k + 1).start < x.end, false) THEN get(spans, k + 1).label ELSE x.label END"
    put = f"CASE WHEN x.start >= get(reach, k) THEN concat({piece('get(reach, k)', 'x.start')}, {label}) ELSE '' END"
    last = _bound("array_max(transform(spans, x -> x.end))", "a", piece("a", "length(text)"))
    whole = f"concat(array_join(transform(spans, (x, k) -> {put}), ''), {last})"
    reach = _before("transform(spans, x -> x.end)", _most, "greatest({0}, {1})")
    return _bound(f"regexp_extract_all(text, r'(?s).{{1,{_BLOCK}}}', 0)", "blocks", _bound(spans, "spans", _bound(reach, "reach", whole)))


def sanitise(docs: DataFrame, share: float = SHARE, chance: float = CHANCE, near: int = NEAR, shortest: int = SHORTEST) -> DataFrame:
    """The same rows and columns with personal data out of the text: matches as [EMAIL], [IP], [CARD] or [PHONE], disclosing
    terms as [TERM], or removed where they disclose an entity wholly. n_chars, if there, is the changed texts' new length.

    Matches and terms are found and cut by their places in the text as it was; what the patterns match in the cut text is masked too. Null text stays
    null. Rows without personal data are passed on as they are. The other parameters are those of disclosing().
    """
    columns = docs.columns
    # The other columns travel as one struct, so that none of their names can clash with those made here.
    row = F.struct(F.lit(0).alias("_"), *[docs[c] for c in columns if c != "text"]).alias("row")
    found = table(entities(docs.select(row, docs["text"], docs["text"].isNull().alias("empty"))), "entities")
    rich = _with_terms(found, _told(found.where(_any()), disclosing(found.where(_any()), docs, share, chance, near, shortest)))
    labels = {k: f"'[{k.upper()}]'" for k in KINDS} | {"term": "CASE WHEN array_contains(wholes, lower(x.value)) THEN '' ELSE '[TERM]' END"}
    every = ", ".join(f"transform({k}, x -> named_struct('start', x.start, 'kind', {n}, 'end', x.end, 'label', {label}))" for n, (k, label) in enumerate(labels.items()))
    # Written in between: as one, these nested expressions take the optimiser very long.
    rich = table(rich.select("row", "text", F.expr(f"array_sort(concat({every}))").alias("spans")), "spans")
    rich = table(rich.select("row", F.expr(_cut("spans")).alias("text")), "cut")
    for kind, where in _CONDITIONS.items():
        rich = _masked(rich, kind, where)
    poor = found.where(~_any()).withColumn("text", F.when(~F.col("empty"), F.col("text")))
    restored = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns]
    counted = [F.length("text").cast("long").alias(c) if c == "n_chars" else x for c, x in zip(columns, restored)]
    return rich.select(counted).unionByName(poor.select(restored))


def _masked(rows: DataFrame, kind: str, where: str) -> DataFrame:
    """Put the kind's label for each of its valid matches."""
    pattern = _quoted(PATTERNS[kind])
    rows = rows.withColumn("_m", F.expr(f"CASE WHEN {where} THEN regexp_extract_all(text, {pattern}, 0) END")).withColumn("_p", F.expr(f"CASE WHEN size(_m) > 0 THEN split(text, {pattern}, -1) END"))
    put = f"zip_with(_p, _m, (p, m) -> concat(p, CASE WHEN m IS NULL THEN '' WHEN {_valid(kind, 'm')} THEN '[{kind.upper()}]' ELSE m END))"
    return rows.withColumn("text", F.expr(f"CASE WHEN size(_m) > 0 THEN array_join({put}, '') ELSE text END")).drop("_m", "_p")
