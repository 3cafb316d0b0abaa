from __future__ import annotations

import random
import re

from lodestrata.llm import decontaminate as d

WORDS = [f"w{k}" for k in range(300)]


def test_substitutions_are_tolerated_and_clean_documents_left(spark):
    draw = random.Random(5)
    items = [[draw.choice(WORDS) for _ in range(n)] for n in (12, 16, 20, 40, 80)]
    docs, planted = [], set()
    for k in range(120):
        body = [draw.choice(WORDS) for _ in range(draw.randrange(5, 120))]
        if k % 3 == 0:
            number = draw.randrange(len(items))
            copy = list(items[number])
            for at in draw.sample(range(len(copy)), len(copy) // 10):
                copy[at] = "changed"
            cut = draw.randrange(len(body))
            body[cut:cut] = copy
            planted.add((k, number))
        docs.append((k, draw.choice([" ", "\n", ", "]).join(body).upper()))
    found = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == planted


def test_blocks_of_items_change_nothing(spark):
    docs = spark.createDataFrame([(k, " ".join(WORDS[k : k + 30])) for k in range(0, 200, 20)], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(WORDS[k : k + 25])) for k in range(0, 250, 25)], "item_id long, text string")
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    assert rows(d.contaminated(docs, items)) == rows(d.contaminated(docs, items, block_words=60)) != []


def test_hard_rows(spark, hard, none):
    items = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "lorem ipsum dolor " * 6, "x"), (3, "the and of", "x")], "item_id long, text string, doc_id string")
    got = d.contaminated(hard, items).collect()
    assert [(r["doc_id"], r["item_id"], r["agreed"]) for r in got] == [(5, None, 18)]
    assert d.contaminated(none, items).count() == d.contaminated(hard, items.limit(0)).count() == 0
    kept = d.clean(hard, items)
    assert kept.columns == hard.columns and kept.count() == hard.count() - 1 and kept.where("doc_id = 5").count() == 0


def test_no_python_in_the_plan(spark, hard):
    items = spark.createDataFrame([(1, "lorem ipsum dolor " * 6)], "item_id long, text string")
    plan = d.contaminated(hard, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clean_rows_stay_beside_a_leaking_one_of_the_same_id(spark):
    leak, fine = " ".join(WORDS[:30]), " ".join(WORDS[100:130])
    docs = spark.createDataFrame([(None, leak), (None, fine), (None, None), (1, leak), (1, fine), (2, fine)], "doc_id long, text string")
    kept = d.clean(docs, spark.createDataFrame([(1, leak)], "item_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, fine), (None, None), (1, fine), (2, fine)], key=repr)


def test_items_of_every_length_are_found_with_as_many_words_changed_as_count(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from compare import connect, same

    from lodestrata.llm.queries import ORACLES

    draw = random.Random(9)
    items, docs, planted = [], [], {}
    for n in range(1, 25):
        for k in range(12):
            number = 100 * n + k
            item = [f"x{number}x{j}" for j in range(n)]
            changed = 0 if n < 10 else n - -(-n * 4 // 5) if n < 20 else 4
            copy = list(item)
            for at in draw.sample(range(min(n, 20)), changed):
                copy[at] = "changed"
            items.append((number, " ".join(item)))
            docs.append((number, " ".join([*draw.choices(WORDS, k=15), *copy, *draw.choices(WORDS, k=15)])))
            planted[number] = n
    columns = lambda rows, key: pa.table({key: [r[0] for r in rows], "text": [r[1] for r in rows]})
    con = connect("/root/testdata/sf0.001")
    for name, table in (("documents", columns(docs, "doc_id")), ("benchmark", columns(items, "item_id"))):
        pq.write_table(table, tmp_path / f"{name}.parquet")
        con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = d.contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    pairs = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert all(a == b for a, b in pairs)
    recall = {n: sum((k, k) in pairs for k, m in planted.items() if m == n) / 12 for n in range(1, 25)}
    assert all(recall[n] == (n >= 5) for n in range(1, 15)) and all(recall[n] >= 0.9 for n in range(15, 25))
    same(found, con, ORACLES["op1_benchmark_decontamination"])
