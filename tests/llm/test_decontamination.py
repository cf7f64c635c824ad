import random

from pyspark.sql import functions as F

from framefusion.llm import decontamination as dc


def test_templates_keep_one_token_for_one(spark):
    text = "In 1999, Alice Smith paid $3.50 for 5 kg of apples - and 12km walk, two miles. The End's"
    row = spark.createDataFrame([(text,)], "text string").select(
        dc.raw_tokens(F.col("text")).alias("raw"), dc.template_tokens(F.col("text")).alias("made")).first()
    n, p, u = dc.NUM, dc.NAME, dc.UNIT
    assert row.raw[:6] == ["In", "1999,", "Alice", "Smith", "paid", "$3.50"] and len(row.raw) == len(row.made)
    assert row.made == ["in", n, p, p, "paid", n, "for", n, u, "of", "apples", "and", n + u, "walk", n, u, "the", p + "s"]


def brute(docs, items):
    """Items of plain words only: share of the 8-word windows found in the document."""
    out = set()
    for doc, text in docs:
        words = [w.strip(".,").lower() for w in (text or "").split()]
        for item, it in items:
            mine = [w.strip(".,").lower() for w in it.split()]
            if len(mine) < 4:
                continue
            k = min(8, len(mine))
            have = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
            wins = [tuple(mine[i:i + k]) for i in range(len(mine) - k + 1)]
            if sum(w in have for w in wins) >= 0.3 * len(wins):
                out.add((doc, item))
    return out


def test_copied_passages_equal_brute_force(spark):
    rng = random.Random(4)
    words = [a + b + c for a in "bdfg" for b in "aeio" for c in "lmnr"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ","]) for _ in range(n))

    items = [(i, prose(rng.choice([3, 5, 7, 9, 20, 45]))) for i in range(40)]
    docs = [(d, prose(rng.randint(0, 120))) for d in range(100)]
    for d in range(100, 160):
        i, text = rng.choice(items)
        part = text.split()
        part = part[:rng.randint(1, len(part))]
        docs.append((d, f"{prose(30)} {' '.join(part).upper()} {prose(30)}"))
    docs += [docs[120], (None, None), (500, "")]
    found = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == brute(docs, items) and len(got) > 10


def test_slots_must_be_consistent(spark):
    item = "Alice has 3 apples and Bob gives Alice 4 more apples so how many apples does Alice have in 3 days"
    docs = [(1, "Well then Carol has 7 apples and Dan gives Carol 9 more apples so how many apples does Carol have in 7 days ok"),
            (2, "Well then Carol has 7 apples and Dan gives Carol 9 more apples so how many apples does Carol have in 8 days ok"),
            (3, "x " + item), (4, "nothing to see in this text at all")]
    df = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item, 5)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r.changed_slots for r in dc.leaks(df, bench).collect()}
    assert got == {1: 4, 3: 0}
    kept = dc.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4]
    assert dc.leaks(df.limit(0), bench).count() == 0 and dc.leaks(df, bench.limit(0)).count() == 0
    assert dc.without_leaks(df, bench.limit(0)).count() == 4


def leaked(spark, docs, items):
    found = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.doc_id, r.item_id) for r in found.collect())


def test_one_altered_value_leaves_the_copied_windows(spark):
    item = ("the old mill by the river was built in 1999 and the miller who lived there with a large family sold it again in 1999 to "
            "a baker from the town who wanted to live near the water")
    docs = [(1, "x " + item), (2, "x " + item[::-1].replace("9991", "8991", 1)[::-1]), (3, "the old mill was built in 1999")]
    assert leaked(spark, docs, [(1, item)]) == [(1, 1), (2, 1)]


def test_names_at_sentence_starts_short_and_numeric_items(spark):
    items = [(1, "Alice has 3 apples. Alice buys 4 more pears. Alice eats 2 of them."), (2, "Lima is the capital of Peru"),
             (3, "12 7 1999 4.5 88 3 41 20 6 17"), (4, "Anna Berta Carla Dora Emil")]
    docs = [(1, "so Carol has 7 apples. Carol buys 9 more pears. Carol eats 5 of them."), (2, "they say Lima is the capital of Peru ok"),
            (3, "see 12 7 1999 4.5 88 3 41 20 6 17 there"), (4, "with Anna Berta Carla Dora Emil"), (5, "see 12 7 1999 4.6 88 3 42 20 6 17")]
    assert leaked(spark, docs, items) == [(1, 1), (2, 2), (3, 3), (4, 4)]
