import random
import re

from framefusion.llm import licenses as lc


def words(text):
    return re.findall(r"[A-Za-z0-9_]+", (text or "").lower())


def grams(ws):
    return [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [tuple(ws)] if ws else []


def brute(rows):
    out = set()
    for d, text in rows:
        mine = grams(words(text))
        for t, (_, template) in enumerate(lc.TEMPLATES):
            theirs = grams(words(template))
            n, own = len(theirs), set(theirs)
            for at in range(max(1, len(mine) - n + 1)):
                if len(own & set(mine[at:at + n])) / len(own) >= lc.CONTAINED:
                    out.add((d, t))
    return out


def test_matches_equal_brute_force(spark):
    rng = random.Random(8)
    pool = ["alpha", "beta", "license", "the", "of", "software", "under", "work", "is"]

    def prose(n):
        return " ".join(rng.choices(pool, k=n))

    rows = [(i, prose(rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 140):
        text = rng.choice(lc.TEMPLATES)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(pool)
        rows.append((i, f"{prose(rng.randint(0, 40))}\n{' '.join(text).upper() if i % 2 else ' '.join(text)} {prose(rng.randint(0, 40))}"))
    rows += [rows[60], (None, None), (500, ""), (501, "mit"), (502, ("x " * 5_000) + lc.TEMPLATES[0][1])]
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, license string")
    out = lc.scan_licenses(df).collect()
    assert {(r.doc_id, r.template) for r in out} == brute(rows)
    whole = {d: t for d, t in rows}
    for r in out:
        covered = set(grams(words(whole[r.doc_id][r.start:r.end])))
        own = set(grams(words(lc.TEMPLATES[r.template][1])))
        assert abs(len(covered & own) / len(own) - r.containment) < 1e-9
    assert lc.scan_licenses(df.limit(0)).count() == 0
