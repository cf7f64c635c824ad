import hashlib
import json
import random

from pyspark.sql import functions as F

from framefusion.llm import chat

LAYOUTS = [
    ({"role": "user", "text": "hi"}, "turn", [("user", "hi")]),
    ({"role": "user", "text": None}, "turn", [("user", "")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 7}, "messages",
     [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "messages_parts",
     [("user", "a\nb")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, "from_value",
     [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "input": "it", "output": "done"}, "instruction", [("user", "do\n\nit"), ("assistant", "done")]),
    ({"instruction": "do", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "score": 1.5}, "prompt_response", [("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
    ({"unknown": 1}, None, []), ([1, 2], None, []), (None, None, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r) if r is not None else None) for i, (r, _, _) in enumerate(LAYOUTS)] + [(99, "{not json")]
    out = chat.canonical_turns(spark.createDataFrame(rows, "id long, record string"), ["id"], "record").collect()
    for i, (_, layout, turns) in enumerate([*LAYOUTS, (None, None, [])]):
        mine = sorted((r for r in out if r.id == (i if i < len(LAYOUTS) else 99)), key=lambda r: r.position or 0)
        assert mine[0].layout == layout, i
        assert [(r.role, r.text) for r in mine if r.position is not None] == turns, i
    assert len({r.fingerprint for r in out}) > 8


def test_round_trip_and_digests(spark):
    rng = random.Random(2)
    pieces = ["\\", "### ", "</turn>", ": ", "a", "<", "\n", "é", "assistant", ":", "#"]
    rows = [(rng.randint(0, 12), t, rng.choice(["user", "assistant", "a: b", "", None, "x\\"]),
             rng.choice([None, "".join(rng.choices(pieces, k=rng.randint(0, 9)))])) for t in range(300)]
    rows += [rows[0], (None, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_turns(df)
    out = {r.conv_id: r for r in chat.digests(done, "conv_id", [F.col("turn"), F.col("role"), F.col("text")]).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        got = out[conv]
        assert (got.n_turns, got.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in done.collect():
        assert chat.read_back(r.formatted) == [(r.role or "", r.text or "")]
        assert chat.unescaped(r.formatted[r.loss_start:r.loss_end]) == ((r.text or "") if r.role == "assistant" else "")
    assert chat.digests(done.limit(0), "conv_id", [F.col("turn")]).count() == 0
