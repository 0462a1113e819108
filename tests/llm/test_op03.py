import json

import duckdb
from pyspark.sql import functions as F

from gridmark.llm import op03_chat as op

HARD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "a<", "|b", "\\", "<|", "<|im_end|>\n", "\n\n", "", "%25 %0A", "é😀<|é", "$1 \\1"]


def test_reading_back_is_exact(spark):
    turns = [(i, j, r, t) for i, (r, t) in enumerate((r, t) for r in ["user", "assistant", "odd\nrole%0A", "<|im_start|>"] for t in HARD) for j in (0, 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = op.format_turns(op.canonical_turns(df))
    out = out.select("conv_id", "turns", op.read_turns(F.col("formatted")).alias("back"), op.read_learnt(F.col("formatted"), F.col("loss_mask")).alias("learnt"), "formatted", "loss_mask").collect()
    assert len(out) == len(turns) // 2
    for r in out:
        assert r.back == r.turns
        assert r.learnt == [t.text for t in r.turns if t.role == "assistant"]
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == 2
        at, masked = 0, []
        for x in r.loss_mask:
            if x.learnt:
                masked.append(r.formatted[at : at + x.length])
            at += x.length
        assert at == len(r.formatted)
        assert len(masked) == len(r.learnt)


def test_layouts(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        "system and messages": {"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "instruction": {"instruction": "q", "output": "a"},
        "instruction with input": {"instruction": "q", "input": "", "output": "a"},
        "prompt and completion": {"completion": "a", "prompt": "q"},
        "system, prompt and response": {"system": None, "response": "a", "prompt": "q"},
        "question and answer": {"question": "q", "answer": 5},
    }
    rows = [(json.dumps(v), k) for k, v in records.items()] + [("{}", None), ("no json", None), (None, None), ('{"a": {"b": 1}}', None), ('{"messages": 3}', None)]
    df = spark.createDataFrame(rows, "record string, layout_wanted string")
    out = {r.record: r for r in op.canonical_turns(df, "record").collect()}
    assert all(out[r].layout == k and (out[r].turns is None) == (k is None) for r, k in rows)
    said = {k: [(t.role, t.text) for t in out[json.dumps(v)].turns] for k, v in records.items()}
    assert said["messages"] == said["conversations"] == said["instruction"] == said["instruction with input"] == said["prompt and completion"] == [("user", "q"), ("assistant", "a")]
    assert said["system and messages"] == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert said["system, prompt and response"] == [("system", ""), ("user", "q"), ("assistant", "a")]
    assert said["question and answer"] == [("user", "q"), ("assistant", "5")]
    flat = spark.createDataFrame([("a", "q", 1)], "completion string, prompt string, turns int").drop("turns")
    assert op.canonical_turns(flat).first().layout == "prompt and completion"


def test_query_equals_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = op.op3_chat(spark, sf)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(op.OP3_SQL).fetchall()
    cols = [d[0] for d in con.description]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
    odd = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "y"), (2, None, "assistant", "<|z"), (2, 0, "assistant", "long é" * 50_000), (2, 0, "a%\n", "<\\|")]
    path = str(tmp_path)
    spark.createDataFrame([(*r, 1) for r in odd], "conv_id long, turn long, role string, text string, layout int").write.parquet(path + "/conversations.parquet")
    con.execute(f"create or replace view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, op.op3_chat(spark, path).select(*cols).collect()), key=key) == sorted(con.execute(op.OP3_SQL).fetchall(), key=key)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(path + "/e/conversations.parquet")
    assert op.op3_chat(spark, path + "/e").count() == 1
