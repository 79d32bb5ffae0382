import collections
import hashlib

from corelev.llm import chat as C
from corelev.llm.common import table


def brute(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    out = {}
    for c, ts in convs.items():
        ts = [(t[3], t[5]) for t in sorted(ts)]
        loss = "".join(x for r, x in ts if r == "assistant")
        esc = lambda s: "".join("\\" * (c in "\\<[]") + c for c in s)
        chars = sum(len(f"<s>[{esc(r)}] {esc(x)}</s>\n") for r, x in ts)
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in df.collect()}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert got(C.op6_chat_formatting(spark, sf)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", "<s>[x] y</s>\n"), (1, 0, "assistant", "<s>[x] y</s>\n"), (1, 2, "a]] <b\\", "\\\\<\\]é"),
            (None, 1, "user", ""), (None, 1, "user", None), (2, 5, "assistant", "z" * 300_000), (2, 5, "assistant", "\\")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    turns = C.format_turns(df)
    assert got(C.read_back(turns)) == brute(rows)
    assert C.read_back(C.format_turns(df.limit(0))).count() == 0
