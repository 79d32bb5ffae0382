import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corelev.llm import tokens as T
from corelev.llm.common import table

TOK = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
TOK.encode_special_tokens = True
PIECES = T.Pieces(T.TOKENIZER, 2)


def ids(t):
    return TOK.encode(t or "", add_special_tokens=False).ids + [0]


def test_whole_table(spark, sf):
    docs = sorted(tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    want, at = [], 0
    for i, t in docs:
        x = np.array(ids(t), "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    got = [tuple(r) for r in T.op7_token_output(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == want


def test_odd_rows_and_keyed_access(spark, odd, none, tmp_path):
    path = str(tmp_path / "x")
    width = T.write_tokens(odd, path, block_tokens=500)
    rows = odd.select("doc_id", "text").collect()
    got = T.read_tokens(spark, path, width).collect()
    want = sorted((str(r["doc_id"]), zlib.crc32(np.array(ids(r["text"]), "<u4").tobytes())) for r in rows)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted([r["doc_id"] for r in got], key=lambda x: (x is not None, x or 0))
    text = {r["doc_id"]: r["text"] for r in rows}
    assert T.lookup(spark, path, width, 11).tolist() == ids(text[11])
    assert T.lookup(spark, path, width, 5, 1) is not None and T.lookup(spark, path, width, 5, 2) is None
    assert T.lookup(spark, path, width, 999) is None
    empty = str(tmp_path / "y")
    assert T.read_tokens(spark, empty, T.write_tokens(none, empty)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", " ", "　", "'s", "9", "é", "<|endoftext|>", ".", "x y", "\x1c"]), max_size=12))
def test_pieces_are_the_whole(parts):
    t = "".join(parts)
    assert np.frombuffer(PIECES.encode([t])[0], "<u2").tolist() == ids(t)[:-1]


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=500))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.uint64)
    h = T.PerfectHash.load(T.PerfectHash.build(k).dump())
    assert sorted(h.slots(k).tolist()) == list(range(len(k)))


def test_special_strings_get_their_ids(spark, tmp_path):
    """The files hold the ids of an unchanged tokenizer, also where a text holds its special strings."""
    plain = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "no such string", "x<|endoftext|><|endoftext|> y z", "<|endoftext"]
    path = str(tmp_path / "s")
    width = T.write_tokens(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), path)
    for i, t in enumerate(texts):
        assert T.lookup(spark, path, width, i).tolist() == plain.encode(t, add_special_tokens=False).ids + [T.END_ID]
    assert 50256 in T.lookup(spark, path, width, 0)
