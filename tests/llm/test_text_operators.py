from __future__ import annotations

import random
from itertools import chain

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm.packing import BLOCK_ITEMS, Packer, pack_containers
from strandloom.llm.tokens import DEFAULT_VOCABULARY, Transducer, Utf8Machine, count_tokens, decode_ids, encode_texts, sufficient_lookahead


@pytest.fixture(scope="module")
def ours():
    with open(DEFAULT_VOCABULARY, encoding="utf-8") as f:
        return Transducer(f.read())


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def ids(t, x):
    return list(t.encode(x))


def test_every_code_point(ours, theirs):
    for start in range(0, 0x110000, 0x4000):
        x = "".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}\n" for c in range(start, start + 0x4000) if not 0xD800 <= c < 0xE000)
        if x and (start < 0x34000 or start >= 0xE0000):
            assert ids(ours, x) == theirs(x)


def test_any_text(ours, theirs):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80) | st.text(alphabet="ab'sdt \n\r\t1.é中", max_size=200))
    def check(x):
        got = ids(ours, x)
        assert got == theirs(x) and "".join(ours.decode(got)) == x

    check()


def test_long_pieces_stream_in_windows(ours, theirs):
    rng = random.Random(8)
    words = [b.decode() for b in ours.bytes_of.values() if b.isalpha()]
    for n, alphabet in ((9000, "ab"), (20000, "ACDEFGHIKLMNPQRSTVWY"), (5000, "éüaßяж中"), (30000, "-"), (4000, words)):
        x = "".join(rng.choice(alphabet) for _ in range(n))
        assert ids(ours, x) == theirs(x)


def test_chunks_don_t_matter(ours):
    rng = random.Random(9)
    data = "".join(rng.choice("etaoin") for _ in range(8000)).encode()
    cuts = sorted(rng.sample(range(1, 8000), 60))
    assert list(ours.stream(data[a:b] for a, b in zip([0, *cuts], [*cuts, 8000]))) == ours._apply_rules(data)


def test_lookahead_of_a_small_list():
    # b+c may take the b that a+b wants: two bytes; then z+a may or may not be left over
    assert sufficient_lookahead([(b"b", b"c"), (b"a", b"b"), (b"z", b"a")]) == 3
    assert sufficient_lookahead([(b"x", b"y")]) == 1


def test_utf8_machine_holds_three_bytes_at_most():
    text = "aé中😀z" * 5
    m, out = Utf8Machine(), []
    for b in text.encode():
        out.append(m.push(bytes([b])))
        assert len(m.held) <= 3
    assert "".join(out) + m.end() == text
    m = Utf8Machine()
    assert m.push(b"\xe4\xb8") == "" and m.end() == "�"


def test_encoding_operator_edges(spark, theirs):
    texts = [None, "", " ", "<|endoftext|>", "a\r\n b", "x" * 100_000, "same", "same", "\x00﻿"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no key")], "k bigint, text string").withColumn("ids", F.lit(1)).withColumn("_text", F.lit(2))
    got = {r["k"]: r["ids"] for r in encode_texts(df, "k", "text").collect()}
    assert got == {i: theirs(t or "") for i, t in enumerate(texts)} | {None: theirs("no key")}
    assert {r["k"]: r["n_tokens"] for r in count_tokens(df, "k", "text").collect()} == {k: len(v) for k, v in got.items()}
    back = {r["k"]: r["text"] for r in decode_ids(encode_texts(df, "k", "text"), "k", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)} | {None: "no key"}
    assert encode_texts(df.limit(0), "k", "text").collect() == []
    broken = spark.sql("SELECT 1 AS k, CAST(unhex('61FF62') AS STRING) AS text")
    assert encode_texts(broken, "k", "text").first()["ids"] == theirs("a�b")


def check_packing(items, out, capacity):
    used: dict = {}
    pieces: dict = {}
    for row, piece, n, size, at in out:
        used[at] = used.get(at, 0) + size
        pieces.setdefault(row, []).append((piece, n, size))
    assert max(used.values(), default=0) <= capacity
    for row, size in items:
        got = sorted(pieces[row])
        assert [p for p, _, _ in got] == list(range(got[0][1])) and sum(s for _, _, s in got) == max(0, size or 0)
        assert len(got) == max(1, -(-max(0, size or 0) // capacity)) and all(s == capacity for _, _, s in got[:-1])
    return sum(used.values()) / (capacity * len(used)) if used else 1


@pytest.mark.parametrize("kind", ["texts", "large", "halves", "tiny", "one"])
def test_packing_is_whole_and_tight(kind):
    rng = np.random.default_rng(10)
    n = BLOCK_ITEMS + 5000
    sizes = {"texts": rng.lognormal(5.4, 1.1, n).astype(int), "large": rng.integers(2100, 9000, 3000), "halves": np.full(2001, 2048), "tiny": rng.integers(0, 20, n), "one": np.array([5])}[kind]
    p, out = Packer(4096), []
    for a in range(0, len(sizes), BLOCK_ITEMS):
        out += p.block(list(range(a, min(len(sizes), a + BLOCK_ITEMS))), sizes[a : a + BLOCK_ITEMS], a + BLOCK_ITEMS >= len(sizes))
    fill = check_packing(list(enumerate(sizes.tolist())), out, 4096)
    assert fill > {"texts": 0.99, "large": 0.7, "halves": 0.99, "tiny": 0.99, "one": 0}[kind]


def test_packing_operator_edges(spark):
    rows = [("a", 4096), ("b", 4097), ("c", 0), ("d", None), ("e", -3), ("f", 20_000), ("g", 1), ("h", 2048), ("i", 2048)]
    df = spark.createDataFrame(rows, "k string, s bigint").withColumn("container", F.lit("x")).withColumn("_size", F.lit(1))
    out = [tuple(r) for r in pack_containers(df, "k", "s", 4096).collect()]
    check_packing(rows, out, 4096)
    assert {r[0] for r in out if r[2] > 1} == {"b", "f"}
    assert pack_containers(df.limit(0), "k", "s", 4096).collect() == []
    again = spark.createDataFrame([(None, 3000)] * 3, "k string, s bigint")
    assert len({r["container"] for r in pack_containers(again, "k", "s", 4096).collect()}) == 3
