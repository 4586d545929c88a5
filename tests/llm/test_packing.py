import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlens.llm.packing import best_pattern, cutting_stock, encoder, op2_cutting_stock, pack


def read_back(rows, texts, length):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(pieces[i]):
            assert start == at
            at += n
        assert at == len(x)
    fill = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        fill.append(at)
    return sum(fill) / (length * len(fill))


def test_pieces_cover_every_id_once(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "béta", "x", "Gamma42", "<|endoftext|>", "  "]) for _ in range(rng.choice([1, 5, 40, 300, 5000]))) for i in range(300)}
    texts |= {300: None, 301: "", 302: " " * 5000, 303: "a" * 30000, 304: "one"}
    df = spark.createDataFrame([(i, x, 1) for i, x in texts.items()], "doc_id long, text string, sequence_id int").repartition(6)
    rows = pack(df, length=256).collect()
    assert read_back(rows, texts, 256) > 0.99


def test_empty_table_and_repeats(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = pack(spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 3), (1, 3)]


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(4)
    widths = np.arange(1, 65)
    demand = rng.integers(1, 300, 64) * np.linspace(2, 0.1, 64)
    patterns, x = cutting_stock(widths, demand, 64)
    assert (widths @ patterns <= 64).all()
    assert np.allclose(patterns @ x, demand)
    assert x.sum() <= 1.002 * (widths * demand).sum() / 64
    value, p = best_pattern(np.array([3.0, 4.0, 5.1]), np.array([2, 3, 4]), 9)
    assert abs(value - 13) < 1e-9 and (p * [2, 3, 4]).sum() <= 9


def test_ids_are_those_of_tokenizers():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder()("a <|endoftext|> b") == [64, 220, 50256, 275]
    for text in ["<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "Hello  world\n\n x", "naïve ñandú 日本語 😀", "​ \t\r\n", "don't 12345", " " * 3000 + "a"]:
        assert encoder()(text) == t.encode(text, add_special_tokens=False).ids


def test_repeated_ids_with_other_texts_are_packed_apart(spark):
    rows = pack(spark.createDataFrame([(1, "same text"), (1, "quite another text"), (1, None)], "doc_id long, text string")).collect()
    assert sorted(r.doc_tokens for r in rows) == [1, 3, 4] and {r.start for r in rows} == {0}


def test_query_on_its_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = op2_cutting_stock(spark, "/root/testdata/sf0.001")
    assert dict(rows.dtypes) == {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    assert read_back(rows.collect(), {r.doc_id: r.text for r in docs}, 1024) > 0.97
