"""BPE, token files: exact against the tokenizers library; round trips."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import bpe, token_files
from loglathe.llm.shared import scratch

TEXTS = ["", None, " ", "\n\n\t x", "Hello world's end", "<|endoftext|>a<|endoftext|>", "éß中文😀 ñ", "aaaa aaaaaaa", "a" * 3000, "x\x1cy\x85z ", "same", "same", "²³ 1½ _a_ -- '"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def texts(spark):
    rows = [(n, t, "clash", n) for n, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, __part long")


def test_every_token_encodes_to_itself(library):
    own = bpe.bpe(bpe.default_vocabulary())
    for i in random.Random(1).sample(range(50_000), 4000):
        text = library.decode([i])
        if "�" not in text:
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(own.encode(text), np.uint32).tolist() == want


def test_random_texts(library):
    own, r = bpe.bpe(bpe.default_vocabulary()), random.Random(5)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\r\n", "'s", "'", "1", "é", "ß", "中", "😀", "\x1c", "\x85", "\xa0", "<|endoftext|>", "!!", "_", "ñ", "́", "aaaa", "er", "on", "\x00", "٣", "ǅ", "²"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), np.uint32).tolist()
        assert got == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_one_long_piece(library):
    own, r = bpe.bpe(bpe.default_vocabulary()), random.Random(7)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a"):
        text = "".join(r.choice(letters) for _ in range(200_000))
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    kept = len(own.packed)
    assert own.decode(np.frombuffer(own.encode(text), np.uint32)) == text and len(own.packed) == kept


def test_latin_texts_are_cut_as_the_library_cuts_them(library):
    splitter, r = bpe.Splitter(bpe.default_vocabulary()), random.Random(11)
    letters = [chr(c) for c in range(0x2B0)] + ["'s", "'ve", "'ll", " ", " ", "a", "1"] * 20
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 30)))
        assert splitter.cut(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], text


def test_columns(spark, library):
    rows = texts(spark).select("doc_id", "text", bpe.encode(F.col("text")).alias("i"))
    rows = rows.withColumn("d", bpe.decode(F.col("i"))).collect()
    for row in rows:
        assert row["i"] == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["d"] == (row["text"] or "")
    assert texts(spark).limit(0).select(bpe.decode(bpe.encode(F.col("text")))).count() == 0
    assert spark.sql("SELECT cast(NULL AS array<int>) AS i").select(bpe.decode(F.col("i")).alias("d")).first()["d"] == ""


def test_a_round_trip_is_one_pass(spark, library):
    rows = texts(spark).select("text", bpe.round_trip(F.col("text")).alias("c"))
    for row in rows.collect():
        assert row["c"]["ids"] == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["c"]["text"] == (row["text"] or "")
    assert texts(spark).limit(0).select(bpe.round_trip(F.col("text"))).count() == 0


def test_tables_of_a_worker_are_bounded():
    own = bpe.Bpe(bpe.default_vocabulary())
    for n in range(300_000):
        own.packed[f"{n} "]
    assert len(own.packed) + len(own.packed.older) <= 200_000
    assert len(own.compatible) + len(own.compatible.older) <= 150_000


def test_token_files(spark, library):
    docs = texts(spark).unionByName(texts(spark).where("doc_id = 4")).unionByName(texts(spark).where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    packed = docs.drop("ids").withColumn("ids", bpe.library_encode(F.col("text"), end_id=0))
    folder = scratch(spark, "files")
    manifest, back = token_files.token_files(spark, packed, folder, seq_len=16, batch_rows=2, width=bpe.id_width(bpe.default_vocabulary()))
    got = sorted(back.collect(), key=lambda x: x["start"])
    at = 0
    for row, (doc, text) in zip(got, sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc, at, len(ids))
        assert row["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        at += len(ids)
    files = [f for f in manifest.collect() if f["n_tokens"] >= 16]
    ids, mask = token_files.sequence(files[0]["path"], 0)
    assert len(ids) == 16 and mask.all() and ids.base is not None and mask.base is not None and not mask.flags.writeable
    for f in files:
        for number in range(-(-f["n_tokens"] // 16)):
            ids, mask = token_files.sequence(f["path"], number)
            want = min(16, f["n_tokens"] - 16 * number)
            assert mask.tolist() == [1] * want + [0] * (16 - want) and not ids[want:].any() and mask.base is not None
    assert token_files.token_files(spark, packed.limit(0), scratch(spark, "none"), width=2)[1].count() == 0
