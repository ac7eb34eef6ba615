"""The columns of the registered queries on small tables, and the rule of held-out rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import bpe, queries

TEXTS = [None, "", "Hello, world! token=abcdef 🎉", "a b. a b, a b; " * 12, "x" * 3000, "the same text", "the same text"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs = [(i if i != 5 else None, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{top}/documents.parquet")
    r = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in r.standard_normal(5)], 0) for i in range(30)] + [(30, None, 1), (31, [float("nan")] * 5, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{top}/embeddings.parquet")
    return str(top)


def test_held_out_is_crc32_of_the_id(spark):
    ids = list(range(0, 3000, 7)) + [10**12, -1]
    got = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", queries.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


COLUMNS = {
    "op5_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op11_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, tables, name):
    df = queries.QUERIES[name](spark, tables)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == {"op12_whitening": 150, "op13_phrases": 0}.get(name, len(TEXTS)) or name == "op13_phrases"


def test_encoded_and_decoded_digests(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    got = sorted(tuple(r)[1:] for r in queries.op5_bpe(spark, tables).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    coded = [library.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert got == sorted((len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for ids in coded)


def test_urls_of_any_length(spark):
    from loglathe.llm import url_cascade

    rules = [("block", "com", "/de/")]
    long = ["http://" + "a." * 20_000 + "com/de/" + "x" * 200_000, "http://x.com/de/" + "?" * 300_000, "x" * 300_000 + "://x.com/de/", "http://x.com/" + "/" * 300_000]
    df = spark.createDataFrame(list(enumerate(long)), "page_id long, url string").withColumn("extra", F.lit(1))
    got = {r["page_id"]: r["verdict"] for r in url_cascade.judged(df.select("page_id", "url"), rules).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow"}
