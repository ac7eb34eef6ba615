"""Each stage of the pipeline, and all of it, against plain Python."""

import random

import corpus_pipeline as cp
import numpy as np
import pytest
from loglathe.llm import bpe, toxicity
from loglathe.llm.queries import held_out
from test_filters import brute_lines, plain_leak, plain_tokens
from test_similarity import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id string, score double"


def made():
    r = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(30).replace("w1", "Train ").replace("w2", "7 ") for _ in range(6)] + [None, ""]
    docs = [f"{text(40)} {'you trash person' if n % 4 == 0 else 'you kind person'} {text(5)}" for n in range(80)]
    common = "This footer line is found in many documents"
    docs = [f"{t}\n {common.upper()} \nown {n}" if n % 3 == 0 else t for n, t in enumerate(docs)]
    docs += [docs[1], docs[2] + " more", docs[1], common, f"{common}\n\n", "", None, " \n", f"{text(10)} {items[0]} {text(10)}", items[1].lower(), "x " * 30_000]
    labels = [(n, int(n % 4 == 0)) for n in range(80)]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs, items, labels = made()
    rows = [(n, t, "en", "s", len(t or ""), "clash", 0.5) for n, t in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def rows_of(df):
    return {x["doc_id"]: x["text"] for x in df.collect()}


def plain_stages(spark, folder, texts):
    """The documents that each stage keeps."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    i, w, bias = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), eligible=~held_out())
    weight = dict(zip(i.tolist(), w.tolist(), strict=True))
    kept = {d: t for d, t in texts.items() if bias + sum(weight.get(x, 0.0) for x in set(toxicity.features(t).tolist())) < 0}
    yield kept
    lines = brute_lines(list(kept.items()))
    kept = {d: lines[d] for d, t in kept.items() if lines[d] == (t or "") or lines[d].strip(" \t\n\x0b\x0c\r")}
    yield kept
    found = brute_components(list(kept.items()), 5)
    kept = {d: t for d, t in kept.items() if not found[d][0] or found[d][1] == d}
    yield kept
    cut = [plain_tokens(x) for x in made()[1]]
    kept = {d: t for d, t in kept.items() if len(t) > 10_000 or not any(plain_leak(plain_tokens(t), x) for x in cut)}
    yield kept


def test_stages_match_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), want in zip(cp.STAGES, plain_stages(spark, folder, rows_of(docs)), strict=False):
        out = cp.saved(stage(spark, docs, folder), "stage")
        assert out.columns == docs.columns, name
        got = rows_of(out)
        assert got.keys() == want.keys() and all((got[d] or "") == (want[d] or "") for d in got), name
        assert len(got) < docs.count(), name
        docs = out
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    out = {x["doc_id"]: x for x in cp.run(spark, folder).collect()}
    assert out.keys() == rows_of(docs).keys() and all(x["exact"] for x in out.values())
    for d, text in rows_of(docs).items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert out[d]["ids"] == ids and out[d]["n_tokens"] == len(ids)


def test_stages_on_nulls_ties_and_nothing(spark, folder):
    rows = [(None, None, None, None, None, None, None), (None, "a b c d e f", "en", "s", 1, "", 0.0), (7, "a b c d e f", "en", "s", 1, "", 0.0), (7, "a b c d e f", "en", "s", 1, "", 0.0)]
    some = spark.createDataFrame(rows, SCHEMA)
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, some, folder).count() == len(rows), name
        none = stage(spark, some.limit(0), folder)
        assert none.count() == 0 and none.columns == some.columns, name
    assert sorted(np.array([x["n_tokens"] for x in cp.tokenise(spark, some, folder).collect()]) > 0) == [False, True, True, True]


def test_tokens_encode_each_text_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = cp.tokenise(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    assert "pythonUDF0" in plan and "pythonUDF1" not in plan
