"""Dynamic itemset counting against plain counting."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from loglathe.llm import phrases, shared

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least, first=2000, percent=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], score)
    covered = set()
    for (lang, p), (a, *_) in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                q = p[i : i + k]
                if 100 * a >= percent * found[lang, q][0]:
                    covered.add((lang, q))
    out = []
    for lang in {lang for lang, _ in found}:
        rows = sorted(((-v[3], -v[0], " ".join(p).encode(), v) for (own, p), v in found.items() if own == lang and (own, p) not in covered))[:first]
        out += [(lang, k, phrase.decode(), v[0], v[1], v[2], n[lang], v[3]) for k, (_, _, phrase, v) in enumerate(rows, 1)]
    return sorted(out)


SCHEMA = "lang string, text string, n int, phrase string"


def check(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    got = sorted(map(tuple, phrases.collocations(df, **kw).collect()))
    kw = {k: v for k, v in kw.items() if k not in ("shards", "bits")}
    assert got == plain(rows, **{"least": 30} | kw)
    return got


@pytest.mark.parametrize("seed, shards, least", [(1, 3, 4), (2, 2, 3), (4, 1, 5)])
def test_random_texts(spark, seed, shards, least):
    r = random.Random(seed)
    words = ["The", "the", "of", "é", "ÉA", "x-y", "\x00", "\xa0", "a b", "z1", *"abcdefg"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "; ", "\x0b", "! "]
    rows = [(r.choice(["en", "de", None, ""]), "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 60)))) for _ in range(60)]
    assert check(spark, rows + [("en", None), ("en", ""), ("de", " \n ")], least=least, shards=shards)


def test_phrases_that_pass_late_and_ties(spark):
    rows = [("en", "rare words come late")] * 3 + [("en", f"filler{k} alone") for k in range(200)] + [("en", "rare words come late and rare words come")] * 8
    check(spark, rows, parts=1, least=9)
    check(spark, [("en", "a b. c d. e f. b a")] * 9, least=9, first=3)
    assert check(spark, [("en", "a a a a a a")] * 9, least=9)


def test_long_texts_are_cut_between_pieces(spark):
    text = b"one two three four five six. " * 30
    parts = list(phrases._cut(text, 40))
    assert b"".join(parts) == text and max(map(len, parts)) <= 90 and all(p.endswith(b".") for p in parts[:-1])
    assert list(phrases._cut(b"x" * 500, 40)) == [b"x" * 500]
    check(spark, [("en", "one two three. " * 20_000), ("en", "one two " * 20_000)])


def test_full_bitmaps_change_nothing(spark):
    r = random.Random(8)
    check(spark, [("en", " ".join(r.choice("abcdef") for _ in range(40))) for _ in range(40)], least=12, bits=12)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "")], [("en", "once only")]])
def test_nothing_to_find(spark, rows):
    assert check(spark, rows) == []


def test_products_beyond_64_bits(spark):
    rows = [("en", 1, "a", 10**18), ("en", 1, "b", 10**18 + 7), ("en", 2, "a b", 10**18 - 1)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).first()
    assert (got["score"], got["l"], got["r"]) == (2_000_000 * (10**18 - 1) // (2 * 10**18 + 7), 10**18, 10**18 + 7)


def test_a_step_scans_its_shard_once(spark, monkeypatch):
    """Each text is taken once for the sieve, once a step, and once more where words and longer phrases are counted in one step."""
    taken, seen, save = spark.sparkContext.accumulator(0), [], phrases.saved
    of_language = phrases._by_language

    def counted(batches, use):
        def rows():
            for b in batches:
                taken.add(b.num_rows)
                yield b

        return of_language(rows(), use)

    monkeypatch.setattr(phrases, "_by_language", counted)
    monkeypatch.setattr(phrases, "saved", lambda df, name, until=None: (seen.append(name), save(df, name, until))[1])
    phrases.counted(spark.createDataFrame([("en", "one two")] * 40, "lang string, text string").repartition(1), 30)
    steps = seen.count("phrase-counts")
    assert steps > 3 and taken.value == 40 + 20 * steps + 20


def test_triples_that_cannot_reach_the_threshold_are_not_counted(spark):
    """All pairs are frequent, no triple is but one."""
    texts = [f"a{i % 40} b c{i // 40}" for i in range(1600)] + ["x y z"] * 40
    able = phrases.sieve(spark.createDataFrame([("en", text) for text in texts], "lang string, text string"), 30)
    full = np.full(1 << phrases.BITS - 6, 2**64 - 1, np.uint64)
    found = [b.to_pydict() for b in phrases._counts("en", [text.encode() for text in texts], False, phrases.Maps(full, full, *able))]
    assert [(b["size"][0], len(b["size"])) for b in found] == [(2, 82), (3, 1)] and found[1]["phrase"] == ["x y z"]


def test_a_step_leaves_no_shuffle_files(spark, monkeypatch):
    save, left = phrases.saved, []

    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")

    def saved(df, name, until=None):
        before, out, end = files(), save(df, name, until), time.monotonic() + 10
        while (now := files()) > before and time.monotonic() < end:  # they are deleted in the background
            time.sleep(0.1)
        left.append(now - before)
        return out

    monkeypatch.setattr(phrases, "saved", saved)
    rows = spark.createDataFrame([("en", "one two three")] * 40, "lang string, text string")
    assert phrases.collocations(rows).count() == 1 and len(left) > 4 and max(left) <= 0
    assert spark.conf.get(shared.SHUFFLES_DROPPED, "false") == "false"
