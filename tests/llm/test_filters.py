"""Edges of the other operators: nulls, empty texts and tables, ties, clashing columns."""

import datetime
import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import decontamination, line_runs, pseudonyms, toxicity, url_cascade, warc_bundles
from loglathe.llm.shared import scratch


def test_templates_catch_exact_and_reparameterised_items(spark):
    q = "A train leaves at 9 and travels 120 km to the town where Anna waits for 9 hours today"
    other = "A train leaves at 7 and travels 300 km to the town where Berta waits for 7 hours today"
    broken = "A train leaves at 7 and travels 300 km to the town where Berta waits for 8 hours today"
    items = spark.createDataFrame([(1, q), (2, None), (3, ""), (4, "tiny item words here")], "item_id long, text string")
    docs = [(1, "xx yy. " + q + ". zz"), (2, other), (3, broken), (4, "nothing to see here at all, my friend, nothing"), (5, None), (6, ""), (7, "so a tiny item words here. " * 3), (1, "xx yy. " + q + ". zz")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, item_id int, h long")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.contaminated(df, items).collect()}
    # of document 3, the windows over the value that disagrees don't count; 16 tokens of 19 are left
    assert got.keys() == {(1, 1), (2, 1), (3, 1), (7, 4)} and got[1, 1] and not got[2, 1] and not got[3, 1]
    strict = {(r["doc_id"], r["item_id"]): r["matched_tokens"] for r in decontamination.contaminated(df, items, enough=17).collect()}
    assert strict.keys() == {(1, 1), (2, 1), (7, 4)} and strict[2, 1] == 19
    assert decontamination.contaminated(df, items.limit(0)).count() == 0 and decontamination.contaminated(df.limit(0), items).count() == 0


def plain_tokens(text):
    """(slot type, word in lower case) of each token."""
    out, before = [], "end"
    for t in decontamination.TOKEN.findall(text or ""):
        low = t.lower()
        kind = "end" if t in ".!?\n" else "number" if t[0].isdigit() else "unit" if low in decontamination.UNITS else "name" if t[0].isupper() and t[1:].islower() else "word"
        if kind != "end":
            out.append(("n" if kind == "number" else "u" if kind == "unit" and before == "number" else "v" if kind == "name" and before != "end" else "", low))
        before = kind
    return out


def tokens_of(texts):
    """As plain_tokens, from the arrays of templates."""
    t, out = decontamination.templates(texts), [[] for _ in texts]
    for a, b, k, r in zip(t.start, t.end, t.slot, t.row, strict=True):
        out[r].append((("", "n", "u", "v")[k], t.text[a:b].lower()))
    return out, t


@pytest.mark.parametrize("block", [7, 200_000])
def test_tokens_of_odd_texts_match_plain_python(monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    r = random.Random(31)
    parts = list("aA \n.,:!?1_'\x00\x85") + ["Anna ", "Hours ", " HOURS ", "7 hours", "3.5", "1.,2", "٣", "²a", "½", "Ⅷ", "ǅ", "ß", "İs ", "ΑΣ", "Σa", "ς", "𝐀a", "中", "😀", "\u0301", "Ⓐ", "ª"]
    hashed = {}
    for _ in range(1500):
        texts = [r.choice(["", None, "".join(r.choice(parts) for _ in range(r.randrange(30)))]) for _ in range(r.randrange(1, 6))]
        got, t = tokens_of(texts)
        assert got == [plain_tokens(x) for x in texts]
        for (_, low), h in zip([x for own in got for x in own], t.plain.tolist(), strict=True):
            assert hashed.setdefault(low, h) == h
    assert len(set(hashed.values())) == len(hashed) > 500


def test_new_words_cost_no_more_than_finding_them():
    r = random.Random(32)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   .") for _ in range(3000)) for _ in range(2000)]

    def seconds(f):
        began = time.process_time()
        for n in range(0, len(texts), 256):
            f(texts[n : n + 256])
        return time.process_time() - began

    decontamination.templates(["warm"])
    assert min(seconds(decontamination.templates) for _ in range(2)) < 2 * min(seconds(lambda x: [decontamination.TOKEN.findall(t) for t in x]) for _ in range(2))


def plain_leak(doc, item, width=8, literals=4, enough=13):
    """Tokens of the item under windows that count, if they are enough."""
    w = min(width, len(item))
    cut = lambda tokens: [tuple(tokens[i : i + w]) for i in range(len(tokens) - w + 1)] if w else []
    form = lambda window: tuple(k or low for k, low in window)
    words = lambda window: tuple(low for _, low in window)
    whole = set(map(words, cut(doc)))
    places, runs = {p for p, x in enumerate(cut(item)) if words(x) in whole}, {}
    for p, x in enumerate(cut(item)):
        if any(k for k, _ in x) and sum(not k for k, _ in x) >= min(literals, w):
            for q, y in enumerate(cut(doc)):
                if form(x) == form(y) and [k for k, _ in x] == [k for k, _ in y]:
                    runs.setdefault(q - p, []).append((p, [(f"{k}:{a}", f"{k}:{b}") for (k, a), (_, b) in zip(x, y, strict=True) if k]))
    for found in runs.values():
        votes = Counter(pair for _, slots in found for pair in set(slots))
        chosen = lambda side, x: max((n, a == b, (a, b)[1 - side]) for (a, b), n in votes.items() if (a, b)[side] == x)[2]
        agreed = {(a, b) for a, b in votes if chosen(0, a) == b and chosen(1, b) == a}
        places |= {p for p, slots in found if all(a == b for a, b in slots) or set(slots) <= agreed}
    covered = len({i for p in places for i in range(p, p + w)})
    return covered if item and covered >= min(enough, len(item)) else 0


def test_random_texts_against_plain_python(spark):
    r = random.Random(12)
    words = ["the", "of", "train", "Anna", "Rome", "7", "9", "7", "km", "hours", "and", "to", "box", ".", "red"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(r.choice([3, 8, 14, 20, 30])) for _ in range(25)] + ["", None]
    items += items[:3]
    docs = []
    for _ in range(150):
        own = r.choice(items[:25]).split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            own[r.randrange(len(own))] = r.choice(words)
        docs.append(f"{text(r.randint(0, 12))} {' '.join(own)} {text(r.randint(0, 12))} {r.choice(['', ' '.join(own[:9])])}")
    docs += docs[:5] + ["", None, "x " * 100_000 + items[4]]
    want = {}
    cut = [plain_tokens(t) for t in items]
    for i, t in enumerate(docs):
        tokens = plain_tokens(t)[-60:] if len(t or "") > 10_000 else plain_tokens(t)
        want |= {(i, j): n for j, item in enumerate(cut) if (n := plain_leak(tokens, item))}
    got = leaks(spark, items, docs)
    assert {k: x["matched_tokens"] for k, x in got.items()} == want and len(want) > 100


def leaks(spark, items, docs):
    frame = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    rows = decontamination.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_every_whole_copy_of_an_item_is_found(spark):
    items = ["Compute 3 x 4 + 5 x 6 - 7 x 8 for x = 2 and y = 9.", "Is Paris in France?", "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"]
    got = leaks(spark, items, [f"so it is. {t} and no more" for t in items] + [items[2].lower(), items[2].upper(), "Is Rome in France?"])
    assert got.keys() == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)}
    assert all(r["matched_tokens"] == r["item_tokens"] and r["exact"] for r in got.values())


def test_one_differing_value_leaves_the_rest_of_a_copy(spark):
    item = "The small town of the north built a long bridge over the river in 2019 and the people of the valley were glad, but later the water rose and took it away in 2019"
    got = leaks(spark, [item], [item, "2018".join(item.rsplit("2019", 1)), item.replace("2019", "2001"), "2001".join(item.replace("2019", "2018").rsplit("2018", 1))])
    assert got.keys() == {(0, 0), (1, 0), (2, 0), (3, 0)} and not got[2, 0]["exact"]
    assert got[0, 0]["matched_tokens"] == got[2, 0]["matched_tokens"] == got[0, 0]["item_tokens"] and 13 <= got[1, 0]["matched_tokens"] < got[0, 0]["item_tokens"]


def test_a_phrase_counts_once_however_often_it_occurs(spark):
    phrase = "which of the following is the correct answer"
    item = f"{phrase} if all the green boxes are moved from one room into another"
    got = leaks(spark, [item], [" and so on. ".join([phrase] * 6), " then ".join([f"{phrase} or 7 of the following is the correct {n}" for n in range(6)]), item])
    assert got.keys() == {(2, 0)}


def test_long_reparameterised_items(spark):
    """A copy of a long item with other values, all different, and one with a value that disagrees in places."""
    r = random.Random(2)
    words = ["walks", "to", "the", "shop", "and", "buys", "some", "apples", "for", "his", "friend", "at", "price"]
    parts = [f"{r.choice(words)} {r.choice(words)} {k} {r.choice(words)} {r.choice(words)}" for k in range(4_000)]
    item = " ".join(parts)
    other = re.sub(r"\d+", lambda m: str(int(m[0]) + 50_000), item)
    wrong = re.sub(r"\b5(\d\d)0\b", r"77\g<1>0", other)
    began = time.time()
    got = {i: r["matched_tokens"] for (i, _), r in leaks(spark, [item], [item, other, wrong, "some apples for his friend"]).items()}
    assert time.time() - began < 90 and got.keys() == {0, 1, 2} and got[0] == got[1] == 20_000 >= got[2] > 0


def test_one_phrase_in_many_items_and_many_documents(spark):
    """Items and documents share a phrase that is too short to count; one document has an item whole."""
    phrase = "which of the following is the correct answer"
    own = lambda k, j: "".join(chr(97 + (k * 7 + j * 3) // 26**d % 26) for d in range(3)) + "qj"[j % 2]
    items = [f"{phrase} " + " ".join(own(k, j) for j in range(8)) for k in range(600)]
    docs = [f"{own(k, 20)} text {phrase} goes {own(k, 30)}" for k in range(600)] + [f"x {items[7]} y"]
    assert leaks(spark, items, docs).keys() == {(600, 7)}


def test_toxicity(spark):
    bad = [(i, f"you are a trash person number{i} ok") for i in range(60)]
    good = [(100 + i, f"you are a kind person number{i} ok") for i in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in [*bad, *good, (500, None), (501, ""), (None, "trash")]], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in [*bad, *good]] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert all(got[i] > 0.5 for i, _ in bad) and all(got[i] < 0.5 for i, _ in good) and got[500] == got[501] and 0 <= got[500] <= 1
    assert toxicity.fit(df, labels.limit(0)) is None
    assert df.select(toxicity.score(F.col("text"), None, spark).alias("s")).first()["s"] == 0.0


def plain_ftrl(rows, labels, alpha, beta, l1, l2, epochs, size):
    """FTRL-proximal as published, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        zi, own = z.get(i, 0.0), (0.0, 0.0) if i == size else (l1, l2)
        return 0.0 if abs(zi) <= own[0] else -(zi - math.copysign(own[0], zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + own[1])

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            w = {i: weight(i) for i in [*rows[r], size]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[r]
            for i, wi in w.items():
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - rate * wi, n.get(i, 0.0) + g * g
    return {i: w for i in z if i != size and (w := weight(i))}, weight(size)


def test_weights_are_those_of_plain_ftrl():
    r = random.Random(4)
    texts = [" ".join(r.choice(["kind", "trash", "you", "me", "so", "very", "day"]) for _ in range(r.randint(0, 12))) for _ in range(300)]
    labels = [int("trash" in t) for t in texts]
    rows = [np.unique(toxicity.features(t, 10)) for t in texts]
    for l1 in (0.5, 3.0):
        i, w, bias = toxicity.train_ftrl(rows, labels, 10, 0.4, 1.0, l1, 0.7, 2)
        want, want_bias = plain_ftrl([x.tolist() for x in rows], labels, 0.4, 1.0, l1, 0.7, 2, 1 << 10)
        assert sorted(want) == i.tolist() and abs(bias - want_bias) < 1e-9
        assert all(abs(x - want[k]) < 1e-5 for k, x in zip(i.tolist(), w.tolist(), strict=True))


def test_toxicity_learns_from_one_text_of_an_id(spark):
    rows = [(i % 4, f"trash {i}" if i % 2 else f"kind {i}", "x") for i in range(400)] + [(9, "long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(9, 0)], "doc_id long, toxic int")
    i, w, bias = toxicity.fit(df, labels, most_rows=4, l1=0.0)
    scores = df.select("doc_id", toxicity.score(F.col("text"), (i, w, bias), spark).alias("s")).collect()
    assert len(scores) == len(rows) and all(0 <= r["s"] <= 1 for r in scores)


def test_warc_round_trip(spark):
    long = "<p>é" * 600
    rows = [(1, "http://a/", long), (9, None, long), (3, "http://b/\r\nX: 1", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = scratch(spark, "warc")
    index = warc_bundles.write_bundles(pages, folder, frame_bytes=2000, bundle_bytes=3000)
    got = {r["page_id"]: r for r in warc_bundles.read_bundles(index, folder).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 9), 3: ("revisit", 9), 9: ("response", None), **{k: ("response", None) for k in (4, 5, 6, 7)}}
    for page, _, html in rows:
        payload = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
    row = index.where("page_id = 9").first()
    assert warc_bundles.read_record(folder, row)[1] == long.encode()
    assert warc_bundles.read_bundles(warc_bundles.write_bundles(pages.limit(0), folder), folder).count() == 0
    plan = lambda most: sorted(tuple(r) for r in warc_bundles.with_revisits(pages, most_broadcast_rows=most).drop("payload").collect())
    assert plan(0) == plan(10)


def test_warc_ids_tell_records_apart(spark):
    long = "y" * 3_000_000
    rows = [(1, "u", "one"), (1, "u", "two"), (1, "u", "two"), (2, "u", long), (3, "u", long)]
    folder = scratch(spark, "warc")
    index = warc_bundles.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, frame_bytes=1 << 16)
    ids = [r["record_id"] for r in index.collect()]
    assert len(ids) == 5 and len(set(ids)) == 4
    blocks = sorted(warc_bundles.read_record(folder, r)[1] for r in index.where("page_id = 1").collect())
    assert blocks == [b"one", b"two", b"two"]
    assert warc_bundles.read_record(folder, index.where("page_id = 3").first())[1] == long.encode()
    fields, block = warc_bundles.read_record(folder, index.where("page_id = 2").first())
    assert block == b"" and fields["WARC-Refers-To"] == index.where("page_id = 3").first()["record_id"]


def luhn(digits):
    return sum(x if n % 2 == 0 else x * 2 - 9 * (x > 4) for n, x in enumerate(map(int, reversed(digits)))) % 10


def test_pseudonyms_keep_format_and_link(spark):
    text = "card 4111 1111 1111 1111, 4111111111111111; iban DE89370400440532013000 on 2024-02-29 or 29/02/2024, ip 10.0.0.1, tel +1 (605) 555-9305, ssn 123-45-6789, ann.b1@mail7.example.com. no 4111111111111112, 2023-02-30, 300.1.1.1"
    rows = [(1, text), (2, text), (3, None), (4, ""), (5, "plain")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kinds string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(df, "key").collect()}
    new = got[1]["text"]
    assert new == got[2]["text"] != text and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "plain" and got[5]["n_replaced"] == 0
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+", "0", s)))
    assert shape(new) == shape(text) and got[1]["n_replaced"] == 9
    a, b = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), (\d{16});", new).groups()
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) == 0
    iban = re.search(r"iban ([A-Z]{2}\d+)", new)[1]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    y, m, d = re.search(r"on (\d{4})-(\d\d)-(\d\d) or", new).groups()
    assert f"{d}/{m}/{y}" in new and new.endswith("no 4111111111111112, 2023-02-30, 300.1.1.1")
    assert pseudonyms.pseudonymised(df.limit(0), "key").count() == 0


def test_values_beside_other_digits(spark):
    whole = ["4111111111111111 123", "4111 1111 1111 1111 12/27", "item 7 4111111111111111", "4111111111111111 12/27/2025", "DE89 3704 0044 0532 0130 00 123", "OR12 DE89 3704 0044 0532 0130 00", "on 12/27/2025"]
    df = spark.createDataFrame(list(enumerate(whole)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(df, "key").collect()}
    assert [got[i]["n_replaced"] for i in range(len(whole))] == [1, 1, 1, 2, 1, 1, 1]
    card = re.search(r"\d{16}", got[0]["text"])[0]
    assert card != "4111111111111111" and luhn(card) == 0 and got[0]["text"] == f"{card} 123" and got[2]["text"] == f"item 7 {card}"
    assert got[1]["text"] == " ".join(card[i : i + 4] for i in range(0, 16, 4)) + " 12/27"
    iban = re.search(r"DE[\d ]+ \d\d(?= 123)", got[4]["text"])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and got[5]["text"].startswith("OR12 DE")
    month, day, _ = got[6]["text"][3:].split("/")
    assert int(month) <= 12 < int(day) and got[6]["text"][3:] != "12/27/2025" and got[3]["text"] == f"{card} {got[6]['text'][3:]}"


SHAPE = str.maketrans(string.digits + string.ascii_lowercase + string.ascii_uppercase, "0" * 10 + "a" * 26 + "A" * 26)


def plain_feistel(value, key, tag):
    """The character network in plain Python."""
    x, y, shape = value[: len(value) // 2], value[len(value) // 2 :], value.translate(SHAPE)
    for n in range(1, pseudonyms.ROUNDS + 1):
        digests = "".join(hashlib.sha512(f"{b}|{key}|{tag}|{n}|{shape}|{y}".encode()).hexdigest() for b in range(len(x) // 32 + 1))
        moved = ""
        for i, c in enumerate(x):
            letters = next((s for s in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in s), None)
            moved += c if letters is None else letters[(letters.index(c) + int(digests[4 * i : 4 * i + 4], 16)) % len(letters)]
        x, y = y, moved
    return x + y


def test_characters_are_permuted_as_in_plain_python(spark):
    r = random.Random(3)
    values = ["", "a", "7", "Ab.9-", "x" * 150] + ["".join(r.choice("abzAZ019.-_") for _ in range(r.randint(2, 40))) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["p"] for r in df.select("v", pseudonyms.feistel_chars(F.col("v"), "key", "t").alias("p")).collect()}
    assert all(got[v] == plain_feistel(v, "key", "t") for v in values)
    every = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert every.select(pseudonyms.feistel_chars(F.col("v"), "key", "t").alias("p")).where("p rlike '^[0-9]{4}$'").distinct().count() == 10_000


def test_cards_in_random_texts_against_plain_python(spark):
    """Every run of digit groups: the longest valid stretches of whole groups go, and nothing else."""
    r = random.Random(6)

    def number():
        body = "".join(r.choice(string.digits) for _ in range(r.choice([12, 14, 15, 18])))
        return body + str(-luhn(body + "0") % 10)

    def grouped(digits, sep):
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def card_of(digits):
        body = plain_feistel(digits[:-1], "key", "card")
        return body + str(-luhn(body + "0") % 10)

    def plain(text):
        def one(m):
            groups, gaps = re.split("[ .-]", m[0]), re.findall("[ .-]", m[0])
            spans = [(a, b) for a in range(len(groups)) for b in range(a, len(groups)) if 13 <= len(d := "".join(groups[a : b + 1])) <= 19 and luhn(d) == 0 and set(d) != {"0"}]
            taken = []
            for a, b in sorted(spans, key=lambda s: (-len("".join(groups[s[0] : s[1] + 1])), s)):
                if all(b < x or y < a for x, y in taken):
                    taken.append((a, b))
            for a, b in taken:
                new = card_of("".join(groups[a : b + 1]))
                for k in range(a, b + 1):
                    groups[k], new = new[: len(groups[k])], new[len(groups[k]) :]
            return "".join(x for pair in zip(groups, [*gaps, ""], strict=True) for x in pair)

        return re.sub(pseudonyms.CARD_RUN, one, text)

    texts = []
    for _ in range(300):
        words = [r.choice([number(), grouped(number(), r.choice(" -.")), "12", "7", "and", "2", "no.", "\x01", "\x02\x03"]) for _ in range(r.randint(1, 6))]
        texts.append(r.choice([" ", "  ", ", ", " x "]).join(words))
    texts.append("word " * 50_000 + "4111.1111.1111.1111" + " end" * 50_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymised(df, "key").collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain(text), text[:200]


def plain_numbers(a, b, low, high, key, tag):
    number = lambda t, n, v: int(hashlib.sha256(f"{key}|{tag}{t}|{n}|{v}".encode()).hexdigest()[:13], 16)
    for n in range(4):
        a = (a + number("a", n, b)) % low
        b = (b + number("b", n, a)) % high
    return a, b


def plain_iban(text):
    body = plain_feistel(text[4:], "key", "iban")
    rest = int("".join(str(int(c, 36)) for c in body + text[:2] + "00")) % 97
    return f"{text[:2]}{98 - rest:02}{body}"


def plain_day(day):
    a, b = plain_numbers(day // 773, day % 773, 189, 773, "key", "date")
    return a * 773 + b


def plain_ip(text):
    w, x, y, z = map(int, text.split("."))
    a, b = plain_numbers(w * 256 + x, y * 256 + z, 65536, 65536, "key", "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def test_other_forms_against_plain_python(spark):
    r = random.Random(12)
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    epoch, want, texts = datetime.date(1800, 1, 1), [], []
    for _ in range(60):
        day = r.randrange(146_097)
        date, new_date = epoch + datetime.timedelta(day), epoch + datetime.timedelta(plain_day(day))
        name = "q" + "".join(r.choice("abzAZ09._%+-") for _ in range(r.randint(0, 30)))
        country, body = r.choice(["DE", "GB", "NO"]), digits(r.randint(11, 18))
        iban = f"{country}{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}{body}"
        grouped = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
        ssn, ip = f"{digits(3)}-{digits(2)}-{digits(4)}", ".".join(str(r.randrange(256)) for _ in range(4))
        number = f" ({digits(3)}) {digits(3)}-{digits(4)}"
        texts.append(f"; {name}@mail.example.com; {iban}; {grouped(iban)}; {date.isoformat()}; {date.strftime('%d.%m.') + str(date.year)}; {ssn}; {ip}; +44{number};")
        new = plain_iban(iban)
        want.append(f"; {plain_feistel(name, 'key', 'email')}@mail.example.com; {new}; {grouped(new)}; {new_date.isoformat()}; {new_date.strftime('%d.%m.') + str(new_date.year)}; {plain_feistel(ssn, 'key', 'ssn')}; {plain_ip(ip)}; +44{plain_feistel(number, 'key', 'phone')};")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x["doc_id"]: x["text"] for x in pseudonyms.pseudonymised(df, "key").collect()}
    for i, text in enumerate(texts):
        assert got[i] == want[i], text


LONG = {
    "numbers": "12 " * 100_000 + "x",
    "a word": "abcdefgh" * 130_000,
    "digits": "1234567890" * 100_000,
    "names": "a.b_c" * 100_000 + "@",
    "parts of a host": "a@" + "b." * 200_000 + "com",
    "groups of letters": "AB12" + " AB12" * 20_000,
    "cards": "4111 1111 1111 1111 " * 5_000,
}


def test_texts_of_any_length(spark):
    df = spark.createDataFrame([(k, kind, text) for k, (kind, text) in enumerate(LONG.items())], "doc_id int, kind string, text string").repartition(4)
    began = time.time()
    got = {r["kind"]: r for r in pseudonyms.pseudonymised(df, "key").collect()}
    assert time.time() - began < 90  # seconds or none at all: no square, no stack
    for kind, text in LONG.items():
        assert len(got[kind]["text"]) == len(text) and got[kind]["n_replaced"] == {"cards": 5_000, "parts of a host": 1}.get(kind, 0)


def test_long_runs_of_groups_against_plain_python(spark):
    r = random.Random(15)
    groups = [r.choice(["7", "12", "4111", "123456", "4111111111111111"]) for _ in range(1500)]
    spans = [(a, b) for a in range(len(groups)) for b in range(a, min(a + 19, len(groups))) if 13 <= len(d := "".join(groups[a : b + 1])) <= 19 and luhn(d) == 0 and set(d) != {"0"}]
    taken = []
    for a, b in sorted(spans, key=lambda s: (-len("".join(groups[s[0] : s[1] + 1])), s)):
        if all(b < x or y < a for x, y in taken):
            taken.append((a, b))
    df = spark.createDataFrame([(1, " ".join(groups))], "doc_id int, text string")
    assert pseudonyms.pseudonymised(df, "key").first()["n_replaced"] == len(taken) > 100


def test_dates_are_permuted(spark):
    days = spark.range(0, 146_097, 97).select(F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    out = days.select(pseudonyms.date(F.col("d"), "k").alias("p"))
    assert out.distinct().count() == out.where("p BETWEEN '1800-01-01' AND '2199-12-31'").count() == days.count()


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/")]


def test_url_cascade(spark):
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en", "http://notexample.com/de/", "http://badorg/", None, "no scheme", "http://", "ftp://x.com", "http://x.com/de", "http://a.com/de/#f", "http://a.com/de/#f"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judged(df, RULES).orderBy("page_id").collect()]
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("org/", "allow") and got[2][2:] == ("com/de/", "block")
    assert got[3][2:] == (None, "allow") and got[4] == ("", "", None, "allow") == got[5] and got[7][:2] == ("x.com", "") and got[8][2] is None and got[9] == got[10]
    assert url_cascade.judged(df.limit(0), RULES).count() == 0 and url_cascade.judged(df, []).count() == len(urls)


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_cascade.Cascade(universe.where("cast(substring(key, 2) AS int) % 37 = 0"), universe)
    wrong = universe.where(cascade.contains(F.col("key")) != (F.expr("cast(substring(key, 2) AS int) % 37 = 0")))
    assert len(cascade.levels) > 1 and wrong.count() == 0


def brute_lines(rows):
    strip, found = " \t\n\x0b\x0c\r", {}
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(strip))
    for i, t in rows:
        for k in {low(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                found.setdefault(k, []).append(i)
    keep = {k: max(v) for k, v in found.items() if len(v) >= 3}
    return {i: "\n".join(x for x in (t or "").split("\n") if keep.get(low(x), i) == i) for i, t in rows}


@pytest.mark.parametrize("batches", [1, 5])
def test_line_runs(spark, batches):
    """Against plain Python, with clashing columns, ties and a very long text."""
    line, other = "This Line is long enough É", "another line that is long"
    rows = [(i, f" {line.upper().replace('É', 'É')}\t\n{other if i % 3 else 'x'}\n\n{line}" if i % 2 else f"own {i}\n{other}") for i in range(20)] + [(30, None), (31, ""), (32, other), (33, "\n\n"), (34, "\n".join(["long line of a long text " + "z" * 2000, other] * 500))]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], "doc_id long, text string, h1 string, n int")
    got = {r["doc_id"]: r["text"] for r in line_runs.deduped(df, batches=batches).collect()}
    assert got == brute_lines(rows)
    assert line_runs.deduped(df.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    ties = spark.createDataFrame([(1, line), (1, line), (None, line)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_runs.deduped(ties).collect()) == [("1", line), ("1", line), ("None", "")]


def test_many_repeated_lines_in_one_document(spark):
    text = "\n".join(f"a repeated line number {k}" for k in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id long, text string")
    line_runs.deduped(df.where("doc_id = 3")).collect()
    began = time.time()
    got = {r["doc_id"]: (r["__dropped"], len(r["text"])) for r in line_runs.deduped(df).collect()}
    assert got == {1: (60_000, 0), 2: (60_000, 0), 3: (0, len(text))} and time.time() - began < 60


def test_rows_without_an_id_share_nothing(spark):
    lines = [f"a repeated line number {k}" for k in range(30)]
    rows = [(None, "\n".join(lines[k : k + 3])) for k in range(0, 30, 3)] * 2 + [(5, "\n".join(lines[:20])), (None, None), (None, "")]
    got = [r["text"] for r in line_runs.deduped(spark.createDataFrame(rows, "doc_id long, text string"), most_broadcast_rows=0).where("doc_id IS NULL").collect()]
    assert sorted(got) == sorted([""] * 14 + ["\n".join(lines[k : k + 3]) for k in (21, 24, 27)] * 2 + [lines[20]] * 2)
