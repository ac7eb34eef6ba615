"""Near-duplicates, fingerprints: against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
from fractions import Fraction

from loglathe.llm import fingerprints, odd_sketches


def brute_sets(texts, words):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [x for y in w for x in y.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute_components(rows, words):
    sets = brute_sets([t for _, t in rows], words)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def near_texts(seed=3, groups=12, size=14):
    r, out = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice([6, 30, 80]))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 9))):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own))
    out += ["", None, "one", "ONE", "two  words", "Two\twords\n", " \n", "É x", "é x"] + [out[0]] * 5
    r.shuffle(out)
    return out


def test_components_match_brute_force(spark):
    rows = list(enumerate(near_texts()))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rep long, n long")
    for words in (2, 5):
        want = brute_components(rows, words)
        for block, sketch_block in ((512, 4096), (4, 5)):
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in odd_sketches.linked(df, words=words, block=block, sketch_block=sketch_block).collect()}
            assert got == want


def test_links_beside_a_far_hub(spark):
    """Texts that share a frame and are linked with each other, not with the smallest id of their buckets."""
    r = random.Random(8)
    fill = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    frame, rows = fill(70), []
    for k in range(60):
        own = fill(30)
        rows += [(len(rows) + n, f"{frame} {own} {fill(2) if n else ''}") for n in range(1 + (k % 3 == 1))]
    rows.append((10_000, "word " + fill(30_000)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in odd_sketches.linked(df, words=2, block=8, sketch_block=16).collect()}
    assert got == brute_components(rows, 2) and len({c for _, c in got.values()}) == 61


def test_rows_of_one_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    df = spark.createDataFrame([(5, a), (5, b), (7, a + " x"), (9, b + " y"), (2, b + " z")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in odd_sketches.linked(df, words=2).collect())
    assert got == [(2, 2), (5, 2), (5, 2), (7, 2), (9, 2)]


def test_near_dedup_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, odd_sketches.linked(df, words=2).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (None, 0, None, True)], key=str)
    assert odd_sketches.linked(df.limit(0)).count() == 0


def test_block_links_span_components():
    pack = lambda *x: np.array(sorted(x), np.int64)
    pdf = pd.DataFrame({"id": [1, 2, 3], "set": [pack(1, 2, 3, 4, 5), pack(1, 2, 3, 4, 5, 6), pack(9, 10)], "component": [1, 2, 3], "block": [0, 0, 0]})
    assert odd_sketches.block_links(pdf, Fraction("0.8")).values.tolist() == [[1, 2]]


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    for share in (0.6, 0.8, 0.95):
        base = r.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * (1 - share) / (1 + share))
        a, b = base[n:], base[: len(base) - n]
        x, y = (odd_sketches.signature(np.unique(s), 36, 5, 512)[1] for s in (a, b))
        odd = sum(int(p ^ q).bit_count() if p ^ q >= 0 else (int(p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x.tolist(), y.tolist(), strict=True))
        assert abs(odd - odd_sketches.most_odd(share, 180, 512)) < 45


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_estimate_weighted_jaccard(spark):
    texts = near_texts(9, 8, 6)
    r = random.Random(2)
    s = fingerprints.sampler(fingerprints.SAMPLES)
    errors = []
    for _ in range(300):
        a, b = r.choice(texts) or "", r.choice(texts) or ""
        if a and b:
            errors.append(fingerprints.likeness(s.fingerprint(a), s.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def plain_fingerprint(text, samples=fingerprints.SAMPLES):
    """For each sample the term with the least number, each term's numbers made on their own."""
    from xxhash import xxh3_64_intdigest

    counts = Counter((text or "").lower().split())
    if not counts:
        return [0] * samples
    keys = [fingerprints.packed_keys(np.array([xxh3_64_intdigest(word.encode())], np.uint64), np.array([n]), samples)[0] for word, n in counts.items()]
    return [min(int(k[s]) for k in keys) & 0xFFFF for s in range(samples)]


def share(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def test_compare_edited(spark):
    rows = [(5, "b c d e"), (1, "a b c d e f g h"), (9, None), (7, ""), (12, "z"), (12, "y y"), (13, "long text " * 20_000 + "é"), (14, "Long text\u00a0 b c")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = fingerprints.compare_edited(df).collect()
    order = sorted(((i, t or "") for i, t in rows))
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        assert by[i, len(t)]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, new = (plain_fingerprint(x) for x in (t, after, edited))
        assert by[i, len(t)]["fingerprint"] == "".join(f"{x:04x}" for x in own) and by[i, len(t)]["edited_fingerprint"] == "".join(f"{x:04x}" for x in new)
        assert by[i, len(t)]["near_edited"] == share(own, new) and by[i, len(t)]["near_next"] == share(own, other)
    assert by[9, 0]["fingerprint"] == by[7, 0]["fingerprint"] and by[7, 0]["near_next"] == 1.0
    one = fingerprints.compare_edited(spark.createDataFrame([(3, "q r")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0
    assert fingerprints.compare_edited(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "q r"), (None, "s")], "doc_id long, text string")
    assert fingerprints.compare_edited(nulls).count() == 2


def test_samples_follow_the_formula():
    """Each sample against consistent weighted sampling in plain Python with doubles; 32-bit floats may differ at near ties."""
    import math
    import random

    from xxhash import xxh3_64_intdigest

    def gamma(share):
        low, high = 0.0, 40.0
        for _ in range(50):
            x = (low + high) / 2
            low, high = (x, high) if (1 + x) * math.exp(-x) > 1 - share else (low, x)
        return low

    def sample(counts, k):
        best = None
        for word, n in counts.items():
            h, mask = xxh3_64_intdigest(word.encode()), (1 << 64) - 1
            x = (h ^ (k * 0x9E3779B97F4A7C15 & mask)) * 0xBF58476D1CE4E5B9 & mask
            x ^= x >> 32
            x = x * 0x94D049BB133111EB & mask
            x ^= x >> 29
            u = [((x >> 16 * i & 0xFFFF) + 0.5) / 65536 for i in range(4)]
            r, c = gamma(u[0]), -math.log(u[2] * u[3])
            t = math.floor(math.log(n) / r + u[1])
            key = math.log(c) - r * (t - u[1] + 1)
            if best is None or key < best[0]:
                best = key, max((h + t * 0x9E37) & 0xFFFF, 1)
        return best[1]

    draw, same, all_ = random.Random(3), 0, 0
    for _ in range(4):
        counts = {f"w{draw.randrange(10**6)}": draw.choice([1, 1, 2, 7, 300]) for _ in range(25)}
        text = " ".join(w for w, n in counts.items() for _ in range(n))
        got = fingerprints.Sampler(kept_terms=1000).fingerprint(text)
        same += sum(int(x) == sample(counts, k) for k, x in enumerate(got, 1))
        all_ += len(got)
    assert same >= 0.99 * all_


def test_known_terms_may_be_forgotten_at_any_time():
    texts = [" ".join(f"t{(i * 37 + j * j) % 700}" for j in range(120)) for i in range(60)]
    small, large = fingerprints.Sampler(kept_terms=300, block=64), fingerprints.Sampler()
    assert all((small.fingerprint(t) == large.fingerprint(t)).all() for t in texts + texts)
