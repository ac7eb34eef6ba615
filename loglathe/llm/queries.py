"""One query for each operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, fingerprints, line_runs, odd_sketches, phrases, pseudonyms, secrets, token_files, toxicity, url_cascade, warc_bundles, whitening
from .shared import scratch, table

#: The rules of the url query, (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The key of the query where the session has none; a real one comes from the session's configuration.
PSEUDONYM_KEY = ("spark.loglathe.pseudonyms.key", "no secret")


def held_out(doc_id=None):
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents, one row for each document and benchmark item."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), eligible=~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc-bundles")
    index = warc_bundles.write_bundles(table(spark, sf_dir, "pages"), folder)
    return warc_bundles.read_bundles(index, folder)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.library_encode(F.col("text"), end_id=0).alias("ids"))
    return token_files.token_files(spark, docs, folder, width=bpe.id_width(bpe.default_vocabulary()))[1]


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "documents").select("doc_id", bpe.round_trip(F.col("text")).alias("coded"))
    return coded.select("doc_id", "coded.*").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(*PSEUDONYM_KEY))


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketches.linked(table(spark, sf_dir, "documents"), words=2, similarity="0.8")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), most=32)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, first=2000, percent=80)


_ALL = [op1_decontamination, op2_toxicity, op3_warc_bundles, op4_token_files, op5_bpe, op6_pseudonyms, op7_url_cascade, op8_fingerprints, op9_near_dedup, op10_line_dedup, op11_secrets, op12_whitening, op13_phrases]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


def _base_sql() -> str:
    """Spans of the known forms: lengths of the gaps between matches and of the matches, summed up."""
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.BASE.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(range(len(f))) AS i, f, m, g, {least} AS least FROM
            (SELECT doc_id, regexp_extract_all(text, '{p}') AS f, regexp_extract_all(text, '{p}', {group}) AS m, string_split_regex(text, '{re.sub(r"[(](?![?])", "(?:", p)}') AS g FROM t)""")
    return " UNION ALL ".join(parts)


def _tense_sql() -> str:
    """Candidates, each with its place in the text."""
    parts = []
    for rank, (kind, (one, symbols, window, entropy)) in enumerate(secrets.CLASSES.items(), len(secrets.BASE)):
        p = f"{one}{{{window},}}"
        lower = "lower(x)" if symbols == symbols.lower() else "x"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, i, {window} AS w, {secrets.most_weight(window, entropy)} AS lim, f[i + 1] AS x, {lower.replace("x", "f[i + 1]")} AS y, f, g FROM
            (SELECT *, unnest(range(len(f))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS g FROM t))""")
    return " UNION ALL ".join(parts)


_WEIGHTS = secrets.weights(max(window for _, _, window, _ in secrets.CLASSES.values()))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op3_warc_bundles": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
        g AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM d LEFT JOIN g ON d.digest = g.digest""",
    "op7_url_cascade": f"""
        WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parsed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
                          coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
        ranked AS (SELECT p.*, r.host || r.path AS rule, r.verdict,
                          row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
                   FROM parsed p LEFT JOIN rules r
                   ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE k = 1""",
    "op10_line_dedup": f"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM cut),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
        f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        j AS (SELECT k.*, coalesce(f.keeper <> doc_id, false) AS dropped FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op11_secrets": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        b0 AS ({_base_sql()}),
        b AS (SELECT doc_id, rank, kind, coalesce(list_sum(list_transform(f[1:i], lambda a: length(a))), 0) + list_sum(list_transform(g[1:i + 1], lambda a: length(a))) AS s, length(f[i + 1]) AS n FROM b0 WHERE length(m[i + 1]) >= least),
        c0 AS ({_tense_sql()}),
        c AS (SELECT doc_id, rank, kind, w, lim, x, y, coalesce(list_sum(list_transform(f[1:i], lambda a: length(a))), 0) + list_sum(list_transform(g[1:i + 1], lambda a: length(a))) AS s FROM c0
              WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND NOT ({" OR ".join(f"regexp_matches(x, '{form}')" for form in secrets.ALLOW)})),
        win AS (SELECT *, unnest(range(length(x) - w + 1)) AS p FROM c),
        ch AS (SELECT doc_id, rank, kind, w, lim, x, s, p, substr(y, p + unnest(range(w)) + 1, 1) AS l FROM win),
        cnt AS (SELECT doc_id, rank, kind, w, lim, x, s, p, l, count(*) AS k FROM ch GROUP BY ALL),
        hot AS (SELECT doc_id, rank, kind, w, x, s, p FROM cnt GROUP BY doc_id, rank, kind, w, lim, x, s, p HAVING sum({_WEIGHTS}[k + 1]) <= lim),
        cut AS (SELECT *, CASE WHEN lag(p) OVER (PARTITION BY doc_id, rank, s ORDER BY p) >= p - w THEN 0 ELSE 1 END AS begins FROM hot),
        isle AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id, rank, s ORDER BY p) AS no FROM cut),
        e AS (SELECT doc_id, rank, kind, s + min(p) AS s, max(p) + w - min(p) AS n, substr(x, min(p)::INT + 1, (max(p) + w - min(p))::INT) AS y FROM isle GROUP BY doc_id, rank, kind, w, x, s, no),
        every AS (SELECT doc_id, rank, kind, s, n, true AS base FROM b UNION ALL SELECT doc_id, rank, kind, s, n, false FROM e WHERE regexp_matches(y, '[0-9]') AND regexp_matches(y, '[A-Za-z]')),
        r AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank) FILTER (base) AS base, string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank) AS spans FROM every GROUP BY doc_id)
        SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN r ON t.doc_id = r.doc_id""",
    "op13_phrases": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
        cuts AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM c),
        s AS (SELECT c.lang, c.k, c.phrase, c.a, c.j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score FROM cuts c
              JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.j + 1:], ' ')),
        b AS (SELECT lang, k, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        q AS (SELECT lang, a, ws, unnest(range(2, k)) AS m FROM (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE k > 2)),
        i AS (SELECT lang, a, unnest(list_transform(range(1, len(ws) - m + 2), lambda x: array_to_string(ws[x:x + m - 1], ' '))) AS phrase FROM q),
        o AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
        d AS (SELECT b.* FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase WHERE o.longer IS NULL OR 100 * o.longer < 80 * b.a),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM d)
        SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON z.lang = n.lang WHERE rank <= 2000""",
}
