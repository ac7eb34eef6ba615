"""Format-preserving pseudonyms by a keyed Feistel network.

Validated values in a text are replaced by values of the same format, by a
keyed permutation of the format's values: the same value always gets the same
pseudonym, in every document, and different values get different ones.

- card numbers (13 to 19 digits that pass the Luhn test, in one piece or in
  groups with blanks, hyphens or dots): the digits
  before the check digit are permuted and the check digit is computed anew; in a
  longer run of digit groups, every stretch of whole groups is tried, the longest
  first;
- IBANs (mod-97 test), in one piece or in groups of four, tried likewise: the
  account part is permuted and the check digits are computed anew;
- dates (ISO, or day and month with ``/`` or ``.`` and a year from 1800 to 2199):
  the day number is permuted within the 146,097 days of the 400 years; where only
  month and day can be meant, within the days after the 12th, so that the result
  reads the same way;
- IPv4 addresses: both 16-bit halves are permuted against each other;
- telephone numbers, US social security numbers and e-mail names: digits and
  letters are permuted within their classes, all else stays.

Out of form, and left as they are: card numbers with a letter right before or
after them (card4111..., 4111...x), or with other separators (``/``, ``_``);
IBANs in lower case; of an e-mail name over 64 characters, all but the last 64.

Only Spark expressions are used: texts are split at the found values, and the
values alone are transformed. All rounds are SHA-2 over the key, which is a
parameter.

Defined results: null texts stay null; empty texts and texts without values stay
as they are; texts of any length are searched whole; characters that are no part
of a value stay, control characters too; equal rows have equal results; an empty
table gives an empty result; all other columns stay, but columns named
n_replaced, kinds and __parts are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\x01"
#: A text's own U+0001 and U+0002 during the work.
ESCAPED = (("\x02", "\x02\x04"), (MARK, "\x02\x03"))
#: The forms that are looked for, in order.
FORMS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "date": r"(?<![\d./-])(?:(?:18|19|20|21)\d{2}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.](?:18|19|20|21)\d{2})(?![\d/-]|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z])\d(?:[ .-]?\d){12,18}(?![\dA-Za-z])",
}
#: Runs of groups in which stretches are tried: grouped IBANs, cards. Nothing is given back once taken, so runs of any length need no stack.
IBAN_RUN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ -][A-Z0-9]{4}(?![A-Za-z0-9])){2,}+(?:[ -][A-Z0-9]{1,3}(?![A-Za-z0-9]))?+"
CARD_RUN = r"(?<![\dA-Za-z+])(?=\d(?:[ .-]?\d){12})\d++(?![A-Za-z])(?:[ .-]\d++(?![A-Za-z]))*+"
CARD_DIGITS, IBAN_CHARS = (13, 19), (15, 34)
IBAN_GROUPS = r"[A-Z]{2}\d{2}(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,3})?"
ROUNDS, EPOCH, DAYS = 8, "1800-01-01", (189, 773)


def _round(key: str, tag: str, n: Column, value: Column) -> Column:
    """A keyed pseudo-random non-negative number below 2**52."""
    text = F.concat(F.lit(f"{key}|{tag}|"), n.cast("string"), F.lit("|"), value)
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def feistel_numbers(left: Column, right: Column, low: int, high: int, key: str, tag: str) -> tuple[Column, Column]:
    """Permute pairs of 0 <= left < low and 0 <= right < high."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(state: Column, n: Column) -> Column:
        a = F.pmod(state["a"] + _round(key, tag + "a", n, state["b"].cast("string")), F.lit(low))
        return F.struct(a.cast("long").alias("a"), state["b"].alias("b"))

    def turn_back(state: Column, n: Column) -> Column:
        b = F.pmod(state["b"] + _round(key, tag + "b", n, state["a"].cast("string")), F.lit(high))
        return F.struct(state["a"].alias("a"), b.cast("long").alias("b"))

    done = start
    for n in range(ROUNDS // 2):
        for step in (turn, turn_back):
            done = F.aggregate(F.array(F.lit(n)), done, step)
    return done["a"], done["b"]


def _shift(char: Column, by: Column) -> Column:
    """Move a digit or letter within its class; other characters stay."""
    out = char
    for letters in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
        at = F.instr(F.lit(letters), char) - 1
        out = F.when((at >= 0) & (char != ""), F.substring(F.lit(letters), F.pmod(at + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(out)
    return out


def feistel_chars(value: Column, key: str, tag: str) -> Column:
    """Permute strings of one pattern of classes: each half is shifted by keyed numbers of the other half.

    A round's numbers are 16-bit pieces of SHA-512 over key, round, pattern and
    the other half; a half of over 32 characters takes as many digests as it needs.
    """
    half = F.floor(F.length(value) / 2).cast("int")
    shape = F.translate(value, string.digits + string.ascii_lowercase + string.ascii_uppercase, "0" * 10 + "a" * 26 + "A" * 26)
    start = F.struct(F.substring(value, F.lit(1), half).alias("x"), F.substring(value, half + 1, F.length(value)).alias("y"))

    def turn(state: Column, n: Column) -> Column:
        message = F.concat(F.lit(f"{key}|{tag}|"), n.cast("string"), F.lit("|"), shape, F.lit("|"), state["y"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(state["x"]) / 32).cast("int")), lambda b: F.sha2(F.concat(b.cast("string"), F.lit("|"), message), 512))
        by = lambda digests, i: F.conv(F.substring(digests, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        moved = _with(F.array_join(blocks, ""), lambda digests: F.array_join(F.transform(F.split(state["x"], ""), lambda c, i: _shift(c, by(digests, i))), ""))
        return F.struct(state["y"].alias("x"), moved.alias("y"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    return F.concat(done["x"], done["y"])


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last one has weight 1."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2 - 1, F.lit(9)) + F.when(d == "0", 0 - F.lit(8)).otherwise(1)))
    return F.aggregate(places, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _filled(value: Column, new: Column) -> Column:
    """``value`` with its k-th digit or letter replaced by the k-th character of ``new``."""
    step = lambda a, c: F.when(F.rlike(c, F.lit("[A-Za-z0-9]")), F.struct(F.concat(a["s"], F.substring(new, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step)["s"]


def is_card(digits: Column) -> Column:
    return F.length(digits).between(*CARD_DIGITS) & (F.pmod(luhn_sum(digits), F.lit(10)) == 0) & (F.length(F.replace(digits, F.lit("0"))) > 0)


def card(value: Column, key: str) -> Column:
    """Same separators and length, a valid check digit; null if not valid."""
    digits = F.regexp_replace(value, r"\D", "")
    body = feistel_chars(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    new = F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(is_card(digits), _with(new, lambda n: _filled(value, n)))


def _mod97(text: Column) -> Column:
    """Remainder of the number that a string of digits and capitals stands for."""
    value = lambda c: F.instr(F.lit(string.digits + string.ascii_uppercase), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(F.pmod(r * F.when(value(c) < 10, 10).otherwise(100) + value(c), F.lit(97)).cast("int")))


def is_iban(text: Column) -> Column:
    return F.length(text).between(*IBAN_CHARS) & (_mod97(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4))) == 1)


def iban(value: Column, key: str) -> Column:
    plain = F.regexp_replace(value, "[ -]", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = feistel_chars(body, key, "iban")
    whole = _with(new, lambda n: F.concat(country, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
    return F.when(is_iban(plain), _with(whole, lambda w: F.when(plain == value, w).otherwise(_filled(value, w))))


def _permuted_day(day: Column, key: str) -> Column:
    low, high = DAYS
    a, b = feistel_numbers(F.floor(day / high), F.pmod(day, F.lit(high)), low, high, key, "date")
    return (a * high + b).cast("int")


def date(value: Column, key: str) -> Column:
    epoch = F.lit(EPOCH).cast("date")
    iso = F.substring(value, 5, 1) == "-"
    mark = F.when(iso, F.lit("-")).otherwise(F.substring(value, 3, 1))
    plain = F.when(iso, value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    new = F.date_add(epoch, _permuted_day(F.datediff(F.try_to_date(plain, "yyyy-MM-dd"), epoch), key))
    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy")))
    # month first: the permutation is repeated until the day is after the 12th again (a bijection; 0.4 ** 64 is left)
    late = lambda n: F.dayofmonth(F.date_add(epoch, n)) > 12
    american = F.datediff(F.try_to_date(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2)), "yyyy-MM-dd"), epoch)
    turn = lambda s, i: F.when((i > 1) & late(s), s).otherwise(_permuted_day(s, key))
    other = F.date_add(epoch, F.aggregate(F.sequence(F.lit(1), F.lit(64)), american, turn))
    us = F.concat(F.date_format(other, "MM"), mark, F.date_format(other, "dd"), mark, F.date_format(other, "yyyy"))
    return F.when(~iso & (F.substring(value, 4, 2) > "12"), us).otherwise(out)


def ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    at = lambda i: F.get(parts, F.lit(i))
    a, b = feistel_numbers(at(0) * 256 + at(1), at(2) * 256 + at(3), 65536, 65536, key, "ip")
    octet = lambda x, by: F.pmod(F.floor(x / by), F.lit(256)).cast("string")
    return F.when(F.forall(parts, lambda x: x <= 255), F.concat_ws(".", octet(a, 256), octet(a, 1), octet(b, 256), octet(b, 1)))


def email(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    return F.concat(feistel_chars(name, key, "email"), F.substring(value, F.length(name) + 1, F.length(value)))


def phone(value: Column, key: str) -> Column:
    """The country code stays."""
    head = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)
    return F.concat(head, feistel_chars(F.substring(value, F.length(head) + 1, F.length(value)), key, "phone"))


def _within(text: Column, form: str, change) -> Column:
    """``change`` of all that fits ``form`` outside the marked values of ``text``."""
    either = f"{MARK}[^{MARK}]*+{MARK}|(?:{form})"
    found, gaps = F.regexp_extract_all(text, F.lit(either), F.lit(0)), F.split(text, either)
    one = lambda gap, x: F.when(x.isNull(), gap).otherwise(F.concat(gap, F.when(F.startswith(x, F.lit(MARK)), x).otherwise(change(x))))
    return F.when(F.rlike(text, F.lit(form)), F.array_join(F.zip_with(gaps, found, one), "")).otherwise(text)


def _stretches(run: Column, valid, most: int) -> Column:
    """``run`` with its valid stretches of at most ``most`` whole groups marked: the longest first, none over another.

    What is taken is drawn in a string with a letter for each group: F the first
    of a stretch, L the last, B both, I between.
    """
    groups = F.split(run, "[ .-]")

    def candidates(groups: Column) -> Column:
        last = F.size(groups) - 1
        one = lambda a, b: F.struct((-F.length(F.array_join(F.slice(groups, a + 1, b - a + 1), ""))).alias("n"), a.alias("a"), (b - a + 1).alias("groups"))
        fits = lambda x: valid(F.array_join(F.slice(groups, x["a"] + 1, x["groups"]), " "), -x["n"])
        found = lambda a: F.filter(F.transform(F.sequence(a, F.least(a + most - 1, last)), lambda b: one(a, b)), fits)
        return F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), last), found)))

    def take(drawn: Column, x: Column) -> Column:
        new = F.when(x["groups"] == 1, F.lit("B")).otherwise(F.concat(F.lit("F"), F.repeat(F.lit("I"), x["groups"] - 2), F.lit("L")))
        free = F.substring(drawn, x["a"] + 1, x["groups"]) == F.repeat(F.lit("."), x["groups"])
        return F.when(free, F.overlay(drawn, new, x["a"] + 1)).otherwise(drawn)

    def marked(drawn: Column) -> Column:
        letters, gaps = F.split(drawn, ""), F.split(run, "[A-Z0-9]+")
        mark = lambda c, kinds: F.when(c.isin(*kinds), F.lit(MARK)).otherwise(F.lit(""))
        parts = F.zip_with(groups, letters, lambda x, c: F.concat(mark(c, "FB"), x, mark(c, "LB")))
        return F.when(F.contains(drawn, F.lit("L")) | F.contains(drawn, F.lit("B")), F.array_join(F.zip_with(gaps, parts, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")).otherwise(run)

    return _with(_with(groups, lambda g: F.aggregate(candidates(g), F.repeat(F.lit("."), F.size(g)), take)), marked)


def _card_run(run: Column) -> Column:
    return _stretches(run, lambda s, n: n.between(*CARD_DIGITS) & _with(F.replace(s, F.lit(" ")), is_card), CARD_DIGITS[1])


def _iban_run(run: Column) -> Column:
    """Groups have four characters, so a stretch has at most nine."""
    return _stretches(run, lambda s, n: n.between(*IBAN_CHARS) & F.rlike(s, F.lit(f"^{IBAN_GROUPS}$")) & is_iban(F.replace(s, F.lit(" "))), 9)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with values replaced in ``text_col``; adds n_replaced and kinds (sorted, distinct)."""
    text = F.col(text_col)
    others = "|".join(form for kind, form in FORMS.items() if kind != "card")
    any_form = "|".join([*FORMS.values(), IBAN_RUN])
    # odd places of the split are values; cards come after the other forms, in what these leave
    own = F.rlike(text, F.lit("[\x01\x02]"))
    plain = F.when(own, F.replace(F.replace(text, *map(F.lit, ESCAPED[0])), *map(F.lit, ESCAPED[1]))).otherwise(text)
    marked = _within(plain, IBAN_RUN, _iban_run)
    marked = _within(marked, others, lambda p: F.concat(F.lit(MARK), p, F.lit(MARK)))
    parts = F.split(_within(marked, CARD_RUN, _card_run), MARK)
    make = {"email": email, "iban": iban, "ip": ip, "date": date, "phone": phone, "ssn": lambda v, k: feistel_chars(v, k, "ssn"), "card": card}

    def one(part: Column, i: Column) -> Column:
        out = F.struct(part.alias("s"), F.lit("").alias("kind"))
        for kind in reversed(FORMS):
            form = FORMS[kind] + (f"|{IBAN_GROUPS}" if kind == "iban" else "")
            fits = (i % 2 == 1) & F.rlike(part, F.lit(f"^(?:{form})$"))
            new = make[kind](part, key)
            out = F.when(fits & new.isNotNull(), F.struct(new.alias("s"), F.lit(kind).alias("kind"))).otherwise(out)
        return out

    changed = F.transform(parts, one)
    hit = F.rlike(text, F.lit(any_form))
    done = docs.withColumn("__parts", F.when(hit, changed))
    kinds = F.filter(F.coalesce(F.col("__parts.kind"), F.array().cast("array<string>")), lambda k: k != "")
    joined = F.array_join(F.col("__parts.s"), "")
    back = F.replace(F.replace(joined, *map(F.lit, ESCAPED[1][::-1])), *map(F.lit, ESCAPED[0][::-1]))
    new = F.when(F.col("__parts").isNull(), text).otherwise(F.when(own, back).otherwise(joined))
    return done.withColumns({text_col: new, "n_replaced": F.size(kinds).cast("long"), "kinds": F.array_sort(F.array_distinct(kinds))}).drop("__parts")
