"""Format-preserving pseudonyms of personal values: keyed Feistel permutations; DataFrame functions only."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, those that PATTERNS finds, as the two factors of the permuted domain.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "date": r"(?<![\w./-])(?:(?:19|20)\d\d([./-])\d\d\1\d\d|\d\d([./-])\d\d\2(?:19|20)\d\d)(?![\w]|[./-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "phone": r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}|(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d)[ .-]\d{4}(?!\w)",
    # A whole run of numbers, up to a social security number: the cards in it are looked for between its separators.
    "card": r"(?<![\w.-])\d(?:(?:[ -](?!\d{3}-\d{2}-\d{4}(?![\w-])))?\d){12,}+(?![\w-])",
}
ANY = "|".join(f"(?:{p})" for p in [PATTERNS["email"], PATTERNS["date"], PATTERNS["ssn"], PATTERNS["ip"], PATTERNS["phone"], PATTERNS["card"]])
USUAL = r"^(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})[ -]?$"
OTHER = "|".join(f"(?:{PATTERNS[p]})" for p in ["date", "ssn", "ip", "phone"])
#: Spark setting that holds the secret key of op8 and the pipeline; unset, each run draws one and its values link within it.
KEY_SETTING = "spark.rastermill.pseudonym.key"
#: First serials of social security numbers: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
SSN = r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"


def _digest(key: str, kind: str, i: Column, x: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256)


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def permute(value: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1: the quotient and remainder by b are shifted in turn by a digest of the other."""
    start = F.struct(((value - value % b) / b).cast("long").alias("l"), (value % b).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        shift = _number(F.substring(_digest(key, kind, i, F.when(odd, s["r"]).otherwise(s["l"])), 1, 12))
        return F.struct(F.when(odd, (s["l"] + shift) % a).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise((s["r"] + shift) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, one after another."""
    before = lambda i: F.length(_digits(F.substr(template, F.lit(1), i)))
    return F.array_join(F.transform(F.split(template, ""), lambda ch, i: F.when(ch.rlike("^[0-9]$"), F.substr(digits, before(i) + 1, F.lit(1))).otherwise(ch)), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, counted from the last digit on."""
    value = lambda ch, i: F.when(i % 2 == 0, ch.cast("int")).otherwise(2 * ch.cast("int") - F.when(ch.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> Column:
    """Brand digit and length stay, the middle is permuted, the check digit is made valid again. Not valid: untouched."""
    d = _digits(m)
    k = F.length(d) - 2
    half = lambda n: F.pow(F.lit(10.0), n).cast("long")
    low = F.floor(k / 2).cast("int")
    middle = permute(F.substr(d, F.lit(2), k).cast("long"), half(k - low), half(low), key, "card")
    body = F.concat(F.substring(d, 1, 1), F.lpad(middle.cast("string"), k, F.lit("0")))
    full = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    return F.when(_luhn(d) % 10 == 0, _refill(m, full)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    parts = [p[i].cast("long") for i in range(4)]
    n = permute(parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, "ip")
    spread = F.transform(F.array(n), lambda v: F.concat_ws(".", F.shiftright(v, 24).cast("string"), (F.shiftright(v, 16) % 256).cast("string"), (F.shiftright(v, 8) % 256).cast("string"), (v % 256).cast("string")))
    return F.when(F.greatest(*parts) <= 255, spread[0]).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The ten national digits are permuted among the numbers whose area and exchange start with 2 to 9; of other
    numbers (written with +1) those two digits stay and the eight others are permuted."""
    d = F.substr(_digits(m), F.length(_digits(m)) - 9, F.lit(10))
    n = permute((F.substring(d, 1, 3).cast("long") - 200) * 8_000_000 + (F.substring(d, 4, 3).cast("long") - 200) * 10_000 + F.substring(d, 7, 4).cast("long"), F.lit(80_000), F.lit(80_000), key, "phone")
    spread = lambda v: F.concat((F.floor(v / 8_000_000) + 200).cast("string"), (F.floor(v / 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0"))
    eight = F.lpad(permute(F.concat(F.substring(d, 2, 2), F.substring(d, 5, 6)).cast("long"), F.lit(10_000), F.lit(10_000), key, "phone8").cast("string"), 8, "0")
    other = lambda e: F.concat(F.substring(d, 1, 1), F.substring(e, 1, 2), F.substring(d, 4, 1), F.substring(e, 3, 6))
    ten = F.when(d.rlike("^[2-9]..[2-9]"), F.transform(F.array(n), spread)[0]).otherwise(F.transform(F.array(eight), other)[0])
    lead = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
    return _refill(m, F.concat(lead, ten))


def _ssn(m: Column, key: str) -> Column:
    """Permuted among the numbers that can be issued (see SSN); others stay."""
    d, many = _digits(m), 99 * 9999
    area, group, serial = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 2).cast("long"), F.substring(d, 6, 4).cast("long")
    n = permute((area - F.when(area > 666, 2).otherwise(1)) * many + (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(many), key, "ssn")
    at = F.floor(n / many)
    spread = lambda v, at: F.concat(F.lpad((at + F.when(at >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(v % many / 9999) + 1).cast("string"), 2, "0"), F.lpad((v % 9999 + 1).cast("string"), 4, "0"))
    return F.when(m.rlike(SSN), _refill(m, spread(n, at))).otherwise(m)


def _date(m: Column, key: str) -> Column:
    d = _digits(m)
    first = m.rlike(r"^\d{4}")
    year, month, day = F.when(first, F.substring(d, 1, 4)).otherwise(F.substring(d, 5, 4)), F.when(first, F.substring(d, 5, 2)).otherwise(F.substring(d, 3, 2)), F.when(first, F.substring(d, 7, 2)).otherwise(F.substring(d, 1, 2))
    month, day = F.when(~first & (month.cast("int") > 12), day).otherwise(month), F.when(~first & (month.cast("int") > 12), month).otherwise(day)
    swapped = ~first & (F.substring(d, 3, 2).cast("int") > 12)
    when = F.concat_ws("-", year, month, day).try_cast("date")
    n = permute(F.datediff(when, F.lit(FIRST_DAY).cast("date")).cast("long"), F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")
    to = F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    digits = F.when(first, F.date_format(to, "yyyyMMdd")).when(swapped, F.date_format(to, "MMddyyyy")).otherwise(F.date_format(to, "ddMMyyyy"))
    return F.when(when.isNull(), m).otherwise(_refill(m, digits))


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part (lower case) are shifted within their class: a Feistel network on its halves."""
    local = F.lower(F.substring_index(m, "@", 1))
    half = F.floor(F.length(local) / 2).cast("int")

    def shift(s: Column, digest: Column) -> Column:
        by = lambda i: _number(F.substr(digest, (2 * i) % 64 + 1, F.lit(2)))
        turn = lambda ch, i: F.when(ch.between("0", "9"), F.char(48 + (F.ascii(ch) - 48 + by(i)) % 10)).when(ch.between("a", "z"), F.char(97 + (F.ascii(ch) - 97 + by(i)) % 26)).otherwise(ch)
        return F.array_join(F.transform(F.split(s, ""), turn), "")

    start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, shift(s["l"], _digest(key, "email", i, s["r"]))).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(shift(s["r"], _digest(key, "email", i, s["l"]))).alias("r"))

    return F.concat(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"])), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of OTHER or an e-mail address, or the match itself if it isn't valid for its kind."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    return (
        F.when(m.contains("@"), _email(m, key)).when(m.rlike(whole["date"]), _date(m, key)).when(m.rlike(whole["ssn"]), _ssn(m, key))
        .when(m.rlike(whole["ip"]), _ip(m, key)).when(m.rlike(whole["phone"]), _phone(m, key)).otherwise(m)
    )


def _run(m: Column, layout: str) -> Column:
    """A run of numbers as parts (x, card): cards are the leftmost, then longest, runs of 13 to 19 digits between
    separators that have the layout and a valid Luhn sum; what lies between them are the other parts."""
    words = F.split(m, "(?<=[ -])")  # each with its separator
    between = lambda i, j: F.array_join(F.slice(words, i, j - i + 1), "")
    valid = lambda x: x.rlike(layout) & F.length(_digits(x)).between(13, 19) & (_luhn(_digits(x)) % 10 == 0)

    def step(s: Column, i: Column) -> Column:
        ends = F.filter(F.sequence(i, F.least(i + 18, F.size(words))), lambda j: valid(between(i, j)))
        last = F.when(i >= s["next"], F.array_max(ends))
        before, part = F.try_element_at(s["parts"], F.lit(-1)), lambda x, card: F.array(F.struct(x.alias("x"), F.lit(card).alias("card")))
        longer = F.concat(F.slice(s["parts"], 1, F.size(s["parts"]) - 1), part(F.concat(before["x"], F.element_at(words, i)), False))
        parts = F.when(i < s["next"], s["parts"]).when(last.isNotNull(), F.concat(s["parts"], part(between(i, last), True))).when(~before["card"], longer).otherwise(F.concat(s["parts"], part(F.element_at(words, i), False)))
        return F.struct(F.greatest(s["next"], F.coalesce(last, i) + 1).alias("next"), parts.alias("parts"))

    start = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<struct<x:string,card:boolean>>)").alias("parts"))
    return F.aggregate(F.sequence(F.lit(1), F.size(words)), start, step, lambda s: s["parts"])


def _values(m: Column, key: str) -> Column:
    """(s, n): one match of ANY with its values replaced, and how many they are. A run of numbers can hold several."""
    pair = lambda s, n: F.struct(s.alias("s"), n.cast("int").alias("n"))

    def others(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(OTHER), F.lit(0))
        new = F.transform(found, lambda v: pseudonym(v, key))
        joined = F.array_join(F.zip_with(F.split(x, OTHER, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return pair(joined, F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda c: c)))

    def card(x: Column) -> Column:
        new = _card(x, key)
        return pair(new, new != x)

    # The usual layouts first, so that no chance sum of other numbers breaks such a card.
    runs = F.flatten(F.transform(_run(m, USUAL), lambda p: F.when(p["card"], F.array(p)).otherwise(_run(p["x"], "."))))
    parts = F.transform(runs, lambda p: F.when(p["card"], card(p["x"])).otherwise(others(p["x"])))
    whole = pair(F.array_join(F.transform(parts, lambda p: p["s"]), ""), F.aggregate(F.transform(parts, lambda p: p["n"]), F.lit(0), lambda a, b: a + b))
    new = pseudonym(m, key)
    return F.when(m.rlike(f"^(?:{PATTERNS['card']})$") & ~m.rlike(f"^(?:{OTHER})$"), whole).otherwise(pair(new, new != m))


def secret_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING, or a new random one where it is unset."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with personal values in `text_col` replaced; with count_col also how many values were replaced.

    Kinds: e-mail addresses, payment cards (Luhn), IPv4 addresses (octets up to 255), North American telephone numbers,
    social security numbers, dates from 1900 to 2100 (a calendar's days). Equal values get equal pseudonyms in every
    document, different values of a format different ones, and separators stay; numbers and dates that are not valid stay
    (social security numbers of areas 000, 666 and 9xx, group 00 or serial 0000 among them). The caller owns the key: it
    undoes the pseudonyms. The local part of an address is permuted in lower case, its domain stays. Each
    text, however long, is cut at the matches, whole and within its row: no shuffle. Null and empty texts stay; repeated
    rows are treated each; an empty table gives an empty one; other columns stay, whatever their names.
    """
    text = F.col(text_col)
    found, parts, new = (f"{text_col}_{x}_{'x' * max(map(len, docs.columns))}" for x in ("found", "parts", "new"))
    maybe = text.rlike("[0-9@]") & text.rlike(ANY)
    d = docs.withColumn(found, F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    d = d.withColumn(new, F.transform(found, lambda m: _values(m, key)))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(F.transform(new, lambda v: v["s"]), F.array(F.lit(""))), lambda s, m: F.concat(s, m)), "")
    if count_col:
        d = d.withColumn(count_col, F.coalesce(F.aggregate(F.transform(new, lambda v: v["n"]), F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    return d.withColumn(text_col, F.when(F.col(found).isNull(), text).otherwise(joined)).drop(found, parts, new)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in their texts: doc_id, text, n_values."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key(spark), count_col="n_values")
