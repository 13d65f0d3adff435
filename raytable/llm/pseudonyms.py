"""PII: format-preserving Feistel pseudonyms for validated numbers and dates, built from DataFrame functions alone.

One expression finds candidates; each is validated by its own rule (Luhn sum, octet range, calendar, number plan) and, if
valid, replaced by the value that a keyed permutation of its format gives: card numbers keep length, separators and a right
check digit, addresses stay addresses, dates stay dates of the same notation, telephone numbers keep their leading digits
(numbers with '+' may be grouped in any way; a digit group after a space may be read as part of them, up to 15 digits in all).
The permutation works on the value, not on its spelling, so equal values stay linked across documents and notations, and the
holder of the key can undo it. Addresses of persons (mail) and secrets have no numeric domain; they get keyed digests of
the same length. A secret reaches to its last letter, digit or one of ``+/=_-`` before a space, quote, bracket or one of ``,;&|``,
whatever its length; a punctuation mark behind that stays. Invalid candidates (a number that fails its check sum, a date that does not exist) are left alone.

A Feistel network runs over a rectangle left x right that is exactly the format's domain, so no value leaves it; a round
function is a keyed SHA-256. Texts are rebuilt from the gaps between candidates and the pseudonyms; nothing is shuffled.

Defined cases: a null text stays null, a text without candidates is untouched; rows are treated one by one; extra columns
pass through; candidates are tried in the order of ``PATTERNS`` and do not overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare

ROUNDS = 8
KEY = "corpus-pseudonyms"  # production callers pass their own secret
FIRST_DAY, LAST_DAY = "1900-01-01", "2100-01-01"  # 73050 days: 487 x 150
DAYS = (487, 150)

_ALONE, _END = r"(?<![\p{L}\p{N}.])", r"(?![\p{L}\p{N}])"
_KEY_WORDS = "(?i:token|secret|password|key)"
_PART = "[A-Za-z0-9+/_-]"
_OTHER = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -]|(?:[0-9]{1,3}\.){3}[0-9]|[0-9]{3}-[0-9]{2}-[0-9]{4}"  # not the next digit group of a telephone number
# Repeated groups are possessive: they run as loops, so no text is too long for the stack, and a run is looked at once.
_LOCAL, _LABEL, _SHORT = r"[\p{L}\p{N}._%+-]", "[A-Za-z0-9-]", r"(?:\.(?![A-Za-z]{2})[A-Za-z0-9-]++)*+"  # _SHORT: labels that cannot end a domain
PATTERNS = {
    "mail": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:{_SHORT}\.[A-Za-z]{{2,}}+{_LABEL}*+(?={_SHORT}\.[A-Za-z]{{2}}))*+{_SHORT}\.[A-Za-z]{{2,}}+",
    "secret": rf"""(?<=["'])[0-9A-Fa-f]{{32,}}+(?=["'])|(?<={_KEY_WORDS} {{0,2}}[=:] {{0,2}}["']?)(?:{_PART}{{1,15}}[.~]){{0,4}}{_PART}{{16,}}(?:[^\s"'`<>()\[\]{{}},;&|]*[\p{{L}}\p{{N}}+/=_-])?""",
    "address": _ALONE + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\p{L}\p{N}])",
    "date": _ALONE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _END,
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _END + r"|\+[0-9](?:(?:[./-]|[ \u00A0](?!" + _OTHER + r"))?\(?[0-9]\)?){7,14}(?![\p{L}\p{N}]|[./-][0-9])|" + _ALONE + r"(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}" + _END,
    "person": _ALONE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _ALONE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
SECRETS = "|".join(f"({p})" if k == "secret" else f"(?:{p})" for k, p in PATTERNS.items())  # the same, secrets in group 1
#: Every candidate holds a digit or '@', stands behind a key word, or is quoted hex of letters alone.
MAY_HOLD = f"""[0-9@]|{_KEY_WORDS} {{0,2}}[=:]|["'][A-Fa-f]{{32}}"""
_DATES = [("[0-9]{4}-.*", "yyyy-MM-dd"), ("../../....", "dd/MM/yyyy"), ("../../....", "MM/dd/yyyy"), (r"..\...\.....", "dd.MM.yyyy")]


def _prf(key: str, kind: str, n: Column, half: Column) -> Column:
    """Keyed non-negative number below 16**15."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def permute(x: Column, left: Column, right: Column, key: str, kind: str) -> Column:
    """Keyed permutation of 0 .. left*right-1, an even number of rounds that swap the halves."""
    start = F.struct(F.call_function("div", x, right).alias("a"), (x % right).alias("b"))

    def step(half: Column, n: Column) -> Column:
        size = F.when(n % 2 == 0, left).otherwise(right)
        return F.struct(half["b"].alias("a"), F.pmod(half["a"] + F.pmod(_prf(key, kind, n, half["b"]), size), size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda half: half["a"] * right + half["b"])


def _power(digits: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), (digits + 1).cast("int"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(d)
    low = F.call_function("div", n, F.lit(2)).cast("int")
    return F.lpad(permute(d.cast("long"), _power(n - low), _power(low), key, kind).cast("string"), n, "0")


def _luhn_sum(d: Column) -> Column:
    """Sum of the Luhn check over digits that a check digit will follow."""
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, F.call_function("div", c.cast("int") * 2, F.lit(10)) + c.cast("int") * 2 % 10).otherwise(c.cast("int").cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b)


def _with_digits(m: Column, new: Column) -> Column:
    """``m`` with its digits replaced, one by one, by those of ``new``."""
    def char(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.substring(new, F.length(_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(m, ""), char), "")


def _card(m: Column, key: str) -> Column:
    d = _digits(m)
    body = F.substring(d, F.lit(1), F.length(d) - 1)
    new = _permuted_digits(body, key, "card")
    check = F.pmod(-_luhn_sum(new), F.lit(10)).cast("string")
    return F.when(F.call_function("luhn_check", d) & ~d.rlike("^(.)\\1*$"), _with_digits(m, F.concat(new, check))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    own = F.least(F.length(d) - 1, F.lit(10))
    own = F.when(m.startswith("+"), own).otherwise(F.length(d))
    head = F.substring(d, F.lit(1), F.length(d) - own)
    return F.when(F.length(d).between(8, 15), _with_digits(m, F.concat(head, _permuted_digits(F.substring(d, F.length(d) - own + 1, own), key, "phone")))).otherwise(m)


def _person(m: Column, key: str) -> Column:
    """Numbers of the form area-group-serial: areas 1 to 899 without 666, no zero part; the domain is (898 * 99) x 9999."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    at = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permute((at * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "person")
    pair = F.call_function("div", new, F.lit(9999))
    back = F.call_function("div", pair, F.lit(99))
    text = F.format_string("%03d-%02d-%04d", F.when(back >= 665, back + 2).otherwise(back + 1), pair % 99 + 1, new % 9999 + 1)
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), text).otherwise(m)


def _address(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    x = F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a * 256 + b)
    new = permute(x, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "address")
    octets = F.array(*[F.call_function("div", new, F.lit(256**k)) % 256 for k in (3, 2, 1, 0)])
    return F.when(F.forall(part, lambda p: p <= 255), F.array_join(F.transform(octets, lambda o: o.cast("string")), ".")).otherwise(m)


def _date(m: Column, key: str) -> Column:
    out = m
    for shape, form in reversed(_DATES):
        day = F.when(m.rlike(f"^{shape}$"), F.try_to_timestamp(m, F.lit(form)).cast("date"))
        x = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), permute(x, F.lit(DAYS[0]).cast("long"), F.lit(DAYS[1]).cast("long"), key, "date").cast("int"))
        out = F.when(day.between(FIRST_DAY, LAST_DAY), F.date_format(new, form)).otherwise(out)
    return out


def _mail(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: str) -> Column:
    def block(*part: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), *part), 512)

    first = block(F.lower(m))
    last = F.call_function("div", F.length(m) - 1, F.lit(128))
    long = F.aggregate(F.array(first), F.lit(""), lambda _, d: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.when(k == 0, d).otherwise(block(d, k.cast("string")))), ""))
    digest = F.substring(F.when(F.length(m) > 128, long).otherwise(first), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(digest)).otherwise(digest)


_KINDS: dict[str, Callable[[Column, str], Column]] = {"mail": _mail, "secret": _secret, "address": _address, "date": _date, "phone": _phone, "person": _person, "card": _card}


def _kind(m: Column) -> Column:
    """Which rule a candidate belongs to; its shape tells."""
    return (F.when(m.contains("@"), "mail").when(m.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "address").when(m.rlike(r"^([0-9]{4}-..-..|../../....|..\...\.....)$"), "date")
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "person").when(m.rlike(r"^(\+|\(|[0-9]{3}-[0-9]{3}-)"), "phone").when(m.rlike(r"^[0-9 -]{13,23}$"), "card").otherwise("secret"))


def pseudonym(m: Column, key: str, secret: Column | None = None) -> Column:
    """The replacement of a candidate; the candidate itself if it is not valid. ``secret``: it was found as one, whatever its shape."""
    kind, out = _kind(m), m
    if secret is not None:
        kind = F.when(secret, "secret").otherwise(kind)
    for name, rule in _KINDS.items():
        out = F.when(kind == name, rule(m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and an array column ``__replaced`` of (value, pseudonym) structs."""
    prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    found = F.when(text.rlike(MAY_HOLD), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    secrets = F.when(text.rlike(_KEY_WORDS), F.regexp_extract_all(text, F.lit(SECRETS), F.lit(1)))
    out = docs.withColumn("__found", found).withColumn("__secrets", F.when(F.size("__found") > 0, secrets))
    out = out.withColumn("__new", F.transform("__found", lambda m, i: pseudonym(m, key, F.coalesce(F.get("__secrets", i) == m, F.lit(False)))))
    gaps = F.split(text, ANY, -1)
    rebuilt = F.array_join(F.flatten(F.zip_with(gaps, F.array_append("__new", F.lit("")), lambda g, m: F.array(g, m))), "")
    pairs = F.filter(F.arrays_zip(F.col("__found").alias("value"), F.col("__new").alias("pseudonym")), lambda p: p["value"] != p["pseudonym"])
    return (out.withColumn("__replaced", F.when(F.size("__found") > 0, pairs))
            .withColumn("text", F.when(F.size("__found") > 0, rebuilt).otherwise(text)).drop("__found", "__secrets", "__new"))


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row per document: its text with pseudonyms and the number of replaced values."""
    out = pseudonymised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    return out.select("doc_id", "text", F.coalesce(F.size("__replaced"), F.lit(0)).alias("n_replaced"))
