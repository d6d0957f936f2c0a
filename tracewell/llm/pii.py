"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions alone.

One pattern finds the candidates; each is validated (octets, calendar, Luhn, mod 97, issued ranges) and then permuted
within its own format by a keyed Feistel network over mixed radices: two halves of a value's digits take turns, each
adding a keyed hash of the other modulo the radix of every position. Such a step can be undone, so different values stay
different and equal values stay linked across documents. What is not valid is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import table

ROUNDS = 10
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,6}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,3}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "address": ADDRESS, "social": SOCIAL, "phone": PHONE, "card": CARD}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Days from this date on that a date may lie in: a whole Gregorian cycle of 189 * 773 days.
FIRST_DAY, DAY_RADICES = "1800-01-01", (189, 773)


def _prf(key: str, kind: str, round_no: Column, position: Column, other: Column) -> Column:
    """48 bits of a keyed hash."""
    told = F.concat_ws("|", F.lit(key), F.lit(kind), round_no.cast("string"), position.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
    return F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 12), 16, 10).cast("long")


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """A permutation of the arrays of numbers below `radices` (arrays of long, at least one entry)."""
    half = F.greatest(F.floor(F.size(values) / 2).cast("int"), F.lit(1))
    rest = F.size(values) - half

    def turned(part: Column, sizes: Column, other: Column, i: Column) -> Column:
        return F.transform(part, lambda v, j: F.pmod(v + _prf(key, kind, i, j, other), F.element_at(sizes, j + 1)))

    left_sizes, right_sizes = F.slice(radices, 1, half), F.slice(radices, half + 1, rest)
    start = F.struct(F.slice(values, 1, half).alias("l"), F.slice(values, half + 1, rest).alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, turned(s["l"], left_sizes, s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(turned(s["r"], right_sizes, s["l"], i)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _permuted_text(s: Column, key: str, kind: str) -> Column:
    """ASCII letters and digits permuted, each within its class, in a string of them alone."""
    c = _characters(s)
    base = lambda x: F.when(x.between("0", "9"), F.lit(48)).when(x.between("A", "Z"), F.lit(65)).otherwise(F.lit(97))
    values = F.transform(c, lambda x: (F.ascii(x) - base(x)).cast("long"))
    radices = F.transform(c, lambda x: F.when(x.between("0", "9"), F.lit(10)).otherwise(F.lit(26)).cast("long"))
    return F.array_join(F.zip_with(c, feistel(values, radices, key, kind), lambda x, v: F.char(base(x) + v)), "")


def _alnum(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9]", "")


def _refilled(s: Column, new: Column) -> Column:
    """s with its letters and digits replaced in order by those of new."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))

    def step(a: Column, c: Column) -> Column:
        own = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(a["o"], F.when(own, F.substr(new, a["k"], F.lit(1))).otherwise(c)).alias("o"), F.when(own, a["k"] + 1).otherwise(a["k"]).alias("k"))

    return F.aggregate(_characters(s), start, step, lambda a: a["o"])


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum of a digit string; doubled_last: the last digit counts as a doubled one, as when the check digit is missing."""
    back = F.transform(_characters(F.reverse(digits)), lambda d, i: F.when((i + int(doubled_last)) % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(back, F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    return F.aggregate(_characters(s), F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _longs(*columns: Column) -> Column:
    return F.array(*[c.cast("long") for c in columns])


def _email(s: Column, key: str) -> Column:
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    return F.when(F.length(_alnum(local)) > 0, F.concat(_refilled(local, _permuted_text(_alnum(local), key, "email")), F.lit("@"), domain))


def _iban(s: Column, key: str) -> Column:
    flat = F.replace(s, F.lit(" "), F.lit(""))
    country, own = F.substring(flat, 1, 2), F.substr(flat, F.lit(5))
    new = _permuted_text(own, key, "iban")
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(own, country, F.substring(flat, 3, 2))) == 1
    return F.when(valid & F.length(flat).between(15, 34), _refilled(s, F.concat(country, check, new)))


def _date(s: Column, key: str) -> Column:
    out = None
    for shape, form in ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy")):
        day = F.try_to_timestamp(s, F.lit(form)).cast("date")
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        a, b = DAY_RADICES
        new = feistel(_longs(F.floor(n / b), F.pmod(n, F.lit(b))), _longs(F.lit(a), F.lit(b)), key, "date")
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.element_at(new, 1) * b + F.element_at(new, 2)).cast("int"))
        got = F.when(s.rlike(shape) & day.isNotNull() & n.between(0, a * b - 1), F.date_format(moved, form))
        out = got if out is None else F.coalesce(out, got)
    return out


def _address(s: Column, key: str) -> Column:
    values = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    return F.array_join(F.transform(feistel(values, _longs(*[F.lit(256)] * 4), key, "address"), lambda v: v.cast("string")), ".")


def _social(s: Column, key: str) -> Column:
    p = F.split(s, "-")
    area, group, serial = [F.element_at(p, i).cast("int") for i in (1, 2, 3)]
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = feistel(_longs(area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1)), group - 1, serial - 1), _longs(F.lit(898), F.lit(99), F.lit(9999)), key, "social")
    a = F.element_at(new, 1)
    return F.when(valid, F.format_string("%03d-%02d-%04d", a + F.when(a >= 665, F.lit(2)).otherwise(F.lit(1)), F.element_at(new, 2) + 1, F.element_at(new, 3) + 1))


def _phone(s: Column, key: str) -> Column:
    code = F.regexp_extract(s, r"^\+[0-9]{1,3}(?=[ .-]?\(|[ .-])", 0)
    rest = F.substr(s, F.length(code) + 1)
    return F.concat(code, _refilled(rest, _permuted_text(_alnum(rest), key, "phone")))


def _card(s: Column, key: str) -> Column:
    digits = _alnum(s)
    new = _permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - luhn_sum(new, True) % 10, F.lit(10)).cast("string")
    return F.when(luhn_sum(digits, False) % 10 == 0, _refilled(s, F.concat(new, check)))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "address": _address, "social": _social, "phone": _phone, "card": _card}


def pseudonym(s: Column, key: str) -> Column:
    """struct(kind, new) of a string that the pattern found; new is null where the value is not valid."""
    kind = F.lit("card")
    new = _card(s, key)
    for k in ("phone", "social", "address", "date", "iban", "email"):
        is_k = s.rlike(f"^(?:{KINDS[k]})$")
        kind, new = F.when(is_k, F.lit(k)).otherwise(kind), F.when(is_k, _MAKERS[k](s, key)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text column rewritten, n_replaced, and kinds (an array of struct(kind, n_of_it), in order of kind).

    Null texts stay null with nothing replaced; empty texts stay empty; repeated rows give equal results; an empty table
    gives no rows. Of further columns only those named n_replaced or kinds are replaced.
    """
    if not key:
        raise ValueError("a pseudonym needs a secret key")
    names = [c for c in docs.columns if c not in ("n_replaced", "kinds")]
    t = F.col("row")[text]
    found = F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    docs = docs.select(F.struct(*names).alias("row")).withColumn("__found", found).withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda s: pseudonym(s, key))))
    new = F.zip_with("__found", "__new", lambda old, n: F.coalesce(n["new"], old))
    rebuilt = F.array_join(F.flatten(F.zip_with(F.split(t, PATTERN, -1), new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    made = F.transform(F.filter("__new", lambda n: n["new"].isNotNull()), lambda n: n["kind"])
    counts = F.transform(F.array_sort(F.array_distinct("__made")), lambda k: F.struct(k.alias("kind"), F.size(F.filter("__made", lambda x: x == k)).alias("n_of_it")))
    docs = docs.withColumn("__made", F.coalesce(made, F.array().cast("array<string>")))
    new_text = F.when(F.size("__found") > 0, rebuilt).otherwise(t)
    return docs.select(*[new_text.alias(c) if c == text else F.col("row")[c].alias(c) for c in names], F.size("__made").alias("n_replaced"), counts.alias("kinds"))


def pseudonym_key(spark) -> str:
    """The session's secret key. Only the query over the made-up tables does without one: whoever knows its key can undo it."""
    return spark.conf.get("spark.tracewell.pseudonym.key", "key of the made-up tables, not a secret")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with its numbers, dates and addresses replaced."""
    out = pseudonymised(table(spark, sf_dir, "documents"), pseudonym_key(spark))
    return out.select("doc_id", "text", "n_replaced", F.array_join(F.transform("kinds", lambda k: F.concat_ws(":", k["kind"], k["n_of_it"].cast("string"))), " ").alias("kinds"))
