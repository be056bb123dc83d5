"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame operations only.

Found values are validated (Luhn sum of card numbers, real calendar dates, octets of
addresses) and permuted within their format: digits stay digits, letters keep their case,
a card number stays Luhn-valid, a date stays a date, an octet keeps its length. A value is
a row of places, each with its own radix; a round adds a keyed digest of one half to the
other half, place by place, modulo the radix. Every round can be undone with the key, so
equal values get equal pseudonyms in all documents and different values different ones.

| kind | what is permuted |
|---|---|
| card | 13-19 digits with a valid Luhn sum: all but the first and the check digit, which is made anew |
| date | `yyyy-mm-dd` and `dd.mm.yyyy` / `dd/mm/yyyy` of 1900-2099: year, and month with day |
| phone, national | `+1 (ddd) ddd-dddd`, `ddd-ddd-dddd`, `ddd-dd-dddd`: digits; a leading 0-1 of a group and 2-9 stay apart |
| address | four octets: each within its number of digits |
| mail | ASCII letters and digits before the `@`; other letters stay |
| secret | ASCII letters and digits of `AKIA...` keys and of values behind a marker (`password`, `passwd`, `pwd`, `passwort`, `secret`, `api_key`, `token`) with `=` or `:`, in any case and spacing: in quotes the whole value, else up to a space; behind `:`, and behind `token` without quotes, only values with a digit |

A run of numbers is searched for cards from left to right, the longest first at each number;
what belongs to no card is judged number by number. Values that fail validation stay as they are. The key is
the session's `spark.docloom.pii.key`; the fallback `KEY` is public and for tests. Not found:
phone numbers and dates of other forms, IBANs, IPv6 addresses. Null texts stay null; empty texts stay empty.
Repeated rows are treated alike; other columns are kept, whatever their names, but for one
named like `changed`, which is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import query, table

KEY = "docloom"  # for tests; whoever knows the key can undo the pseudonyms
SETTING = "spark.docloom.pii.key"
TURNS = 8
KINDS = ("mail", "secret", "phone", "national", "date", "address", "card")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LOCAL = r"\p{L}\p{N}._%+-"
_MAIL = rf"[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_PASS = r"password|passwd|passwort|pwd|secret|api[_-]?key"
# What stands before a secret; it belongs to the match and stays.
_MARK = rf"(?i:(?:{_PASS}|token)\s*+[=:]\s*+[\"']?+)"
_BARE = r"[^\s\"'<>]*[A-Za-z0-9]"
_SECRET = "|".join((
    rf"(?i:(?:{_PASS}|token)\s*+=\s*+)(?:\"(?!{_MAIL})[^\"\n]+(?=\"|\z)|'(?!{_MAIL})[^'\n]+(?='|\z))",
    rf"(?i:(?:{_PASS})\s*+=\s*+)[\"']?+(?!{_MAIL}){_BARE}",
    rf"(?i:token\s*+=\s*+)[\"'](?!{_MAIL})[A-Za-z0-9]+",
    rf"(?i:(?:{_PASS}|token)\s*+[=:]\s*+)[\"']?+(?!{_MAIL})(?=[^\s\"'<>]*[0-9]){_BARE}",
))
_CARD = r"\d(?:[ -]?\d){12,18}"
PATTERNS = {
    "mail": rf"(?<![{_LOCAL}]){_MAIL}",
    "secret": rf"(?<![A-Za-z0-9])AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9])|{_SECRET}",
    "phone": r"\+1 ?\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "national": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])"
            r"|(?<![\d./])\d\d([./])\d\d\1(?:19|20)\d\d(?![\d/])",
    "address": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    # The whole run of numbers; `pieces` finds the cards in it.
    "card": r"(?<![\d-])(?=\d(?:[ -]?\d){12})\d[\d -]*\d(?![\d-])",
}
ANY = "|".join(PATTERNS.values())


def _ints(*xs) -> Column:
    return F.array(*[F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in xs])


def feistel(values: Column, radixes: Column, kind: Column, key: str, turns: int = TURNS) -> Column:
    """The permuted values: each stays in 0 .. radix - 1 of its place."""
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half

    def parts(a: Column) -> tuple[Column, Column]:
        return F.slice(a, F.lit(1), half), F.slice(a, half + 1, rest)

    (left, right), (lr, rr) = parts(values), parts(radixes)
    start = F.struct(left.alias("l"), right.alias("r"), lr.alias("lr"), rr.alias("rr"))

    def turn(s: Column, n: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, n.cast("string"),
                                    F.array_join(s["r"], ",")), 256)
        added = F.zip_with(
            F.transform(s["l"], lambda x, i: x + F.conv(F.substring(digest, (i * 4) % 60 + 1, 4), 16, 10)
                        .cast("int")), s["lr"], lambda x, m: F.pmod(x, m).cast("int"))
        return F.struct(s["r"].alias("l"), added.alias("r"), s["rr"].alias("lr"), s["lr"].alias("rr"))

    # An even number of turns brings the halves back to their sides.
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _characters(value: Column, frozen: Column, kind: str, key: str, grouped: bool = False) -> Column:
    """Permute letters and digits of a text; the first `frozen` characters stay."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    code = F.transform(chars, lambda c: F.ascii(c))
    before = F.concat(_ints(32), code)

    def base(c: Column, i: Column) -> Column:
        lead = (~F.element_at(before, i + 1).between(48, 57)) & (c >= 50) if grouped else F.lit(False)
        return (F.when(i < frozen, c)
                .when(c.between(48, 57), F.when(lead, 50).otherwise(48))
                .when(c.between(65, 90), 65).when(c.between(97, 122), 97).otherwise(c))

    def radix(c: Column, i: Column) -> Column:
        first = ~F.element_at(before, i + 1).between(48, 57)
        digit = F.when(first & (c >= 50), 8).when(first, 2).otherwise(10) if grouped else F.lit(10)
        return (F.when(i < frozen, 1).when(c.between(48, 57), digit)
                .when(c.between(65, 90) | c.between(97, 122), 26).otherwise(1))

    bases = F.transform(code, base)
    moved = feistel(F.zip_with(code, bases, lambda c, b: (c - b).cast("int")),
                    F.transform(code, lambda c, i: radix(c, i).cast("int")), F.lit(kind), key)
    out = F.zip_with(moved, bases, lambda m, b: F.char(m + b))
    # A place of radix 1 shows the character itself, also where it is not ASCII.
    return F.array_join(F.zip_with(out, chars, lambda o, c: F.when(c.rlike("[A-Za-z0-9]"), o).otherwise(c)), "")


def _luhn(digits: Column, offset: int) -> Column:
    """Luhn sum of an array of digits; the last one counts double if offset is 1."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when(
        F.pmod(n - 1 - i + offset, F.lit(2)) == 1,
        F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("^[0-9]$")), lambda c: c.cast("int"))


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    payload = F.slice(digits, F.lit(1), F.size(digits) - 1)
    radixes = F.transform(payload, lambda d, i: F.when(i == 0, 1).otherwise(10))
    start = F.transform(payload, lambda d, i: F.when(i == 0, 0).otherwise(d))
    moved = F.transform(feistel(start, radixes, F.lit("card"), key),
                        lambda d, i: F.when(i == 0, F.element_at(digits, 1)).otherwise(d))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(moved, 1), F.lit(10)), F.lit(10)).cast("int")
    fresh = F.concat(moved, F.array(check))
    # Put the digits back between the spaces and hyphens of the value.
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    laid = F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), lambda a, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(a["t"], F.element_at(fresh, a["n"] + 1).cast("string")).alias("t"),
                                   (a["n"] + 1).alias("n"))).otherwise(
        F.struct(F.concat(a["t"], c).alias("t"), a["n"].alias("n"))), lambda a: a["t"])
    return F.when(F.pmod(_luhn(digits, 0), F.lit(10)) == 0, laid).otherwise(value)


def _address(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    base = F.transform(octets, lambda o: F.when(o < 10, 0).when(o < 100, 10).otherwise(100))
    radix = F.transform(octets, lambda o: F.when(o < 10, 10).when(o < 100, 90).otherwise(156))
    moved = feistel(F.zip_with(octets, base, lambda o, b: o - b), radix, F.lit("address"), key)
    return F.array_join(F.zip_with(moved, base, lambda m, b: m + b), ".")


# Months and days above the 28th that every year has.
_LATE = [(m, d) for m in range(1, 13) for d in (29, 30, 31)
         if m != 2 and not (d == 31 and m in (4, 6, 9, 11))]


def _date(value: Column, key: str) -> Column:
    iso = value.rlike("^[0-9]{4}")
    at = lambda i, n: F.substring(value, i, n)
    y, m, d = (F.when(iso, at(*a)).otherwise(at(*b)) for a, b in
               (((1, 4), (7, 4)), ((6, 2), (4, 2)), ((9, 2), (1, 2))))
    valid = F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd").isNotNull()
    y, m, d = y.cast("int"), m.cast("int"), d.cast("int")
    late = F.array(*[F.lit(100 * a + b) for a, b in _LATE])
    leap = (m == 2) & (d == 29)
    # Leap years 1904 .. 2096 count by fours from 1904.
    values = F.when(leap, _ints((y - 1904) / 4, 0)).when(
        d <= 28, _ints(y - 1900, (m - 1) * 28 + d - 1)).otherwise(
        _ints(y - 1900, F.array_position(late, 100 * m + d) - 1))
    radixes = F.when(leap, _ints(49, 1)).when(d <= 28, _ints(200, 336)).otherwise(
        _ints(200, len(_LATE)))
    moved = feistel(values, radixes, F.concat(F.lit("date"), F.when(leap, "l").when(d <= 28, "e").otherwise("f")), key)

    def shown(p: Column) -> Column:
        a, b = F.element_at(p, 1), F.element_at(p, 2)
        year = F.when(leap, 1904 + a * 4).otherwise(1900 + a)
        code = F.when(leap, 229).when(d <= 28, F.floor(b / 28).cast("int") * 100 + 100 + F.pmod(b, F.lit(28)) + 1) \
            .otherwise(F.element_at(late, b + 1))
        yy, mm, dd = year.cast("string"), F.lpad(F.floor(code / 100).cast("string"), 2, "0"), \
            F.lpad(F.pmod(code, F.lit(100)).cast("string"), 2, "0")
        mark = at(3, 1)
        return F.when(iso, F.concat_ws("-", yy, mm, dd)).otherwise(F.concat(dd, mark, mm, mark, yy))

    return F.when(valid, F.element_at(F.transform(F.array(moved), shown), 1)).otherwise(value)


def pieces(value: Column) -> Column:
    """The parts of a found value: cards and single numbers of a run, anything else whole."""
    groups = F.split(value, " ")
    numbers = F.sequence(F.lit(0), F.size(groups) - 1)
    # Single numbers with a kind of their own are no part of a card.
    own = "|".join(PATTERNS[k] for k in ("phone", "national", "date"))

    def joined(i: Column, j: Column) -> Column:
        return F.array_join(F.slice(groups, i + 1, j - i + 1), " ")

    def valid(i: Column, j: Column) -> Column:
        return F.when(joined(i, j).rlike(f"^{_CARD}$"),
                      (F.pmod(_luhn(_digits(joined(i, j)), 0), F.lit(10)) == 0)
                      & ~F.exists(F.slice(groups, i + 1, j - i + 1), lambda g: g.rlike(f"^(?:{own})$"))) \
            .otherwise(F.lit(False))

    last = F.transform(numbers, lambda i: F.array_max(F.filter(
        F.sequence(i, F.least(i + 18, F.size(groups) - 1)), lambda j: valid(i, j))))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("out"))

    def walk(ends: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            end = F.coalesce(F.element_at(ends, i + 1), i)
            return F.when(i <= s["end"], s).otherwise(F.struct(
                end.alias("end"), F.concat(s["out"], F.array(joined(i, end))).alias("out")))
        return F.aggregate(numbers, start, step, lambda s: s["out"])

    run = value.rlike(f"^(?:{PATTERNS['card']})$")
    return F.when(run, F.element_at(F.transform(F.array(last), walk), 1)).otherwise(F.array(value))


def kind_of(value: Column) -> Column:
    """The kind whose pattern found the value; null for a number without one."""
    whole = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    return reduce(lambda out, k: out.when(whole(k), k), KINDS[2:-1],
                  F.when(whole("secret"), "secret").when(value.contains("@"), "mail")) \
        .when(value.rlike(f"^{_CARD}$"), "card")


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one piece of a found value."""
    kind, none = kind_of(value), F.lit(0)
    mark = F.regexp_extract(value, f"^{_MARK}", 0)
    bare = F.substring(value, F.char_length(mark) + 1, F.char_length(value))
    return (F.when(kind == "mail", F.concat(
                _characters(F.substring_index(value, "@", 1), none, "mail", key), F.lit("@"),
                F.substring_index(value, "@", -1)))
            .when(kind == "phone", F.when(value.startswith("+1"), F.concat(
                F.lit("+1"), _characters(F.substring(value, 3, 100), none, "phone", key, True)))
                .otherwise(_characters(value, none, "phone", key, True)))
            .when(kind == "national", _characters(value, none, "national", key))
            .when(kind == "date", _date(value, key))
            .when(kind == "address", _address(value, key))
            .when(kind == "card", _card(value, key))
            .when(kind == "secret", F.concat(mark, _characters(
                bare, F.when(bare.rlike("^AKIA[A-Z0-9]{16}$"), 4).otherwise(0), "secret", key)))
            .otherwise(value))


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None,
                 changed: str = "n_changed") -> DataFrame:
    """`docs` with `text` replaced, and `changed`: number of values that got a pseudonym.

    Without `key`, the session's setting is the key.
    Texts without a digit or `@` are passed on after one quick search.
    """
    key = docs.sparkSession.conf.get(SETTING, KEY) if key is None else key
    taken = {c.lower() for c in docs.columns}
    found, fresh = (next(c for c in (stem + "_" * k for k in range(len(taken) + 1)) if c not in taken)
                    for stem in ("found", "fresh"))
    whole = F.col(text)
    has = whole.rlike(rf"[0-9@]|(?i:{_PASS}|token)\s*+=") & whole.rlike(ANY)
    parts = docs.select("*", F.when(has, F.transform(
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), pieces)).alias(found))
    parts = parts.withColumn(fresh, F.transform(F.flatten(found), lambda v: pseudonym(v, key)))
    # A space stands between the pieces of a value.
    gaps = F.flatten(F.zip_with(F.split(whole, ANY, -1), F.col(found), lambda g, ps: F.when(
        ps.isNull(), F.array(g)).otherwise(F.concat(F.array(g), F.array_repeat(F.lit(" "), F.size(ps) - 1)))))
    joined = F.array_join(F.zip_with(gaps, F.col(fresh), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    n = F.size(F.filter(F.zip_with(F.flatten(found), fresh, lambda a, b: a != b), lambda d: d))
    any_ = F.col(found).isNotNull()
    out = parts.withColumns({text: F.when(any_, joined).otherwise(whole),
                             changed: F.coalesce(F.when(any_, n), F.lit(0)).cast("bigint")})
    return out.drop(found, fresh)


@query("op9_pii")
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pseudonymise(docs)
