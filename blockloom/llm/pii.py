"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

Found values are validated (check digits, calendar, ranges) and permuted by a keyed Feistel network within their own
format. The permutation depends on the key and the kind alone, so equal values get equal pseudonyms in all documents,
different values different ones, and every pseudonym passes the validation that its original passed.

    card      13 to 19 digits with a valid Luhn digit: first digit kept, check digit computed anew
    iban      mod-97 valid account numbers: country kept, check digits computed anew
    ssn       area, group and serial within the issued ranges
    phone     North American numbers (area and exchange from 2); others with '+': country digits kept
    ip        dotted quads
    date      calendar dates of 1900 to 2099: yyyy-MM-dd, MM/dd/yyyy (else dd/MM/yyyy), dd.MM.yyyy
    email     the local part, letter by letter and digit by digit; the domain is kept
    secret    access keys with known prefixes, signed web tokens, and values after password=, token:, api-key= and the like,
              also with a prefix (DB_PASSWORD=) or in quotes ("token": "..."), up to white space, a quote, a comma or the like

Numbers are one step of a walk over a product of two ranges, character strings over two halves; each of the ROUNDS adds
a hash of one half to the other, which can be undone for any hash. Pseudonyms have the length of their originals, but
for dotted quads. Texts are cut at the matches, the matches are mapped, and all is put together again in one row: no
shuffle, no explode.

Cases: a null text stays null and an empty one empty; texts and values of any length are read whole, in a time that grows
with their length; where two kinds could begin at one place, the first in the order of PATTERNS is taken; values that fail
validation stay as they are; repeated rows give repeated results; an empty table gives an empty table; other columns, whatever their names, are kept as they are, but
for those the operator writes (text, n_values, kinds).
"""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and checks only; a deployment passes its own secret.
SAMPLE_KEY = "blockloom sample key"

#: The patterns by kind, in the order in which they are tried at a place.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
ACCOUNTS = "|".join(rf"(?:{c.replace(' ', '|')})\d\d(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])" for n, c in IBAN_LENGTHS.items())
#: What doesn't belong to the digits before it: dates, addresses, social security and phone numbers.
OTHER = r"(?:19|20)\d\d-\d\d-\d\d(?![\w\-])|\d\d/\d\d/\d|\d{1,3}\.\d|\d{3}-\d\d-\d{4}(?![\w\-])|\d{3}-\d{3}-\d{4}(?![\w\-])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "secret": r"\bAKIA[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{16,}+|\bsk-[A-Za-z0-9_\-]{16,}+|\beyJ[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]{5,}+\.[A-Za-z0-9_\-]{5,}+"
    r"|(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_\-]?key)(?!\w)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"'<>,;(){}\[\]]{7,}[^\s\"'<>,;(){}\[\].!?:]",
    # The length of the country; others as far as the groups go.
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d\d)(?:(?:{ACCOUNTS})|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "date": r"(?<![\w.\-/])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![\w\-/]|\.\d)",
    "ssn": r"(?<![\w\-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])(?:\+1[ .\-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{4}(?!\d)|(?<![\w+])\+1[2-9]\d\d[2-9]\d{6}(?!\d)|(?<![\w+])\+(?!1[ (.\-])[1-9]\d{0,2}[ .\-](?:\d{2,4}[ .\-]?){1,4}\d{2,4}(?!\d)",
    # Groups of digits up to a date or another number with a form of its own; cards are looked for among them.
    "card": rf"(?<![\w.])(?=\d(?:[ \-]?\d){{12}})\d++(?!\w)(?:[ \-](?!{OTHER})\d++(?!\w))*+",
}
ANY = "|".join(PATTERNS.values())
#: How the digits of cards are written.
CARD_FORM = r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ \-])\d{6}\2\d{4,5}|\d{4}(?:[ \-]\d{3}){3})$"
#: What a match of any kind has: an e-mail's sign, a secret's mark or prefix, a digit in all others.
NEEDED = "[0-9@=:]|AKIA|gh[pousr]_|sk-|eyJ"
#: Day and month of dates that can only be read day first, without 29 February.
DAY_FIRST = [f"{d:02d}/{m:02d}" for m in range(1, 13) for d in range(13, calendar.monthrange(2001, m)[1] + 1)]
LEAP_YEARS = [y for y in range(1900, 2100) if calendar.isleap(y)]
DAYS = (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days + 1
DAY_PARTS = (319, 229)  # their product is DAYS


def let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def digest(key: str, *parts: Column, digits: int = 12) -> Column:
    """A keyed hash of parts as a number below 16 ** digits."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, digits), 16, 10).cast("long")


def permute_pair(key: str, kind: str, u: Column, v: Column, a: int, b: int) -> Column:
    """A keyed permutation of pairs (u below a, v below b)."""

    def turn(state: Column, i: Column) -> Column:
        left = (state["u"] + digest(key, F.lit(kind), i, state["v"]) % a) % a
        right = (state["v"] + digest(key, F.lit(kind), i, state["u"]) % b) % b
        return F.when(i % 2 == 0, F.struct(left.alias("u"), state["v"].alias("v"))).otherwise(F.struct(state["u"].alias("u"), right.alias("v")))

    start = F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


#: Character classes that pseudonyms keep: first and last character, and two factors of the size.
CLASSES = (("0", "9", 2, 5), ("a", "z", 2, 13), ("A", "Z", 2, 13))
HEX_CLASSES = (("0", "9", 2, 5), ("a", "f", 2, 3))


def permute_char(key: str, kind: str, char: Column, classes) -> Column:
    """A keyed permutation of each character class."""
    out = char
    for first, last, a, b in classes:
        index, start, width = F.ascii(char) - ord(first), F.lit(ord(first)), F.lit(b)
        pair = permute_pair(key, f"{kind} {first}", F.floor(index / b), index % b, a, b)
        place = let(pair, lambda p: p["u"] * width + p["v"] + start)
        out = F.when(char.between(first, last), F.chr(place)).otherwise(out)
    return out


def permute_text(key: str, kind: str, text: Column, hexadecimal: bool = False) -> Column:
    """A keyed permutation of the strings with the same character classes at the same places."""
    classes = HEX_CLASSES if hexadecimal else CLASSES

    def shifted(part: Column, other: Column, i: Column) -> Column:
        def one(c: Column, j: Column, seed: Column) -> Column:
            by, code = digest(key, F.lit(kind), i, j, seed, digits=8), F.ascii(c)
            out = c
            for first, last, a, b in classes:
                out = F.when(c.between(first, last), F.chr(F.lit(ord(first)) + (code - ord(first) + by) % (a * b))).otherwise(out)
            return out

        # One digest of the other half serves all characters.
        each = let(digest(key, F.lit(kind), i, other), lambda seed: F.transform(F.split(part, ""), lambda c, j: one(c, j, seed)))
        return F.when(part == "", part).otherwise(F.array_join(each, ""))

    def turn(state: Column, i: Column) -> Column:
        half = F.floor(F.length(state) / 2).cast("int")
        left, right = F.substring(state, F.lit(1), half), F.substring(state, half + 1, F.length(state))
        return F.when(i % 2 == 0, F.concat(shifted(left, right, i), right)).otherwise(F.concat(left, shifted(right, left, i)))

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), text, turn)
    # A single character has no halves.
    return F.when(F.length(text) == 1, permute_char(key, kind, text, classes)).otherwise(whole)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def put_back(form: Column, chars: Column, kept: str) -> Column:
    """form with its characters of the class kept replaced, in order, by those of chars."""
    place = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), f"[^{kept}]", ""))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substring(chars, place(i), F.lit(1))).otherwise(c)), "")


def luhn(digits: Column, first: int) -> Column:
    """The Luhn sum modulo 10; from the right, every second digit counts double, starting with number first."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == first, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10


def card(key: str, hit: Column) -> Column:
    d = digits_of(hit)
    body = F.concat(F.substring(d, 1, 1), permute_text(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
    new = let(body, lambda b: F.concat(b, ((10 - luhn(b, 0)) % 10).cast("string")))
    return F.when(F.length(d).between(13, 19) & hit.rlike(CARD_FORM) & (luhn(d, 1) == 0), let(new, lambda n: put_back(hit, n, "0-9")))


def values_within(make, hit: Column, group: str, starts: int | None = None) -> Column:
    """new: hit with the values of its groups replaced (null if none is valid), and n, their number.

    From each group that isn't in a value yet (the first starts of them), the longest run of groups that make takes is a value.
    """
    most = 18  # groups of a value beside its first: one for each further digit at most

    def walk(groups: Column) -> Column:
        def turn(state: Column, i: Column) -> Column:
            def tried(found: Column, j: Column) -> Column:
                raw = F.array_join(F.slice(groups, i + 1, j - i + 1), "")
                value = F.regexp_replace(raw, r"[ \-]$", "")
                here = lambda v: F.struct(F.concat(make(v), F.substring(raw, F.length(v) + 1, F.length(raw))).alias("new"), (j + 1).alias("next"))
                return F.when(found["new"].isNotNull(), found).otherwise(let(value, here))

            none = F.struct(F.lit(None).cast("string").alias("new"), F.lit(0).alias("next"))
            ends = F.sequence(F.least(F.size(groups) - 1, i + most), i, F.lit(-1))
            put = lambda new, after, n: F.struct(F.concat(state["text"], new).alias("text"), after.alias("after"), n.alias("n"))
            step = lambda b: F.when(b["new"].isNotNull(), put(b["new"], b["next"], state["n"] + 1)).otherwise(put(F.get(groups, i), i + 1, state["n"]))
            found = F.aggregate(ends, none, tried)
            if starts is not None:
                found = F.when(i < starts, found).otherwise(none)
            return F.when(i < state["after"], state).otherwise(let(found, step))

        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("after"), F.lit(0).alias("n"))
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, turn)

    out = let(F.regexp_extract_all(hit, F.lit(group), F.lit(0)), walk)
    return let(out, lambda x: F.struct(F.when(x["n"] > 0, x["text"]).alias("new"), x["n"].alias("n")))


def mod97(text: Column) -> Column:
    def add(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def iban(key: str, hit: Column) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    check = lambda n: F.format_string("%02d", 98 - mod97(F.concat(n, country, F.lit("00"))))
    new = let(permute_text(key, "iban", body), lambda n: F.concat(country, check(n), n))
    valid = (F.length(plain) >= 12) & (mod97(F.concat(body, F.substring(plain, 1, 4))) == 1)
    return F.when(valid, let(new, lambda n: put_back(hit, n, "0-9A-Z")))


def ip(key: str, hit: Column) -> Column:
    part = lambda i: F.element_at(F.split(hit, r"\."), i).cast("long")
    out = permute_pair(key, "ip", part(1) * 256 + part(2), part(3) * 256 + part(4), 1 << 16, 1 << 16)
    return let(out, lambda p: F.format_string("%d.%d.%d.%d", F.floor(p["u"] / 256), p["u"] % 256, F.floor(p["v"] / 256), p["v"] % 256))


def ssn(key: str, hit: Column) -> Column:
    area, group, serial = (F.element_at(F.split(hit, "-"), i).cast("long") for i in (1, 2, 3))
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = permute_pair(key, "ssn", index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
    form = lambda p: F.format_string("%03d-%02d-%04d", F.when(p["u"] >= 665, p["u"] + 2).otherwise(p["u"] + 1), F.floor(p["v"] / 9999) + 1, p["v"] % 9999 + 1)
    return let(pair, form)


def phone(key: str, hit: Column) -> Column:
    d = digits_of(hit)
    national = F.when(F.length(d) == 11, F.substring(d, 2, 10)).otherwise(d)
    north = hit.rlike(r"^\+1|^[^+]")
    number = lambda at, n: F.substring(national, at, n).cast("long")
    pair = permute_pair(key, "phone", number(1, 3) - 200, (number(4, 3) - 200) * 10000 + number(7, 4), 800, 8_000_000)
    form = lambda p: F.format_string("%03d%07d", p["u"] + 200, p["v"] + 2_000_000)
    fresh = F.concat(F.when(F.length(d) == 11, "1").otherwise(""), let(pair, form))
    code = F.regexp_extract(hit, r"^\+\d+", 0)
    rest = F.substring(hit, F.length(code) + 1, F.length(hit))
    other = F.when(F.length(d).between(8, 15), F.concat(code, permute_text(key, "phone abroad", rest)))
    return F.when(north, let(fresh, lambda n: put_back(hit, n, "0-9"))).otherwise(other)


def date(key: str, hit: Column) -> Column:
    mark = F.regexp_extract(hit, "[-/.]", 0)
    iso = (
        F.when(mark == "-", hit)
        .when(mark == "/", F.concat_ws("-", F.substring(hit, 7, 4), F.substring(hit, 1, 2), F.substring(hit, 4, 2)))
        .otherwise(F.concat_ws("-", F.substring(hit, 7, 4), F.substring(hit, 4, 2), F.substring(hit, 1, 2)))
    )
    start, day = F.lit("1900-01-01").cast("date"), iso.try_cast("date")
    index = F.datediff(day, start)
    a, b = DAY_PARTS
    pair = permute_pair(key, "date", F.floor(index / b), index % b, a, b)
    moved = let(pair, lambda p: F.date_add(start, (p["u"] * b + p["v"]).cast("int")))
    text = let(moved, lambda m: F.when(mark == "-", F.date_format(m, "yyyy-MM-dd")).when(mark == "/", F.date_format(m, "MM/dd/yyyy")).otherwise(F.date_format(m, "dd.MM.yyyy")))
    days, year = F.array(*[F.lit(x) for x in DAY_FIRST]), F.substring(hit, 7, 4).cast("int")
    at = F.array_position(days, F.substring(hit, 1, 5))
    other = permute_pair(key, "day first", at - 1, year - 1900, len(DAY_FIRST), 200)
    day_first = let(other, lambda p: F.format_string("%s/%d", F.get(days, p["u"].cast("int")), p["v"] + 1900))
    leaps = F.array(*[F.lit(y) for y in LEAP_YEARS])
    leap = permute_pair(key, "29 February", F.lit(0), F.array_position(leaps, year) - 1, 1, len(LEAP_YEARS))
    leap_day = let(leap, lambda p: F.format_string("29/02/%d", F.get(leaps, p["v"].cast("int"))))
    return F.when(day.isNotNull(), text).when((mark == "/") & (at > 0), day_first).when(hit.startswith("29/02/") & F.array_contains(leaps, year), leap_day)


def email(key: str, hit: Column) -> Column:
    return F.concat(permute_text(key, "email", F.substring_index(hit, "@", 1)), F.lit("@"), F.substring_index(hit, "@", -1))


def secret(key: str, hit: Column) -> Column:
    fixed = F.regexp_extract(hit, r"^(?:AKIA(?=[A-Z0-9]{16}$)|gh[pousr]_|sk-|eyJ(?=[A-Za-z0-9_\-]+\.)|[A-Za-z_\-]+[\"']?\s*[=:]\s*[\"']?)", 0)
    rest = F.substring(hit, F.length(fixed) + 1, F.length(hit))
    return F.concat(fixed, F.when(rest.rlike("^[0-9a-f]+$"), permute_text(key, "hex", rest, hexadecimal=True)).otherwise(permute_text(key, "secret", rest)))


MAKERS = {"email": email, "secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
#: How to tell the kinds of hits apart, in the order of PATTERNS.
SHAPES = {
    "email": r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+$", "secret": r"[=:]|^AKIA[A-Z0-9]{16}$|^gh[pousr]_|^sk-|^eyJ", "iban": "^[A-Z]", "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "date": r"^(\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})$", "ssn": r"^\d{3}-\d\d-\d{4}$", "phone": r"^[+(]|^\d{3}[ .\-]\d{3}[ .\-]\d{4}$", "card": "",
}


#: Kinds whose hits may have more than the value: the groups of a hit, and how many of them can begin a value.
WITHIN = {"iban": (r"[A-Z0-9]+ ?", 1), "card": (r"\d+[ \-]?", None)}


def pseudonym(key: str, hit: Column) -> tuple[Column, Column]:
    """The kind of a hit, and its pseudonym, or null where it isn't valid, with the number of values (new, n)."""

    def made(name: str, make) -> Column:
        if name in WITHIN:
            return values_within(lambda v: make(key, v), hit, *WITHIN[name])
        return F.struct(make(key, hit).alias("new"), F.lit(1).alias("n"))

    kind, new = None, None
    for name, make in MAKERS.items():
        here = hit.rlike(SHAPES[name]) if SHAPES[name] else F.lit(True)
        kind = F.when(here, name) if kind is None else kind.when(here, name)
        new = F.when(here, made(name, make)) if new is None else new.when(here, made(name, make))
    return kind, new


def pseudonymize(docs: DataFrame, key: str = SAMPLE_KEY, text: str = "text") -> DataFrame:
    """docs with text's personal data replaced, n_values (replaced values) and kinds (theirs, sorted, by comma)."""

    def mapped(hit: Column) -> Column:
        kind, new = pseudonym(key, hit)
        return let(new, lambda x: F.struct(F.coalesce(x["new"], hit).alias("new"), F.when(x["new"].isNotNull(), kind).alias("kind"), x["n"].alias("n")))

    col = F.col(text)
    # Each pattern needs one of these; only texts that have one are searched with the long pattern.
    hits = F.when(col.rlike(NEEDED), F.regexp_extract_all(col, F.lit(ANY), F.lit(0)))
    found = docs.withColumn("__hits", F.when(F.size(hits) > 0, F.transform(hits, mapped)))
    cut = F.transform(F.split(col, ANY, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("__hits"), i)["new"], F.lit(""))))
    kinds = F.array_compact(F.transform("__hits", lambda h: h["kind"]))
    values = F.aggregate("__hits", F.lit(0), lambda n, h: n + F.when(h["kind"].isNotNull(), h["n"]).otherwise(0))
    return (
        found.withColumn("n_values", F.coalesce(values, F.lit(0)).cast("long"))
        .withColumn("kinds", F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")))
        .withColumn(text, F.when(F.col("__hits").isNull(), col).otherwise(F.array_join(cut, "")))
        .drop("__hits")
    )
