"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in SQL functions only.

| kind | found as | valid if | permuted |
| --- | --- | --- | --- |
| email | local@domain | it has a dotted domain | local part and domain become keyed names under `.example` |
| ipv4 | four numbers | each is at most 255 | its 32 bits |
| date | 1999-12-31, 1999/12/31, 12/31/1999, 31.12.1999 | the day exists, 1900 to 2099 | the day number in those years |
| ssn | 123-45-6789 | area, group and serial are assigned | among the assigned numbers |
| phone | +1 (234) 555-6789 and the like | 7 to 15 digits | the digits after the calling code, in any spelling |
| card | 13 to 19 digits, grouped or not | the Luhn digit is right | all but that digit, which is set anew |

A permutation depends on the key and the kind's format, never on the document: equal values get equal
pseudonyms everywhere, different ones different pseudonyms, and separators, lengths and check digits
stay valid. The value is split into two registers of radix a and b; each round adds a keyed hash of
one register to the other, modulo its radix, so the map is one to one on a * b values. Other numbers
stay as they are.

Null text stays null with no kinds. Empty texts, repeated rows, ties and extra columns need no care:
each row is changed alone, and other columns pass through (the column for kinds is replaced if present).
One narrow pass, no shuffle, no state. Not looked for: IBAN, IPv6, dates with the month as a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsafe.llm.frames import free_name

ROUNDS = 10
KINDS = ("email", "ipv4", "date", "ssn", "phone", "card")
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
_IP = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)(?!\p{L})"
_DATE = (
    r"(?<![\p{L}\p{N}/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})"
    r"(?![\p{L}\p{N}])(?![/.-]\d)"
)
_SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?!-?[\p{L}\p{N}])"
_PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?[\p{L}\p{N}])"
)
_CARD = (
    r"(?<![\p{L}\p{N}.-])(?:\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{1,7}"
    r"|\d{4}(?<room>[ -])\d{6}\k<room>\d{5})(?![\p{L}\p{N}])"
)
PATTERN = "|".join((_EMAIL, _IP, _DATE, _SSN, _PHONE, _CARD))
# Calling codes of one and of two digits; all others have three.
_CALLING = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days from 1900 to 2099


def _long(column: Column) -> Column:
    return column.cast("long")


def _keyed(key: str, *parts: Column) -> Column:
    """60 bits that only the holder of the key can compute."""
    return _long(F.conv(F.substring(_digest(key, *parts), 1, 15), 16, 10))


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256)


def permute(key: str, label: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of the pairs (left below a, right below b), as a struct of both."""
    start = F.struct(_long(left).alias("l"), _long(right).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        mixed_l = (s["l"] + _keyed(key, label, a, b, i, s["r"]) % _long(a)) % _long(a)
        mixed_r = (s["r"] + _keyed(key, label, a, b, i, s["l"]) % _long(b)) % _long(b)
        even = i % 2 == 0
        return F.struct(F.when(even, mixed_l).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(mixed_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(key: str, label: Column, digits: Column) -> Column:
    """A keyed permutation of all digit strings of the same length (2 to 36 digits)."""
    size = F.length(digits)
    half = (size / 2).cast("int")
    powers = F.array(*[F.lit(10**i) for i in range(19)])
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, size - half)
    a, b = F.element_at(powers, half + 1), F.element_at(powers, size - half + 1)
    done = permute(key, F.concat(label, size.cast("string")), left, right, a, b)
    return _with(done, lambda s: F.concat(_padded(s["l"], half), _padded(s["r"], size - half)))


def _with(value: Column, use) -> Column:
    """Compute a value once and use it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts once."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(places, F.lit(0), add)


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced, in order."""
    places = F.sequence(F.lit(1), F.length(shape))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def put(s: Column, i: Column) -> Column:
        sign = F.substring(shape, i, F.lit(1))
        is_digit = sign.between("0", "9")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["next"], F.lit(1))).otherwise(sign)).alias("out"),
            (s["next"] + is_digit.cast("int")).alias("next"),
        )

    return F.aggregate(places, start, put, lambda s: s["out"])


def _email(key: str, value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    hashed = F.substring(_digest(key, F.lit("local"), F.lower(local), F.lower(domain)), 1, 12)
    place = F.substring(_digest(key, F.lit("domain"), F.lower(domain)), 1, 8)
    return F.concat(F.lit("u"), hashed, F.lit("@d"), place, F.lit(".example"))


def _ip(key: str, value: Column) -> tuple[Column, Column]:
    parts = [F.element_at(F.split(value, r"\."), i).cast("long") for i in range(1, 5)]
    valid = (parts[0] < 256) & (parts[1] < 256) & (parts[2] < 256) & (parts[3] < 256)
    side = F.lit(65536)
    done = permute(key, F.lit("ipv4"), parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], side, side)
    made = _with(done, lambda s: F.concat_ws(
        ".", *[_long(F.floor(s[r] / 256)).cast("string") if high else (s[r] % 256).cast("string")
               for r, high in (("l", True), ("l", False), ("r", True), ("r", False))]))
    return valid, made


def _date(key: str, value: Column) -> tuple[Column, Column]:
    part = [F.element_at(F.split(value, "[-/.]"), i) for i in (1, 2, 3)]
    iso = value.substr(5, 1).isin("-", "/")
    slash = F.contains(value, F.lit("/")) & ~iso

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    month_first = day(part[2], part[0], part[1])
    day_first = day(part[2], part[1], part[0])
    by_month = slash & month_first.isNotNull()
    found = F.when(iso, day(part[0], part[1], part[2])).when(by_month, month_first).otherwise(day_first)
    number = F.datediff(found, F.to_date(F.lit(_FIRST_DAY)))
    a, b = _DAYS
    valid = F.coalesce(number.between(0, a * b - 1), F.lit(False))
    done = permute(key, F.lit("date"), F.floor(number / b), number % b, F.lit(a), F.lit(b))
    out = _with(done, lambda s: F.date_add(F.to_date(F.lit(_FIRST_DAY)), (s["l"] * b + s["r"]).cast("int")))
    # Both fields of two digits: padded, as in 03/04/2001; else as in 3/4/2001.
    two = (F.length(part[0]) == 2) & (F.length(part[1]) == 2)

    def show(d: Column) -> Column:
        full = [F.date_format(d, p) for p in ("yyyy", "MM", "dd")]
        m = F.when(two, full[1]).otherwise(F.month(d).cast("string"))
        n = F.when(two, full[2]).otherwise(F.dayofmonth(d).cast("string"))
        sep = F.when(slash, F.lit("/")).otherwise(F.lit("."))
        return (
            F.when(iso, F.concat(full[0], value.substr(5, 1), full[1], value.substr(5, 1), full[2]))
            .when(by_month, F.concat(m, sep, n, sep, full[0]))
            .otherwise(F.concat(n, sep, m, sep, full[0]))
        )

    return valid, _with(out, show)


def _ssn(key: str, value: Column) -> tuple[Column, Column]:
    area, group, serial = [F.element_at(F.split(value, "-"), i).cast("long") for i in (1, 2, 3)]
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    # 898 areas without 000, 666 and 900-999; groups 01-99; serials 0001-9999.
    place = area - 1 - (area > 666).cast("long")
    done = permute(key, F.lit("ssn"), place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def show(s: Column) -> Column:
        row = _long(F.floor(s["l"] / 99))
        new_area = row + 1 + (row >= 665).cast("long")
        return F.concat_ws("-", *[_padded(n, F.lit(w)) for n, w in (
            (new_area, 3), (s["l"] % 99 + 1, 2), (s["r"] + 1, 4))])

    return valid, _with(done, show)


def _phone(key: str, value: Column) -> tuple[Column, Column]:
    digits = _digits(value)
    code = F.when(value.startswith("+"), F.regexp_extract(digits, _CALLING, 0)).otherwise("")
    rest = F.substring(digits, F.length(code) + 1, F.length(digits))
    valid = F.length(digits).between(7, 15) & (F.length(rest) >= 6)
    return valid, _refill(value, F.concat(code, permute_digits(key, F.lit("phone"), rest)))


def _card(key: str, value: Column) -> tuple[Column, Column]:
    digits = _digits(value)
    valid = luhn_sum(digits) % 10 == 0
    payload = permute_digits(key, F.lit("card"), F.substring(digits, F.lit(1), F.length(digits) - 1))

    def close(body: Column) -> Column:
        open_ = F.concat(body, F.lit("0"))
        check = (F.lit(10) - luhn_sum(open_) % 10) % 10
        return F.concat(body, check.cast("string"))

    return valid, _refill(value, _with(payload, close))


def _pseudonym(key: str, value: Column) -> Column:
    """Kind and replacement of one match; the kind is null where the match is not valid."""
    def whole(pattern: str) -> Column:
        return F.rlike(value, F.lit(f"^(?:{pattern})$"))

    out = F.when(F.contains(value, F.lit("@")), F.struct(F.lit("email").alias("kind"), _email(key, value).alias("value")))
    for kind, pattern, make in (
        ("ipv4", _IP, _ip), ("date", _DATE, _date), ("ssn", _SSN, _ssn), ("phone", _PHONE, _phone), ("card", _CARD, _card)
    ):
        valid, made = make(key, value)
        chosen = F.when(valid, F.struct(F.lit(kind).alias("kind"), made.alias("value"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value"))
        )
        out = out.when(whole(pattern), chosen)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value")))


def pseudonymise(df: DataFrame, key: str, text: str = "text", kinds_column: str | None = "pii_kinds") -> DataFrame:
    """The rows with personal data in `text` replaced; `pii_kinds`, if wanted, lists the kind of every value replaced."""
    columns = [c for c in df.columns if kinds_column is None or c.lower() != kinds_column.lower()]
    value = F.col(f"`{text}`")
    name = free_name(df, "_pii_found")
    has = F.rlike(value, F.lit("[0-9@]"))
    found = F.transform(F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0)), lambda m: _pseudonym(key, m))
    marked = df.select(*[F.col(f"`{c}`") for c in columns], F.when(has, found).alias(name))
    parts = F.split(value, PATTERN, -1)
    joined = F.array_join(
        F.zip_with(parts, F.col(name), lambda p, f: F.concat(p, F.coalesce(f["value"], F.lit("")))), ""
    )
    new_text = F.when(F.size(name) > 0, joined).otherwise(value)
    kinds = F.filter(F.transform(name, lambda f: f["kind"]), lambda k: k.isNotNull())
    none = F.array().cast("array<string>")
    extra = [] if kinds_column is None else [F.coalesce(kinds, none).alias(kinds_column)]
    return marked.select(*[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in columns], *extra)
