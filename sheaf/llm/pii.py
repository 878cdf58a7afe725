"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that pass their check are permuted within their format by a keyed Feistel network over two residues, so
the same value gets the same pseudonym in every document, different values get different ones, and a pseudonym passes
the same check:

* payment cards (13 to 19 digits, Luhn): all digits but the last, which becomes the new check digit;
* IBANs (mod 97): the digits of the account part, then new check digits;
* social security numbers (valid areas, groups and serials): within the valid ones;
* phone numbers: the last ten digits; IPv4 addresses: the four octets;
* dates of the years 1000 to 2999, in figures or with an English month name: among the days of their century, so the same day
  in two forms stays the same day. With slashes the month stands first where it can, with dots the day, with dashes the day
  where it can. Two-digit years, years first with dots and month names of other languages are left alone.

E-mail addresses and hexadecimal secrets, in small letters or capitals, are no numbers; they get keyed digests in their own
format. The rest of a text is
unchanged: numbers that fail their check, and texts without personal data. A null text stays null.

The round function is SHA-256 over key, kind, round and the other residue. The key is a parameter: keep it secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]{0,63}[A-Fa-f])(?=[0-9A-Fa-f]{0,63}\d)[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
DATE = r"(?<![\d./\-])(?:[12]\d{3}-\d{2}-\d{2}|[12]\d{3}/\d{1,2}/\d{1,2}|\d{1,2}-\d{1,2}-[12]\d{3}|\d{1,2}/\d{1,2}/[12]\d{3}|\d{1,2}\.\d{1,2}\.[12]\d{3})(?![\d/\-]|\.\d)"
MONTH = (r"(?i:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?"
         r"|Dec(?:ember)?)(?![A-Za-z])")
_DAY = r"\d{1,2}(?i:st|nd|rd|th)?"
NAMED_DATE = (rf"(?<![\w./\-]){_DAY}(?:\s{{1,3}}of)?[\s\-]{{1,3}}{MONTH}\.?,?[\s\-]{{1,3}}[12]\d{{3}}(?!\w)"
              rf"|(?<![A-Za-z]){MONTH}\.?\s{{1,3}}{_DAY},?\s{{1,3}}[12]\d{{3}}(?!\w)")
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = (r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)"
         r"|(?<![\d)])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}([.\-])\d{3}\1\d{4}(?![\d\-]|\.\d)")
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\2\d{4}\2\d{4}|\d{4}([ \-])\d{6}\3\d{5})(?!\d)"
ANY = "|".join((EMAIL, SECRET, IBAN, IPV4, DATE, NAMED_DATE, SSN, PHONE, CARD))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def number(digits: Column) -> Column:
    return digits.try_cast("bigint")


def feistel(x: Column, y: Column, size_x: Column, size_y: Column, tweak: Column | str, key: str) -> Column:
    """A keyed permutation of the pairs below (size_x, size_y), as a struct of x and y."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def keyed(i: Column, v: Column) -> Column:
        drawn = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), v.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(drawn, 1, 14), 16, 10).cast("bigint")

    def turn(s: Column, i: Column) -> Column:
        a, b = s["x"], s["y"]
        return F.struct(F.when(i % 2 == 0, F.pmod(a + keyed(i, b), size_x)).otherwise(a).alias("x"),
                        F.when(i % 2 == 1, F.pmod(b + keyed(i, a), size_y)).otherwise(b).alias("y"))

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("bigint")


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """A digit string of 2 to 36 digits permuted among those of its length."""

    def body(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        new = feistel(number(F.substr(d, F.lit(1), left)), number(F.substr(d, left + 1)), ten_to(left), ten_to(right),
                      F.concat(F.lit(kind), F.length(d).cast("string")), key)
        return let(new, lambda s: F.concat(F.lpad(s["x"].cast("string"), left, "0"), F.lpad(s["y"].cast("string"), right, "0")))

    return let(digits, body)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def with_digits(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits``, one by one."""

    def put(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike(r"\d"), F.substr(digits, F.length(digits_of(F.substr(text, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), put), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled``: parity (from the right, 0 the last digit) of the digits that are doubled."""

    def one(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, b: a + b)


def new_card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        payload = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
        whole = let(payload, lambda p: F.concat(p, F.pmod(10 - F.pmod(luhn_sum(p, 0), F.lit(10)), F.lit(10)).cast("string")))
        real = (F.pmod(luhn_sum(d, 1), F.lit(10)) == 0) & (F.replace(d, F.substr(d, F.lit(1), F.lit(1)), F.lit("")) != "")
        return F.when(real, let(whole, lambda w: with_digits(m, w))).otherwise(m)

    return let(digits_of(m), body)


def mod97(letters: Column) -> Column:
    """Remainder of a string of digits and capitals, a capital counting as 10 to 35."""

    def step(r: Column, i: Column) -> Column:
        c = F.substr(letters, i, F.lit(1))
        return F.when(c.rlike(r"\d"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(letters)), F.lit(0), step)


def new_iban(m: Column, key: str) -> Column:
    def body(bare: Column) -> Column:
        land, account = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5))
        digits = digits_of(account)
        fresh = let(permuted_digits(digits, "iban", key), lambda d: with_digits(account, d))
        check = let(fresh, lambda a: F.concat(F.lpad((98 - mod97(F.concat(a, land, F.lit("00")))).cast("string"), 2, "0"), a))
        real = (mod97(F.concat(account, F.substr(bare, F.lit(1), F.lit(4)))) == 1) & (F.length(digits) > 3) & (F.length(bare) >= 15)
        return F.when(real, let(digits_of(check), lambda d: with_digits(m, d))).otherwise(m)

    return let(F.translate(m, " ", ""), body)


def new_ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (number(F.substr(m, F.lit(i), F.lit(n))) for i, n in ((1, 3), (5, 2), (8, 4)))
    real = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), "ssn", key)

    def text(s: Column) -> Column:
        r = F.floor(s["x"] / 99)
        a = F.when(r >= 665, r + 2).otherwise(r + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"),
                           F.lpad((s["y"] + 1).cast("string"), 4, "0"))

    return F.when(real, let(new, text)).otherwise(m)


def new_phone(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        kept = F.greatest(F.length(d) - 10, F.lit(0))
        fresh = F.concat(F.substr(d, F.lit(1), kept), permuted_digits(F.substr(d, kept + 1), "phone", key))
        return let(fresh, lambda n: with_digits(m, n))

    return let(digits_of(m), body)


def new_ipv4(m: Column, key: str) -> Column:
    def body(p: Column) -> Column:
        o = [p[i].cast("bigint") for i in range(4)]
        new = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "ipv4", key)
        return let(new, lambda s: F.concat_ws(".", *[x.cast("bigint").cast("string") for x in (
            F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256)]))

    return let(F.split(m, r"\."), body)


def new_day(year: Column, month: Column, day: Column, key: str) -> Column:
    """Permuted among the 36,524 or 36,525 days of its century; 92 * 397 and 75 * 487 are the residues. Null if there is no such day."""
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    century = F.floor(year.cast("int") / 100)
    first = F.try_to_date(F.concat(F.lpad(century.cast("string"), 2, "0"), F.lit("00-01-01")), "yyyy-MM-dd")
    size_x = F.when(century % 4 == 0, 75).otherwise(92).cast("bigint")
    size_y = F.when(century % 4 == 0, 487).otherwise(397).cast("bigint")
    index = F.datediff(date, first)
    new = feistel(F.floor(index / size_y), index % size_y, size_x, size_y, F.concat(F.lit("date"), century.cast("string")), key)
    return F.when(date.isNotNull(), let(new, lambda s: F.date_add(first, (s["x"] * size_y + s["y"]).cast("int"))))


def new_date(m: Column, key: str) -> Column:
    sep = F.regexp_extract(m, r"[-/.]", 0)

    def body(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        day_first = (sep == ".") | (sep == "-") & (number(p[1]) <= 12) | (number(p[0]) > 12)
        year = F.when(year_first, p[0]).otherwise(p[2])
        month = F.when(year_first, p[1]).when(day_first, p[1]).otherwise(p[0])
        day = F.when(year_first, p[2]).when(day_first, p[0]).otherwise(p[1])

        def text(d: Column) -> Column:
            def like(old: Column, form: str) -> Column:
                new = F.date_format(d, form)
                return F.when(F.length(old) == 1, F.ltrim(new, F.lit("0"))).otherwise(new)

            def joined(*parts: Column) -> Column:
                return F.concat(parts[0], sep, parts[1], sep, parts[2])

            yyyy = F.date_format(d, "yyyy")
            return (F.when(year_first, joined(yyyy, like(p[1], "MM"), like(p[2], "dd")))
                    .when(day_first, joined(like(p[0], "dd"), like(p[1], "MM"), yyyy)).otherwise(joined(like(p[0], "MM"), like(p[1], "dd"), yyyy)))

        return let(new_day(year, month, day, key), lambda d: F.when(d.isNotNull(), text(d)).otherwise(m))

    return let(F.split(m, r"[-/.]"), body)


def new_named_date(m: Column, key: str) -> Column:
    """Long or short month name, letter case, leading zero and ordinal ending follow the original."""
    name, day, year = (F.regexp_extract(m, x, 1) for x in (rf"({MONTH})", r"(?<!\d)(\d{1,2})(?!\d)", r"(\d{4})$"))
    month = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int").cast("string")

    def text(d: Column) -> Column:
        short = (F.length(name) < 5) & ~F.lower(name).isin("may", "june", "july")
        new = F.when(short, F.date_format(d, "MMM")).otherwise(F.date_format(d, "MMMM"))
        new = F.when(name == F.upper(name), F.upper(new)).when(name == F.lower(name), F.lower(new)).otherwise(new)
        n, suffix = F.dayofmonth(d), F.regexp_extract(m, r"(?<!\d)\d{1,2}((?i:st|nd|rd|th))", 1)
        ending = F.when(n.isin(1, 21, 31), "st").when(n.isin(2, 22), "nd").when(n.isin(3, 23), "rd").otherwise("th")
        ending = F.when(suffix == "", "").when(suffix == F.upper(suffix), F.upper(ending)).otherwise(ending)
        figures = F.when(day.startswith("0"), F.date_format(d, "dd")).otherwise(n.cast("string"))
        out = F.regexp_replace(m, F.lit(MONTH), new)
        out = F.regexp_replace(out, F.lit(r"(?<!\d)\d{1,2}(?!\d)(?i:st|nd|rd|th)?"), F.concat(figures, ending))
        return F.regexp_replace(out, F.lit(r"\d{4}$"), F.date_format(d, "yyyy"))

    return let(new_day(year, month, day, key), lambda d: F.when(d.isNotNull(), text(d)).otherwise(m))


def keyed_digest(kind: str, m: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m).cast("binary"), 256)


def new_email(m: Column, key: str) -> Column:
    """User and domain get their own pseudonyms, so users of the same domain stay together."""
    domain = F.substring(keyed_digest("domain", F.lower(F.substring_index(m, "@", -1)), key), 1, 8)
    return F.concat(F.lit("u"), F.substring(keyed_digest("email", F.lower(m), key), 1, 12), F.lit("@d"), domain, F.lit(".example"))


def new_secret(m: Column, key: str) -> Column:
    new = F.substr(keyed_digest("secret", F.lower(m), key), F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(new)).otherwise(new)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a string that matched ANY, or the string itself where it fails its check."""
    kinds = ((EMAIL, new_email), (SECRET, new_secret), (IBAN, new_iban), (IPV4, new_ipv4), (DATE, new_date), (NAMED_DATE, new_named_date),
             (SSN, new_ssn), (PHONE, new_phone))
    out = None
    for pattern, new in kinds:
        whole = m.rlike(f"^(?:{pattern})$")
        out = F.when(whole, new(m, key)) if out is None else out.when(whole, new(m, key))
    return out.otherwise(new_card(m, key))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and how many values were, as the last column ``count``; a column of
    ``docs`` that has this name already gives way to it."""
    name = free_name(docs.columns, "_pii")
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), 0))
    kept = F.when(F.col(text).rlike("[0-9@]"), F.split(text, ANY, -1))
    new = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    work = docs.select("*", F.struct(kept.alias("kept"), new.alias("new")).alias(name))
    whole = F.array_join(F.transform(F.col(f"{name}.kept"), lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col(f"{name}.new"), i)["new"], F.lit("")))), "")
    changed = F.size(F.filter(F.col(f"{name}.new"), lambda p: p["old"] != p["new"]))
    done = F.when(F.size(f"{name}.new") > 0, whole).otherwise(F.col(text))
    others = [done.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() != count.lower()]
    return work.select(*others, F.when(F.size(f"{name}.new") > 0, changed).otherwise(0).cast("bigint").alias(count))
