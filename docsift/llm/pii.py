"""Format-preserving pseudonyms for personal numbers, dates and addresses (DataFrame functions only).

Candidates are found by one pattern, validated by kind (Luhn, octets, calendar,
number blocks, mod 97), and replaced by a keyed permutation of the kind's own
domain: a Feistel network on Z_a x Z_b whose round function is SHA-256 under the
key.  The result is valid in its turn, and equal values get equal pseudonyms in
every document.  Everything happens inside the row: no shuffle.

Covered: e-mail addresses; IPv4; IBANs of digits and capitals, together or in
printed groups of four (a word of four capitals right behind one in groups hides
it); dates yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, dd/mm/yyyy, mm/dd/yyyy from 1800
to 2199; nnn-nn-nnnn social numbers; phone numbers with + and a country code, and
national ones as (nnn) nnn-nnnn, nnn-nnn-nnnn or nnn.nnn.nnnn with area and
exchange from 200 on (a number of its own beside the + form); cards of 13 to 19
digits, 4-4-4-4 or 4-6-5.  Not covered, and left in the text: IPv6, phone numbers
of other national shapes, small-letter IBANs, names and postal addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.tables import same_columns

ROUNDS = 10
#: Days of one whole calendar cycle of 400 years from 1800-01-01: 189 * 773.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773

#: Fixed patterns of each kind; a kind's own order decides which is tried first.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{2}([./])\d{2}\2\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
             r"|(?<![\w+.)-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.-])[2-9]\d{2}[.-]\d{4}(?![\w-]|\.\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5})(?!\d)",
}
#: Each kind's pattern in a form that needs no look-around, to tell what matched.
SHAPES = {
    "email": "@", "ip": r"^\d{1,3}(\.\d{1,3}){3}$", "iban": "^[A-Z]", "date": r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[./]\d{2}[./]\d{4})$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$", "phone": r"^(\+|\(|\d{3}[.-]\d{3}[.-]\d{4}$)", "card": r"^[\d -]+$",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _prf(key: str, tag: Column, i: Column, x: Column) -> Column:
    """60 bits of SHA-256 of key, tag, round and half."""
    h = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), x.cast("string"), F.lit(key)).cast("binary"), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def permute(key: str, tag: Column, x: Column, y: Column, a: Column, b: Column) -> Column:
    """struct(x, y): keyed permutation of Z_a x Z_b, halves in turn shifted by a hash of the other."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    def step(acc, i):
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(acc["x"] + F.pmod(_prf(key, tag, i, acc["y"]), a), a)).otherwise(acc["x"]).alias("x"),
            F.when(odd, acc["y"]).otherwise(F.pmod(acc["y"] + F.pmod(_prf(key, tag, i, acc["x"]), b), b)).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _pad(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def digits(key: str, tag: str, s: Column) -> Column:
    """Keyed permutation of decimal strings of one length (at most 36 digits)."""
    n = F.length(s)
    k = F.floor(n / 2).cast("int")
    ten = lambda e: F.pow(F.lit(10.0), e).cast("long")
    x = F.when(k > 0, F.substr(s, F.lit(1), k)).otherwise("0").cast("long")
    y = F.substr(s, k + 1).cast("long")
    p = permute(key, F.concat(F.lit(tag + ":"), n.cast("string")), x, y, F.greatest(ten(k), F.lit(1)), ten(n - k))
    return let(p, lambda p: F.concat(F.when(k > 0, _pad(p["x"], k)).otherwise(""), _pad(p["y"], n - k)))


def refill(shape: Column, new: Column, which: str) -> Column:
    """`shape` with its characters matching `which` replaced, in order, by those of `new`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(F.split(shape, ""), start, lambda acc, c: F.when(
        c.rlike(which), F.struct(F.concat(acc["out"], F.substr(new, acc["k"], F.lit(1))).alias("out"),
                                 (acc["k"] + 1).alias("k")))
        .otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))), lambda acc: acc["out"])


def luhn_sum(s: Column) -> Column:
    """Luhn sum of a digit string, the rightmost digit having weight 1."""
    def add(acc, i):
        d = F.substr(s, F.length(s) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), add)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _card(key: str, m: Column) -> Column:
    def made(s):
        body = digits(key, "card", F.substr(s, F.lit(1), F.length(s) - 1))
        check = lambda b: F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")
        return F.when(luhn_sum(s) % 10 == 0, let(body, lambda b: refill(m, F.concat(b, check(b)), r"\d")))
    return let(_only_digits(m), made)


def _phone(key: str, m: Column) -> Column:
    """International: the last ten digits.  National: area and exchange 200-999 stay in that range."""
    far = let(_only_digits(m), lambda s: refill(m, F.concat(
        F.substr(s, F.lit(1), F.length(s) - 10), digits(key, "phone", F.substr(s, F.length(s) - 9))), r"\d"))

    def near(s):
        part = lambda i, n: F.substr(s, F.lit(i), F.lit(n)).cast("int")
        p = permute(key, F.lit("national"), part(1, 3) - 200, (part(4, 3) - 200) * 10_000 + part(7, 4),
                    F.lit(800), F.lit(800 * 10_000))
        return let(p, lambda p: refill(m, F.concat(
            (p["x"] + 200).cast("string"), (p["y"] + 2_000_000).cast("string")), r"\d"))
    return F.when(m.startswith("+"), far).otherwise(let(_only_digits(m), near))


def _ip(key: str, m: Column) -> Column:
    def made(o):
        p = permute(key, F.lit("ip"), o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        octets = lambda p: [F.shiftright(p["x"], 8), p["x"] % 256, F.shiftright(p["y"], 8), p["y"] % 256]
        return F.when(F.array_max(o) <= 255, let(p, lambda p: F.concat_ws(
            ".", *(x.cast("string") for x in octets(p)))))
    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), made)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    ok = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    x = F.when(area > 666, area - 2).otherwise(area - 1)            # 898 areas
    p = permute(key, F.lit("ssn"), x, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    return F.when(ok, let(p, lambda p: F.concat_ws(
        "-", _pad(F.when(p["x"] >= 665, p["x"] + 2).otherwise(p["x"] + 1), F.lit(3)),
        _pad(F.floor(p["y"] / 9999) + 1, F.lit(2)), _pad(p["y"] % 9999 + 1, F.lit(4)))))


def _date(key: str, m: Column) -> Column:
    s = F.regexp_replace(m, "[./]", "-")
    start = F.lit(FIRST_DAY).cast("date")

    def as_(form: str, shown: str) -> Column:
        day = F.try_to_timestamp(s, F.lit(form)).cast("date")

        def made(at):
            p = permute(key, F.lit("date"), F.floor(at / DAYS_B), at % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
            new = let(p, lambda p: F.date_format(F.date_add(start, (p["x"] * DAYS_B + p["y"]).cast("int")), shown))
            return F.when((at >= 0) & (at < DAYS_A * DAYS_B), refill(m, new, r"\d"))
        return let(F.datediff(day, start), made)

    return F.coalesce(as_("yyyy-MM-dd", "yyyyMMdd"), as_("dd-MM-yyyy", "ddMMyyyy"), as_("MM-dd-yyyy", "MMddyyyy"))


#: Letters of an account part that are permuted, at most (26 to half their number is exact in a double).
IBAN_LETTERS = 20


def letters(key: str, tag: str, s: Column) -> Column:
    """Keyed permutation of strings of 1 to IBAN_LETTERS letters A-Z of one length."""
    n = F.length(s)
    k = F.floor(n / 2).cast("int")
    size = lambda e: F.pow(F.lit(26.0), e).cast("long")
    number = lambda t: F.aggregate(F.split(t, ""), F.lit(0).cast("long"), lambda acc, c: F.when(
        c == "", acc).otherwise(acc * 26 + F.ascii(c) - 65))
    spelled = lambda x, e: F.when(e > 0, F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(e, F.lit(1))), lambda i: F.char(F.floor(x / size(e - i)) % 26 + 65)), "")).otherwise("")
    p = permute(key, F.concat(F.lit(tag + ":"), n.cast("string")), number(F.substr(s, F.lit(1), k)),
                number(F.substr(s, k + 1)), size(k), size(n - k))
    return let(p, lambda p: F.concat(spelled(p["x"], k), spelled(p["y"], n - k)))


def mod_97(s: Column) -> Column:
    """Remainder of the number that digits and letters (A = 10) spell."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(key: str, m: Column) -> Column:
    """Digits become digits, letters letters, each in its place; the country stays."""
    def made(s):
        land, body = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5))
        ds, ls = F.regexp_replace(body, "[A-Z]", ""), F.regexp_replace(body, "[0-9]", "")
        ok = (mod_97(F.concat(body, land, F.substr(s, F.lit(3), F.lit(2)))) == 1) & (F.length(ls) <= IBAN_LETTERS)
        turned = F.when(F.length(ds) > 0, refill(body, digits(key, "iban", ds), "[0-9]")).otherwise(body)
        turned = F.when(F.length(ls) > 0, refill(turned, letters(key, "iban", ls), "[A-Z]")).otherwise(turned)
        check = lambda n: _pad(98 - mod_97(F.concat(n, land, F.lit("00"))), F.lit(2))
        return F.when(ok, let(turned, lambda n: refill(m, F.concat(land, check(n), n), "[A-Z0-9]")))
    return let(F.regexp_replace(m, " ", ""), made)


def _email(key: str, m: Column) -> Column:
    """Letters and digits of the local part become others of their class, keyed by the whole address."""
    local, domain = F.split(m, "@")[0], F.split(m, "@")[1]
    seed = F.lower(m)

    def swap(c, i):
        h = _prf(key, F.lit("email"), i, seed)
        pick = lambda chars: F.substr(F.lit(chars), (h % len(chars) + 1).cast("int"), F.lit(1))
        return (F.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
                .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                .when(c.rlike("[0-9]"), pick("0123456789")).otherwise(c))

    return F.concat(F.array_join(F.transform(F.split(local, ""), swap), ""), F.lit("@"), domain)


_MAKERS = {"email": _email, "ip": _ip, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _named(kind: str, value: Column) -> Column:
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))))


def pseudonym(key: str, m: Column) -> Column:
    """struct(kind, value) of one candidate; null where it is not valid and stays."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(SHAPES[kind]), _named(kind, _MAKERS[kind](key, m))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with valid personal values replaced, and n_<kind> counts of them.

    Emails keep their shape (not a permutation: two addresses could meet, with
    probability 26^-length); the other kinds are permutations of their valid
    values.  Null stays null; text between values is untouched; all rows and
    columns stay, of any name (counts overwrite columns of the same names).  Each
    row is judged by itself, so ids, null or equal ones too, play no part.
    """
    text = F.col(text_col).cast("string")
    found = F.regexp_extract_all("t", F.lit(ANY), F.lit(0))
    work = (docs.select(F.struct("*").alias("row"), text.alias("t"))
            .withColumn("found", F.when(F.col("t").rlike("[0-9@]"), found))
            .withColumn("new", F.transform("found", lambda m: pseudonym(key, m))))
    changed = F.exists("new", lambda p: p.isNotNull())
    work = work.withColumn("gaps", F.when(changed, F.split("t", ANY)))
    rebuilt = F.concat(F.array_join(F.transform("new", lambda p, i: F.concat(
        F.get(F.col("gaps"), i), F.coalesce(p["value"], F.get(F.col("found"), i)))), ""),
        F.element_at("gaps", -1))
    counts = {f"n_{kind}": F.expr(f"bigint(coalesce(size(filter(new, p -> p.kind = '{kind}')), 0))")
              for kind in PATTERNS}
    return same_columns(work, docs, **{text_col.lower(): F.when(changed, rebuilt).otherwise(F.col("t")), **counts})
