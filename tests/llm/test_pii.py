import datetime
import hashlib
import re

from docsift.llm.pii import pseudonymise

KEY = "k1"


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def run(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_ip string")
    return [r for r in pseudonymise(df, key).orderBy("doc_id").collect()]


def prf(tag, i, x):
    return int(hashlib.sha256(f"{KEY}|{tag}|{i}|{x}|{KEY}".encode()).hexdigest()[:15], 16)


def feistel(tag, x, y, a, b):
    for i in range(1, 11):
        if i % 2:
            x = (x + prf(tag, i, y) % a) % a
        else:
            y = (y + prf(tag, i, x) % b) % b
    return x, y


def test_values_keep_their_format_and_validity(spark):
    cards = ["4845168114407329", "4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004"]
    rows = run(spark, [f"pay {c} now" for c in cards])
    for c, r in zip(cards, rows):
        new = r.text[4:-4]
        if not luhn(re.sub(r"\D", "", c)):
            assert new == c and r.n_card == 0
            continue
        assert new != c and r.n_card == 1 and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", c)
        assert luhn(re.sub(r"\D", "", new))
    assert re.sub(r"\D", "", rows[1].text) == re.sub(r"\D", "", rows[2].text)


def test_feistel_equals_python(spark):
    x, y = feistel("phone:10", 17555, 17713, 10**5, 10**5)
    assert run(spark, ["+1 (017) 551-7713."])[0].text == "+1 ({0}) {1}-{2}.".format(
        *re.fullmatch(r"(...)(...)(....)", f"{feistel('phone:10', 1755, 17713, 10**5, 10**5)[0]:05d}"
                      f"{feistel('phone:10', 1755, 17713, 10**5, 10**5)[1]:05d}").groups()) and (x, y)
    a, b = feistel("ip", 97 * 256 + 51, 17 * 256 + 173, 65536, 65536)
    assert run(spark, ["at 97.51.17.173, ok"])[0].text == f"at {a >> 8}.{a & 255}.{b >> 8}.{b & 255}, ok"
    start, day = datetime.date(1800, 1, 1), datetime.date(1987, 3, 14)
    n = (day - start).days
    p, q = feistel("date", n // 773, n % 773, 189, 773)
    new = start + datetime.timedelta(days=p * 773 + q)
    got = run(spark, ["on 1987-03-14 and 14.03.1987 and 1987/03/14"])[0]
    assert got.text == f"on {new:%Y-%m-%d} and {new:%d.%m.%Y} and {new:%Y/%m/%d}" and got.n_date == 3


def test_permutation_has_no_collisions(spark):
    rows = run(spark, [f"{a}-{g:02d}-{s:04d}" for a in ("001", "665", "667", "899") for g in (1, 99) for s in range(1, 200)])
    out = [r.text for r in rows]
    assert len(set(out)) == len(out)
    for t in out:
        a, g, s = map(int, t.split("-"))
        assert 0 < a < 900 and a != 666 and 0 < g < 100 and 0 < s < 10000


def test_invalid_and_degenerate_texts_stay(spark):
    same = ["", None, "no numbers", "999.1.1.1", "2021-02-30", "000-12-3456", "666-12-3456", "1.2.3.4.5",
            "1234567890123456", "9" * 500, "x" * 5000, "a@b", "DE00370400440532013000"]
    assert [r.text for r in run(spark, same)] == same


def test_iban_and_email(spark):
    r = run(spark, ["DE89370400440532013000 and jane.doe83@example.org!", "(jane.doe83@example.org)"])
    iban = r[0].text.split(" ")[0]
    assert r[0].n_iban == 1 and iban[:2] == "DE" and iban != "DE89370400440532013000"
    assert int(iban[4:] + "1314" + iban[2:4]) % 97 == 1
    mail = re.search(r"[a-z]{4}\.[a-z]{3}\d\d@example\.org", r[0].text)[0]
    assert mail in r[1].text and "jane" not in r[1].text and r[1].n_email == 1


def test_national_phones(spark):
    rows = run(spark, ["743-555-3824", "call (743) 555-3824.", "743.555.3824", "143-555-3824", "743-155-3824", "x743-555-3824",
                       "743-555-38245", "0-743-555-3824"])
    x, y = feistel("national", 543, 355 * 10_000 + 3824, 800, 8_000_000)
    a, e, n = str(x + 200), str(y // 10_000 + 200), f"{y % 10_000:04d}"
    assert [r.text for r in rows[:3]] == [f"{a}-{e}-{n}", f"call ({a}) {e}-{n}.", f"{a}.{e}.{n}"]
    assert [r.n_phone for r in rows] == [1, 1, 1, 0, 0, 0, 0, 0] and rows[3].text == "143-555-3824"
    many = [r.text for r in run(spark, [f"{a}-{e}-{n:04d}" for a in (200, 201, 998, 999) for e in (200, 999) for n in range(60)])]
    assert len(set(many)) == len(many) and all(re.fullmatch(r"[2-9]\d\d-[2-9]\d\d-\d{4}", t) for t in many)


def iban(land, body):
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    return f"{land}{98 - number(body + land + '00') % 97:02d}{body}"


def test_ibans_with_letters_and_in_groups(spark):
    own = ["GB82WEST12345698765432", iban("MT", "MALT011000012345MTLCAST001S"), iban("FR", "20041010050500013M02606"),
           iban("NL", "ABNA0417164300"), iban("XX", "ABCDEFGHIJKLMNOPQRST"), iban("XX", "12345678901")]
    groups = [" ".join(s[i:i + 4] for i in range(0, len(s), 4)) for s in own]
    rows = run(spark, [f"to {s}, now" for s in own + groups])
    for old, r in zip(own + groups, rows):
        new = r.text[3:-5]
        shape = lambda s: re.sub("[0-9]", "9", re.sub("[A-Z]", "A", s))
        s = new.replace(" ", "")
        assert r.n_iban == 1 and new != old and new[:2] == old[:2] and shape(new) == shape(old)
        assert iban(s[:2], s[4:]) == s
    assert [r.text.replace(" ", "") for r in rows[:6]] == [r.text.replace(" ", "") for r in rows[6:]]
    bad = ["GB83WEST12345698765432", "GB83 WEST 1234 5698 7654 32", iban("XX", "ABCDEFGHIJKLMNOPQRSTU")]
    assert [r.text for r in run(spark, bad)] == bad
    short = [r.text for r in run(spark, [iban("GB", f"A{a}{b}T1234567{c}") for a in "AZ" for b in "ABCDEFXYZ" for c in range(100, 140)])]
    assert len(set(short)) == 2 * 9 * 40


def test_cards_of_fifteen_digits(spark):
    r = run(spark, ["3782 822463 10005", "378282246310005", "3782-822463-10006"])
    assert re.fullmatch(r"\d{4} \d{6} \d{5}", r[0].text) and luhn(r[0].text.replace(" ", ""))
    assert r[0].text.replace(" ", "") == r[1].text != "378282246310005" and r[2].text == "3782-822463-10006"


def test_links_across_documents_depend_on_the_key(spark):
    a, b = (run(spark, ["129.38.82.176", "see 129.38.82.176."], k) for k in ("k1", "k2"))
    assert a[1].text == f"see {a[0].text}." and a[0].text != b[0].text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pseudonymise(df, KEY).count() == 0
