import re

from colprism.llm.pii import replace_entities, surrogates, entities
from colprism.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"
FINDS = re.compile(
    r"[A-Za-z0-9._%+-]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.+-])\d{16}(?!\w)|(?<![\w.])\d+\.\d+\.\d+\.\d+(?!\w)"
)


def test_whole_query(spark):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    new = {r.doc_id: r.text for r in QUERIES["op8_pii_surrogates"](spark, FOLDER).collect()}
    assert old.keys() == new.keys()
    seen, real = {}, {f for t in old.values() for f in FINDS.findall(t)}
    assert real
    for i, text in old.items():
        gaps = FINDS.split(text)
        pattern = "(.+?)".join(map(re.escape, gaps))
        match = re.fullmatch(pattern, new[i], re.S)
        assert match, (i, text[:80])
        for was, now in zip(FINDS.findall(text), match.groups()):
            assert was != now and now not in real and seen.setdefault(was, now) == now
            if was[0] == "+":
                assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", now)
            elif "@" in was:
                assert re.sub(r"\d", "9", re.sub("[a-z]", "a", now.split("@")[0])) == re.sub(
                    r"\d", "9", re.sub("[a-z]", "a", was.lower().split("@")[0])
                )
            elif "." not in was:
                assert re.fullmatch(r"\d{16}", now)
    assert len(set(seen.values())) == len(seen)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(rows)], "doc_id bigint, text string, found string, kind int")


def replaced(spark, rows, key="k"):
    return {r.doc_id: r.text for r in replace_entities(frame(spark, rows), key=key).collect()}


def test_coreference_and_format(spark):
    got = replaced(
        spark,
        [
            "call +1 (375) 555-4393 or (375) 555-4393 or 375-555-4393.",
            "A.b9@Mail.com, a.b9@mail.com; x@y.org",
            "Mrs. Anna Smith and Mr Smith and Frau Müller, Mrs. Anna Smith again. Господин Пушкин",
            "card 4785 3805 9239 1139 is 4785380592391139 and 4785-3805-9239-1139",
            "ip 10.0.0.1 and 10.0.0.1, not 1.2.3 nor 999.1.1.1",
            "iban DE89 3704 0044 0532 0130 00 = DE89370400440532013000",
        ],
    )
    a, b, c = re.fullmatch(r"call \+1 (.{14}) or (.{14}) or (.{12})\.", got[0]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) == re.sub(r"\D", "", c) and a[0] == "("
    x, y, z = re.fullmatch(r"(\S+), (\S+); (\S+)", got[1]).groups()
    assert x == y != z and x.endswith(".example.org") and re.match(r"[a-z]\.[a-z]\d@", x)
    names = re.fullmatch(r"Mrs\. (\w+ [\w-]+) and Mr ([\w-]+) and Frau ([\w-]+), Mrs\. (\w+ [\w-]+) again\. Господин ([А-Яа-я-]+)", got[2])
    assert names and names[1] == names[4] and names[1] != "Anna Smith"
    card = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) is (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4})", got[3])
    assert card and card[1].replace(" ", "") == card[2] == card[3].replace("-", "")
    assert re.fullmatch(r"ip (\S+) and \1, not 1\.2\.3 nor 999\.1\.1\.1", got[4]) and "10.0.0.1" not in got[4]
    iban = re.fullmatch(r"iban (DE[\d ]+) = (DE\d+)", got[5])
    assert iban and iban[1].replace(" ", "") == iban[2]


def test_every_match_holds_a_sign(spark):
    from pyspark.sql import functions as F

    from colprism.llm import pii

    found = {
        "email": ["a@b", "x.y@z.org"],
        "ip": ["8.8.8.8", "1.1.1.1", "10.0.0.1", "255.255.255.255"],
        "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
        "card": ["4785380592391139", "4785-3805-9239-1139"],
        "ssn": ["123-45-6789"],
        "phone": ["+1 (375) 555-4393", "375-555-4393", "+49 3 12 34", "+1(2)34 56"],
        "name": ["Mr Smith", "Dr. Ada Bach", "Госпожа Белых"],
    }
    assert found.keys() == pii.PATTERNS.keys()
    for kind, texts in found.items():
        for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", F.col("t").rlike(f"^(?:{pii.PATTERNS[kind]})$").alias("match"), F.col("t").rlike(pii._SIGN).alias("sign")
        ).collect():
            assert r.match and r.sign, (kind, r.t)
    got = replaced(spark, ["use 8.8.8.8 or 1.1.1.1", "42 hosts ask 8.8.8.8"])
    a, b = re.fullmatch(r"use ([\d.]+) or ([\d.]+)", got[0]).groups()
    assert a != "8.8.8.8" and b != "1.1.1.1" and a != b and got[1] == f"42 hosts ask {a}"


def test_more_spellings(spark):
    rows = [
        "Dr. J. Smith met Mr O'Brien, Mr SMITH and Frau Anna Maria Schmidt.",
        "Mrs Anna Smith's dog. Then Anna Smith left; Annabel stayed.",
        "Dr Παπαδόπουλος",
        "cards 378282246310005, 3782 822463 10005, 4222222222222 but 4222222222223",
        "call (415)555-0123 or 4155550123 or 030 1234567",
        "at 1712345678901 or 1712345678, no. 123456",
    ]
    got = replaced(spark, rows)
    assert not re.search(r"Smith|O'Brien|SMITH|Anna Maria|Schmidt", got[0])
    name = re.fullmatch(r"Mrs (.+)'s dog\. Then (.+) left; Annabel stayed\.", got[1])
    assert name and name[1] == name[2] != "Anna Smith"
    assert re.fullmatch("Dr [Ͱ-Ͽ]+", got[2]) and got[2] != rows[2]
    cards = re.fullmatch(r"cards (\d{15}), (\d{4} \d{6} \d{5}), (\d{13}) but 4222222222223", got[3])
    assert cards and cards[1] == cards[2].replace(" ", "") != "378282246310005" and cards[3] != "4222222222222"
    phones = re.fullmatch(r"call (\(\d{3}\)\d{3}-\d{4}) or (\d{10}) or (\d{3} \d{7})", got[4])
    assert phones and re.sub(r"\D", "", phones[1]) == phones[2] != "4155550123" and phones[3] != "030 1234567"
    assert got[5] == rows[5]


def test_keyed_and_repeatable(spark):
    rows = ["a@b.com 4785380592391139"]
    assert replaced(spark, rows) == replaced(spark, rows) != replaced(spark, rows, "other")


def test_edges(spark):
    rows = [None, "", "nothing here", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "a" * 200000, "1 " * 50000, "@ @@ a@ @b +1 (1"]
    docs = frame(spark, rows)
    got = replace_entities(docs)
    assert got.columns == docs.columns and sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))
    twice = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (1, "x"), (None, "c@d.com")], "doc_id bigint, text string")
    got = replace_entities(twice).collect()
    assert len(got) == 4 and not any("b.com" in r.text or "d.com" in r.text for r in got)
    assert replace_entities(twice.limit(0)).count() == 0


def test_no_two_share_a_surrogate_where_room_is_small(spark):
    rows = [" ".join(f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz")] + [f"Mr {a}{b}" for a in "ABCDEFGHIJ" for b in "abcdefghij"]
    known = entities(frame(spark, rows))
    given = surrogates(known).collect()
    assert len(given) == known.select("kind", "canon").distinct().count() == 126
    assert len({(r.kind, r.surrogate) for r in given}) == 126


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def mod_97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_surrogates_pass_what_their_originals_passed(spark):
    import random

    draw = random.Random(5)

    def card(start, n):
        body = start + "".join(draw.choices("0123456789", k=n - len(start) - 1))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def iban(country, account):
        return f"{country}{98 - mod_97(country + '00' + account):02d}{account}"

    cards = [card(s, n) for s, n in [("4", 16), ("4", 13), ("51", 16), ("37", 15), ("6011", 16), ("30", 14)] for _ in range(5)]
    ibans = [iban("DE", "370400440532013000"), iban("GB", "WEST12345698765432"), iban("NO", "86011117947"), "FR7630006000011234567890180"]
    rows = [f"a {c} b" for c in cards + ibans] + ["a 4111111111111112 b"]
    got = replaced(spark, rows)
    for i, c in enumerate(cards):
        new = got[i][2:-2]
        assert luhn(new) and len(new) == len(c) and new[:2] == c[:2] and new != c, (c, new)
    for i, c in enumerate(ibans, len(cards)):
        new = got[i][2:-2]
        assert (mod_97(new) == 1) == (mod_97(c) == 1) and new[:2] == c[:2] and new != c
        assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", c) or re.search("[A-Z]", c[2:])
        assert len(new) == len(c)
    assert re.fullmatch(r"a 41\d{14} b", got[len(rows) - 1])


def test_addresses_keep_to_their_range(spark):
    import ipaddress

    own = ["10.0.0.1", "192.168.1.7", "172.20.0.4", "127.0.0.1", "169.254.3.3"]
    got = replaced(spark, [f"at {a} now" for a in own + ["8.8.8.8", "172.32.0.1", "192.169.1.1"]])
    nets = ["10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "127.0.0.0/8", "169.254.0.0/16"] + ["240.0.0.0/4"] * 3
    for i, net in enumerate(nets):
        assert ipaddress.ip_address(got[i].split(" ")[1]) in ipaddress.ip_network(net)
    # A range that is in use as a whole leaves for the next.
    full = " ".join(f"192.168.{a}.{b}" for a in range(256) for b in range(256))
    new = replaced(spark, [full])[0].split(" ")
    assert len(set(new)) == 65536 and all(a.startswith("10.") for a in new)


def test_phones_and_names_keep_their_shape(spark):
    rows = ["+49 170 1234567", "+358 40 1234567", "+1 (415) 555-0123", "030 1234567", "078-05-1120", "999-05-1120"]
    rows += ["Mr SMITH and Mr Smith", "Frau Anna Maria Schmidt", "Dr. J.R. Smith, Mr J. SMITH", "Mrs Anna SCHMIDT. Anna SCHMIDT"]
    got = replaced(spark, rows)
    for i, shape in enumerate([r"\+49 [1-9]\d{2} \d{7}", r"\+358 [1-9]\d \d{7}", r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", r"0[1-9]\d \d{7}"]):
        assert re.fullmatch(shape, got[i]) and got[i] != rows[i], got[i]
    assert re.fullmatch(r"[0-8]\d\d-\d\d-\d{4}", got[4]) and not got[4].startswith("666") and got[5][0] != "0"
    a, b = re.fullmatch(r"Mr ([A-Z-]+) and Mr ([A-Z][\w-]+)", got[6]).groups()
    assert a == b.upper() != "SMITH" and not b.isupper()
    assert re.fullmatch(r"Frau [A-Z][a-z]+ [A-Z][a-z]+ [A-Z][\w-]+", got[7])
    assert re.fullmatch(r"Dr\. [A-Z]\.[A-Z]\. [A-Z][a-z][\w-]*, Mr [A-Z]\. [A-Z-]+", got[8])
    a, b = re.fullmatch(r"Mrs (.+)\. (.+)", got[9]).groups()
    assert a == b != "Anna SCHMIDT" and re.fullmatch("[A-Z][a-z]+ [A-Z-]+", a)


def test_key_of_the_session(spark):
    from colprism.llm import pii

    assert len(pii.session_key(spark)) == 64 == len({pii.session_key(spark)} | set(range(63)))
    spark.conf.set(pii.KEY_SETTING, "own")
    try:
        assert replaced(spark, ["a@b.com"], None) == replaced(spark, ["a@b.com"], "own")
    finally:
        spark.conf.unset(pii.KEY_SETTING)
