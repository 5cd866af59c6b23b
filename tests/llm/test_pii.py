"""Surrogates: consistent, distinct, same kind and format, and native."""

import re

import pytest

from tierscope.llm import pii

TEXT = ('Mail Bob.Smith@Mail.example.com or bob.smith@mail.example.com; call +1 (974) 555-3436 or 974-555-3436. '
        'IP 10.2.33.255, card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112. Mr. John Smith, '
        'Mrs. Ada Smith, г-жа Анна Петрова; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", ssn 123-45-6789.')
SCHEMA = "doc_id bigint, text string, Entities string"


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, TEXT, "x"), (2, None, None), (3, "", "z"), (4, "clean 12 text 1234567890123456", "q"),
                                  (None, "10.2.33.255 again", "r"), (1, TEXT, "x")], SCHEMA)


def test_kinds_formats_and_coreference(docs):
    rows = pii.replace(docs).collect()
    text = next(r.text for r in rows if r.doc_id == 1)
    for own in ("Smith", "974", "10.2.33.255", "4111 1111", "4111111111111111", "04dbebab", "123-45", "Анна"):
        assert own not in text
    assert "4111111111111112" in text  # fails its check digit
    mails = re.findall(r"\S+@\S+\.com", text)
    assert mails[0].lower() == mails[1] and mails[0][0].isupper() and mails[0] != mails[1]
    phones = re.findall(r"(?:\+1 \()?\d{3}\)?[ -]\d{3}-\d{4}", text)
    assert re.sub(r"\D", "", phones[0])[-10:] == re.sub(r"\D", "", phones[1]) and phones[0].startswith("+1 (")
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|(?<!\d)\d{16}(?!\d)", text)
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and cards[1][0] == "4"
    names = re.search(r"Mr\. (\w+) (\w+), Mrs\. (\w+) (\w+), г-жа ([А-я]+) ([А-я]+);", text)
    assert names[2] == names[4] and names[1] != names[3]
    ip = re.search(r"IP (\d+)\.(\d+)\.(\d+)\.(\d+),", text)
    assert [len(ip[k]) for k in (1, 2, 3, 4)] == [2, 1, 2, 3] and all(int(ip[k]) < 256 for k in (1, 2, 3, 4))
    assert re.search(r'token = "[0-9a-f]{40}"', text)
    again = next(r for r in rows if r.doc_id is None)
    assert again.text == f"{ip[1]}.{ip[2]}.{ip[3]}.{ip[4]} again"
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[2].text, by_id[2].n_entities, by_id[2]["entities"]) == (None, 0, [])
    assert by_id[3].text == "" and by_id[4].text == "clean 12 text 1234567890123456" and by_id[4].n_entities == 0
    assert sum(r.doc_id == 1 for r in rows) == 2 and len({r.text for r in rows if r.doc_id == 1}) == 1
    assert next(r.text for r in pii.replace(docs, key="other").collect() if r.doc_id == 1) != text
    assert pii.replace(docs.where("false")).count() == 0


def test_secrets_of_any_case_and_length(spark):
    token, long = "04dbebab91ab85687d33eeaaf9ac699e1188f962", "aB3-" * 75
    docs = spark.createDataFrame([(1, f'token = "{token}"'), (2, f'TOKEN = "{token.upper()}"'),
                                  (3, f"Api_Key: '{long}' and Password=\"{long}x\"")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.replace(docs).collect()}
    new = re.fullmatch(r'token = "([0-9a-f]{40})"', got[1].text)[1]
    assert new != token and got[2].text == f'TOKEN = "{new.upper()}"'
    a, b = re.fullmatch(r"Api_Key: '((?:[a-z][A-Z]\d-){75})' and Password=\"((?:[a-z][A-Z]\d-){75}[a-z])\"", got[3].text).groups()
    assert long not in (a, b[:300]) and a != b[:300]
    assert [got[i].n_entities for i in (1, 2, 3)] == [1, 1, 2]


def test_secrets_of_any_alphabet(spark):
    """Masks, other scripts and emoji get another surrogate of the same length and kind."""
    secrets = ["********", "секретныйКлюч", "パスワード密码密码", "😀😁😂🤣😃😄😅😆", "--------", "Пароль-12-Äß", "ΜυστικόΚλειδί", "________x"]
    docs = spark.createDataFrame([(i, f'password = "{x}" and PASSWORD: "{x}"') for i, x in enumerate(secrets)],
                                 "doc_id bigint, text string")
    got = {r.doc_id: re.fullmatch(r'password = "([^"]+)" and PASSWORD: "([^"]+)"', r.text).groups()
           for r in pii.replace(docs).collect()}
    new = [got[i][0] for i in range(len(secrets))]
    assert all(a == b for a, b in got.values()) and len(set(new) | set(secrets)) == 2 * len(secrets)
    assert all(len(a) == len(b) for a, b in zip(new, secrets))
    assert re.fullmatch(r"[а-я]{9}[А-Я][а-я]{3}", new[1]) and re.fullmatch(r"[\u30a2-\u30f2]{3}.[\u30a2-\u30f2]?.*", new[2])
    assert re.fullmatch(r"[А-Я][а-я]{5}-\d\d-[A-Z][a-z]", new[5]) and re.fullmatch(r"[Α-Ω][α-ω]{6}[Α-Ω][α-ω]{5}", new[6])
    assert set(new[0] + new[4] + new[3]) <= set(pii._SYMBOLS) and re.fullmatch(r"_{8}[a-z]", new[7])


def test_very_long_text_and_greek_names(spark):
    body = "word " * 300_000
    docs = spark.createDataFrame([(1, body + 'Dr Παπαδόπουλος, token = "' + "q1" * 40_000 + '" ' + body)], "doc_id bigint, text string")
    r = pii.replace(docs).first()
    assert r.n_entities == 2 and r.text.startswith(body) and r.text.endswith(body)
    assert re.search(r"Dr [Α-Ω][α-ως]+, token = \"([a-z]\d){40000}\"", r.text) and "Παπαδόπουλος" not in r.text


def test_drawing_ends_with_an_error_when_nothing_is_free(spark, monkeypatch):
    monkeypatch.setattr(pii, "MOST_DRAWS", 3)
    monkeypatch.setattr(pii, "_secret", lambda m, h, draw: m)
    docs = spark.createDataFrame([(1, 'token = "abcdefgh1"')], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="no surrogate"):
        pii.replace(docs)


def test_collisions_are_drawn_again(spark):
    """Short addresses have few surrogates of their own format: they still stay
    apart, also when the entities drawn again are joined instead of inlined."""
    ips = [f"{a}.{b}.1.1" for a in range(1, 10) for b in range(10)]
    docs = spark.createDataFrame([(i, f"at {ip} x") for i, ip in enumerate(ips)], "doc_id bigint, text string")
    out = {}
    for inline in (500, -1):
        got = {r.doc_id: r.text.split()[1] for r in pii.replace(docs, inline=inline).collect()}
        assert len(set(got.values())) == len(ips) and not set(got.values()) & set(ips)
        out[inline] = got
    assert out[500] == out[-1]


def test_names_without_a_title(spark):
    """The whole name of a titled mention gets its surrogate everywhere in its text, and
    nowhere else; the longest name first."""
    texts = ["Mr John Smith came. John Smith left; XJohn Smith and John Smithson stayed. (John Smith)",
             "John Smith is not known here.",
             "Anna Maria Berg met Frau Anna Maria Berg and Mrs Anna Berg. Anna Berg, Anna Maria Berg.",
             "г-жа Анна Петрова. Анна Петрова!", "Mr Green likes green and Green.", "Dr Jean-Luc Mas; Jean-Luc Mas"]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    new = re.fullmatch(r"Mr (\w+ \w+) came\. (\w+ \w+) left; XJohn Smith and John Smithson stayed\. \((\w+ \w+)\)", got[0].text)
    assert new[1] == new[2] == new[3] != "John Smith" and got[0].n_entities == 3
    assert [tuple(e) for e in got[0]["entities"]] == [("name", "Mr " + new[1]), ("name", new[1]), ("name", new[1])]
    assert got[1].text == texts[1] and got[1].n_entities == 0
    a = re.fullmatch(r"(\w+ \w+ \w+) met Frau (\w+ \w+ \w+) and Mrs (\w+ \w+)\. (\w+ \w+), (\w+ \w+ \w+)\.", got[2].text)
    assert a[1] == a[2] == a[5] and a[3] == a[4] and "Anna" not in got[2].text and got[2].n_entities == 5
    b = re.fullmatch(r"г-жа ([А-я]+ [А-я]+)\. ([А-я]+ [А-я]+)!", got[3].text)
    assert b[1] == b[2] != "Анна Петрова"
    assert got[4].text.endswith(" likes green and Green.") and "Jean" not in got[5].text and got[5].n_entities == 2


def mod97(iban):
    c = iban.replace(" ", "")
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97


def test_iban_and_ipv6(spark):
    ibans = ["GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    kept = ["DE88370400440532013000", "std::face::b00c", "10:20:30", "DE89"]
    ips = ["2001:db8::ff00:42:8329", "2001:DB8::FF00:42:8329", "fe80::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fd12:3456:789a:1::1"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(ibans + kept + ips)], "doc_id bigint, text string").selectExpr(
        "doc_id", "concat('at ', text, ', so') as text")
    got = {r.doc_id: r for r in pii.replace(docs).collect()}
    new = [got[i].text[3:-4] for i in range(len(got))]
    assert [len(x) for x in new] == [len(x) for x in ibans + kept + ips]
    for a, b in zip(ibans, new):
        assert a != b and mod97(b) == 1 and a[:2] == b[:2] and re.sub("[A-Z]", "A", re.sub(r"\d", "0", a)) == re.sub(
            "[A-Z]", "A", re.sub(r"\d", "0", b))
    assert new[1] == new[2].replace(" ", "")
    assert new[4:8] == kept and [got[i].n_entities for i in range(4, 8)] == [0] * 4
    import ipaddress
    for a, b in zip(ips, new[8:]):
        assert a != b and a[:2].lower() == b[:2].lower() and ipaddress.ip_address(b)
        assert [len(g) for g in a.split(":")] == [len(g) for g in b.split(":")]
    assert new[8].upper() == new[9] and new[8] != new[9]


def test_short_addresses_collide_and_grow(spark):
    ips = [f"fe8{a}::{b}" for a in "abcdef" for b in "0123456789abcdef"]
    docs = spark.createDataFrame([(i, f"at {x} 1") for i, x in enumerate(ips)], "doc_id bigint, text string")
    new = [r.text.split()[1] for r in pii.replace(docs).collect()]
    assert len(set(new)) == len(ips) and not set(new) & set(ips)


def test_no_python_on_the_executors(docs):
    plan = pii.replace(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
