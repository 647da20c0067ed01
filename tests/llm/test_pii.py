import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import pii
from eventloom.llm.queries import EXAMPLE_KEY, op8_pseudonyms

KEY = b"a key for tests"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation(size):
    out = [pii.permute(x, size, KEY, "t") for x in range(size)]
    assert sorted(out) == list(range(size)) and [pii.permute(y, size, KEY, "t", back=True) for y in out] == list(range(size))
    assert size < 97 or out != [pii.permute(x, size, b"another", "t") for x in range(size)]
    odd = [x for x in range(size) if x % 2]
    assert sorted(pii.permute(x, size, KEY, "t", allowed=lambda x: x % 2 == 1) for x in odd) == odd


VALID = [
    ("email", "Anna.Lee-7@mail7.example.com"), ("card", "4111111111111111"), ("card", "4111 1111 1111 1111"), ("card", "3782-822463-10005"),
    ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("phone", "+1 (017) 555-7713"), ("phone", "555-867-5309"), ("phone", "+49 30 1234 5678"),
    ("phone", "+33123456789"), ("ssn", "078-05-1120"), ("ipv4", "192.168.0.1"), ("date", "2024-02-29"), ("date", "29.2.2024"), ("date", "12/31/1999"), ("date", "31/12/1999"), ("date", "01.01.1900"),
]
INVALID = ["4111111111111112", "1234567890123456", "DE89370400440532013001", "999-05-1120", "000-12-3456", "256.1.1.1", "2023-02-29", "31.4.2024", "13/32/1999", "2024-13-01", "1.2.3", "4.0", "a@b", "12345", "0000000000000000"]


@pytest.mark.parametrize("kind,value", VALID)
def test_valid_values_change_within_their_format(kind, value):
    text = f"before {value}, after"
    new, found = pii.pseudonymised(text, KEY)
    assert found == [(kind, 7, 7 + len(value))] and new != text
    own = new[7 : len(new) - 7]
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
    if kind != "ipv4":
        assert shape(own) == shape(value) or kind == "email"
    assert pii.pseudonymised(new, KEY)[1][0][0] == kind
    assert pii.pseudonymised(new, KEY, back=True)[0] == text
    assert pii.pseudonymised(text, b"another key")[0] != new


@pytest.mark.parametrize("value", INVALID)
def test_what_is_not_valid_stays(value):
    assert pii.pseudonymised(f"x {value} y", KEY) == (f"x {value} y", [])


def test_neighbours_and_links():
    text = "7536784127813050 4111111111111111 +1 (171) 555-2028 4111-1111-1111-1111 é.34@mail1.example.com 1.2.3.4."
    new, found = pii.pseudonymised(text, KEY)
    assert [k for k, _, _ in found] == (["card"] if pii.luhn("7536784127813050") % 10 == 0 else []) + ["card", "phone", "card", "email", "ipv4"]
    cards = [re.sub("-", "", x) for x in re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", new)]
    assert cards[-1] == cards[-2] and pii.pseudonymised(new, KEY, back=True)[0] == text


@settings(deadline=None, max_examples=200)
@given(st.dates(pii.FIRST, pii.LAST), st.sampled_from(["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"]), st.integers(0, 2**32 - 1))
def test_round_trips(day, form, ip):
    text = f"{day.strftime(form)} and {'.'.join(map(str, ip.to_bytes(4, 'big')))}"
    new, found = pii.pseudonymised(text, KEY)
    assert len(found) == 2 and pii.pseudonymised(new, KEY, back=True)[0] == text


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op8_pseudonyms(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    mails = re.compile(r"[\w.]+@mail\d\.example\.com")
    pairs, seen = {}, 0
    for r in rows:
        old, new = texts[r["doc_id"]], r["text"]
        gone = mails.findall(old) + re.findall(r"\+1 \(\d{3}\) 555-\d{4}", old) + re.findall(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d)", old) + [x for x in re.findall(r"(?<!\d)\d{16}(?!\d)", old) if pii.luhn(x) % 10 == 0]
        seen += len(gone)
        assert not [g for g in gone if g in new] and sum(r[f"n_{k}"] for k in pii.KINDS) >= len(gone)
        for a, b in zip(mails.findall(old), mails.findall(new)):
            assert pairs.setdefault(a, b) == b
        if not gone and not pii.HINT.search(old):
            assert new == old
    assert seen > 20 and len(set(pairs.values())) == len(pairs)


def test_odd_rows(odd_docs, no_docs, clashing):
    got = pii.pseudonyms(clashing, KEY).collect()
    assert sorted(map(repr, (r["text"] for r in got))) == sorted(map(repr, (r["text"] for r in odd_docs.collect()))) and all(r["values"] == [] and r["n"] == 1 for r in got)
    assert pii.report(no_docs, KEY).count() == 0 and len(pii.report(odd_docs, KEY).collect()) == odd_docs.count()


IBANS = ["BE68 5390 0754 7034", "AT611904300234573201", "ES9121000418450200051332", "SE45 5000 0000 0583 9825 7466", "RO49AAAA1B31007593840000", "PL61 1090 1014 0000 0712 1981 2874"]
LATER = [("EUR", []), ("2024", []), ("BIC", []), ("AB12", []), ("4111 1111 1111 1111", ["card"]), ("4111111111111111", ["card"])]


@pytest.mark.parametrize("kind,value", [*VALID, *(("iban", x) for x in IBANS), ("phone", "+49 301 234 567")])
@pytest.mark.parametrize("later,kinds", LATER)
def test_what_follows_a_value(kind, value, later, kinds):
    for sign in " ", ". ", "\n":
        if (value, later) == ("+49 301 234 567", "2024") and sign == " ":
            continue  # that is a number of 15 digits
        text = f"before {value}{sign}{later}."
        new, found = pii.pseudonymised(text, KEY)
        assert [k for k, _, _ in found] == [kind, *kinds] and found[0] == (kind, 7, 7 + len(value)), text
        assert pii.pseudonymised(new, KEY, back=True)[0] == text


@pytest.mark.parametrize("head", ["1234", "XX12", "BE12", "+999 1234", "999-05-1120"])
def test_a_card_behind_what_is_not_valid(head):
    for k in range(200):
        body = f"4{k * 7919:014d}"
        card = re.sub(r"(\d{4})(?=\d)", r"\1 ", body + str(-pii.luhn(body + "0") % 10))
        text = f"{head} {card}."
        new, found = pii.pseudonymised(text, KEY)
        assert found, text
        again, back = pii.pseudonymised(new, KEY, back=True)
        assert again == text and back == found
        assert card not in new


def pseudonym(value):
    return pii.pseudonymised(f"on {value}, so", KEY)[0][3:-4]


@pytest.mark.parametrize("day", ["2020-01-02", "2020-11-02", "2020-01-25", "1999-12-31", "2024-02-29"])
def test_all_forms_of_a_date_link(day):
    y, m, d = (int(x) for x in day.split("-"))
    new = tuple(int(x) for x in pseudonym(day).split("-"))
    forms = {f"{d}.{m}.{y}": (2, 1, 0), f"{d:02d}.{m:02d}.{y}": (2, 1, 0), f"{m}/{d}/{y}": (2, 0, 1), f"{m:02d}/{d:02d}/{y}": (2, 0, 1)}
    if d > 12:
        forms |= {f"{d}/{m}/{y}": (2, 1, 0)}
    for form, order in forms.items():
        fields = [int(x) for x in re.split("[./]", pseudonym(form))]
        assert tuple(fields[k] for k in order) == new and len(pseudonym(form)) == len(form)


def test_forms_of_a_number_link():
    digits = lambda text: re.sub("[^0-9]", "", text)[-10:]
    assert len({digits(pseudonym(x)) for x in ("+1 555-123-4567", "(555) 123-4567", "555.123.4567", "+1 (555) 123-4567")}) == 1
    assert len({digits(pseudonym(x)) for x in ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111")}) == 1


def feistel(x, size, tweak):
    """The permutation once more, in plain numbers."""
    a = next(k for k in range(1, size + 1) if k * k >= size)
    b = -(-size // a)
    while True:
        left, right = x // b, x % b
        for k in range(8):
            source, n = (left, b) if k % 2 else (right, a)
            more = int(hashlib.blake2b(f"{tweak}:{size}:{k}:{source}".encode(), key=EXAMPLE_KEY, digest_size=32).hexdigest(), 16) % n
            left, right = (left, (right + more) % b) if k % 2 else ((left + more) % a, right)
        x = left * b + right
        if x < size:
            return x


def test_whole_table_against_brute_force(spark):
    """Every octet address and every phone number of the tables, found and permuted by a plain copy of the method."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op8_pseudonyms(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(texts)
    phone, quad, seen = re.compile(r"\+1 \((\d{3})\) (\d{3})-(\d{4})(?!\d)"), re.compile(r"(?<![\d.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?!\d|\.\d)"), 0
    for i, old in texts.items():
        new = got[i]["text"]
        wanted = []
        for m in phone.finditer(old):
            x = f"{feistel(int(''.join(m.groups())), 10**10, 'phone1'):010d}"
            wanted.append(f"+1 ({x[:3]}) {x[3:6]}-{x[6:]}")
        for m in quad.finditer(old):
            if all(int(g) < 256 for g in m.groups()):
                x = feistel(sum(int(g) << (24 - 8 * k) for k, g in enumerate(m.groups())), 1 << 32, "ipv4")
                wanted.append(".".join(str(x >> s & 255) for s in (24, 16, 8, 0)))
        assert all(w in new for w in wanted), (i, wanted)
        assert got[i]["n_phone"] >= len(phone.findall(old)) and pii.pseudonymised(new, EXAMPLE_KEY, back=True)[0] == old
        seen += len(wanted)
    assert seen > 10
