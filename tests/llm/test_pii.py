import hashlib
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from convlytics.llm import pii


def replaced(spark, texts, key="k"):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: (r.text, r.n_replaced) for r in pii.pseudonymise(frame, key).collect()}


def luhn(digits):
    places = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(places)) % 10 == 0


def noise(key, kind, step, value):
    return hashlib.sha512("\x1f".join([key, kind, str(step), str(value)]).encode()).hexdigest()


def brute_chars(key, kind, value):
    """The network on strings, written out."""

    def move(part, h):
        out = ""
        for j, c in enumerate(part):
            by = int(h[j * 4 % 128 : j * 4 % 128 + 4], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if first <= c < chr(ord(first) + n):
                    c = chr((ord(c) - ord(first) + by) % n + ord(first))
                    break
            out += c
        return out

    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = move(a, noise(key, kind, i, b))
        else:
            b = move(b, noise(key, kind, i, a))
    return a + b


def brute_pair(key, kind, a, b, size_a, size_b):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + int(noise(key, kind, i, b)[:15], 16)) % size_a
        else:
            b = (b + int(noise(key, kind, i, a)[:15], 16)) % size_b
    return a, b


def test_values_equal_the_written_out_networks(spark):
    day = (date(1984, 2, 29) - date(1900, 1, 1)).days
    a, b = brute_pair("k", "date", day // 319, day % 319, 229, 319)
    moved = date.fromordinal(date(1900, 1, 1).toordinal() + a * 319 + b)
    x, y = brute_pair("k", "ip", 97 * 256 + 51, 17 * 256 + 173, 65536, 65536)
    card = brute_chars("k", "card", "453914880343646")
    got = replaced(spark, ["1984-02-29", "97.51.17.173", "4539 1488-03436467", "und.34@mail7.example.com", "+1 (017) 555-7713", "(212) 555-0100"])
    assert got[0] == (moved.isoformat(), 1)
    assert got[1] == (f"{x // 256}.{x % 256}.{y // 256}.{y % 256}", 1)
    digits = re.sub(r"\D", "", got[2][0])
    assert digits[:-1] == card and luhn(digits) and re.fullmatch(r"\d{4} \d{4}-\d{8}", got[2][0])
    assert got[3][0] == brute_chars("k", "mail", "und.34") + "@mail7.example.com"
    national = brute_chars("k", "phone", "0175557713")
    assert got[4][0] == f"+1 ({national[:3]}) {national[3:6]}-{national[6:]}"
    assert re.fullmatch(r"\(\d{3}\) \d{3}-\d{4}", got[5][0]) and got[5][0] != "(212) 555-0100"


def test_what_is_not_valid_stays(spark):
    texts = [
        "4539148803436468", "2023-02-30 31.04.2001 1899-01-01", "000-12-3456 666-12-3456 123-00-4567 123-45-0000", "256.1.1.1 1.2.3.4.5", "a1984-02-29 x4539148803436467",
        "@ a@b 12 1 none", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "1984-02-291",
    ]
    got = replaced(spark, texts)
    assert [got[i] for i in range(len(texts))] == [(t, 0) for t in texts]


def test_equal_values_stay_linked_and_keys_differ(spark):
    texts = ["x 4539148803436467. y", "4539148803436467 and 4539148803436467", "x (4539148803436467)"]
    one, two = replaced(spark, texts), replaced(spark, texts, "other")
    found = {n for t, _ in one.values() for n in re.findall(r"\d{16}", t)}
    assert len(found) == 1 and one[1][1] == 2
    assert found.isdisjoint(n for t, _ in two.values() for n in re.findall(r"\d{16}", t))
    assert one[0][0].startswith("x ") and one[0][0].endswith(". y")


@pytest.mark.parametrize("form", ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"])
def test_dates_are_permuted_within_their_format(spark, form):
    days = [date.fromordinal(date(1900, 1, 1).toordinal() + i) for i in range(0, 73049, 61)]
    if form == "%d/%m/%Y":
        days = [d for d in days if d.day > 12]
    texts = [d.strftime(form) for d in days]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.text for r in frame.select(pii.pseudonym("k", F.col("text")).alias("text")).collect()]
    assert len(set(got)) == len(texts)
    from datetime import datetime

    parsed = [datetime.strptime(g, form) for g in got]  # noqa: DTZ007
    assert all(1900 <= d.year <= 2099 for d in parsed)
    if form == "%d/%m/%Y":
        assert all(d.day > 12 for d in parsed)


def test_numbers_are_permuted_not_merged(spark):
    random.seed(1)
    ssn = sorted({f"{random.choice([1, 665, 667, 899]):03d}-{random.randint(1, 99):02d}-{random.randint(1, 9999):04d}" for _ in range(400)})
    got = [r.t for r in spark.createDataFrame([(s,) for s in ssn], "t string").select(pii.pseudonym("k", F.col("t")).alias("t")).collect()]
    assert len(set(got)) == len(ssn)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", g) for g in got)


def test_awkward_rows(awkward):
    out = pii.pseudonymise(awkward, "k", count_col="replaced")
    assert out.columns == [*awkward.columns, "replaced"]
    before = sorted(((r.doc_id, r.text) for r in awkward.collect()), key=str)
    rows = out.collect()
    assert len(rows) == len(before)
    assert all(r.replaced == (4 if r.doc_id == 13 else 0) for r in rows)
    assert sorted(((r.doc_id, r.text) for r in rows if r.doc_id != 13), key=str) == [b for b in before if b[0] != 13]


def test_empty_table(nothing):
    assert pii.pseudonymise(nothing, "k").collect() == []


def test_a_very_long_text(spark):
    text = "la " * 400_000 + "97.51.17.173 " + "lo4 " * 100_000 + "1984-02-29"
    got = replaced(spark, [text])[0]
    assert got[1] == 2 and len(got[0].split()) == len(text.split()) and "1984-02-29" not in got[0]


def test_no_python_on_the_executors(awkward):
    plan = pii.pseudonymise(awkward, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cards_with_numbers_beside_them(spark):
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    texts = [
        "card 4111 1111 1111 1111 12/27", "4111111111111111 123", "row 12 4111 1111 1111 1111 ok", f"{card} {other} 7", f"1 {card} 05.03.1990",
        f"{card} 97.51.17.173 9", f"555-123-4567 {card}", f"{card} 555-123-4567 555.123.4567", f"{card} 12x", "1 2 3 " * 2000 + card,
    ]
    got = replaced(spark, texts)
    assert [got[i][1] for i in range(9)] == [1, 1, 1, 2, 2, 2, 2, 3, 1]
    shapes = lambda t: re.sub("[0-9]", "0", t)
    assert [shapes(got[i][0]) for i in range(10) if i != 5] == [shapes(t) for i, t in enumerate(texts) if i != 5]
    assert re.fullmatch(r"[\d ]{19} [\d.]+ 9", got[5][0]) and "97.51.17.173" not in got[5][0]
    hidden = replaced(spark, [card])[0][0]
    assert hidden != card and luhn(hidden.replace(" ", ""))
    assert got[0][0] == f"card {hidden} 12/27" and got[2][0] == f"row 12 {hidden} ok" and got[6][0].endswith(hidden)
    assert got[1][0] == hidden.replace(" ", "") + " 123" and got[3][0] == f"{hidden} {replaced(spark, [other])[0][0]} 7"
    assert card not in got[9][0]


def test_further_telephone_and_date_forms(spark):
    phones = [
        "+44 7911 123456", "+49 30 1234567", "+49 170 1234567", "+33 1 23 45 67 89", "+442079460958", "+44 (0)20 7946 0958", "+7 (495) 123-45-67", "(555) 123 4567", "(555) 123-4567",
        "555 123 4567", "555.123.4567", "1-800-555-1234", "1 (800) 555-1234", "1.800.555.1234", "+49 30 1234567 1990-05-03",
    ]
    dates = ["3/5/1990", "13/5/1990", "5/13/1990", "13-5-1990", "15-03-1990", "03-15-1990", "5-3-1990", "3.5.1990", "1990-3-5", "1990/3/15"]
    got = replaced(spark, [f"x {v}, y" for v in phones + dates])
    shapes = lambda t: re.sub("[0-9]", "0", t)
    for i, v in enumerate(phones):
        assert got[i][1] == 1 + (i == len(phones) - 1), v
        assert shapes(got[i][0]) == shapes(f"x {v}, y") and v not in got[i][0]
        kept = re.match(r"\+[2-9][0-9]|\+1|1(?=[ .-])|", v)[0]
        assert got[i][0].startswith(f"x {kept}")
    for i, v in enumerate(dates, len(phones)):
        assert got[i][1] == 1 and v not in got[i][0], v
        assert re.sub("[0-9]+", "0", got[i][0]) == re.sub("[0-9]+", "0", f"x {v}, y")


@pytest.mark.parametrize(("form", "late"), [("%d-%m-%Y", False), ("%m-%d-%Y", True)])
def test_dates_with_dashes_are_permuted_not_merged(spark, form, late):
    days = [date.fromordinal(date(1900, 1, 1).toordinal() + i) for i in range(0, 73049, 97)]
    texts = [d.strftime(form) for d in days if not late or d.day > 12]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.text for r in frame.select(pii.pseudonym("k", F.col("text")).alias("text")).collect()]
    assert len(set(got)) == len(texts) and sum(a == b for a, b in zip(got, texts, strict=True)) < 3
    assert all((int(g[3:5]) > 12) == late for g in got)


def test_what_is_still_no_phone_or_date(spark):
    texts = ["32-05-1990 31/2/1990 30-2-1990", "+44 1234 x +2 345", "12 345 678", "1.2.3 3.141 592", "555 1234"]
    got = replaced(spark, texts)
    assert [got[i] for i in range(len(texts))] == [(t, 0) for t in texts]
