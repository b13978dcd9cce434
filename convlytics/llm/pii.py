"""Format-preserving pseudonyms for personal numbers, dates and mail addresses.

One pattern finds candidates; each is validated (check digits, ranges, calendar) and then
permuted within its format by a Feistel network whose round function is a keyed SHA-512, so
equal values get equal pseudonyms in every document and different values different ones:

* card numbers (Luhn): digits permuted, check digit made anew, separators kept; they are
  looked for in all neighbouring groups of a run of numbers,
* telephone numbers: digits permuted, country code and punctuation kept,
* social security numbers: digits permuted, walking on until the result is a valid one,
* IPv4 addresses: two halves of 16 bits,
* dates from 1900 to 2099: the day number, as 229 * 319 days (their exact count),
* mail addresses: letters and digits before the @ permuted within their kind.

Everything is a column expression of the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlytics.functions.text import let
from convlytics.plans.once import evaluate_once

ROUNDS = 10
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A domain has at most 253 characters, so 126 labels before the last; the bound keeps the search off the stack.
_MAIL = r"[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,126}[A-Za-z]{2,24}"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9A-Za-z])"
_YEAR = "(?:19|20)[0-9]{2}"
_PLACE = "[0-9]{1,2}"
_DATE = (
    rf"(?:{_YEAR}(?:-{_PLACE}-|/{_PLACE}/){_PLACE}|{_PLACE}(?:\.{_PLACE}\.|/{_PLACE}/|-{_PLACE}-){_YEAR})"
    r"(?![0-9A-Za-z])"
)
_SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
#: 8 to 15 digits in groups of any length, up to a number that starts another kind of value.
_INTERNATIONAL = (
    r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])"
    rf"|\+[2-9](?:(?![ .\-](?:{_IP}|{_DATE}|{_SSN}))[ .\-]?[0-9]){{7,14}}(?![0-9A-Za-z])"
    r"|\+[2-9][0-9]{0,2}[ .\-]?(?:\([0-9]{1,2}\)(?:[ .\-]?[0-9]){6,10}|\([0-9]{3,4}\)(?:[ .\-]?[0-9]){4,8})(?![0-9A-Za-z])"
)
_NATIONAL = (
    r"(?:(?:1[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|(?:1[ .\-])?[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4})"
    r"(?![0-9A-Za-z])"
)
#: Numbers beside each other that may hold card numbers, up to a number that starts another kind of value.
_DOTTED = r"(?:1\.)?[0-9]{3}(?:\.[0-9]{3}[ .\-]|[ \-][0-9]{3}\.)[0-9]{4}(?![0-9A-Za-z])"
_RUN = rf"(?=(?:[0-9][ -]?){{12}}[0-9])[0-9]++(?![A-Za-z@])(?:[ -](?!{_IP}|{_DATE}|{_SSN}|{_DOTTED})[0-9]++(?![A-Za-z@]))*+"
#: A value starts where no letter, digit or part of a longer number stands before it.
PATTERN = rf"(?<![A-Za-z0-9._%+\-]){_MAIL}|(?<![A-Za-z0-9])(?<![0-9][.\-])(?:{_IP}|{_DATE}|{_SSN}|{_INTERNATIONAL}|{_RUN}|{_NATIONAL})"
#: Texts without any of these hold no value.
MAYBE = r"@[A-Za-z0-9]|[0-9][ .\-/()]{0,2}[0-9]"
_DAYS = (229, 319)  # 73,049 days from 1900-01-01 to 2099-12-31


def _keyed(key: str, kind: str, step: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 512)


def _feistel(key: str, kind: str, a: Column, b: Column, size_a: int, size_b: int) -> Column:
    """A permutation of pairs below (size_a, size_b): ``struct(a, b)``."""

    def add(value: Column, other: Column, step: Column, size: int) -> Column:
        noise = F.conv(F.substring(_keyed(key, kind, step, other), 1, 15), 16, 10).cast("long")
        return F.pmod(value + noise, F.lit(size).cast("long"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        start,
        lambda s, i: F.when(i % 2 == 0, F.struct(add(s["a"], s["b"], i, size_a).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), add(s["b"], s["a"], i, size_b).alias("b"))
        ),
    )


def _shifted(chars: Column, noise: Column) -> Column:
    """Each digit and ASCII letter moved within its kind by four hexadecimal digits of ``noise``."""

    def move(c: Column, j: Column) -> Column:
        by = F.conv(F.substring(noise, F.pmod(j * 4, F.lit(128)) + 1, F.lit(4)), 16, 10).cast("int")
        turn = lambda first, n: F.char(F.pmod(F.ascii(c) - ord(first) + by, F.lit(n)) + ord(first))
        return F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26)).otherwise(c)

    return F.transform(chars, move)


def _permuted(key: str, kind: str, value: Column) -> Column:
    """A permutation of strings of one shape (digits, small and capital letters stay such)."""

    def network(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), half).alias("a"), F.substring(v, half + 1, F.length(v)).alias("b"))
        joined = lambda text, noise: F.array_join(_shifted(F.split(text, ""), noise), "")
        done = F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            start,
            lambda s, i: F.when(i % 2 == 0, F.struct(joined(s["a"], _keyed(key, kind, i, s["b"])).alias("a"), s["b"].alias("b"))).otherwise(
                F.struct(s["a"].alias("a"), joined(s["b"], _keyed(key, kind, i, s["a"])).alias("b"))
            ),
        )
        return let(done, lambda d: F.concat(d["a"], d["b"]))

    return let(value, network)


def _walked(value: Column, permute, valid) -> Column:
    """Permute until the result is valid again: a permutation of the valid values."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), permute(value), lambda v, _: F.when(valid(v), v).otherwise(permute(v)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; from the right, places with this parity are doubled."""
    at = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == doubled, F.floor(c.cast("int") / 5) + F.pmod(c.cast("int") * 2, F.lit(10))).otherwise(c.cast("int")),
    )
    return F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def _laid_out(layout: Column, digits: Column) -> Column:
    """``digits`` in the places that digits have in ``layout``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        return F.when(
            c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(layout, ""), start, step, lambda s: s["out"])


def _is_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), F.pmod(_luhn(digits, 1), F.lit(10)) == 0).otherwise(False)


def _interleaved(gaps: Column, values: Column, filler: Column) -> Column:
    """gap, value, gap, ..., gap: there is one value less than gaps."""
    return F.flatten(F.zip_with(gaps, F.concat(values, F.array(filler)), lambda a, b: F.array(a, b)))


def _cards_apart(run: Column) -> Column:
    """``run`` cut into pieces such that each card number in it is one.

    Of all valid sequences of neighbouring groups the longest is taken, then the longest of
    those beside it and so on; of equal lengths one with an issuer's first digit, then the first.
    """

    def cut(groups: Column, seps: Column) -> Column:
        last = F.size(groups) - 1

        def candidates(i: Column) -> Column:
            ends = F.sequence(i, F.least(i + 18, last))
            each = F.transform(ends, lambda j: F.struct(i.alias("i"), j.alias("j"), F.array_join(F.slice(groups, i + 1, j - i + 1), "").alias("d")))
            valid = F.filter(each, lambda c: _is_card(c["d"]))
            return F.transform(valid, lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), F.length(c["d"]).alias("size"), (~c["d"].rlike("^[2-6]")).alias("other")))

        def before(cards: Column, k: Column) -> Column:
            """The last group of the card before the k-th."""
            return F.coalesce(F.get(cards, k - 1)["j"], F.lit(-1))

        def marked(cards: Column) -> Column:
            """A byte per group up to the last card: 1 where a card lies."""
            bits = F.transform(cards, lambda x, k: F.concat(F.repeat(F.lit("0"), x["i"] - before(cards, k) - 1), F.repeat(F.lit("1"), x["j"] - x["i"] + 1)))
            return F.array_join(bits, "").cast("binary")

        def beside(cards: Column, found: Column, kind: Column) -> Column:
            """``cards`` and, from the left, the found ones of a length and kind that overlap none."""
            free = lambda x, busy: F.hex(F.substring(busy, x["i"] + 1, x["j"] - x["i"] + 1)).contains("31") == F.lit(False)
            mine = let(marked(cards), lambda busy: F.filter(found, lambda x: (x["size"] == kind["size"]) & (x["other"] == kind["other"]) & free(x, busy)))
            start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<i:int,j:int,size:int,other:boolean>>").alias("t"))
            more = F.aggregate(mine, start, lambda s, x: F.when(x["i"] > s["end"], F.struct(x["j"].alias("end"), F.concat(s["t"], F.array(x)).alias("t"))).otherwise(s), lambda s: s["t"])
            return F.array_sort(F.concat(cards, more))

        def chosen(found: Column) -> Column:
            none = F.array().cast("array<struct<i:int,j:int,size:int,other:boolean>>")
            kinds = F.array(*(F.struct(F.lit(n).alias("size"), F.lit(o).alias("other")) for n in range(19, 12, -1) for o in (False, True)))
            return F.when(F.size(found) == 0, none).otherwise(F.aggregate(kinds, none, lambda t, kind: beside(t, found, kind)))

        def plain(a: Column, b: Column) -> Column:
            """The groups from a to b, each behind its separator."""
            each = F.flatten(F.transform(F.sequence(a, b), lambda g: F.array(F.get(seps, g), F.get(groups, g))))
            return F.when(a <= b, each).otherwise(F.array().cast("array<string>"))

        def pieces(cards: Column) -> Column:
            # A separator of its own stands between groups; inside a card they are joined again.
            joined = lambda x: F.concat(F.get(groups, x["i"]), F.array_join(plain(x["i"] + 1, x["j"]), ""))
            parts = F.transform(cards, lambda x, k: F.concat(plain(before(cards, k) + 1, x["i"] - 1), F.array(F.get(seps, x["i"]), joined(x))))
            return F.concat(F.flatten(parts), plain(before(cards, F.size(cards)) + 1, last), F.array(F.get(seps, last + 1)))

        found = F.flatten(F.transform(F.sequence(F.lit(0), last), candidates))
        return let(let(found, chosen), lambda t: F.when(F.size(t) == 0, F.array(run)).otherwise(pieces(t)))

    both = F.struct(F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0)).alias("groups"), F.split(run, "[0-9]+", -1).alias("seps"))
    return F.when(F.length(_digits(run)) < 13, F.array(run)).otherwise(let(both, lambda x: cut(x["groups"], x["seps"])))


def _pieces(value: Column) -> Column:
    """A candidate as pieces of one value or none each: only numbers beside each other have more than one."""
    phones = rf"(?<![0-9])(?<![0-9][.\-]){_NATIONAL}"
    numbers = value.rlike("^[0-9][0-9 -]*$") & ~value.rlike(f"^(?:{_DATE}|{_SSN}|{_NATIONAL})$")
    parts = _interleaved(F.transform(F.split(value, phones, -1), _cards_apart), F.transform(F.regexp_extract_all(value, F.lit(phones), F.lit(0)), lambda v: F.array(v)), F.array().cast("array<string>"))
    return F.when(~numbers | _is_card(_digits(value)), F.array(value)).otherwise(F.flatten(parts))


def _card(key: str, value: Column) -> Column:
    def moved(d: Column) -> Column:
        payload = _permuted(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        full = let(payload, lambda p: F.concat(p, F.pmod(10 - F.pmod(_luhn(p, 0), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(_is_card(d), _laid_out(value, full)).otherwise(value)

    return let(_digits(value), moved)


def _phone(key: str, value: Column) -> Column:
    def moved(d: Column) -> Column:
        national = F.when(F.length(d) == 11, 1).otherwise(0)  # the 1 before a national number stays
        kept = F.when(~value.startswith("+"), national).when(value.startswith("+1"), 1).otherwise(2)
        return let(kept, lambda k: _laid_out(value, F.concat(F.substring(d, F.lit(1), k), _permuted(key, "phone", F.substring(d, k + 1, F.length(d))))))

    return let(_digits(value), moved)


def _ssn(key: str, value: Column) -> Column:
    valid = lambda d: ~d.rlike("^(000|666|9)|^...00|0000$")
    return let(_digits(value), lambda d: F.when(valid(d), _laid_out(value, _walked(d, lambda v: _permuted(key, "ssn", v), valid))).otherwise(value))


def _ip(key: str, value: Column) -> Column:
    half = lambda o, i: F.get(o, F.lit(i)).cast("int") * 256 + F.get(o, F.lit(i + 1)).cast("int")
    parts = lambda x: [F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string")]
    done = let(F.split(value, r"\."), lambda o: _feistel(key, "ip", half(o, 0), half(o, 2), 65536, 65536))
    return let(done, lambda s: F.concat_ws(".", *parts(s["a"]), *parts(s["b"])))


def _date(key: str, value: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")
    size_b = _DAYS[1]

    def permute(day: Column) -> Column:
        at = F.datediff(day, first)
        done = _feistel(key, "date", F.floor(at / size_b), F.pmod(at, F.lit(size_b)), *_DAYS)
        return let(done, lambda s: F.date_add(first, (s["a"] * size_b + s["b"]).cast("int")))

    read = lambda form: F.try_to_timestamp(value, F.lit(form)).cast("date")
    single = value.rlike("(?:^|[./-])[0-9](?:[./-]|$)")  # some day or month has one digit

    def written(form: str, step) -> Column:
        # Days and months without a zero before them are written without one again.
        short = form.replace("dd", "d").replace("MM", "M")
        shown = lambda d: F.when(single, F.date_format(d, short)).otherwise(F.date_format(d, form))
        return let(F.coalesce(read(form), F.when(single, read(short))), lambda d: F.when(d.isNull(), value).otherwise(let(step(d), shown)))

    all_days = lambda form: written(form, permute)
    # Where one of the first two numbers can't be a month, it is the day; such days stay such.
    late = lambda d: F.dayofmonth(d) > 12
    late_days = lambda form: written(form, lambda d: _walked(d, permute, late))
    place = lambda i: F.get(F.split(value, "[./-]"), F.lit(i)).cast("int")
    return (
        F.when(value.rlike("^[0-9]{4}-"), all_days("yyyy-MM-dd"))
        .when(value.rlike("^[0-9]{4}/"), all_days("yyyy/MM/dd"))
        .when(value.contains("."), all_days("dd.MM.yyyy"))
        .when(value.contains("-"), F.when(place(1) > 12, late_days("MM-dd-yyyy")).otherwise(all_days("dd-MM-yyyy")))
        .otherwise(F.when(place(0) <= 12, all_days("MM/dd/yyyy")).otherwise(late_days("dd/MM/yyyy")))
    )


def pseudonym(key: str, value: Column) -> Column:
    """The pseudonym of one candidate; what is not valid stays as it is."""
    mail = F.concat(_permuted(key, "mail", F.substring_index(value, "@", 1)), F.lit("@"), F.substring_index(value, "@", -1))
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(value.contains("@"), mail)
        .when(whole(_IP), _ip(key, value))
        .when(whole(_DATE), _date(key, value))
        .when(whole(_SSN), _ssn(key, value))
        .when(whole(rf"{_INTERNATIONAL}|{_NATIONAL}"), _phone(key, value))
        .otherwise(_card(key, value))
    )


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """``docs`` with personal values replaced in ``text_col`` and their number in ``count_col``.

    All other columns stay.  NULL and empty texts stay as they are with 0 replaced; texts of
    any length are searched whole; rows are independent, so repeated rows and ties get equal
    results and an empty table an empty one.  A column of ``docs`` named like ``count_col`` is
    replaced.
    """
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = evaluate_once(docs.drop(count_col), {"__found": F.transform(found, _pieces)})
    renamed = evaluate_once(rows, {"__new": F.transform("__found", lambda some: F.transform(some, lambda v: pseudonym(key, v)))})
    joined = F.array_join(_interleaved(F.split(text, PATTERN, -1), F.transform("__new", lambda some: F.array_join(some, "")), F.lit("")), "")
    changed = F.size(F.filter(F.zip_with(F.flatten("__found"), F.flatten("__new"), lambda a, b: a != b), lambda x: x))
    kept = [F.when(F.size("__found") > 0, joined).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    return renamed.select(*kept, F.when(text.isNull(), 0).otherwise(changed).cast("int").alias(count_col))
