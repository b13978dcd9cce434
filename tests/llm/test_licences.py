from collections import Counter

from convlytics.llm import licences
from convlytics.llm.licences import FULL_TEXTS, TEMPLATES, bigrams, normal_words, size_bounds


def brute(rows, percent=80):
    grams = {n: set(bigrams(normal_words(t))) for n, t in TEMPLATES.items()}
    best, units = {}, Counter()
    for doc, text in rows:
        text = text or ""
        parts = [*text.split("\n"), text] if "\n" in text else [text]
        for part in parts:
            own = set(bigrams(normal_words(part)))
            for name, some in grams.items():
                if own and 200 * len(own & some) >= percent * (len(own) + len(some)):
                    shared, united = len(own & some), len(own) + len(some)
                    units[doc, name] += 1
                    best[doc, name] = max(best.get((doc, name), (-1, 0, 0)), (shared / united, -united, shared))
    return sorted(((d, n, s, -u, units[d, n]) for (d, n), (_, u, s) in best.items()), key=str)


def found(frame):
    return sorted((tuple(r) for r in licences.licence_matches(frame).collect()), key=str)


def test_awkward_rows(awkward):
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert found(awkward) == want and want


def test_real_rows(documents):
    want = brute([tuple(r) for r in documents.collect()])
    assert found(documents) == want and want


def test_empty_table(nothing):
    assert found(nothing) == []


def test_changed_notices_and_long_texts(spark):
    mit = TEMPLATES["mit-notice"]
    texts = [
        mit, mit.upper() + " !", "x " * 100_000 + "\n" + mit, mit.replace(" ", "  \t"), mit.replace(",", "\n"), mit.replace("Software", "Thing"),
        " ".join(mit.split()[::2]), "Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0\nLicensed under CC BY 4.0.", "licensed under", "Copyright 2020. All rights reserved", "version 3 of the License",
        TEMPLATES["gpl-3.0"] + "\n" + TEMPLATES["apache-2.0"] + "\n" + TEMPLATES["apache-2.0"],
    ]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_every_template_meets_itself(spark):
    rows = list(enumerate(TEMPLATES.values()))
    got = found(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(i, n) for i, n in enumerate(TEMPLATES)} <= {(r[0], r[1]) for r in got if 2 * r[2] == r[3]}


def test_no_python_on_the_executors(awkward):
    plan = licences.licence_matches(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_passages(rows, percent=80):
    """Every run of words whose number of bigrams lies within the bounds."""
    best = {}
    for doc, text in rows:
        words = normal_words(text or "")
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        for name, template in (TEMPLATES | FULL_TEXTS).items():
            some = set(bigrams(normal_words(template)))
            least, most = size_bounds(len(some), percent)
            for i in range(len(pairs)):
                for j in range(i + least, min(i + most, len(pairs)) + 1):
                    own = set(pairs[i:j])
                    shared, united = len(own & some), len(own) + len(some)
                    if 200 * shared >= percent * united:
                        best[doc, name] = max(best.get((doc, name), (-1, 0, 0)), (shared / united, -united, shared))
    return sorted(((d, n, s, -u) for (d, n), (_, u, s) in best.items()), key=str)


def test_passages_equal_all_word_windows(spark, nothing):
    gpl, mit = TEMPLATES["gpl-3.0-notice"].split(), FULL_TEXTS["mit-full"].split()
    wrapped = "".join("// " + " ".join(gpl[i : i + 11]) + "\n" for i in range(0, len(gpl), 11))
    texts = [
        "The tool does things. Released under the MIT License. See the docs for more of it.", "#include <x>\n" + wrapped + "int main() { return 0; }\n",
        "MIT License\n\nCopyright (c) 2020 X\n\n" + "".join(" ".join(mit[i : i + 12]) + "\n" for i in range(0, len(mit), 12)), "# Copyright 2020\n# " + TEMPLATES["apache-2.0-notice"].replace(" you may", "\n# you may"),
        "Copyright 2020. All rights reserved", "all rights the under License of the Software and of the " * 8, " ".join(gpl[::2]), None, "", "x",
        "a " + TEMPLATES["cc0-1.0"] + " b " + TEMPLATES["cc-by-4.0"] + " c", " ".join(w for i, w in enumerate(gpl) if i % 12) + " end",
    ]
    rows = [*enumerate(texts), (0, texts[0])]
    got = licences.licence_passages(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_passages(rows)
    names = {(r.doc_id, r.licence) for r in got.collect()}
    assert {(0, "mit"), (1, "gpl-3.0-notice"), (2, "mit-full"), (3, "apache-2.0-notice")} <= names
    assert licences.licence_passages(nothing).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_passages_of_awkward_rows(awkward, spark):
    from pyspark.sql import functions as F

    clashing = awkward.withColumns({c: F.lit("x") for c in ("words", "pairs", "marks", "hits", "at", "gram", "licence", "shared", "united", "share")})
    got = sorted((tuple(r) for r in licences.licence_passages(clashing).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect() if len(r.text or "") < 10_000]
    assert got == brute_passages(rows) and {r[0] for r in got} == {12}
    notice = TEMPLATES["cc0-1.0"]
    rows = [(None, notice), (None, "b " + notice), (2, notice + " x"), (2, notice), (2, notice), (3, "w " * 50_000 + notice + " v" * 50_000)]
    many = licences.licence_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("licence = 'cc0-1.0'").collect()
    assert sorted((str(r.doc_id) for r in many)) == ["2", "3", "None"] and len({(r.shared, r.united) for r in many}) == 1
