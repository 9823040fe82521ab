"""Text operators against hand-written rows and a plain re-statement of their rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bugsieve.functions import fixed_values as fv
from bugsieve.functions import text as tx

CLEANED = [
    (
        "/usr/é/ab.c 0x7fff1234 defaced deadbeef1 1234567 12.5.",
        "filepathtoken hextoken hashtoken hashtoken hashtoken numtoken",
    ),
    (r"c:\win\sys.dll me@x.org <b a='1'>x</b>", "c filepathtoken emailtoken x"),
    ("Version 3.0b2 at 10:57", "version numtoken b at numtoken numtoken"),
    ("a\u00a0b http://x.y\u00a0tail", "a b urltoken tail"),
    ("é123 x", "x"),
    ("٣ 4 ٣٤٥", "numtoken numtoken numtoken"),
]

SECTIONS = [
    (
        "Bug: crash\nSteps to reproduce:\n1. a\n2. b\nExpected result: fine\nActual result: boom\n"
        "Environment: Linux\nStack trace: x\n y",
        {"steps": ":\n1. a\n2. b", "expected": ": fine", "actual": ": boom",
         "environment": ": Linux", "logs": ": x\n y"},
    ),
    (
        "Actual behaviour should be ok instead\n\n  OS version 7\nBuild ID 99",
        {"expected": "ok instead", "environment": "7\nBuild ID 99"},
    ),
    ("string only", {"steps": "ing only"}),
    ("how to reproduce: z\nSTR: q", {"steps": ": q"}),
    ("expected output\nactual output", {}),
]


@pytest.mark.parametrize("text,expected", CLEANED)
def test_clean(column, text, expected):
    assert column([text], tx.clean) == [expected]


def test_clean_null_and_blank(column):
    assert column([None, "", " \n "], tx.clean) == ["", "", ""]


@pytest.mark.parametrize("text,expected", SECTIONS)
@pytest.mark.parametrize("probed", [False, True])
def test_sections(spark, text, expected, probed):
    df = spark.createDataFrame([(text,)], "t string").withColumn("p", tx.folded(F.col("t")))
    probe = F.col("p") if probed else None
    row = df.select(*[c.alias(n) for n, c in tx.extract_sections(F.col("t"), probe=probe).items()]).head()
    assert row.asDict() == {s: expected.get(s, "") for s in fv.SECTION_PATTERNS}


def test_sections_of_null(column):
    assert column([None], lambda c: tx.extract_section(c, "steps")) == [""]


def test_strict_sections_need_word_boundaries(column):
    strict = lambda c: tx.extract_section(c, "steps", strict=True)
    assert column(["string only", "STR: - do it"], strict) == ["", "do it"]


def test_section_is_whole(column):
    out = column(["Environment " + "é" * 600], lambda c: tx.extract_section(c, "environment"))
    assert out == ["é" * 600]


def test_titles(column):
    texts = ["Bugzilla x", "Bug - - q", "bug", "", "  \n\n ", None, "\n\n  Issue# first \n second", "x" * 130]
    assert column(texts, tx.extract_title) == [
        "zilla x", "- q", fv.UNTITLED, fv.UNTITLED, fv.UNTITLED, fv.UNTITLED, "first", "x" * 130,
    ]


def test_strict_title_keeps_longer_words(column):
    assert column(["Bugzilla x", "Bug: x"], lambda c: tx.extract_title(c, strict=True)) == ["Bugzilla x", "x"]


def test_given_title_wins_unless_blank(spark):
    df = spark.createDataFrame([(" Given ", "Bug: d"), (" ", "Bug: d"), (None, "Bug: d")], "t string, d string")
    out = df.select(tx.title_or_extracted(F.col("t"), F.col("d")).alias("o")).collect()
    assert [r["o"] for r in out] == [" Given ", "d", "d"]


def test_strip_removes_all_unicode_blanks(column):
    assert column(["\u3000\x1c a\u00a0b \u2028", "\t\n"], tx.strip) == ["a\u00a0b", ""]


def test_combine_variants(spark):
    df = spark.createDataFrame([(" a ", "", None, "d")], "a string, b string, c string, d string")
    cols = [F.col(c) for c in "abcd"]
    row = df.select(
        tx.combine_index_text(*cols).alias("i"), tx.combine_query_text(*cols).alias("q"),
        tx.combine_enhance_text(*cols).alias("e"),
    ).head()
    assert (row["i"], row["q"], row["e"]) == ("a . d", " a  d", "a    d")


def test_tokens_stopwords_and_order_of_lemmas(column):
    out = column(["The crashes of my TWO boxes, has-been processes & children"], tx.normalize)
    assert out == ["crash two box process child"]
    # Filters come before lemmas, so a lemma may be a stopword again.
    assert column(["the hows and whys"], tx.normalize) == ["how why"]


def test_lemma_rules(column):
    words = ["ies", "queries", "matches", "boxes", "women", "class", "status", "basis", "logs", "mice", "bus"]
    assert column(words, tx.lemma) == [
        "ies", "query", "match", "box", "woman", "class", "status", "basis", "log", "mouse", "bus",
    ]


def test_sentences(column):
    text = "Short. This sentence is long enough. \u00a0And this one is as well\u3000.x"
    assert column([text], lambda c: tx.sentences(c, 15)) == [
        ["This sentence is long enough", "And this one is as well"]
    ]


def test_fold_severity(column):
    raw = ["BLOCKER", "high", "normal", "trivial", "Weird", "", None]
    assert column(raw, tx.fold_severity) == ["Critical", "High", "Medium", "Low", "Weird", "Unknown", "Unknown"]


def test_intents(column):
    asked = {
        "Show cluster spread": "cluster_dist", "cluster": "clusters", "PRIORITY?": "severity",
        "is it a duplicate": "triage", "how many bugs": "totals", "Mozilla": "project_firefox",
        "visual studio code": "project_vscode", "which source": "datasets", "find login": "search",
        "what can you do": "help", "hm": "fallback_search", "spark cluster": "clusters",
    }
    assert column(list(asked), tx.question_intent) == list(asked.values())
    assert column(["Search for login, look up"], tx.search_term) == ["for login,"]


# --- a second statement of the rules, for texts where SQL engines differ ------------------


def py_clean(text):
    out = text.lower()
    for pattern, token in fv.CLEANING_PATTERNS:
        out = re.sub(pattern, token, out)
    return " ".join(re.findall("[a-zA-Z]+", out))


def py_section(text, name):
    for pattern in fv.SECTION_PATTERNS[name]:
        parts = re.split(f"(?i){pattern}", text, maxsplit=1)
        if len(parts) == 2:
            return re.split(f"(?i){fv.NEXT_HEADER}", parts[1], maxsplit=1)[0].strip()
    return ""


def py_title(text):
    lines = [line for line in map(str.strip, text.split("\n")) if line]
    title = re.sub(f"(?i){fv.TITLE_PREFIX}", "", lines[0]) if lines else ""
    return title or fv.UNTITLED


PIECES = [
    "Bug: ", "issue#", "\u00a0", "\u3000", "\n", "\n  ", " ", "é", "ü9", "٣٤", "0xAF", "deadbeef", "a@b.c",
    "@", "x@y", "http://é.x/ü", "www.q", "<b>", "<", ">", "/usr/lib.so", "\\a\\b.c", "/", ".", "1.5", "12.",
    "STR", "str", "\u017ftr", "Expected result", "should be", "instead", "platform", "OS version",
    "log file", "Stack Trace", "steps to reproduce", "Steps\u00a0To Reproduce", "İ", "word", "_", "-", "A1",
]


def test_random_texts_match_the_plain_rules(column):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    assert column(texts, tx.clean) == [py_clean(t) for t in texts]
    assert column(texts, tx.extract_title) == [py_title(t) for t in texts]
    for name in fv.SECTION_PATTERNS:
        want = [py_section(t, name) for t in texts]
        assert column(texts, lambda c: tx.extract_section(c, name)) == want
        assert column(texts, lambda c: tx.extract_section(c, name, probe=tx.folded(c))) == want


def test_long_unbroken_run_is_linear(column):
    assert column(["x" * 200_000 + " a@b.cd"], tx.clean) == ["x" * 200_000 + " emailtoken"]


def test_rare_characters_are_probed_before_texts_are_translated(spark):
    texts = ["Straße İıſK END", "PLAIN", "", None, "İabcdef0ı"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = df.select(tx.folded(t), F.lower(F.translate(t, "İıſK", "iisk")))
    assert all(folded == want for folded, want in got.collect())
    plan = got.select(got.columns[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(t#") == 4
