import html
import html.entities
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.porter import with_stem
from lorekeep.functions.text import decode_entities, plain_text, strip_html, tokens
from lorekeep.operators.analysis import term_counts

from tests import plain


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "token string")
    return {r.token: r.term for r in with_stem(df, "token").collect()}


PUBLISHED = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electriciti": "electr",
    "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin",
    "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
    "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ",
    "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "this": "thi", "was": "wa", "they": "thei", "as": "as",
}


def test_published_stems(spark):
    assert stems(spark, PUBLISHED) == PUBLISHED


def test_stems_against_the_plain_rules(spark):
    rng = random.Random(7)
    pieces = ["a", "e", "i", "o", "u", "y", "yy", "t", "l", "ll", "s", "ss", "st", "b", "z", "x", "w", "é", "7"]
    ends = ["", *plain.TWO, *plain.THREE, *plain.FOUR, "ed", "ing", "eed", "s", "ies", "sses", "e", "y", "ll"]
    words = {"".join(rng.choices(pieces, k=rng.randint(0, 5))) + rng.choice(ends) for _ in range(20_000)} - {""}
    got = stems(spark, words)
    wrong = {w: (got[w], plain.stem(w)) for w in words if got[w] != plain.stem(w)}
    assert not wrong


def test_stop_words_go_after_stemming(spark):
    doc = [(1, "The this-and-that", "this was they are the and of with it")]
    df = spark.createDataFrame(doc, "k int, title string, content string")
    got = {(r.field, r.term): r.tf for r in term_counts(df, "k").collect()}
    assert {t for f, t in got if f == "content"} == {"thi", "wa", "thei", "ar"}
    assert {t for f, t in got if f == "title"} == {"the", "thi", "and", "that"}


@pytest.mark.parametrize(
    "text, words",
    [
        ("Don't stop", ["Don't", "stop"]),
        ("e.g. U.S.A. 3,000.5 a.1 1.b", ["e.g", "U.S.A", "3,000.5", "a", "1", "1", "b"]),
        ("snake_case a:b 10:30", ["snake_case", "a:b", "10", "30"]),
        ("naïve Straße", ["naïve", "Straße"]),
        ("日本 ひら カタカナ 한국어", ["日", "本", "ひ", "ら", "カタカナ", "한국어"]),
        ("...''--", []),
        ("", []),
    ],
)
def test_tokens(values, text, words):
    assert values(tokens, [text]) == [words]


def test_long_words_are_cut_and_long_texts_matched(values):
    assert [len(w) for w in values(tokens, ["x" * 600])[0]] == [255, 255, 90]
    assert len(values(tokens, ["a." * 50_000])[0]) == 393


def test_strip_html(values):
    html = "<p>I&apos;m so <b>hap</b>py!</p><script>if (a<b) x='</p>';</script><!-- no --><style>p{}</style>1 < 2 > 0"
    assert values(strip_html, [html])[0].split() == ["I'm", "so", "happy!", "1", "<", "2", ">", "0"]
    assert values(strip_html, ["&amp;lt; &#233;&#38;amp; &#9999999; &unknown; a&b"]) == ["&lt; é&amp; � &unknown; a&b"]
    assert values(plain_text, ["<h1> A\n</h1>\n<p>b  c</p>", None]) == ["A\nb c", None]


def test_references_match_the_published_rules(values):
    """Against the standard library, for references that end in a semicolon."""
    names = [n for n in html.entities.html5 if n.endswith(";")]
    texts = [
        "it&#x27;s caf&eacute; &#233;&#XE9; &lt;b&gt; &amp;amp; &amp;lt; a&b; &nosuchname; &#xD800; &#0; & &; &#; x",
        "no reference", None, "".join(f"&{n}" for n in names[:900]), "".join(f"&{n}" for n in names[900:]),
    ]
    # Blanks without a width of their own are read as blanks.
    wanted = [t and html.unescape(t).replace("\ufffd", "\ufffd") for t in texts]
    got = values(decode_entities, texts)
    assert [t and t.replace("\u00a0", " ") for t in got] == [t and t.replace("\u00a0", " ") for t in wanted]
