"""Slow and obvious versions of the main rules, to hold the jobs against."""

import math
import re
from collections import Counter

STOPS = set(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they"
    " this to was will with".split()
)


def consonants(word):
    flags = []
    for i, c in enumerate(word):
        if c in "aeiou":
            flags.append(False)
        elif c == "y":
            flags.append(i == 0 or not flags[-1])
        else:
            flags.append(True)
    return flags


def measure(word):
    shape = "".join("c" if f else "v" for f in consonants(word))
    return len(re.findall("v+c+", shape))


def vowel(word):
    return not all(consonants(word))


def doubled(word):
    return len(word) > 1 and word[-1] == word[-2] and consonants(word)[-1]


def cvc(word):
    return len(word) > 2 and consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


def longest(word, suffixes):
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


TWO = dict(
    line.split() for line in """ational ate|tional tion|enci ence|anci ance|izer ize|bli ble|alli al|entli ent|eli e
|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble
|logi log""".replace("\n", "").split("|")
)
THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def stem(word):
    if len(word) < 3:
        return word
    if word.endswith("s"):
        if word.endswith(("sses", "ies")):
            word = word[:-2]
        elif not word.endswith("ss"):
            word = word[:-1]
    if word.endswith("eed"):
        if measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and vowel(word[: -len(s)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif doubled(word):
                word = word if word[-1] in "lsz" else word[:-1]
            elif measure(word) == 1 and cvc(word):
                word += "e"
    if word.endswith("y") and vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (TWO, THREE):
        s = longest(word, rules)
        if s and measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + rules[s]
    s = longest(word, FOUR)
    if s and measure(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and measure(word) > 1:
        word = word[:-1]
    return word


def terms(text, field):
    found = [stem(w) for w in re.findall(r"[a-z]+", text.lower())]
    return [t for t in found if field == "title" or t not in STOPS]


def scores(docs, queries):
    """{query: [(doc, score)]} best first, by the book."""
    out = {}
    index = {f: {d: terms(text[f], f) for d, text in docs.items()} for f in ("title", "content")}
    for q, text in queries.items():
        best = {}
        for field, boost in (("title", 3.0), ("content", 1.0)):
            filled = {d: ts for d, ts in index[field].items() if ts}
            if not filled:
                continue
            average = sum(map(len, filled.values())) / len(filled)
            asked = terms(text, field)
            for d, ts in filled.items():
                total = 0.0
                for t, times in Counter(asked).items():
                    df = sum(t in other for other in filled.values())
                    tf = ts.count(t)
                    if tf:
                        idf = math.log(1 + (len(filled) - df + 0.5) / (df + 0.5))
                        total += times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / average))
                if any(t in ts for t in asked):
                    best[d] = max(best.get(d, 0.0), boost * total)
        out[q] = sorted(((d, round(s, 6)) for d, s in best.items()), key=lambda x: (-x[1], x[0]))
    return out
