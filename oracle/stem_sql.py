"""The stemming rules as SQL, one common table expression per step."""

from __future__ import annotations

from lorekeep.functions import porter


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(pattern: str, value: str) -> str:
    return f"regexp_matches({value}, {_quoted(pattern)})"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _case(branches: list[tuple[str, str]], otherwise: str = "w") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + f" ELSE {otherwise} END"


def _suffix_rules(rules: list[tuple[str, str]], measure: str) -> str:
    longest_first = sorted(rules, key=lambda rule: -len(rule[0]))
    branches = []
    for suffix, new in longest_first:
        stem = _cut(len(suffix))
        extra = f" AND (suffix(w, 'sion') OR suffix(w, 'tion'))" if suffix == "ion" else ""
        value = _case([(_has(measure, stem) + extra, f"concat({stem}, {_quoted(new)})")])
        branches.append((f"suffix(w, {_quoted(suffix)})", value))
    return _case(branches)


def stem_steps(source: str, target: str) -> list[tuple[str, str]]:
    """CTEs that take ``source(token)`` to ``target(token, term)``."""
    vowel, over_0, over_1 = porter.HAS_VOWEL, porter.MEASURE_OVER_0, porter.MEASURE_OVER_1
    kept = ", ".join(_quoted(letter) for letter in porter.NOT_UNDOUBLED)
    doubled = (
        f"((length(w) >= 2 AND right(w, 1) = left(right(w, 2), 1) AND right(w, 1) NOT IN ({kept}))"
        f" OR {_has(porter.DOUBLE_Y, 'w')})"
    )
    repair = _case(
        [
            ("suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz')", "concat(w, 'e')"),
            (doubled, _cut(1)),
            (_has(porter.SHORT_SYLLABLE, "w"), "concat(w, 'e')"),
        ]
    )
    step_5a = f"suffix(w, 'e') AND ({_has(over_1, _cut(1))} OR ({_has(porter.MEASURE_IS_1, _cut(1))} AND NOT {_has(porter.SHORT_SYLLABLE, _cut(1))}))"
    steps = [
        _case([("suffix(w, 'sses') OR suffix(w, 'ies')", _cut(2)), ("suffix(w, 'ss')", "w"), ("suffix(w, 's')", _cut(1))]),
        _case(
            [
                ("suffix(w, 'eed')", _case([(_has(over_0, _cut(3)), _cut(1))])),
                (f"suffix(w, 'ed') AND {_has(vowel, _cut(2))}", f"concat({_cut(2)}, '+')"),
                (f"suffix(w, 'ing') AND {_has(vowel, _cut(3))}", f"concat({_cut(3)}, '+')"),
            ]
        ),
        # A plus sign, which no word holds, marks the words to be repaired.
        f"CASE WHEN suffix(w, '+') THEN (SELECT {repair} FROM (SELECT rtrim(s.w, '+') AS w)) ELSE w END",
        _case([(f"suffix(w, 'y') AND {_has(vowel, _cut(1))}", f"concat({_cut(1)}, 'i')")]),
        _suffix_rules(porter.STEP_2, over_0),
        _suffix_rules(porter.STEP_3, over_0),
        _suffix_rules([(suffix, "") for suffix in porter.STEP_4], over_1),
        _case([(step_5a, _cut(1))]),
        _case([(f"suffix(w, 'll') AND {_has(over_1, 'w')}", _cut(1))]),
    ]
    ctes = [(f"{target}_0", f"SELECT DISTINCT token, token AS w FROM {source}")]
    for number, step in enumerate(steps, 1):
        # Inside the repair the outer word is named s.w.
        ctes.append((f"{target}_{number}", f"SELECT token, {step} AS w FROM {target}_{number - 1} AS s"))
    ctes.append(
        (target, f"SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE w END AS term FROM {target}_{len(steps)}")
    )
    return ctes
