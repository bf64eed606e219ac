"""Keyword rules matched in one pass: an automaton finds their leading letters, and a rule's pattern is tried only where it does.

A rule is a set of alternatives between word boundaries. Each alternative begins with literal letters; these, of all rules of all
subjects, go into one Aho-Corasick automaton. Where it finds some at the beginning of a word, the rules that have an alternative
so beginning are matched from there. Texts are read once, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .rules import KEYWORD_RULES, pattern_of, split_alternatives

#: Letters that match i, s and k where case is ignored, and have another lower-case form.
FOLDED = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})
RULES_SCHEMA = "subject string, words string, targets array<string>"


class Rule(NamedTuple):
    subject: str
    words: str
    targets: tuple[str, ...]


def rules_of(table: DataFrame | None = None) -> tuple[Rule, ...]:
    """The rules of a table (subject, ord, words, targets), in its order, else the built-in ones."""
    if table is None:
        return tuple(Rule(s, words, tuple(targets)) for s, rules in KEYWORD_RULES.items() for words, targets in rules)
    return tuple(Rule(r.subject, r.words, tuple(r.targets)) for r in table.orderBy("subject", "ord").collect())


def literal_start(alternative: str) -> str:
    """The letters that every match of an alternative begins with, in lower case; empty if there are none."""
    out = []
    for token in re.findall(r"\\.[?*+{]?|.[?*+{]?", re.sub(r"^(?:\\b)+", "", alternative)):
        bare = token[1:] if token[0] == "\\" else token
        escaped, repeated = token[0] == "\\", token[-1] in "?*+{" and len(token) > 1 + (token[0] == "\\")
        if repeated or (bare[0].isalnum() if escaped else bare[0] in "()[]|^$."):
            break
        out.append(bare)
    return "".join(out).lower()


@cache
def _automaton(rules: tuple[Rule, ...]):
    """(automaton whose values are the numbers of rules, patterns anchored at a place, patterns of alternatives without leading letters)."""
    import ahocorasick

    starts: dict[str, set[int]] = {}
    rest: dict[int, list[str]] = {}
    for n, rule in enumerate(rules):
        for part in split_alternatives(rule.words):
            if first := literal_start(part):
                starts.setdefault(first, set()).add(n)
            else:
                rest.setdefault(n, []).append(part)
    found = ahocorasick.Automaton()
    for first, numbers in starts.items():
        found.add_word(first, (len(first), tuple(sorted(numbers))))
    if starts:
        found.make_automaton()
    return found if starts else None, [re.compile(pattern_of(r.words), re.I) for r in rules], [(n, re.compile(pattern_of("|".join(parts)), re.I)) for n, parts in rest.items()]


def matched_rules(text: str, rules: tuple[Rule, ...]) -> list[int]:
    """The numbers of all rules that a text matches, in order."""
    automaton, patterns, rest = _automaton(rules)
    low = (text if text.isascii() else text.translate(FOLDED)).lower()
    got: set[int] = set()
    for end, (size, numbers) in automaton.iter(low) if automaton else ():
        at = end + 1 - size
        # a match begins where a word does, or, led by a sign, where one ends
        if at and _is_word(low[at - 1]) == _is_word(low[at]):
            continue
        for n in numbers:
            if n not in got and patterns[n].match(low, at):
                got.add(n)
    got.update(n for n, p in rest if n not in got and p.search(low))
    return sorted(got)


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def matcher(rules: Sequence[Rule] | None = None) -> Callable[[Column | str], Column]:
    """A function of a text column that gives the array of the numbers of matching rules."""
    listed = tuple(rules) if rules is not None else rules_of()

    @F.pandas_udf(ArrayType(IntegerType()))
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: matched_rules(t or "", listed))

    return lambda col: found(F.col(col) if isinstance(col, str) else col)


def rules_result(numbers: Column | str, subject: str, rules: Sequence[Rule] | None = None) -> Column:
    """The struct of match_rules() for one subject from the numbers that a matcher() of the same rules gave."""
    listed = tuple(rules) if rules is not None else rules_of()
    own = [n for n, r in enumerate(listed) if r.subject == subject]
    if not own:
        return F.from_json(F.lit('{"matched":[],"boosts":[]}'), "matched array<string>, boosts array<string>")
    hits = F.filter(F.col(numbers) if isinstance(numbers, str) else numbers, lambda n: n.between(own[0], own[-1]))
    names = F.array(*(F.lit(pattern_of(listed[n].words)[:60]) for n in own))
    targets = F.array(*(F.array(*map(F.lit, listed[n].targets)) for n in own))
    return F.struct(
        F.transform(hits, lambda n: F.get(names, n - own[0])).alias("matched"),
        F.array_distinct(F.flatten(F.transform(hits, lambda n: F.get(targets, n - own[0])))).alias("boosts"),
    )
