"""Trigrams that a text must hold for a regular expression to match in it.

A query is a list of clauses that must all hold; a clause is a list of alternatives of which one must
hold; an alternative is a set of trigrams that must all occur. Trigrams are of lower-cased ASCII, so a
query never rules out a match whatever the expression's case. An expression that forces no trigram has
an empty query.
"""

from __future__ import annotations

import itertools
from re import _constants as kinds
from re import _parser as parser

MOST = 64  # strings of one exact set

Query = list[list[frozenset[bytes]]]


def query_of(pattern: str, flags: int = 0) -> Query:
    return _sequence(parser.parse(pattern, flags))


def _literal(code: int) -> str | None:
    return chr(code).lower() if code < 128 else None


def _exact_set(items: list) -> set[str] | None:
    """Strings of a character class, if they are few and ASCII."""
    codes: list[int] = []
    for kind, value in items:
        if kind is kinds.LITERAL:
            codes.append(value)
        elif kind is kinds.RANGE and value[1] - value[0] < MOST:
            codes.extend(range(value[0], value[1] + 1))
        else:
            return None
    found = {_literal(c) for c in codes}
    return None if None in found or len(found) > 16 else found


def _exact(kind, value) -> set[str] | None:
    """All strings that a node matches, if they are known and few."""
    if kind is kinds.LITERAL:
        found = _literal(value)
        return None if found is None else {found}
    if kind is kinds.AT:
        return {""}
    if kind is kinds.IN:
        return _exact_set(value)
    if kind is kinds.SUBPATTERN:
        return _exact_sequence(value[3])
    if kind is kinds.BRANCH:
        found = [_exact_sequence(branch) for branch in value[1]]
        return None if None in found else _bounded(set().union(*found))
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[1] <= 4:
        inner = _exact_sequence(value[2])
        if inner is None:
            return None
        found = set()
        for times in range(value[0], value[1] + 1):
            if len(inner) ** times > MOST:
                return None
            found |= {"".join(p) for p in itertools.product(inner, repeat=times)}
        return _bounded(found)
    return None


def _bounded(found: set[str]) -> set[str] | None:
    return found if len(found) <= MOST else None


def _exact_sequence(nodes) -> set[str] | None:
    found = {""}
    for kind, value in nodes:
        here = _exact(kind, value)
        if here is None or len(found) * len(here) > MOST:
            return None
        found = {a + b for a in found for b in here}
    return found


def _clause(strings: set[str]) -> Query:
    """One of these strings occurs; no clause if one of them is too short to have a trigram."""
    if any(len(s) < 3 for s in strings):
        return []
    sets = {frozenset(s[k : k + 3].encode() for k in range(len(s) - 2)) for s in strings}
    return [[x for x in sets if not any(y < x for y in sets)]]


def _sequence(nodes) -> Query:
    clauses: Query = []
    strings = {""}
    for kind, value in nodes:
        here = _exact(kind, value)
        if here is not None and len(strings) * len(here) <= MOST:
            strings = {a + b for a in strings for b in here}
            continue
        clauses += _clause(strings)
        strings = here or {""}
        if here is None:
            clauses += _within(kind, value)
    return clauses + _clause(strings)


def _within(kind, value) -> Query:
    """Clauses that a node of unknown strings forces."""
    if kind is kinds.SUBPATTERN:
        return _sequence(value[3])
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] >= 1:
        return _sequence(value[2])
    if kind is kinds.BRANCH:
        branches = [_sequence(branch) for branch in value[1]]
        return [[x for clauses in branches for x in clauses[0]]] if all(branches) else []
    return []


def trigrams_of(query: Query) -> set[bytes]:
    return {t for clause in query for alternative in clause for t in alternative}
