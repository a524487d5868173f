"""Boolean trigram queries of regular expressions, derived while the plan is made (after Cox, 2012).

A query is True (every text may match), a trigram, ("and", ...) or ("or", ...).
A text that the expression matches satisfies the query; all is in small letters,
so the query holds whether or not the expression minds case.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

#: A part of the expression that stands for more strings than these counts as any string.
MOST = 64


def _and(*queries):
    parts = sorted({q for q in queries if q is not True}, key=str)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(*queries):
    if any(q is True for q in queries):
        return True
    sets = {q: trigrams(q) for q in queries if isinstance(q, str) or all(isinstance(x, str) for x in q[1:])}
    plain = {q for q in sets if q[0] != "or" or isinstance(q, str)}
    implied = {q for q in plain for r in plain if sets[r] < sets[q]}  # asks for more than another does
    parts = sorted(set(queries) - implied, key=str)
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings):
    """The query of "one of these strings occurs"."""
    if not strings:
        return True
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def _class(items):
    out = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(parsed):
    """(strings, query): all strings that the part can stand for, or None if many, and what it needs besides."""
    run, needs = {""}, []
    for kind, value in parsed:
        strings, query = None, True
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = _class(value)
        elif kind is op.SUBPATTERN:
            strings, query = _walk(value[-1])
        elif kind is op.BRANCH:
            each = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            else:
                query = _or(*(_and(q, _of_strings(s) if s is not None else True) for s, q in each))
        elif kind is op.MAX_REPEAT:
            least, most, part = value
            inner, query = _walk(part)
            if inner is not None and most <= 2:
                strings = set().union(*({"".join(p) for p in product(inner, repeat=n)} for n in range(least, most + 1)))
            elif inner is not None and least and len(inner) == 1:
                needs.append(_of_strings({next(iter(inner)) * least}))
            query = query if least else True
        elif kind is op.AT:
            strings = {""}
        needs.append(query)
        joined = {a + b for a, b in product(run, strings)} if strings is not None and len(run) * len(strings) <= MOST else None
        if joined is None:
            needs.append(_of_strings(run))
            run = strings if strings is not None and len(strings) <= MOST else {""}
            whole = False
        else:
            run, whole = joined, True
        if not whole:
            needs.append(None)
    if None in needs:
        return None, _and(_of_strings(run), *(q for q in needs if q is not None))
    return run, _and(*needs)


def trigram_query(pattern: str):
    strings, query = _walk(_parser.parse(pattern))
    return _and(query, _of_strings(strings)) if strings is not None else query


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams, query[1:]))
