"""Column-name matching. Works on names only, so no Spark job is needed."""

import re

from ebbtide.functions import fixed


def plain(name):
    return re.sub(r"[^a-z0-9]+", "", str(name).lower())


def find_column(columns, names):
    """Exact match on plain names; the first alias wins, then the last column of that name."""
    by_plain = {plain(c): c for c in columns}
    return next((by_plain[plain(n)] for n in names if plain(n) in by_plain), None)


def find_columns(columns, candidates):
    """Every column matched by one of the candidates, in candidate order, without repeats."""
    hits = (find_column(columns, [c]) for c in candidates)
    return list(dict.fromkeys(h for h in hits if h is not None))


def contains_alias(name, aliases, min_length=4):
    """Containment either way; the contained side needs `min_length` characters, so that a
    column called "c" is not taken for a customer id."""
    n = plain(name)
    for alias in map(plain, aliases):
        inner, outer = sorted((n, alias), key=len)
        if len(inner) >= min_length and inner in outer:
            return True
    return False


def name_words(name):
    """Words of a name, split at signs, spaces and changes from lower to upper case."""
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", str(name)).lower())


def contains_words(name, aliases, min_length=4):
    """The alias is a run of the name's words, or the name a run of the alias's words."""
    own = name_words(name)
    for alias in map(name_words, aliases):
        inner, outer = sorted((own, alias), key=len)
        runs = (outer[k:k + len(inner)] for k in range(len(outer) - len(inner) + 1))
        if len("".join(inner)) >= min_length and inner in runs:
            return True
    return False


def match_column(columns, aliases, produced=fixed.PRODUCED_COLUMNS):
    """Exact match first, then containment over the columns that scoring did not write."""
    exact = find_column(columns, aliases)
    if exact is not None:
        return exact
    skip = {plain(p) for p in produced}
    return next((c for c in columns if plain(c) not in skip and contains_alias(c, aliases)), None)


def match_columns(columns, aliases, produced=fixed.PRODUCED_COLUMNS):
    """All columns that match exactly or by containment, in table order."""
    skip = {plain(p) for p in produced}
    exact = {plain(a) for a in aliases}
    return [c for c in columns
            if plain(c) in exact or (plain(c) not in skip and contains_alias(c, aliases))]


def role(columns, name):
    """Column of a scored table that plays the named role."""
    return find_column(columns, fixed.RESULT_ALIASES[name])
