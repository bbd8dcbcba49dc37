"""Locale membership and resolution as literal maps; no join, no UDF."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.fixed import ALIASES_EXACT, ALIASES_FOLDED, DEFAULT_LOCALE, LOCALES


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def supported(locale: Column) -> Column:
    """Null or empty asks for detection and passes."""
    return locale.isNull() | (locale == "") | locale.isin(LOCALES)


def resolve_exact(detected: Column, requested: Column, strict: bool = False) -> Column:
    """Detected before requested, case-sensitive; then the default, or null in strict mode."""
    known = _map({x: x for x in LOCALES} | ALIASES_EXACT)
    found = F.coalesce(F.try_element_at(known, detected), F.try_element_at(known, requested))
    return found if strict else F.coalesce(found, F.lit(DEFAULT_LOCALE))


def resolve_folded(detected: Column, requested: Column, strict: bool = False, fixed: bool = True) -> Column:
    """Lower case and trimmed. fixed: full locales match whatever their case; else they do not, as in the running service."""
    known = _map(ALIASES_FOLDED | ({x.lower(): x for x in LOCALES} if fixed else {}))
    fold = lambda c: F.trim(F.lower(c))
    found = F.coalesce(F.try_element_at(known, fold(detected)), F.try_element_at(known, fold(requested)))
    return found if strict else F.coalesce(found, F.lit(DEFAULT_LOCALE))
