"""Scalar column functions of the application (SF1-SF4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlake.functions.semantics import col_, js_trim


def client_ip(xff: Column | str, remote: Column | str) -> Column:
    """SF1: first item of X-Forwarded-For, trimmed (even if that leaves ''); else the
    remote address; else 'unknown'.  An empty header counts as absent (JS truthiness)."""
    x = col_(xff)
    r = col_(remote)
    first = js_trim(F.substring_index(x, ",", 1))
    return (F.when(x.isNotNull() & (x != ""), first)
             .when(r.isNotNull() & (r != ""), r).otherwise(F.lit("unknown")))


def display_name(first: Column | str, last: Column | str, email: Column | str) -> Column:
    """SF2: ``(first||'') + ' ' + (last||'')`` trimmed, else e-mail, else 'User'."""
    full = js_trim(F.concat(F.coalesce(col_(first), F.lit("")), F.lit(" "), F.coalesce(col_(last), F.lit(""))))
    e = col_(email)
    return F.when(full != "", full).when(e.isNotNull() & (e != ""), e).otherwise(F.lit("User"))


def avatar_initial(name: Column | str) -> Column:
    """SF2: first character, upper-cased."""
    return F.upper(F.substring(col_(name), 1, 1))


def suspension_end(now: Column, months: Column | str, days: Column | str, hours: Column | str,
                   minutes: Column | str) -> Column:
    """SF3: ``now + interval 'm months d days h hours mi minutes'`` (months first, month-end clamped)."""
    return now + F.make_interval(F.lit(0), col_(months).cast("int"), F.lit(0), col_(days).cast("int"),
                                 col_(hours).cast("int"), col_(minutes).cast("int"), F.lit(0))


def code_hash(code: Column | str) -> Column:
    """SF4: SHA-256 hex of a one-time code."""
    return F.sha2(col_(code), 256)
