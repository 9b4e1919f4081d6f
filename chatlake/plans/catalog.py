"""Imports every plan module so its queries register, and exposes the registry."""

from __future__ import annotations

from chatlake.plans import registry
from chatlake.plans import analytics  # noqa: F401

_MODULES = ["chatlake.plans.text_plans", "chatlake.plans.knowledge_plans",
            "chatlake.plans.state_plans", "chatlake.plans.limit_plans", "chatlake.plans.stream_plans"]

for _m in _MODULES:
    __import__(_m)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLE)
