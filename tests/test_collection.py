"""Every test module can be imported by name, whatever other folders pytest has put on the path."""

from __future__ import annotations

import importlib
import os

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
MODULES = sorted(name[:-3] for name in os.listdir(HERE) if name.startswith("test_") and name.endswith(".py"))


@pytest.mark.parametrize("name", MODULES)
def test_module_imports(name):
    assert importlib.import_module(name).__file__ == os.path.join(HERE, f"{name}.py")
