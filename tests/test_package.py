"""The public names of the package."""

import subprocess
import sys

import pytest

import graphloom


@pytest.mark.parametrize("name", graphloom.__all__)
def test_public_name(name):
    assert getattr(graphloom, name).__name__ == name and name in dir(graphloom)


def test_unknown_name():
    with pytest.raises(AttributeError):
        graphloom.nothing


def test_import_loads_nothing_else():
    code = "import sys, graphloom; print([m for m in sys.modules if m.startswith(('graphloom.', 'pyspark', 'pandas'))])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[]"
