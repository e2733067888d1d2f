"""Checks for tests of code that produces documents."""

from __future__ import annotations

import re

from . import api


def query_where(data, text: str) -> None:
    assert api.query(text, data) is True, f"{text} is not true"


def query_equals(data, text: str, expected) -> None:
    found = api.query(text, data)
    assert found == expected, f"{text}: {found!r} is not {expected!r}"


def query_matches(data, text: str, expected) -> None:
    """``expected`` is a predicate or a pattern that the text of the result must contain."""
    found = api.query(text, data)
    assert expected(found) if callable(expected) else re.search(expected, str(found)), f"{text}: {found!r} doesn't match"


def query_has(data, text: str) -> None:
    assert api.query(text, data) is not None, f"{text} is absent"
