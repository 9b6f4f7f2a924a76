"""Secrets and addresses of any length are proposed, and replaced, whole."""

import random
import re
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import pii

SHORT = re.compile(r"\b([A-Za-z0-9._%+-]{1,64} ?[\[({] ?(?i:at) ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?i:dot) ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,4})")


@pytest.mark.parametrize("size", [40, 190, 201, 300, 3000])
def test_whole_secret(size):
    key = "".join(random.Random(size).choices(string.ascii_letters + string.digits + "+/", k=size))
    for text in (f"use token={key} now", f"the {key} here"):
        (base, added), = pii.find([text], pii.judge())
        assert pii.redact(text, base + added) == text.replace(key, "<SECRET>")


def test_whole_address():
    text = "to " + "a" * 90 + " [at] b" + "b" * 70 + ".c.d.e.f.g [dot] org"
    assert ("email", 3, len(text)) in pii.candidates(text)


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", "[at]", " (At) ", ".", " [dot] ", "%", "-", "_", "+", "1"]), max_size=14))
def test_short_addresses_as_before(parts):
    text = "".join(parts)
    found = [m.span(1) for m in SHORT.finditer(text)]
    if text.count(".") + text.count("[dot]") <= 4:
        assert pii._written(text) == found


def test_long_runs_stay_linear():
    began = time.time()
    for text in ("a" * 200_000 + " [at]", "a-" * 100_000, "a[at]b." * 20_000, "key=" * 40_000, "b." * 100_000 + "(at)", "x" * 199 + "/" * 100_000):
        pii.find([text], pii.judge())
    assert time.time() - began < 20
