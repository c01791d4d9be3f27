"""Long runs of words with digits are searched as one."""

import random

import pytest

from florilege.llm import pii


@pytest.mark.parametrize("pad", range(0, 28, 3))
def test_spans_across_the_length_of_an_island(pad):
    head = "a1 " * 1325 + "x1" + "y" * pad + " "
    text = head + "(555) 123-4567 b2"
    assert len(list(pii.islands(text))) == 1
    assert pii.find_spans(text, pii.trained())[1] == [("phone", len(head), len(head) + 14)]


def test_parts_make_no_difference(monkeypatch):
    model, rng = pii.trained(), random.Random(7)
    text = " ".join(pii._sentence(rng)[0].replace(" ", "1 ") for _ in range(30)) + " 4111 1111 1111 1111 12345678 a@b.de 555-123-4567"
    whole = pii.find_spans(text, model)
    for atoms in (1, 5, 17):
        monkeypatch.setattr(pii, "SCORED_ATOMS", atoms)
        assert pii.find_spans(text, model) == whole
