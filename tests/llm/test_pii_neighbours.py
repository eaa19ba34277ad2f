from __future__ import annotations

import pytest

from gridloom.llm import pii


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("GB29NWBK60161331926819 DE89370400440532013000", ["GB29NWBK60161331926819", "DE89370400440532013000"]),
        ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
        ("XX12 DE89370400440532013000", ["DE89370400440532013000"]),
        ("DE00370400440532 DE89370400440532013000 GB29NWBK60161331926819", ["DE89370400440532013000", "GB29NWBK60161331926819"]),
        ("ADE89370400440532013000", []),
    ],
)
def test_account_numbers_side_by_side(text, numbers):
    assert [text[a:b] for a, b in pii.ibans(text)] == numbers
    assert not any(x in pii.redacted(text, pii.spans_of(text)) for x in numbers)
