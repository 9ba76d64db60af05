import time

import pytest

from plumeline.llm import pii

NUMBERS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84MALT011000012345MTLCAST001S", "FR14 2004 1010 0505 0001 3M02 606"]
AFTER = ["", ".", " then", " Then", " Please pay", " OK", " I", " 12", " 7 items", " A 4", " DE89370400440532013000", " X" * 40, " 1" * 40]


def found(text):
    return [text[a:b] for a, b in pii.all_spans(text)["iban"]]


@pytest.mark.parametrize("number", NUMBERS)
@pytest.mark.parametrize("after", AFTER)
def test_an_account_number_whatever_follows(number, after):
    got = found(f"Bank {number}{after}")
    assert got == [number] + ["DE89370400440532013000"] * ("DE89" in after)
    assert number not in pii.redacted(f"Bank {number}{after}")


def test_what_is_no_account_number():
    # a wrong check, a part of a word, too short, a word that goes on
    for text in ("DE88370400440532013000 Then", "xDE89370400440532013000", "DE89 3704 0044", "DE89370400440532013000Then", "DE89370400440532013000a"):
        assert found(text) == []
    # after an anchor that is none, the next one counts
    assert found("AB12 DE89370400440532013000 Then") == ["DE89370400440532013000"]


def test_a_code_of_a_country_without_a_length():
    code = next(c for k in range(100) if pii.mod97(c := f"ZZ{k:02d}ABCD12345678901"))
    assert found(f"{code} Then") == [code]


def test_accounts_take_linear_time():
    start = time.perf_counter()
    for text in ("AB12 " * 100_000, "AB12" * 100_000, "A " * 200_000, "DE89 3704 0044 0532 0130 01 " * 20_000):
        found(text)
    assert time.perf_counter() - start < 20
