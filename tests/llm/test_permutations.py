"""The ciphers are permutations of exactly the values of a format."""

import datetime as dt

import pytest

from tidemark.llm import feistel


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_a_permutation_of_exactly_so_many_numbers(size):
    c = feistel.Cipher("k")
    got = [c.permute("x", size, v) for v in range(size)]
    assert sorted(got) == list(range(size)) and [c.permute("x", size, v, back=True) for v in got] == list(range(size))


def test_dates_of_three_years_stay_apart_and_come_back():
    c = feistel.Cipher("k")
    for write in (lambda d: d.isoformat(), lambda d: f"{d.month}/{d.day}/{d.year}", lambda d: f"{d.day}.{d.month}.{d.year}"):
        days = [write(dt.date(2019, 1, 1) + dt.timedelta(k)) for k in range(0, 1096, 3)]
        new = [feistel.pseudonym(c, "date", d) for d in days]
        assert len(set(new)) == len(days) and [feistel.pseudonym(c, "date", n, back=True) for n in new] == days
        assert [len(n) for n in new] == [len(d) for d in days]


def test_another_key_gives_other_values():
    assert feistel.pseudonym(feistel.Cipher("a"), "card", "4111 1111 1111 1111") != feistel.pseudonym(feistel.Cipher("b"), "card", "4111 1111 1111 1111")
