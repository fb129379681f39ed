"""Line templates: fields of any number, tables of numbers, short lines."""

import pytest

from tidemark.llm import line_templates


def _cut(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_cut, r.text) for r in line_templates.cut_lines(docs).collect()}


def test_lines_and_variable_fields_that_recur_are_cut(spark):
    got = _cut(spark, ["report number 17 was filed by the office on monday\nfirst own words that nobody else has", "report number 18 was filed by the office on monday\nsecond text which is not the same", "tiny line\nthird one stands here all alone too", "tiny line"])
    assert got[0][0] == 0 and got[1] == (1, "second text which is not the same") and got[2][0] == got[3][0] == 0


@pytest.mark.parametrize("n", [30, 300, 3000])
def test_a_template_is_found_however_many_lines_it_has(spark, n):
    name = lambda k, tag: tag + "".join("abcdefghij"[int(d)] for d in str(k % 100))
    got = _cut(spark, [f"notice sent to the {name(k * 7, 'n')} in {name(k // 3, 'c')} this week again" for k in range(n)])
    assert sum(k for k, _ in got.values()) >= 0.97 * (n - 1)


def test_rows_of_a_table_and_lines_without_constants_stay(spark):
    rows = [" ".join(f"w{k}x{i * j}" for k in range(30)) for i, j in zip(range(1, 6), range(7, 12))]
    assert all(k == 0 for k, _ in _cut(spark, rows).values())
    many = ["\n".join(" ".join(str(i * 50 + r * 8 + c) for c in range(8)) for r in range(6)) for i in range(3)]
    assert all(k == 0 for k, _ in _cut(spark, many).values())
    assert [k for k, _ in _cut(spark, [rows[0], rows[0]]).values()] == [0, 1]


def test_short_lines_recur_as_they_are_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "SHORT_DOCS", 4)
    got = _cut(spark, [f"read more\npage {k}\n\nown words number {'abcdef'[k]} that nobody else has here {'uvwxyz'[k]}\nseen thrice {k % 2}" for k in range(5)])
    assert sum(t.count("read more") for _, t in got.values()) == 1
    assert sum(t.count("page ") for _, t in got.values()) == 5 and sum(t.count("seen thrice") for _, t in got.values()) == 5
    assert all("\n\n" in t or t.startswith("page") for _, t in got.values())


@pytest.mark.parametrize("templates", [1, 2, 3, 5, 10])
@pytest.mark.parametrize("each", [3, 60])
def test_templates_that_share_a_leaf_are_all_found(spark, templates, each):
    """Lines of twelve tokens: four leading ones of all templates, seven of the template, one variable."""
    word = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    lines = [f"all of these begin {' '.join(f't{word(t)}w{word(p)}' for p in range(7))} v{word(t * each + k)}" for k in range(each) for t in range(templates)]
    got = _cut(spark, lines)
    assert sum(k for k, _ in got.values()) == templates * (each - 1)


def test_small_templates_beside_a_large_one(spark):
    word = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    large = [f"the same four words then a long line of the large template {word(k)}" for k in range(500)]
    small = [f"the same four words but here is a quite small template now {word(k)}" for k in range(4)]
    got = _cut(spark, large + small + ["the same four words and nothing else like any other line at all"])
    assert sum(k for k, _ in got.values()) == 499 + 3 and got[504][0] == 0
