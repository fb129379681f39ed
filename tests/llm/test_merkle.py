"""The stored and recomputed tree against one built whole in plain Python."""

import hashlib
import zlib

import pytest

from tidemark.llm import merkle

SCHEMA = "lang string, doc_id long, text string, n_chars long, source string, hash string, pos int, root string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, more=0):
    values = (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h(*now[i : i + 2]) for i in range(0, len(now), 2)])
    return levels


def _path(levels, i):
    """(sibling or nothing, whether it stands left) from a leaf up."""
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else "", i & 1)
        i >>= 1


def _fold(h, path):
    for s, left in path:
        h = _h(s, h) if left else _h(h, s)
    return h


def expected(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r))) for x in langs}
    trees = {x: _tree([_leaf(r) for r in parts[x]]) for x in langs}
    top = _tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(parts[x]):
            path = [*_path(trees[x], i), *_path(top, k)]
            bad = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            back = _fold(_leaf(r, int(bad)), path)
            out.append((r["doc_id"], _leaf(r), trees[x][-1][0], top[-1][0], _h(*[s for s, _ in path]), back, back == top[-1][0]))
            assert back == top[-1][0] or bad
    return sorted(out, key=str)


def _rows(n, langs):
    return [dict(doc_id=k * 7919 % 10007, lang=langs[k % len(langs)], text=f"text {k} ñ" * (k % 3), n_chars=None if k % 11 == 5 else k, source=[None, "a", "b"][k % 3], hash="x", pos=1, root="y") for k in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en"]), (3, ["en", None]), (64, ["en"]), (65, ["en"]), (700, ["en", "en", "en", "de", None, "en", "ß"]), (300, [f"l{k}" for k in range(70)])])
def test_proofs_are_those_of_a_whole_tree(spark, n, langs):
    rows = _rows(n, langs)
    got = [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_deep_trees_and_other_steps(spark):
    rows = _rows(500, ["en", "de"])
    frame = spark.createDataFrame(rows, SCHEMA)
    roots = {merkle.build(frame, step=s).root for s in (1, 2, 3, 9)}
    assert roots == {expected(rows)[0][3]}


def test_odd_rows(spark):
    rows = [dict(doc_id=d, lang=x, text=t, n_chars=n, source=None, hash=None, pos=None, root=None) for d, x, t, n in [(None, None, None, None), (None, None, None, None), (3, "en", "", 0), (3, "en", "", 0), (3, "en", "other", 5), (9, "-", "long " * 100_000, 500_000), (21, "=", "a", 1)]]
    got = [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == expected(rows)
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0 and merkle.build(spark.createDataFrame([], SCHEMA)).root is None
