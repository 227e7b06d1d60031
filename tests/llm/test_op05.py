import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glidemesh.llm import op05_line_dedup as op


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abé", max_size=14), st.text("abé", max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, k):
    assert op.within(a, b, k) == (distance(a, b) <= k)


def corpus(seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(12, 60))).strip().ljust(12, "x") for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(s))
                s[at : at + rng.choice([0, 1])] = rng.choice(["", "z", "q"])
            lines.append("".join(s))
        docs.append((i * 2, "\n".join(lines + rng.choice([[], ["short"], ["", "  "]]))))
    return docs + [(201, None), (202, ""), (203, "\n\n"), (4, docs[2][1]), (None, base[0])]


def brute(rows, p):
    places = []
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")) if text is not None else []:
            if len(line.strip(" ")) >= p.least_chars:
                places.append(((doc is not None, doc or 0), n, line))
    lines = sorted({x[2] for x in places})
    parent = {x: x for x in lines}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in lines:
        for b in lines:
            if a < b and min(len(a), len(b)) >= p.near_chars and distance(a, b) <= p.edits:
                parent[find(a)] = find(b)
    first = {}
    for d, n, line in places:
        c = find(line)
        first[c] = min(first.get(c, (d, n)), (d, n))
    return {(d, n): (first[find(line)] != (d, n), first[find(line)][0]) for d, n, line in places}


@pytest.mark.parametrize("edits,hot", [(0, 32), (1, 32), (2, 32), (2, 1), (3, 2)])
def test_same_lines_dropped_as_by_all_pairs(spark, edits, hot):
    rows, p = corpus(), op.LineParams(edits=edits, hot_members=hot)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, line string")
    got = op.dropped_lines(df, p).collect()
    want = brute(rows, p)
    dropped = {((r.doc_id is not None, r.doc_id or 0), r.line_no) for r in got if r.dropped}
    assert dropped == {k for k, (gone, _) in want.items() if gone}
    assert all(want[((r.doc_id is not None, r.doc_id or 0), r.line_no)][1][1] == (r.kept_in or 0) for r in got)


def test_texts_and_query(spark, tmp_path):
    long = "this line is long enough to be matched with edits"
    rows = [(2, f"{long}\nkeep me, I am on my own\nhi", 5, "b"), (1, f"{long}!\n\nhi", 5, "a"), (3, None, None, None), (4, long + "\n" + long, 9, "c"), (4, long + "\n" + long, 9, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone string")
    out = op.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text, r.n_chars, r.gone) for r in out.collect() if r.doc_id != 3)
    assert got == [(1, f"{long}!\n\nhi", 5, "a"), (2, "keep me, I am on my own", 23, "b"), (4, "", 0, "c"), (4, "", 0, "c")]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    q = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    assert (q[2].n_lines, q[2].n_dropped, q[2].dropped_lines, q[2].kept_in, q[3].n_lines) == (3, 2, [0, 2], [1], 0)
    assert op.dedup_lines(df.limit(0)).count() == 0


def test_repeated_rows_count_once_and_blank_lines_stay(spark, tmp_path):
    line = "this line is long enough to be matched with edits"
    rows = [(1, line), (4, f"{line}\n{line}\n\t\n\t"), (4, f"{line}\n{line}\n\t\n\t"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op.query(spark, str(tmp_path)).where("doc_id = 4").collect()]
    assert got == [(4, 4, 2, 0, [0, 1], [1])] * 2
    linked = rows + [(6, line + "!")]
    spark.createDataFrame(linked, "doc_id long, text string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    q = {r.doc_id: (r.n_dropped, r.n_links) for r in op.query(spark, str(tmp_path / "b")).collect()}
    assert q == {1: (0, 1), 4: (2, 2), 5: (0, 0), 6: (1, 1)}


def test_short_lines_are_matched_exactly(spark):
    df = spark.createDataFrame([(1, "ab\n}\nzz", "u"), (2, "ab\n}\nzy", "v")], "doc_id long, text string, _text string")
    assert [tuple(r) for r in op.dedup_lines(df).orderBy("doc_id").collect()] == [(1, "ab\n}\nzz", "u"), (2, "zy", "v")]


@pytest.mark.parametrize("edits", [0, 2])
def test_lines_are_put_together_once(spark, monkeypatch, edits):
    plans, save = [], op.saved
    monkeypatch.setattr(op, "saved", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df, *a))
    line = "this line is long enough to be matched with edits"
    op.line_classes(spark.createDataFrame([(1, line), (2, line + "!")], "doc_id long, text string"), op.LineParams(edits=edits))
    assert sum("posexplode" in plan for plan in plans) == 1
