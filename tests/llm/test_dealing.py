"""Rows that share an id, or a first column, are dealt over many tasks."""

from collections import Counter

import pytest

from quadframe.llm import jaccard_join, substring_dedup
from quadframe.plans import planner
from tests.llm.test_whole_job import prose


@pytest.mark.parametrize("one", [None, 7])
def test_no_batch_holds_all_rows_of_an_id(spark, monkeypatch, one):
    """Rows of one id are dealt over many batches, and the result is that of all rows in order."""
    rows = [(one, prose(k % 40, 40) + " " + prose(k, 25)) for k in range(120)] + [(k, prose(k, 30)) for k in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = []
    for module in (jaccard_join, substring_dedup):
        own = module.bucket_of
        monkeypatch.setattr(module, "bucket_of", lambda n, *c, own=own: dealt.append((n, c)) or own(n, *c))
    seen, expected = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        ws, gone = t.split(), set()
        for a in range(len(ws) - 19):
            if tuple(ws[a : a + 20]) in seen:
                gone.update(range(a, a + 20))
            seen.add(tuple(ws[a : a + 20]))
        expected[i, " ".join(w for k, w in enumerate(ws) if k not in gone)] += 1
    got = substring_dedup.remove_repeats(docs, batch_bytes=500)
    assert Counter(map(tuple, got.select("doc_id", "kept").collect())) == expected
    ranks = substring_dedup._ranked(docs).where("doc_id is null" if one is None else f"doc_id = {one}")
    assert ranks.select("rank").distinct().count() == 120
    jaccard_join.link_components(docs, batch_bytes=500)
    names = [[c if isinstance(c, str) else c._jc.toString() for c in columns] for _, columns in dealt]
    assert ["doc_id", "rank"] in names and ["doc_id", "text"] in names


def test_delta_in_ranges(spark):
    """Few values in the first column: the width is that of the whole order, and no range holds them all."""
    rows = [(a, b, c) for a in ("x", "y", None) for b in [*map(str, range(60)), None] for c in ("p", "q")]
    table = spark.createDataFrame(rows, "a string, b string, c string").repartition(3)
    order = sorted(rows, key=lambda r: [(v is not None, v or "") for v in r])
    expected = {r: 3 if not k else 3 - next(i for i in range(3) if r[i] != order[k - 1][i]) for k, r in enumerate(order)}
    got = planner.with_delta(table, ["a", "b", "c"])
    assert {tuple(r)[:3]: r["width"] for r in got.collect()} == expected and got.columns == ["a", "b", "c", "width"]
    sizes = Counter(r["__range"] for r in planner._in_ranges(table, ["a", "b", "c"])[0].collect())
    assert max(sizes.values()) < 60 and planner.with_delta(table.limit(0), ["a", "b"]).isEmpty()
