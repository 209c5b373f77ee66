"""Components that grow by more edges."""

import random

from quadframe.llm import components


def test_merged_searches_names_only(spark, monkeypatch):
    """As from all edges at once; the search sees names of components, not the edges that made them."""
    r = random.Random(4)
    for first, more in (([(1, 2), (2, 3), (8, 9), (20, 21)], [(3, 9), (30, 31), (31, 20), (2, 1)]), ([(r.randrange(90), r.randrange(90)) for _ in range(40)], [(r.randrange(90), r.randrange(90)) for _ in range(25)])):
        first, more = ([e for e in x if e[0] != e[1]] for x in (first, more))
        table = lambda e: spark.createDataFrame(e, "a long, b long")
        plain = {tuple(x) for x in components.connected_components(table(first + more)).collect()}
        found = components.connected_components(table(first))
        seen, own = [], components.connected_components
        with monkeypatch.context() as m:
            m.setattr(components, "connected_components", lambda e: seen.append({tuple(sorted(x)) for x in e.collect()}) or own(e))
            got = [tuple(x) for x in components.merged(found, table(more)).collect()]
        assert len(got) == len(set(got)) and {x for x in got if x[0] != x[1] or x in plain} == plain
        names = dict(map(tuple, found.collect()))
        assert seen == [{tuple(sorted((names.get(a, a), names.get(b, b)))) for a, b in more}]
