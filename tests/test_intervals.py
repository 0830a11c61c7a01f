from itertools import accumulate, groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterline.operators import intervals

K = ["k"]


def frame(spark, rows, columns="k int, start double, end double"):
    return spark.createDataFrame(rows, columns)


def spans(df):
    return sorted((r.k, r.start, r.end) for r in df.collect())


def test_uncovered_spans_cases(spark):
    cases = [
        ([(10.0, 40.0)], [(10.0, 12.0), (35.0, 38.0)], [(12.0, 35.0), (38.0, 40.0)]),
        ([(10.0, 40.0)], [(10.0, 39.5)], []),
        ([(10.0, 40.0)], [(9.0, 41.0)], []),
        ([(10.0, 40.0)], [], [(10.0, 40.0)]),
        ([(10.0, 10.5)], [], [(10.0, 10.5)]),
        ([(10.0, 40.0)], [(20.0, 20.0)], [(10.0, 20.0), (20.0, 40.0)]),
    ]
    regions = frame(spark, [(i, *r) for i, c in enumerate(cases) for r in c[0]])
    covers = frame(spark, [(i, *w) for i, c in enumerate(cases) for w in c[1]])
    got = spans(intervals.subtract(regions, covers, K, 1.0, width=7.0))
    assert got == sorted((i, *x) for i, c in enumerate(cases) for x in c[2])


def test_clip_windows(spark):
    got = spans(intervals.padded(frame(spark, [(0, 0.2, 4.0), (0, 4.8, 9.0), (0, 20.0, 25.0)]), K, 0.5))
    assert got == [(0, 0.0, 9.5), (0, 19.5, 25.5)]
    with pytest.raises(ValueError):
        intervals.padded(frame(spark, [(0, 1.0, 2.0)]), K, -1.0)


def test_prefix(spark):
    got = spans(intervals.budgeted_prefix(frame(spark, [(0, 50.0, 70.0), (0, 5.0, 15.0), (0, 20.0, 45.0)]), K, 30.0))
    assert got == [(0, 5.0, 15.0), (0, 20.0, 40.0)]


def test_exit_over_enter_is_an_error(spark):
    with pytest.raises(ValueError):
        intervals.hysteresis(frame(spark, [(0, 1, 1.0)], "k int, i int, v double"), K, 1.0, 2.0)


def test_coverage_of_nothing(spark):
    regions, none = frame(spark, [(0, 0.0, 0.0), (1, 0.0, 10.0), (2, 0.0, 10.0)]), frame(spark, [(2, 5.0, 30.0)])
    got = {r.k: r.covered_ratio for r in intervals.coverage(regions, none, K, width=4.0).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.5}


def test_outside_is_strict(spark):
    lines = frame(spark, [(0, 0.0, 5.0), (0, 5.0, 6.0), (1, 0.0, 1.0)])
    assert spans(intervals.outside(lines, frame(spark, [(0, 5.0, 9.0)]), K, width=3.0)) == [(0, 0.0, 5.0), (1, 0.0, 1.0)]


def runs(flags):
    """Half-open runs of true flags."""
    at, out = 0, []
    for on, group in groupby(flags):
        n = len(list(group))
        out += [(at, at + n)] if on else []
        at += n
    return out


def plain_regions(values, enter, leave, gap, least):
    """States by folding, then gaps closed on the flags themselves."""
    on = list(accumulate(values, lambda was, v: True if v >= enter else was and v >= leave, initial=False))[1:]
    for s, e in runs([not x for x in on]):
        if 0 < s and e < len(on) and e - s < gap:
            on[s:e] = [True] * (e - s)
    return [(s, e) for s, e in runs(on) if e - s >= least]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(0, 10), min_size=1, max_size=40), min_size=5, max_size=20))
def test_activity_regions_property(spark, tracks):
    rows = [(k, i, float(v)) for k, vs in enumerate(tracks) for i, v in enumerate(vs)]
    got = intervals.activity_regions(spark.createDataFrame(rows, "k int, i int, v double"), K, enter=7, exit=4, max_gap=2, min_length=2, width=8).collect()
    want = [(k, s, e, sum(vs[s:e]) / (e - s)) for k, vs in enumerate(tracks) for s, e in plain_regions(vs, 7, 4, 2, 2)]
    assert sorted((r.k, r.start, r.end, round(r["mean"], 9)) for r in got) == sorted((*w[:3], round(w[3], 9)) for w in want)


def cells(spans, size=60):
    return [any(s <= x < e for s, e in spans) for x in range(size)]


def plain_union(xs):
    """On a grid of whole seconds, which all test spans keep to."""
    return [(float(s), float(e)) for s, e in runs(cells(xs))]


def plain_subtract(regions, covers, least):
    out, covered = [], cells(covers)
    for r0, r1 in regions:
        left = [(float(s), float(e)) for s, e in runs([not c and r0 <= x < r1 for x, c in enumerate(covered)])]
        out += [g for g in left if g == (r0, r1) or g[1] - g[0] >= least]
    return out


span = st.tuples(st.integers(0, 40), st.integers(1, 15)).map(lambda x: (float(x[0]), float(x[0] + x[1])))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.lists(span, min_size=1, max_size=4, unique_by=lambda s: s[0]), st.lists(span, max_size=8)), min_size=5, max_size=15))
def test_subtract_property(spark, groups):
    regions = frame(spark, [(k, *r) for k, (rs, _) in enumerate(groups) for r in rs])
    covers = frame(spark, [(k, *c) for k, (_, cs) in enumerate(groups) for c in cs])
    want = sorted((k, *g) for k, (rs, cs) in enumerate(groups) for g in plain_subtract(rs, cs, 3.0))
    assert spans(intervals.subtract(regions, covers, K, 3.0, width=5.0)) == want
    assert spans(intervals.union(covers, K)) == sorted((k, *u) for k, (_, cs) in enumerate(groups) for u in plain_union(cs))
    pairs = intervals.overlapping(regions, covers, K, width=5.0)
    got = sorted((r.k, r.start, r.end, r.r_start, r.r_end) for r in pairs.collect())
    assert got == sorted((k, *r, *c) for k, (rs, cs) in enumerate(groups) for r in rs for c in cs if min(r[1], c[1]) > max(r[0], c[0]))
