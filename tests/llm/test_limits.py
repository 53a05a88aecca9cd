"""Problem 9: lengths at which fields end."""

from __future__ import annotations

from collections import Counter, defaultdict

from folioforge.llm import p9_truncation as p9


def limits(spark, lengths: dict[str, list[int]]) -> dict[str, list[int]]:
    rows = [(source, size, n) for source, sizes in lengths.items() for size, n in Counter(sizes).items()]
    out = defaultdict(list)
    for r in p9.piled_lengths(spark.createDataFrame(rows, "source string, size int, n long")).collect():
        out[r.source].append(r["size"])
    return {k: sorted(v) for k, v in out.items()}


def test_p9_short_fields_have_limits_too(spark):
    assert limits(spark, {"a": [*range(40, 180), *[64] * 30, *[1000] * 30, *[80] * 3]}) == {"a": [64, 1000]}


def test_p9_a_sources_limits_dont_depend_on_other_sources(spark):
    small = [*range(40, 180), *[64] * 30]
    large = [(k * 7919) % 5000 + 40 for k in range(1_700_000)]
    assert limits(spark, {"small": small, "large": large}) == {"small": [64]}
