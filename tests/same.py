"""Comparison of a DataFrame with SQL."""

from __future__ import annotations

from collections import Counter


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in got.fetchall())
    have = Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert have == want
