"""Compares a query with its oracle: equal columns and equal rows, in any order."""


def plain(x):
    if isinstance(x, float):
        return 0.0 if x == 0 else round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


def rows_of(rows, order):
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(df, relation):
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    theirs = rows_of(relation.fetchall(), [list(relation.columns).index(c) for c in cols])
    assert rows_of([tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()], range(len(cols))) == theirs
