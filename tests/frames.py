"""Comparison of results."""


def same_rows(got, want):
    """Equal as bags, numbers to four places (2e-4 at a rounding border); both pandas frames."""
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "~"
        if isinstance(v, bool) or str(v) in ("True", "False"):
            return str(v)
        try:
            return f"{float(v):.4f}".replace("-0.0000", "0.0000")
        except (TypeError, ValueError):
            return str(v)

    rows = [sorted(tuple(plain(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False)) for f in (got, want)]
    different = [(a, b) for a, b in zip(*rows) if a != b]
    for a, b in different:  # values at a rounding border
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) < 2e-4, (a, b)
