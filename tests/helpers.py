from datetime import datetime, timedelta

from tagloom.schema import TAGS

DAY0 = datetime(2024, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def tag(tid, ref, txt="X", dt=DAY0, dirty=False, type="test", sts=None, rec="{}", now=day(100)):
    return (tid, txt, ref, sts, dt, type, now if dirty else None, rec)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), TAGS)


def by(df, *keys):
    """Rows by the given columns; fails when two rows share them."""
    out = {}
    for row in df.collect():
        key = tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]
        assert key not in out, f"{key} twice"
        out[key] = row
    return out
