"""Values that several test modules use."""

import datetime as dt

FOLDER = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def seconds(n):
    return T0 + dt.timedelta(seconds=n)
