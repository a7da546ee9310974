"""Providers of histories that fail now and then."""

import datetime
import pathlib
from collections import Counter

tries: Counter = Counter()


def days(options, code, first, last):
    """Ten days of each code; ``bad`` never comes, ``flaky`` at the third attempt only, ``empty`` has none; the file at the option ``down`` fails all."""
    tries[code] += 1
    if code == "bad" or (code == "flaky" and tries[code] % 3) or ("down" in options and pathlib.Path(options["down"]).exists()):
        raise OSError("no answer")
    start = datetime.date(2024, 1, 1)
    for k in range(0 if code == "empty" else 10):
        d = start + datetime.timedelta(k)
        if (first is None or d >= first) and (last is None or d <= last):
            yield d, 1.0, 2.0, 0.5, float(k), 10.0


def wide(options, code, first, last):
    """What was asked for, as one day."""
    yield first or datetime.date(1900, 1, 1), 0.0, 0.0, 0.0, float((last or datetime.date(2100, 1, 1)).toordinal()), 0.0
