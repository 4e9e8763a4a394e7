"""Text functions whose rules differ from Spark's built-in ones."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_like(column: Column, pattern: str) -> Column:
    """LIKE without regard to the case of A-Z, with % and _ as wild cards and no escape character."""
    fold = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in pattern)
    escape = next(c for c in "\x01\x02\x03\x04\x05\x06\x07" + string.punctuation if c not in low)
    return F.like(fold(column), F.lit(low), F.lit(escape))


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def normal_path(path: Column) -> Column:
    """A relative or absolute path without empty, `.` and resolvable `..` parts; nothing left is `.`."""
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (
            F.when((part == "") | (part == "."), done)
            .when((part == "..") & up, F.slice(done, F.lit(1), F.size(done) - 1))
            .when((part == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    lead = F.when(path.startswith("//") & ~path.startswith("///"), "//").when(rooted, "/").otherwise("")
    whole = F.concat(lead, F.array_join(parts, "/"))
    return F.when(whole == "", ".").otherwise(whole)
