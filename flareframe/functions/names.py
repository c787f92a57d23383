"""Times, keys and stems carried in file names, and other name handling."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file-name layouts in use.
DOTTED_STAMP = r"\.(\d{8})_(\d{6})_"
STAMP_PATTERNS = [
    r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[_-](\d{2})[-_](\d{2})[-_](\d{2})",
    r"(\d{4})(\d{2})(\d{2})[_-](\d{2})(\d{2})(\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})[T_](\d{2})[:\-](\d{2})[:\-](\d{2})",
    r"(\d{4})-(\d{2})-(\d{2})[ _](\d{2}):(\d{2}):(\d{2})",
]


def _stamp(text: Column) -> Column:
    """'yyyyMMddHHmmss' to timestamp_ntz, null when malformed."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def file_time(path: Column) -> Column:
    """Time from names holding '.yyyyMMdd_HHmmss_'."""
    return _stamp(F.concat(F.regexp_extract(path, DOTTED_STAMP, 1),
                           F.regexp_extract(path, DOTTED_STAMP, 2)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_time_any(path: Column) -> Column:
    """Time from the base name; the first matching layout wins."""
    name = base_name(path)
    found = F.lit(None).cast("string")
    for p in reversed(STAMP_PATTERNS):
        digits = F.concat(*[F.regexp_extract(name, p, i) for i in range(1, 7)])
        found = F.when(F.regexp_like(name, F.lit(p)), digits).otherwise(found)
    return _stamp(found)


def file_key(path: Column) -> Column:
    """Leading entity number of names like '1087_...' or 'AR1087_...'."""
    head = F.regexp_replace(F.get(F.split(base_name(path), "_"), F.lit(0)), "^AR", "")
    return F.when(F.regexp_like(head, F.lit(r"^\d+$")), head.cast("bigint"))


def file_key_time(path: Column) -> Column:
    """struct(ar, ts) from names like '1087_..._20100718_193600...'."""
    stamp = F.regexp_extract(path, r"(\d{8})_(\d{6})", 0)
    return F.struct(file_key(path).alias("ar"),
                    _stamp(F.regexp_replace(stamp, "_", "")).alias("ts"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def join_path(root: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), path)


def base_names(paths: Column) -> Column:
    return F.transform(paths, base_name)


def group_key(group: Column, item: Column | None = None, path: Column | None = None) -> Column:
    """Entity key; a missing one becomes a key of its own."""
    rest = [c.cast("string") for c in (item, path) if c is not None]
    return F.coalesce(group.cast("string"),
                      F.concat(F.lit("AR_MISSING::"), F.coalesce(*rest, F.lit("unknown"))))


def safe_name(col: Column) -> Column:
    return F.regexp_replace(col.cast("string"), r"[^A-Za-z0-9_]+", "_")


def series_times(start: Column, n: Column | int, every: str) -> Column:
    """The n times of a series from its start and cadence."""
    from flareframe.operators.ordered import interval
    n = F.lit(n) if isinstance(n, int) else n
    step = interval(every)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + step * i)) \
        .otherwise(F.array().cast("array<timestamp_ntz>"))


def select_features(spec: str, n: int = 29, prefix: str = "feat") -> list[str]:
    """Column names from '0,3,feat7': 0-based index if it fits, else 1-based, else a name."""
    chosen = set()
    for token in filter(None, (t.strip() for t in spec.split(","))):
        named = re.fullmatch(rf"(?i){prefix}(\d+)", token)
        if named:
            k = int(named[1])
        elif token.isdigit():
            k = int(token) + 1 if int(token) < n else int(token)
        else:
            continue
        if 1 <= k <= n:
            chosen.add(k)
    return [f"{prefix}{k}" for k in sorted(chosen)]
