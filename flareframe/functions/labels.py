"""Event classes and class labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class order, label ids and label foldings.
SEVERITY = {"NONE": 0, "A": 1, "B": 2, "C": 3, "M": 4, "X": 5}
CLASSES = ["A", "B", "C", "M", "X"]
LABELS = ["NONE", "C", "M", "X"]
LABEL_ID = {"NONE": 0, "C": 1, "M": 2, "X": 3}
FOLD_AB = {"NONE": "NONE", "A": "NONE", "B": "NONE", "C": "C", "M": "M", "X": "X"}
TO_C_PLUS = {"NONE": "NONE", "C": "C+", "M": "C+", "X": "C+"}
TO_M_PLUS = {"NONE": "NONE", "C": "NONE", "M": "M+", "X": "M+"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def lookup(values: dict, key: Column, default=None) -> Column:
    got = F.try_element_at(literal_map(values), key)
    return got if default is None else F.coalesce(got, F.lit(default))


def class_letter(col: Column) -> Column:
    """Leading class letter of strings like ' m3.0'; null when there is none."""
    letter = F.upper(F.regexp_extract(col, r"^\s*([ABCMXabcmx])", 1))
    return F.when(letter != "", letter)


def severity(col: Column) -> Column:
    """NONE 0, A 1, B 2, C 3, M 4, X 5; null for anything else."""
    return lookup(SEVERITY, col)


def class_of_severity(sev: Column) -> Column:
    """Inverse of ``severity``; null or 0 means no event."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(c) for c in CLASSES]),
                                       F.nullif(sev.cast("int"), F.lit(0))), F.lit("NONE"))


def fold_ab(col: Column) -> Column:
    """A and B count as NONE, and so does anything unknown."""
    return lookup(FOLD_AB, col, "NONE")


def base_label(col: Column) -> Column:
    """Raw label text ('0', 'NONE', 'M3.0', ...) to one of NONE, C, M, X."""
    first = F.substring(col.cast("string"), 1, 1)
    return F.when(first.isin("C", "M", "X"), first).otherwise("NONE")


def regression_label(col: Column) -> Column:
    """Event size as text in one form: upper case without quotes or outer blanks.

    A class letter C, M or X and a number lose blanks between them and anything after; every spelling of zero,
    and null, is '0'; other text stays.
    """
    t = F.trim(F.upper(F.coalesce(col.cast("string"), F.lit("0"))), F.lit(" \t\"'"))
    letter, size = F.left(t, F.lit(1)), F.regexp_substr(F.ltrim(F.substr(t, F.lit(2))), F.lit(r"^\d+(\.\d+)?"))
    return (F.when(letter.isin("C", "M", "X") & size.isNotNull(), F.concat(letter, size))
            .when(t.try_cast("double") == 0, "0").otherwise(t))


def label_struct(col: Column) -> Column:
    """Event size text to struct(flare_type, flare_id, label, id) with M and X positive."""
    first = F.substring(regression_label(col), 1, 1)
    flare = F.when(first.isin("C", "M", "X"), first).otherwise("NONE")
    label = lookup(TO_M_PLUS, flare)
    return F.struct(flare.alias("flare_type"), lookup(LABEL_ID, flare).alias("flare_id"),
                    label.alias("label"), F.when(label == "M+", 1).otherwise(0).alias("id"))


def label_maps(scheme: str = "multi", threshold: str | None = None) -> dict[str, dict]:
    """Label, id and target maps of a labelling scheme.

    ``multi`` keeps four classes; ``binary`` with threshold ``C`` or ``M`` folds
    them into NONE and C+ or M+.
    """
    if scheme == "multi":
        label = {c: c for c in LABELS}
    elif scheme == "binary" and threshold in ("C", "M"):
        label = TO_C_PLUS if threshold == "C" else TO_M_PLUS
    else:
        raise ValueError("scheme is 'multi', or 'binary' with threshold 'C' or 'M'")
    names = list(dict.fromkeys(label.values()))
    label2id = {n: i for i, n in enumerate(names)}
    return {"label": label, "label2id": label2id, "id2label": dict(enumerate(names)),
            "target": {LABEL_ID[c]: label2id[n] for c, n in label.items()}}


def collapse(col: Column) -> Column:
    """Coarse bucket: NONE, M+ or OTHER."""
    s = F.trim(F.upper(F.coalesce(col.cast("string"), F.lit(""))))
    return (F.when(F.contains(s, F.lit("NONE")), "NONE")
            .when(s.startswith("M") | s.startswith("X")
                  | F.contains(s, F.lit("M+")) | F.contains(s, F.lit("X+")), "M+")
            .otherwise("OTHER"))


def ordinal_flags(col: Column, k: int) -> Column:
    """K-1 cumulative flags: class >= 1, ..., class >= K-1."""
    return F.array(*[(col >= i).cast("int") for i in range(1, k)])


def one_hot(col: Column, k: int) -> Column:
    return F.array(*[(col == j).cast("int") for j in range(k)])


def one_hot_each(ids: Column, k: int) -> Column:
    """One-hot vectors of every id of an array (several horizons)."""
    return F.transform(ids, lambda y: one_hot(y, k))


def agreement_letter(col: Column) -> Column:
    """Label letter for agreement tests; A, B, N and 0 are NONE, unknown is null."""
    first = F.substring(F.upper(F.trim(col)), 1, 1)
    return F.when(first.isin("C", "M", "X"), first).when(first.isin("N", "A", "B", "0"), "NONE")
