"""Label alphabet of the sequence labelling operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The labels in the order of their ids; IGNORED marks positions that carry no label.
LABELS = ("O", "B-BIBL", "I-BIBL", "B-QUOTE", "I-QUOTE", "B-CIT", "I-CIT")
IGNORED = -100


def label_id(label: Column) -> Column:
    """0..6, null for an unknown label."""
    at = F.array_position(F.array(*map(F.lit, LABELS)), label)
    return F.when(at > 0, (at - 1).cast("int"))


def id_label(i: Column) -> Column:
    return F.get(F.array(*map(F.lit, LABELS)), i.cast("int"))


def argmax(scores: Column) -> Column:
    """Position of the highest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def prefix(label: Column) -> Column:
    """B, I or O."""
    return F.substring(label, 1, 1)


def kind(label: Column) -> Column:
    """BIBL, QUOTE, CIT, or '' for O."""
    return F.substring(label, 3, 16)


def fit_length(values: Column, length: int, pad) -> Column:
    """The first ``length`` values, filled up with pad."""
    cut = F.slice(values, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def attention(values: Column, length: int) -> Column:
    """1 for each value that fit_length keeps, 0 for padding."""
    n = F.least(F.size(values), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
