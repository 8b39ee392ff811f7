"""URNs ``urn:cts:<namespace>:<author>.<work>.<edition>:<passage>`` and passages of citation strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from citeloom.functions.arrays import let


def parse(urn: Column) -> Column:
    """struct<namespace, author, work, edition, passage>; null unless the urn has a namespace and an author.

    ``work`` is author and work joined, as identifiers are only unique so; missing parts are null.
    """
    text = lambda c: F.when(c != "", c)

    def parts(part: Column, dotted: Column) -> Column:
        author, work = text(F.get(dotted, F.lit(0))), text(F.get(dotted, F.lit(1)))
        fields = F.struct(
            text(F.get(part, F.lit(2))).alias("namespace"),
            author.alias("author"),
            F.when(work.isNotNull(), F.concat(author, F.lit("."), work)).alias("work"),
            text(F.get(dotted, F.lit(2))).alias("edition"),
            text(F.get(part, F.lit(4))).alias("passage"),
        )
        return F.when((F.get(part, F.lit(0)) == "urn") & (F.get(part, F.lit(1)) == "cts") & text(F.get(part, F.lit(2))).isNotNull() & author.isNotNull(), fields)

    # Split once, however many parts are named: a filter would otherwise split anew for each.
    return let(F.split(urn, ":"), lambda part: let(F.split(F.get(part, F.lit(3)), "\\."), lambda dotted: parts(part, dotted)))


def passage(citation: Column) -> Column:
    """The first place that a citation string names: numbers joined by dots, or a page, a letter and
    a line, if there is one; a range gives its start. '' if there is none. See functions.citations for whole citations."""
    found = F.regexp_extract(citation, r"([0-9]+(?:\.[0-9]+)*(?: ?[a-e](?:[0-9]+)?\b)?)", 1)
    return F.replace(found, F.lit(" "), F.lit(""))


def edition(quote: Column) -> Column:
    """``grc`` for a quote in Greek script, else ``lat``."""
    return F.when(quote.rlike(r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"), "grc").otherwise("lat")


def assemble(namespace: Column, work: Column, quote: Column, citation: Column, series: str = "ed") -> Column:
    """A urn from its parts and the name of a series of editions; without a passage it ends after the edition, without a work it is null."""
    head = F.concat(F.lit("urn:cts:"), namespace, F.lit(":"), work, F.lit(f".{series}-"), edition(F.coalesce(quote, F.lit(""))), F.lit("1"))
    place = passage(F.coalesce(citation, F.lit("")))
    return F.when(place == "", head).otherwise(F.concat(head, F.lit(":"), place))
