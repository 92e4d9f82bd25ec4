"""Character spans of regular expressions, with built-in columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
SPAN = "array<struct<start:int,end:int,hit:string>>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once although a lambda inside ``body`` uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points, end exclusive.

    ``split`` by the pattern gives the gaps between matches, so adding up lengths gives every place.
    """
    return let(cut(text, pattern), lambda x: between(x["gaps"], x["hits"]))


def cut(text: Column, pattern: str) -> Column:
    """struct<gaps, hits>: the matches of a pattern and the text around them, one gap more than matches; to be used through ``let``, since each part reads the text."""
    return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))


def between(gaps: Column, hits: Column) -> Column:
    """The ``spans`` of matches from the text between them."""
    pairs = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)),
        hits,
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")),
    )
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["hit"])
        one = F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("hit")))
        return F.struct(b.alias("at"), F.concat(acc["out"], one).alias("out"))

    # two levels, so that appending stays cheap for texts with very many matches
    def chunks(all_pairs: Column) -> Column:
        starts = F.when(F.size(all_pairs) > 0, F.sequence(F.lit(1), F.size(all_pairs), F.lit(CHUNK)))
        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.aggregate(F.slice(all_pairs, i, F.lit(CHUNK)), first, step)
        )

    parts = let(pairs, chunks)

    def shift(acc: Column, part: Column) -> Column:
        moved = F.transform(
            part["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["hit"].alias("hit"))
        )
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.coalesce(F.aggregate(parts, first, shift, lambda acc: F.flatten(acc["out"])), empty)


def places(found: Column) -> Column:
    """The spans without their text."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def written(found: Column, kind: str) -> Column:
    """kind:start:end of each span."""
    return F.transform(found, lambda s: F.concat(F.lit(kind + ":"), s["start"], F.lit(":"), s["end"]))
