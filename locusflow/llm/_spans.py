"""Spans found by regular expressions, as DataFrame expressions.

Spark returns the matches of a pattern but not where they are. Here every match is put between marks, the text is
split at the marks, and the lengths of the parts, added up, give the positions. All patterns used here are
possessive and start at the edge of a run, so that neither long runs nor many repetitions cost more than
linear time or a deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm._common import fresh

_BLOCK = 128
#: A noncharacter, which no proper text holds.
_MARK = "\uffff"


def with_matches(df: DataFrame, text: str, pattern: str, out: str, sign: str) -> DataFrame:
    """Add ``out``: ``array<struct<start, end, m, before, after>>`` of the leftmost non-overlapping matches.

    Offsets are code points, ``end`` exclusive; ``before`` and ``after`` are the neighbouring texts up to the next
    match. A null or empty text has an empty array. ``sign`` is a cheap pattern that every text with a match has: other texts
    are not searched.
    """
    marked, steps, sums = fresh(df, f"{out}_marked", f"{out}_steps", f"{out}_sums")
    body = F.coalesce(F.col(text), F.lit(""))
    # pieces and matches in turn; a text that holds the mark itself takes the slower way
    fast = F.split(F.regexp_replace(body, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    pieces, found = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    slow = F.flatten(F.transform(pieces, lambda x, i: F.when(i < F.size(found), F.array(x, F.get(found, i))).otherwise(F.array(x))))
    has = F.contains(body, F.lit(sign)) if len(sign) == 1 else body.rlike(sign)
    df = df.withColumn(marked, F.when(~has, F.array(body)).when(F.contains(body, F.lit(_MARK)), slow).otherwise(fast))
    df = df.withColumn(
        steps,
        F.expr(
            f"if(size({marked}) > 2, transform(sequence(0, size({marked}) div 2 - 1), "
            f"i -> char_length({marked}[2 * i]) + char_length({marked}[2 * i + 1])), cast(array() as array<int>))"
        ),
    )
    # running totals by blocks: a fold that appends to an array would copy it for every match
    df = df.withColumn(
        sums,
        F.expr(
            f"transform(sequence(0, greatest(size({steps}) - 1, 0) div {_BLOCK}), "
            f"q -> aggregate(slice({steps}, q * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))"
        ),
    )
    df = df.withColumn(
        sums,
        F.expr(f"transform({sums}, (x, q) -> aggregate(slice({sums}, 1, q), 0, (a, y) -> a + y))"),
    )
    spans = F.expr(
        f"transform({steps}, (s, i) -> named_struct('end', {sums}[i div {_BLOCK}] + "
        f"aggregate(slice({steps}, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK} + 1), 0, (a, x) -> a + x), "
        f"'m', {marked}[2 * i + 1], 'before', {marked}[2 * i], 'after', {marked}[2 * i + 2]))"
    )
    df = df.withColumn(out, spans)
    df = df.withColumn(
        out,
        F.expr(f"transform({out}, x -> named_struct('start', x.end - char_length(x.m), 'end', x.end, 'm', x.m, 'before', x.before, 'after', x.after))"),
    )
    return df.drop(marked, steps, sums)


def labelled(spans: str, rank: int, kind: str, keep: str = "true") -> Column:
    """The spans ``x`` for which ``keep`` holds as ``array<struct<start, rank, end, kind>>``."""
    return F.expr(
        f"transform(filter({spans}, x -> {keep}), x -> named_struct('start', x.start, 'rank', {rank}, 'end', x.end, 'kind', '{kind}'))"
    )


def listing(spans: Column) -> Column:
    """``kind:start:end`` by start and then rank, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def digest(listed: Column) -> Column:
    return F.sha2(listed.cast("binary"), 256)
