"""Places of regular-expression matches as built-in Spark expressions. Work is close to linear in texts and matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,text:string>>"
IN_CONTEXT = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
#: Elements of an array that are appended to one another at a time, and characters of a text that are cut at a time.
STEP, BLOCK = 256, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(array: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """An output for each element, in order; step maps (state, element) to (next state, output of type array<kind>).

    Appending copies what is there, so outputs are gathered STEP at a time and these parts are joined at the end.
    """
    nothing = F.array().cast(f"array<{kind}>")
    empty = F.filter(F.array(F.struct(state.alias("state"), nothing.alias("out"))), lambda x: F.lit(False))

    def over(own: Column) -> Column:
        n = F.size(own)

        def one(acc: Column, i: Column) -> Column:
            after, out = step(acc["state"], F.get(own, i))
            return F.struct(after.alias("state"), F.array_append(acc["out"], out).alias("out"))

        def part(acc: Column, at: Column) -> Column:
            before = F.coalesce(F.try_element_at(acc, F.lit(-1))["state"], state)
            places = F.sequence(at, F.least(at + STEP, n) - 1)
            return F.array_append(acc, F.aggregate(places, F.struct(before.alias("state"), nothing.alias("out")), one))

        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(F.aggregate(starts, empty, part), lambda x: x["out"]))

    return let(array, over)


def matches(text: Column, pattern: str, maybe: Column | None = None, context: int = 0) -> Column:
    """Array of (start, end, text) of the pattern's leftmost non-overlapping matches, in code points, end exclusive.

    Splitting gives what lies between matches, so lengths add up to their places. ``maybe`` is a cheap test that is
    false only where there is no match. With ``context`` there is also ``before``, up to so many characters behind the
    match before, with that one's last character, and ``after``, the next character.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    if context:
        none = F.array(F.lit(None).cast("string"))
        pairs = F.arrays_zip(found.alias("hit"), between.alias("gap"), F.concat(none, found).alias("last"), F.slice(between, 2, 2**31 - 1).alias("rest"), F.slice(found, 2, 2**31 - 1).alias("next"))
    else:
        pairs = F.arrays_zip(found.alias("hit"), between.alias("gap"))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        told = [start.alias("start"), end.alias("end"), x["hit"].alias("text")]
        if context:
            last, after = F.right(F.coalesce(x["last"], F.lit("")), F.lit(1)), F.left(F.coalesce(x["next"], F.lit("")), F.lit(1))
            told.append(F.right(F.concat(last, x["gap"]), F.lit(context)).alias("before"))
            told.append(F.left(F.concat(F.coalesce(x["rest"], F.lit("")), after), F.lit(1)).alias("after"))
        return end, F.struct(*told)

    kind = IN_CONTEXT if context else MATCHES
    out = running(pairs, F.lit(0), step, kind.removeprefix("array<").removesuffix(">"))
    return F.when(text.rlike(pattern) if maybe is None else maybe, out).otherwise(F.array().cast(kind))


def blocks(text: Column) -> Column:
    """The text in parts of BLOCK characters, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """What substr(text, start + 1, length) gives, from the text's blocks: it reads no other blocks."""
    first = F.floor(start / BLOCK).cast("int")
    n = F.floor((start + length) / BLOCK).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(parts, first + 1, n), ""), (start % BLOCK + 1).cast("int"), length.cast("int"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
