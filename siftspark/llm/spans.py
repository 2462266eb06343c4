"""Matches of a pattern in a text and their places, with DataFrame functions only.

One walk of the matcher sets marks around the matches, and a split at the marks
gives what lies between them; places are the sums of the lengths. They add up in
blocks of matches, so that the work grows with the text and not with its square.
"""

from __future__ import annotations

MATCHES = 256
_MARK, _OTHER = "\x01", "\x02"


def matches(pattern: str, text: str = "text") -> str:
    """SQL for array<struct<s: int, h: string>>: the start (in code points) and the text of all matches, leftmost first, none overlapping.

    A mark in the text itself counts as another control; no pattern here has either in a class."""
    parts = f"split(regexp_replace(translate({text}, '{_MARK}', '{_OTHER}'), r'{pattern}', '{_MARK}$0{_MARK}'), '{_MARK}', -1)"
    none = "cast(array() AS array<struct<s: int, h: string>>)"
    block = f"""aggregate(sequence(b, least(b + {MATCHES}, size(z) div 2) - 1), struct(0 AS pos, {none} AS out),
        (a, i) -> struct(a.pos + length(z[2 * i]) + length(z[2 * i + 1]) AS pos, concat(a.out, array(struct(a.pos + length(z[2 * i]) AS s, z[2 * i + 1] AS h))) AS out))"""
    blocks = f"CASE WHEN size(z) > 1 THEN transform(sequence(0, size(z) div 2 - 1, {MATCHES}), b -> {block}) ELSE cast(array() AS array<struct<pos: int, out: array<struct<s: int, h: string>>>>) END"
    starts = "aggregate(y, struct(0 AS pos, cast(array() AS array<int>) AS out), (a, x) -> struct(a.pos + x.pos AS pos, concat(a.out, array(a.pos)) AS out), a -> a.out)"
    added = f"flatten(transform(arrays_zip(y, {starts}), p -> transform(p.y.out, x -> struct(x.s + p.`1` AS s, x.h AS h))))"
    return f"transform(transform(array({parts}), z -> {blocks}), y -> {added})[0]"
