"""Untrusted text fenced for a prompt, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that look like ASCII ones, each above the one it stands for, and
# characters that show nothing.
LOOKALIKES = "АВЕКМНОРСТУХаеорсухіԁͼοΑΒΕΚΜΝΟΡΤΧ＜＞：／"
STAND_FOR = "ABEKMHOPCTYXaeopcyxidsoABEKMNOPTX<>:/"
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad\u034f\u061c\u180e"
# Fixed values too: a marker's word, the most characters of its body, and what is put in a marker's place.
WORD, BODY, REDACTED = "untrusted", 64, "[marker removed]"
PREFIX = "tidemark-fence:"


def fold(text: Column) -> Column:
    """Look-alikes replaced one for one, invisible characters deleted."""
    return F.translate(text, LOOKALIKES + INVISIBLE, STAND_FOR)


def _like(c: str) -> str:
    """Class of the characters that fold to ``c`` in either case."""
    same = {c.lower(), c.upper()} | {a for a, b in zip(LOOKALIKES, STAND_FOR, strict=True) if b.lower() == c.lower()}
    return "[" + "".join(sorted(map(re.escape, same))) + "]"


def marker_pattern(flags: str = "(?iuU)") -> str:
    """A marker as folding would read it: invisible characters may stand between any two of its characters.

    So the original text is matched directly, and only the marker's own span is replaced.
    """
    gap = f"[{INVISIBLE}]*"
    space = rf"(?:\s{gap})*"
    chars = lambda s: gap.join(map(_like, s))
    body = f"(?:[^{_like('>')[1:-1]}{INVISIBLE}]{gap}){{0,{BODY}}}"
    return f"{flags}{chars('<<<')}{gap}{space}(?:{_like('/')}{gap})?{space}{chars(WORD)}{gap}{space}{_like(':')}{gap}{body}{chars('>>>')}"


def neutralise(text: Column) -> Column:
    """Text with everything marker-shaped replaced; the rest stays as it is."""
    return F.regexp_replace(text, F.lit(marker_pattern()), F.lit(REDACTED))


def token(request_id: Column) -> Column:
    """What marks this request's fence; a document written earlier cannot hold it."""
    return F.substring(F.sha2(F.concat(F.lit(PREFIX), request_id).cast("binary"), 256), 1, 16)


def opener(request_id: Column) -> Column:
    return F.concat(F.lit("<<<untrusted:"), token(request_id), F.lit(">>>"))


def closer(request_id: Column) -> Column:
    return F.concat(F.lit("<<</untrusted:"), token(request_id), F.lit(">>>"))


def wrap(request_id: Column, fields: dict[str, Column]) -> Column:
    """Fields fenced, one a line; names and values are neutralised."""
    lines = [F.concat(neutralise(F.lit(name)), F.lit(": "), neutralise(value)) for name, value in fields.items()]
    return F.concat_ws("\n", opener(request_id), *lines, closer(request_id))
