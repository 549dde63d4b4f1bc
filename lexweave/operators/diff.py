"""Highlight spans of two texts, and paragraph assembly of extracted lines."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.functions import pandas_udf

SPANS = K.ArrayType(K.StructType([K.StructField("s", K.IntegerType()), K.StructField("e", K.IntegerType()), K.StructField("t", K.StringType())]))
END = ".!?…:;"


@pandas_udf(K.StructType([K.StructField("original", SPANS), K.StructField("corrected", SPANS)]))
def word_diff(original: pd.Series, corrected: pd.Series) -> pd.DataFrame:
    """Spans that differ: words first, then the characters of words that were replaced.  Offsets count single spaces between words."""
    out = [_spans(a or "", b or "") for a, b in zip(original, corrected)]
    return pd.DataFrame({"original": [[dict(zip("set", x)) for x in o] for o, _ in out], "corrected": [[dict(zip("set", x)) for x in c] for _, c in out]})


def _starts(words: list[str]) -> list[int]:
    at, out = 0, []
    for w in words:
        out.append(at)
        at += len(w) + 1
    return [*out, max(0, at - 1)]


def _spans(a: str, b: str) -> tuple[list, list]:
    x, y = a.split(), b.split()
    sx, sy = _starts(x), _starts(y)
    left, right = [], []
    for op, i, j, p, q in difflib.SequenceMatcher(None, x, y).get_opcodes():
        if op == "replace":
            for kind, u, v, w, z in difflib.SequenceMatcher(None, " ".join(x[i:j]), " ".join(y[p:q])).get_opcodes():
                if kind != "equal" and v > u:
                    left.append((sx[i] + u, sx[i] + v, kind))
                if kind != "equal" and z > w:
                    right.append((sy[p] + w, sy[p] + z, kind))
        elif op == "delete":
            left.append((sx[i], sx[j - 1] + len(x[j - 1]), op))
        elif op == "insert":
            right.append((sy[p], sy[q - 1] + len(y[q - 1]), op))
    return left, right


def paragraphs(lines: Column) -> Column:
    """Lines of a document joined to paragraphs: a blank line ends one, a hyphen at a line's end is taken out, and a line that
    ends a sentence ends the paragraph if the next one begins with a capital, a digit or a bullet."""

    def step(acc: Column, line: Column) -> Column:
        line = F.trim(line)
        last = F.element_at(acc, -1)
        opens = line.rlike(r"^[\p{Lu}\p{Nd}•–—-]")
        closed = (last == "") | (F.contains(F.lit(END), F.substring(last, -1, 1)) & opens)
        glued = F.when(last.endswith("-"), F.concat(F.regexp_replace(last, "-$", ""), line)).otherwise(F.concat(last, F.lit(" "), line))
        rest = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(line == "", F.when(last == "", acc).otherwise(F.concat(acc, F.array(F.lit(""))))).when(closed, F.concat(F.when(last == "", rest).otherwise(acc), F.array(line))).otherwise(F.concat(rest, F.array(glued)))

    return F.filter(F.aggregate(lines, F.array(F.lit("")), step), lambda p: p != "")
