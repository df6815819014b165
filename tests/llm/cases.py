"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""
from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use inside or return
    + [T.StructField(x, T.StringType()) for x in ("score", "kept", "size", "key", "block", "fp", "h", "slice", "run", "weight")]
)


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgiklmnorstué") for _ in range(1 + (k * 7) % 9)) + str(k % 3) * (k % 11 == 0) for k in (rng.randrange(vocabulary) for _ in range(n))]


def texts() -> list[tuple[int | None, str | None]]:
    base = [" ".join(words(s, 60 + s)) for s in range(12)]
    passage = " ".join(words(99, 40))
    line = "A line that stands in many documents, é!"
    out: list[tuple[int | None, str | None]] = [
        (1, base[0]), (2, base[0]), (3, base[0] + " x"), (4, "  " + base[0].replace(" ", "\t\n ") + " "),
        (5, base[1] + " " + passage), (6, passage + " " + base[2]), (7, base[3] + "\n" + passage + "\n" + base[4]),
        (8, line + "\n" + base[5]), (9, base[6] + "\n  " + line.upper().replace("É", "é") + " \n" + line), (10, line), (11, line + "\n"),
        (12, None), (13, ""), (14, " \t\n"), (15, "1234 !!"), (16, "one"), (17, "one two three"), (18, "ONE two Three"),
        (19, " ".join(words(7, 20000))), (20, "\n\n\n"), (None, base[7]), (None, base[0]), (None, None), (21, base[8] + "\x0b\x0c" + base[9]),
        (22, base[10]), (22, base[10]), (-5, base[1]), (23, "中文 text ünï 😀 " * 5), (24, " ".join(["same"] * 50)), (25, " ".join(["same"] * 51)),
    ]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["b", "a", None, "hot", "hot", "hot"]
    data = [(i, t, ["en", "fr", None][k % 3], sources[k % 6], None if t is None else len(t), *["x"] * 10) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def ordered(ids):
    """Identifiers with null last."""
    return sorted(ids, key=lambda i: (i is None, i or 0))
