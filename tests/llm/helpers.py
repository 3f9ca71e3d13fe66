"""Small documents with everything that may be odd in them, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Extra columns whose names operators use inside.
CLASH = ("rep", "bucket", "comp", "keys", "node", "root", "mark", "starts", "runs", "part", "salt", "word", "cls", "row", "rank", "score", "piece", "length", "start", "held_out", "component_id", "block", "other", "sha", "x", "y", "a", "b", "n", "first", "many", "gone", "mark_", "leak_id", "cut_id", "cut_text", "kept", "_gone", "_id", "_kept", "m", "w", "own", "shared", "at", "depth", "total", "both", "shingles", "s", "side", "mine", "plan", "extra")


def words(text: str | None, fold: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return WORD.findall(raw.translate(LOWER) if fold else raw)


def frame(spark, rows: list[tuple], key: str = "doc_id", value: str = "text"):
    """``rows`` (id, text) with extra columns of clashing names, null in places."""
    schema = f"{key} long, {value} string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH if c not in (key, value))
    extra = [None if i % 2 else "z" for i, c in enumerate(CLASH) if c not in (key, value)]
    return spark.createDataFrame([(i, t, None, "s", None, *extra) for i, t in rows], schema)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), vocabulary)}" for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    out = text.split(" ")
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def odd(rng: random.Random) -> list[tuple]:
    """Nulls, blanks, short, repeated, and very long texts; a row without id and a repeated row."""
    long = prose(rng, 30_000, 5000)
    same = prose(rng, 80)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (6, same), (6, same), (7, long), (8, long + " end"), (None, same), (None, None), (9, "x" * 50_000), (10, "É é 日本   ß ﬁ 🙂"), (11, "A b C d"), (12, "a B c D")]
