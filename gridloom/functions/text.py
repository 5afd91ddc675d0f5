"""String helpers of annotation pipelines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence frames for class prompts, and the switch between mask levels.
TEMPLATES = ("{}.", "a photo of a {}.", "This is a {}", "There is a {} in the scene")
LEVELS = {1: 3, 2: 2, 3: 0, 4: 4, 5: 1, 6: 5}


def clean_class_name(name: Column) -> Column:
    """Class names as words: commas go, plus signs become spaces, and what follows a full stop goes."""
    return F.regexp_replace(F.translate(F.regexp_replace(name, ",", ""), "+", " "), r"\..*$", "")


def prompt(name: Column, number: Column, top: int = len(TEMPLATES)) -> Column:
    """The name in one of the first ``top`` frames, chosen by ``number``."""
    frames = F.array(*(F.lit(t) for t in TEMPLATES[:top]))
    return F.replace(F.get(frames, F.pmod(number, F.lit(top)).cast("int")), F.lit("{}"), name)


def level_switch(level: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[level]


def frame_name(number: Column, width: int = 5) -> Column:
    return F.concat(F.lpad(number.cast("string"), width, "0"), F.lit(".jpg"))


def hash_text(*parts: Column | str) -> Column:
    """A fixed text for the same parts on every machine and engine: the MD5 of them joined by dashes, in hex."""
    return F.md5(F.concat_ws("-", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)).cast("binary"))


def hash_number(*parts: Column | str) -> Column:
    """A fixed number from 0 to 2^32 - 1 for the same parts: the first eight digits of ``hash_text``."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("long")
