"""Cleaning of section texts as expressions: lines or sentences kept in order within limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import text as T

# Where a text of one or two lines is split, lines of a page's footer, lines of digits.
LINES = r"[\r\n]+"
SENTENCES = r"(?U)(?<=[。！？!?])\s+|(?<=[.;])\s+"
SENTENCES_BEFORE_CAPITALS = r"(?U)(?<=[。！？!?])\s+|(?<=[.;])\s+(?=[A-Z])"
FOOTER = r"(?i)^\d{3,5}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b"
DIGITS_ONLY = r"^[\d\s,.;:/\\\-_%#]+$"


@dataclass(frozen=True)
class Cleaner:
    """least: characters of a line; key: characters that tell lines apart; rest: of the line that
    overflows, more than so many must be left to be kept; drop: lines never kept; empty: texts of
    which nothing is left, where no line is."""

    sentences: str
    least: int
    key: int
    rest: int
    drop: Callable[[Column], Column] | None = None
    empty: Callable[[Column], Column] | None = None

    def __call__(self, text: Column, most_lines: int = 10, most_chars: int = 1800) -> Column:
        return T.bind(F.coalesce(text, F.lit("")), lambda raw: self._of(raw, most_lines, most_chars))

    def _of(self, raw: Column, most_lines: int, most_chars: int) -> Column:
        by_line = F.split(raw, LINES)
        parts = T.bind(by_line, lambda x: F.when(F.size(x) <= 2, F.split(raw, self.sentences)).otherwise(x))
        # Each line is squashed once; too short ones go before the fold looks at any.
        parts = F.filter(F.transform(parts, T.squash), lambda line: F.length(line) >= self.least)
        none = F.array().cast("array<string>")
        start = F.struct(none.alias("out"), none.alias("seen"), F.lit(0).alias("used"), F.lit(False).alias("full"))

        def step(a: Column, line: Column) -> Column:
            key, left = F.substring(line, 1, self.key), F.lit(most_chars) - a["used"]
            skip = F.array_contains(a["seen"], key)
            if self.drop is not None:
                skip = skip | self.drop(line)
            cut = F.when(left > self.rest, F.array(F.concat(F.rtrim(line.substr(F.lit(1), left)), F.lit("...")))).otherwise(none)
            over = F.struct(F.concat(a["out"], cut).alias("out"), a["seen"].alias("seen"), a["used"].alias("used"), F.lit(True).alias("full"))
            kept = F.struct(F.concat(a["out"], F.array(line)).alias("out"), F.concat(a["seen"], F.array(key)).alias("seen"), (a["used"] + F.length(line)).alias("used"), (F.size(a["out"]) + 1 >= most_lines).alias("full"))
            return F.when(a["full"] | skip, a).when(F.length(line) > left, over).otherwise(kept)

        lines = F.aggregate(parts, start, step, lambda a: a["out"])

        def chosen(x: Column) -> Column:
            rest = T.clip(x["whole"], most_chars) if self.empty is None else F.when(self.empty(x["whole"]), F.lit("")).otherwise(T.clip(x["whole"], most_chars))
            return F.when(x["whole"] == "", F.lit("")).when(x["found"] != "", x["found"]).otherwise(rest)

        return T.bind(F.struct(T.squash(raw).alias("whole"), F.array_join(lines, "\n\n").alias("found")), chosen)


def _noise(line: Column) -> Column:
    return T.low_information_line(line) | T.meta_noise_line(line)


def _soft_noise(line: Column) -> Column:
    return F.regexp_like(line, F.lit(FOOTER)) | F.regexp_like(line, F.lit(DIGITS_ONLY)) | T.meta_noise_line(line)


#: Without lines that say little or are boilerplate.
strict = Cleaner(SENTENCES_BEFORE_CAPITALS, 20, 90, 60, _noise, _noise)
#: Keeps lines that a scanner has garbled.
relaxed = Cleaner(SENTENCES, 14, 120, 40, _soft_noise, T.meta_noise_line)
#: Keeps nearly all there is (F20); 40 lines and 12,000 characters by default in sections.
extractive = Cleaner(SENTENCES, 4, 180, 30)


def summary_lines(lines: Column, most: int = 3, most_line: int = 180, most_chars: int = 520) -> Column:
    """The first lines of ten characters or more, each cut at 180, within 520 in all (F21): the
    line that overflows ends them. A null array: none."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(a: Column, item: Column) -> Column:
        line = T.squash(item)
        cut = F.when(F.length(line) > most_line, F.concat(F.rtrim(F.substring(line, 1, most_line)), F.lit("..."))).otherwise(line)
        ended = F.struct(a["out"].alias("out"), a["used"].alias("used"), F.lit(True).alias("full"))
        kept = F.struct(F.concat(a["out"], F.array(cut)).alias("out"), (a["used"] + F.length(cut)).alias("used"), (F.size(a["out"]) + 1 >= most).alias("full"))
        return F.when(a["full"] | (F.length(line) < 10), a).when(a["used"] + F.length(cut) > most_chars, ended).otherwise(kept)

    return F.aggregate(F.coalesce(lines, none), start, step, lambda a: a["out"])
