"""Quality rules for recognised text: transcripts of audio and text read from images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import strip

LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
# Fixed values of the rules.
MIN_LATIN_SHARE = 0.5
SCREENSHOT_LINES, SCREENSHOT_CHARS = 8, 120
UNCLEAR_LANGUAGES, UNCLEAR_BELOW = ["nn", "no", ""], 0.6
NOISE_BELOW, NOTE_BELOW, MIN_WORD_CHARS = 0.45, 0.5, 3


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def latin_letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, r"\P{L}+", ""), r"[^\p{IsLatin}]+", ""))


def latin_share(text: Column) -> Column:
    """Share of Latin among all letters, NULL without letters."""
    return F.try_divide(latin_letter_count(text), letter_count(text))


def is_text_dominant(text: Column, lines: Column) -> Column:
    share = F.coalesce(latin_share(F.coalesce(text, F.lit(""))), F.lit(0.0))
    return (F.coalesce(lines, F.lit(0)) >= 2) & (share >= MIN_LATIN_SHARE)


def trimmed_line_chars(text: Column) -> Column:
    """Characters of all lines after trimming each of them."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_ENDS)
    return F.aggregate(lines, F.lit(0), lambda acc, line: acc + F.length(strip(line)))


def is_screenshot(text: Column, lines: Column) -> Column:
    return (is_text_dominant(text, lines) & (lines >= SCREENSHOT_LINES)
            & (trimmed_line_chars(text) >= SCREENSHOT_CHARS))


def transcript_verdict(text: Column, lang: Column, prob: Column) -> Column:
    """struct<text, note>: the kept text and the reason for dropping or doubting it."""
    body, tongue = F.coalesce(text, F.lit("")), F.coalesce(lang, F.lit(""))
    percent = F.format_string("%.0f%%", prob * 100)
    word_chars = F.length(F.regexp_replace(body, r"[^A-Za-zÀ-ÿ0-9]+", ""))

    def drop(reason: Column | str) -> Column:
        return _verdict(F.lit(""), F.lit(reason) if isinstance(reason, str) else reason)

    return (
        F.when(body == "", drop("empty"))
        .when(tongue.isin(UNCLEAR_LANGUAGES) & (prob < UNCLEAR_BELOW),
              drop("no clear language (hallucination)"))
        .when(prob < NOISE_BELOW,
              drop(F.concat(F.lit("uncertain ("), tongue, F.lit(" "), percent, F.lit(", likely noise)"))))
        .when(latin_share(body) < MIN_LATIN_SHARE, drop("non-latin characters (hallucination)"))
        .when(word_chars < MIN_WORD_CHARS, drop("too short / unintelligible"))
        .when(prob < NOTE_BELOW,
              _verdict(body, F.concat(F.lit("uncertain recognition (language "), tongue, F.lit(", "),
                                      percent, F.lit(")"))))
        .otherwise(_verdict(body, F.lit(None).cast("string")))
    )


def _verdict(text: Column, note: Column) -> Column:
    return F.struct(text.alias("text"), note.alias("note"))
