"""Line-first cleaning: rules per line, then a verdict on what each document lost."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REPEAT_WINDOW = 8

# Phrases of boilerplate, marks that end a sentence, marks that part menu entries.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "terms and conditions", "enable javascript", "javascript is disabled", "lorem ipsum", "powered by", "copyright ©",
    "subscribe to our newsletter", "sign up for our newsletter", "log in to comment", "click here to", "share on facebook",
    "share this article", "skip to content", "skip to main content", "back to top", "alle rechte vorbehalten",
    "tous droits réservés", "todos los derechos reservados", "datenschutzerklärung", "politique de confidentialité",
    "política de privacidad",
)
MENU_WORDS = frozenset(
    "home menu login logout register search next previous prev back top share tweet print reply more contact about faq sitemap".split()
)
ENDS = ".!?:;…。！？"
CLOSERS = "\"'”’»)]*_ \t\r"
SEPARATORS = re.compile(r"\s[|»›·•>/]\s|[|»›]|^\s*[•·»›]\s")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_WORDY = re.compile(r"[^\W\d_]")
_DOUBLED = re.compile(r"[!?#*$%&|<>]{2}")
_SHOUT = re.compile(r"[!?#*$%&|<>]{2,}(?:\s|$)")


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules and of the verdict.

    A line fails if (boilerplate) it holds a stock phrase and at most
    ``boilerplate_words`` words; (navigation) separators part it into at least
    ``menu_parts`` entries of ``menu_words`` words on average at most, or each of
    its words is a menu word; (punctuation) it has no letter, or it is shorter than
    ``short_words`` words and does not end as a sentence, or more than
    ``shout_share`` of its words end in doubled marks or symbols. A document is rejected if
    the failing lines hold more than ``max_lost`` of its word characters.
    """

    boilerplate_words: int = 16
    menu_parts: int = 3
    menu_words: float = 3.0
    short_words: int = 4
    shout_share: float = 0.3
    max_lost: float = 0.5
    min_words: int = 20
    max_repeat_pct: int = 30


def line_failure(line: str, rules: Rules) -> str | None:
    """The rule that a non-blank line fails, or None."""
    words = line.split()
    n = len(words)
    if n <= rules.boilerplate_words and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    parts = SEPARATORS.split(line)
    if len(parts) > 1:
        parts = [part for part in parts if part.strip()]
        if len(parts) >= rules.menu_parts and n <= rules.menu_words * len(parts) + len(parts):
            return "navigation"
    if n <= 12 and all(word.strip(".:|").lower() in MENU_WORDS for word in words):
        return "navigation"
    if not _WORDY.search(line):
        return "punctuation"
    if n < rules.short_words and line.rstrip(CLOSERS)[-1:] not in ENDS:
        return "punctuation"
    if _DOUBLED.search(line) and len(_SHOUT.findall(line)) > rules.shout_share * n:
        return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in windows found twice or more, first ones included."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(word, len(number)) for word in words], dtype=np.int64)
    if len(number) == n:
        return 0
    # Windows of 2, 4 and 8 words get their ranks from pairs of shorter ones: exact, and below 2**63.
    width = 1
    while width < window:
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids = np.unique(pair, return_inverse=True)
        width *= 2
    counts = np.bincount(ids)
    starts = np.flatnonzero(counts[ids] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def judge(text: str | None, rules: Rules) -> dict:
    """Base counts, verdict and cleaned text of one document."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = raw.split(b"\n")
    filled = [line for line in lines if line and not line.isspace()]
    n_repeat = repeated_words(words)
    kept_lines, failed, lost = [], {"boilerplate": 0, "navigation": 0, "punctuation": 0}, 0
    for line in text.split("\n"):
        why = line_failure(line, rules) if line.strip() else None
        if why:
            failed[why] += 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            kept_lines.append(line)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_pct * n_words
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(filled) - len(set(filled)),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.max_lost * word_chars,
        "n_lines": len(filled),
        "n_boilerplate_lines": failed["boilerplate"],
        "n_navigation_lines": failed["navigation"],
        "n_punctuation_lines": failed["punctuation"],
        "lost_chars": lost,
        "clean_text": "\n".join(kept_lines) if sum(failed.values()) else text,
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_boilerplate_lines", "n_navigation_lines", "n_punctuation_lines", "lost_chars")
_FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_boilerplate_lines long, n_navigation_lines long, n_punctuation_lines long, lost_chars long"
)


def verdict(column, rules: Rules = Rules(), *, with_text: bool = False):
    """A struct column with what ``judge`` finds; clean_text only on demand."""
    fields = _FIELDS + (", clean_text string" if with_text else "")
    names = [part.split()[0] for part in fields.split(", ")]
    kinds = {name: pa.int64() if name in _LONGS else pa.string() if name == "clean_text" else pa.bool_() for name in names}

    def run(texts: pa.Array) -> pa.Array:
        found = [judge(text.as_py(), rules) for text in texts]
        return pa.StructArray.from_arrays([pa.array([row[name] for row in found], kinds[name]) for name in names], names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Not to be run again for each use of a field.
    return F.arrow_udf(run, f"struct<{fields.replace(' ', ':').replace(',:', ',')}>").asNondeterministic()(column)


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id, base counts, line failures, verdict.

    Text is read whole; null text has no words and is rejected like an empty
    one. Repeated or null doc_ids give a row each. Other columns are not read.
    One pass, no shuffle.
    """
    return docs.select("doc_id", verdict(F.col("text").cast("string"), rules).alias("q")).select("doc_id", "q.*")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that stay, with failing lines taken out of ``text``.

    All columns of ``docs`` come back in their order; ``n_chars``, where there is
    one, becomes the length of the cleaned text. A null text, one without words, and one of fewer than 20 words go, as they fail the base. Each row is
    judged by itself: repeated rows all stay or all go, and ids, null or tied, play no part. Very long texts are read whole, line by line. An empty
    table gives no rows.
    """
    held = "__quality"
    while held in docs.columns:
        held += "_"
    judged = docs.withColumn(held, verdict(F.col("text").cast("string"), rules, with_text=True)).where(F.col(held)["kept"])
    text = F.col(held)["clean_text"]
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return judged.select(*[new[name].alias(name) if name in new else F.col(f"`{name}`") for name in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
