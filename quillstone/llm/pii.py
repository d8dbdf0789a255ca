"""Personal data: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: In the order in which spans that start together are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "key", "password")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches at every digit run: linear
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_PASSWORD = re.compile(r"(?i)\b(?:password|passwd|pwd|api_key|apikey|secret|token)\s{0,3}[=:]\s{0,3}(\S{6,128})")
_NOT_DIGIT = re.compile("[^0-9]")
_CONTEXT = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

# Score of a confirmed span, and the words near it that raise or lower the score.
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "key": 0.9, "password": 0.7}
RAISE = {
    "email": ("mail", "email", "e-mail", "mails", "contact", "kontakt", "contacto", "courriel", "correo"),
    "ip": ("ip", "address", "addresses", "host", "server", "login", "client"),
    "card": ("card", "cards", "credit", "creditcard", "visa", "mastercard", "payment", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "kontonummer", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "key": ("key", "keys", "aws", "access", "secret"),
    "password": ("login", "user", "username", "credentials"),
}
LOWER = {
    "email": ("noreply", "no-reply"),
    "ip": ("version", "versions", "release", "section", "chapter"),
    "card": ("isbn", "order", "serial", "tracking", "part"),
    "phone": ("version", "ratio"),
    "iban": ("serial", "part"),
    "ssn": ("part", "parts", "order", "serial", "isbn"),
    "key": ("example",),
    "password": ("forgot", "reset"),
}


@dataclass(frozen=True)
class Policy:
    """near: code points of context on each side; step: what a context word adds or takes; least: the score that an added span needs.

    A span of the base kinds stays whatever its score.
    """

    near: int = 48
    step: float = 0.2
    least: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: letters as two digits, the first four signs moved to the end."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(sign, 36)) for sign in moved)) % 97 == 1


def _emails(text: str):
    """The local part is read backwards from its at sign, so long runs cost no more than their length."""
    done = 0
    for match in _AT_DOMAIN.finditer(text):
        before = text[done : match.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            yield match.start() - local, match.end()
            done = match.end()


def _ips(text: str):
    for match in _DOTTED.finditer(text):
        at = match.start()
        parts = match.group().split(".")
        for first in range(0, len(parts) - 3, 4):
            four = parts[first : first + 4]
            length = sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in four):
                yield at, at + length
            at += length + 1


def _cards(text: str):
    for match in _DIGITS.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def _phones(text: str):
    for match in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", match.group())) <= 15:
            yield match.span()


def _ibans(text: str):
    for match in _IBAN.finditer(text):
        code = match.group()
        while len(code.replace(" ", "")) >= 15:
            if len(code.replace(" ", "")) <= 34 and mod97(code.replace(" ", "")):
                yield match.start(), match.start() + len(code)
                break
            if " " not in code:
                break
            code = code[: code.rindex(" ")]  # a word in capitals may follow the number


def _whole(pattern: re.Pattern, group: int = 0):
    return lambda text: (match.span(group) for match in pattern.finditer(text))


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _whole(_SSN), "key": _whole(_KEY), "password": _whole(_PASSWORD, 1)}
_AT, _DIGIT, _ASSIGN = "@", re.compile("[0-9]"), re.compile("[=:]")


def context_words(text: str, start: int, end: int, near: int) -> set[str]:
    """The whole lower-cased words within ``near`` code points of a span; a word that the limit cuts is none."""
    out: set[str] = set()
    for low, high in ((max(0, start - near), start), (end, min(len(text), end + near))):
        for word in _CONTEXT.finditer(text, low, high):
            cut_before = word.start() == low and 0 < low and _CONTEXT.match(text, low - 1)
            cut_after = word.end() == high and high < len(text) and _CONTEXT.match(text, high)
            if not (cut_before or cut_after):
                out.update(word.group().lower().replace("-", " ").split(), [word.group().lower()])
    return out


def score(text: str, kind: str, start: int, end: int, policy: Policy) -> float:
    near = context_words(text, start, end, policy.near)
    value = START[kind]
    value += policy.step * (not near.isdisjoint(RAISE[kind]))
    value -= policy.step * (not near.isdisjoint(LOWER[kind]))
    return round(min(1.0, max(0.0, value)), 3)


def spans(text: str, policy: Policy = Policy()) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) by start, then kind as listed; ends are exclusive."""
    found = []
    has_digit = bool(_DIGIT.search(text))
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text or kind in ("ip", "card", "iban", "ssn") and not has_digit or kind == "key" and "AKIA" not in text and "ASIA" not in text or kind == "password" and not _ASSIGN.search(text):
            continue
        for start, end in _FINDERS[kind](text):
            value = score(text, kind, start, end, policy)
            if kind in BASE_KINDS or value >= policy.least:
                found.append((start, end, kind, value))
    found.sort(key=lambda span: (span[0], KINDS.index(span[2])))
    return found


def redact(text: str, found: list[tuple[int, int, str, float]], least: float = 0.0) -> str:
    """The text with each span of at least that score replaced by its kind in angle brackets; of spans that overlap, the first."""
    out, done = [], 0
    for start, end, kind, value in found:
        if start >= done and value >= least:
            out += [text[done:start], f"<{kind.upper()}>"]
            done = end
    return "".join([*out, text[done:]])


def _joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in found)


_TYPE = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,scores:string,n_added:long>"


def _digest(text: str | None, policy: Policy) -> tuple:
    text = text or ""
    found = spans(text, policy)
    base = [span for span in found if span[2] in BASE_KINDS]
    counts = [sum(span[2] == kind for span in base) for kind in BASE_KINDS]
    return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), ",".join(f"{span[3]:g}" for span in found), len(found) - len(base))


def find(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row per document with its spans; null text counts as empty, repeated or null doc_ids give a row each.

    One pass over whole texts, however long, no shuffle. Spans of different kinds may overlap; those that start
    together are listed in the order of KINDS. An empty table gives no rows. Other columns are not read.
    """
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores", "n_added"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()]

    def run(texts: pa.Array) -> pa.Array:
        rows = [_digest(text.as_py(), policy) for text in texts]
        return pa.StructArray.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    found = F.arrow_udf(run, _TYPE).asNondeterministic()(F.col("text").cast("string"))
    return docs.select("doc_id", found.alias("p")).select("doc_id", "p.*")


def redacted(docs: DataFrame, policy: Policy = Policy(), least: float = 0.5) -> DataFrame:
    """``docs`` with its spans of at least that score masked in ``text``; all columns stay, null text stays null.

    Spans that overlap are masked once. Each row is read by itself, so repeated rows and null ids all stay; empty texts stay empty, very long ones are read
    whole, and an empty table gives no rows.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else redact(text, spans(text, policy), least) for text in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    masked = F.arrow_udf(run, "string")(F.col("text").cast("string"))
    return docs.select(*[masked.alias(name) if name == "text" else F.col(f"`{name}`") for name in docs.columns])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
