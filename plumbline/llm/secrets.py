"""Secret scan: Aho-Corasick keywords, anchored expressions only at hits, then embedded checksums."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The kinds in their order; the words that the prefilter looks for in lower-cased text.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
}
ANCHORED = {
    "assign": re.compile(
        rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    # the rest of a token behind its first part, and the characters of a part
    "jwt": re.compile(rb"\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
}
PART = re.compile(rb"[A-Za-z0-9_-]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = b"h" * 24
HEX_CLASS = bytes(104 if c in b"0123456789abcdef" else 46 for c in range(256))

FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def crc_base62(body: bytes) -> bytes:
    """The six base-62 digits of CRC-32 that close such tokens."""
    n, digits = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.encode()


def _json_object(part: bytes) -> bool:
    """Whether the part says a JSON object. One nested too deeply to be read is none."""
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind == "hex":
        return len(m[0]) >= 24
    return crc_base62(m[1][:30]) == m[1][30:]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_AUTOMATON: list[ahocorasick.Automaton] = []


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, ordered by start and then by kind.

    The text is looked at as one byte for each code point: those above 255 can stand in no keyword and
    in no secret, so a question mark takes their place and positions stay code points. Every run of a
    secret's characters is read a bounded number of times, so time is in proportion to the text."""
    if not text:
        return []
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    shadow = text.encode("latin-1", "replace")
    spans: list[tuple[int, int, str]] = []
    ends = dict.fromkeys(KINDS, 0)

    def at(kind: str, start: int) -> None:
        if start >= ends[kind] and (m := ANCHORED[kind].match(shadow, start)):
            ends[kind] = m.end()
            if _valid(kind, m):
                spans.append((m.start(), m.end(), kind))

    run = 0  # the end of the run of a token's characters that was looked at last, none of whose hits begins a token

    def at_token(start: int) -> None:
        nonlocal run
        if start < max(run, ends["jwt"]) or not shadow.startswith(b"eyJ", start):
            return
        end = PART.match(shadow, start).end()
        if end > start + 3 and (m := ANCHORED["jwt"].match(shadow, end)):
            ends["jwt"] = m.end()
            if _json_object(shadow[start:end]) and _json_object(m[1]):
                spans.append((start, m.end(), "jwt"))
        else:
            run = end

    # words of one kind may hold each other's ends but never begin at one place, so ends come in order of starts
    hits = [(end + 1 - n, kind) for end, (kind, n) in _AUTOMATON[0].iter(shadow.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if kind == "jwt":
            at_token(start)
        else:
            at(kind, start)
    # runs of hexadecimal digits have no keyword of their own: in the text's classes, 24 digits are one
    classes, where = shadow.translate(HEX_CLASS), 0
    while (where := classes.find(HEX_RUN, where)) >= 0:
        at("hex", where)
        where = ends["hex"]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        spans = find_secrets(text)
        kinds = [kind for *_, kind in spans]
        base = _written([s for s in spans if s[2] in BASE])
        rows.append((*map(kinds.count, BASE), hashlib.sha256(base.encode()).hexdigest(), _written(spans), len(spans)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): counts, digest and spans of its secrets.

    A null or empty text has none; repeated rows give repeated results; a null doc_id stays null;
    other columns are ignored. A map over the scan: no shuffle, one batch in memory."""
    return docs.select("doc_id", F.pandas_udf(_scan, FOUND)("text").alias("found")).select("doc_id", "found.*")


def redact(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with each secret, or run of overlapping secrets, replaced by `mark`."""
    if not text or not (spans := find_secrets(text)):
        return text
    out, done = [], 0
    start, end = spans[0][:2]
    for s, e, _ in [*spans[1:], (len(text) + 1, 0, "")]:
        if s <= end and s <= len(text):
            end = max(end, e)
            continue
        out += [text[done:start], mark]
        done, start, end = end, s, e
    return "".join([*out, text[done:]])


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with its columns as they are, but secrets in `text` replaced and `n_chars`, if there, counted anew.

    Texts without a secret, null texts among them, stay as they are."""

    out = docs.withColumn("text", F.pandas_udf(_redacted, "string")("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
