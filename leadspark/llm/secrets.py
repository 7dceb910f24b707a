"""Secret scans: patterns, and strings that a tokenizer's vocabulary does not know.

Words and names take few tokens of a vocabulary, random strings many: a low number of
characters per token exposes them. A run is measured as a whole and by its parts between
separators, so that a name before a key does not hide it. Known kinds of long strings without
secrets (digests, UUIDs, numbers) are left out.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_LONG_HEX = re.compile("[0-9a-f]{24,}")
#: Shorter strings are not measured: few characters say little about how a string was made.
LEAST_LENGTH = 16
#: Strings that have the letters of a word need more: made-up and foreign words take many tokens, too.
LEAST_WORD, _WORD = 20, re.compile("[A-Z]?[a-z]+|[A-Z]+")
#: Candidates: runs of the characters of keys, then their parts by fewer of these characters.
_PARTS = ("+/_=-", "+/_-", "+/", "_-", "")
#: Lengths of hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = (32, 40, 56, 64, 96, 128)
_ALL_HEX = re.compile("[0-9a-fA-F]+")
_UUID = re.compile("[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Numbers, dates and times.
_NUMBER = re.compile("[0-9+/_=-]+(?:T[0-9+/_=-]+Z?)?")
#: A candidate with fewer characters for each token is random.
LEAST_RATIO = 2.0

_VOCABULARIES: dict[str, tiktoken.Encoding] = {}


def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    """The worker's vocabulary from a file of ranks."""
    if path not in _VOCABULARIES:
        with open(path) as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, file)}
        _VOCABULARIES[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _VOCABULARIES[path]


def is_known_kind(run: str) -> bool:
    """Digests, UUIDs, numbers and times: long, but no secrets."""
    return bool((len(run) in _DIGESTS and _ALL_HEX.fullmatch(run)) or _UUID.fullmatch(run) or _NUMBER.fullmatch(run))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the patterns' matches, for each kind leftmost and not overlapping."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs of under 24 characters would be dropped
    found += [(m.start(), "hex", m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[int, str, int]) -> tuple[int, int]:
    return span[0], KINDS.index(span[1])


def _free(start: int, end: int, taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What ``taken`` (sorted) leaves of a run."""
    out = []
    for a, _, b in taken:
        if a < end and start < b:
            out.append((start, a))
            start = b
    return [*out, (start, end)]


@cache
def _shapes(least: int) -> tuple[re.Pattern, ...]:
    """Patterns of runs of ``least`` or more characters, the widest first."""
    return tuple(re.compile(f"[A-Za-z0-9{more}]{{{least},}}") for more in _PARTS)


def random_spans(text: str, encoding: tiktoken.Encoding, taken: list[tuple[int, str, int]], least: int = LEAST_LENGTH) -> list[tuple[int, str, int]]:
    """Runs of ``least`` characters, or else their parts, outside ``taken`` that need a token for fewer than ``LEAST_RATIO`` characters."""
    out, shapes = [], _shapes(least)
    for m in shapes[0].finditer(text):
        found: list[tuple[int, str, int]] = []
        for start, end in _free(m.start(), m.end(), taken):
            measured = set()
            for parts in shapes:
                for at, stop in [p.span() for p in parts.finditer(text, start, end)]:
                    # longer parts come first
                    if (at, stop) in measured or any(a < stop and at < b for a, _, b in found):
                        continue
                    measured.add((at, stop))
                    part = text[at:stop]
                    if len(part) < LEAST_WORD and _WORD.fullmatch(part):
                        continue
                    if not is_known_kind(part) and len(part) < LEAST_RATIO * len(encoding.encode_ordinary(part)):
                        found.append((at, "random", stop))
        out += found
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def secret_spans(path: str, pattern: str, least: int = LEAST_LENGTH):
    """Arrow UDF: ``array<struct<kind, start, end>>`` of a text, in code points, end exclusive."""

    @F.arrow_udf(T.ArrayType(SPAN))
    def scan(texts: pa.Array) -> pa.Array:
        encoding, out = vocabulary(path, pattern), []
        for text in texts.to_pylist():
            base = base_spans(text)
            spans = sorted(base + random_spans(text, encoding, base, least), key=_order)
            out.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return scan


def find_secrets(docs: DataFrame, path: str, pattern: str, least: int = LEAST_LENGTH) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs``.

    Spans are sorted by start, then kind. A null text is empty and has none; repeated rows all
    stay; null ids stay null; an empty table gives no rows; other columns are not read. ``path``
    names a file of token ranks and ``pattern`` the vocabulary's splitting pattern. Strings of
    fewer than ``least`` characters (``LEAST_WORD`` if all are letters of a word, as in ``Word`` or
    ``WORD``) are found by the patterns only.
    """
    return docs.select("doc_id", secret_spans(path, pattern, least)(text_or_empty()).alias("spans"))
