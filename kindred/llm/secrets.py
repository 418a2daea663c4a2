"""Secret scans: fixed patterns, and password guess cost for values in a credential context.

A value that follows a credential word is cut into the segmentation that an attacker would guess cheapest: dictionary
words, dates, repeated characters or blocks, keyboard walks, sequences and brute-force spans. The minimum over all
segmentations is found by dynamic programming over the value's positions; values that would take at least
GUESS_DIGITS decimal digits of guesses are secrets, WORD_DIGITS if they look like plain words. Words are ranked by a
public vocabulary, whose order is about that of their frequency in many languages, after a few common passwords.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "guess")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # a maximal run, as [0-9a-f]+ would find it

#: Fixed: words that announce a credential, with what may stand between them and the value.
_CONTEXT_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api key", "api-key",
                  "access key", "access_key", "credential", "auth_key", "private_key")
#: A value ends at its closing quote, or without quotes at white space, a quote, a bracket, comma or semicolon.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_\x20-]?key|access[_\x20]key|credentials?|auth_key|private_key)["']?"""
    r"""(?:\x20*(?::=|=>|->|[:=])\x20*|\x20+(?:is|was|are)\x20+)(?:"([^\s"]+)"|'([^\s']+)'|`([^\s`]+)`|["'`]?([^\s"'`<>,;]+))""",
    re.ASCII | re.IGNORECASE,
)
#: A context value is a secret from so many decimal digits of guesses on.
GUESS_DIGITS = 8.0
#: So many for a value that could be prose: letters, at most the first of them a capital, and hyphens between them.
WORD_DIGITS = 12.0
_PROSE = re.compile(r"[^\W\d_][^\W\d_A-Z]*(?:[-'’][^\W\d_A-Z]+)*")

#: Fixed: common passwords, ahead of the vocabulary.
COMMON = (
    "password", "123456", "qwerty", "admin", "welcome", "letmein", "monkey", "dragon", "login", "abc123", "master", "hello",
    "freedom", "whatever", "trustno1", "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman",
    "iloveyou", "starwars", "passw0rd", "pass", "user", "root", "test", "guest", "changeme", "default", "example",
    "placeholder", "none", "null", "true", "false",
)
#: Letters of the longest word of the vocabulary that is looked up.
LONGEST = 20


@lru_cache(maxsize=2)
def ranked_words(path: str | None) -> dict[str, int]:
    """Lower-case word to its rank from 1: COMMON, then the vocabulary's tokens of two or more letters in its order.

    path: a file of base64 tokens and ranks; none for COMMON alone."""
    out = {w: i + 1 for i, w in enumerate(COMMON)}
    if path is not None:
        with open(path, "rb") as f:
            tokens = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, f))
        for _, token in tokens:
            word = token.decode("utf-8", "replace").strip(" ").lower()
            if 2 <= len(word) <= LONGEST and word.isalpha():
                out.setdefault(word, len(out) + 1)
    return out


#: Fixed: rows of a keyboard; a walk runs along a row in either direction.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
#: One character to one character: only A-Z fold.
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Fixed: what look-alike characters stand for.
_LEET = str.maketrans("04351@$7!", "oaeslasti")
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:19|20)\d\d|(?:19|20)\d\d")


def _run_end(s: str, i: int, step) -> int:
    """End of the longest run from i whose neighbours all satisfy step with the first pair's value."""
    if i + 1 >= len(s) or (first := step(s[i], s[i + 1])) is None:
        return i + 1
    j = i + 2
    while j < len(s) and step(s[j - 1], s[j]) == first:
        j += 1
    return j


def _keyboard(a: str, b: str) -> int | None:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return q[1] - p[1] if p and q and p[0] == q[0] and abs(q[1] - p[1]) == 1 else None


def _sequence(a: str, b: str) -> int | None:
    d = ord(b) - ord(a)
    return d if d in (1, -1) and a.isalnum() and b.isalnum() else None


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def guess_digits(value: str, enough: float = float("inf"), path: str | None = None) -> float:
    """Decimal digits of the fewest guesses over all segmentations of value, or enough if it takes more; path: the
    vocabulary, as in ranked_words().

    Prefixes that already take enough aren't followed, so the work on a long value ends after a few spans, or after
    the repeats and walks that make it cheap."""
    n, low, ranks = len(value), value.translate(_LOWER), ranked_words(path)
    plain = low.translate(_LEET)
    best = [0.0] + [float("inf")] * n
    last = 0  # no open prefix ends after it
    for i in range(n):
        at = best[i]
        if i > last:
            break
        if at >= enough:
            continue

        def reach(j: int, cost: float, at: float = at) -> None:
            nonlocal last
            if at + cost < best[j]:
                best[j] = at + cost
                if at + cost < enough:
                    last = max(last, j)

        reach(i + 1, log10(_alphabet(value[i])))
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            for form, extra in ((low, 0.0), (plain, 0.3)):
                if rank := ranks.get(form[i:j]):
                    upper = value[i:j] != low[i:j]
                    reach(j, log10(rank + 1) + extra + (0.5 if upper else 0.0))
                    break
        if m := _DATE.match(value, i):
            reach(m.end(), log10(365 * 120))
        for step, start in ((_keyboard, 47), (_sequence, 60)):
            end = _run_end(low, i, step)
            for j in range(i + 3, end + 1):
                reach(j, log10(start * 2 * (j - i)))
        for size in range(1, min(8, (n - i) // 2) + 1):
            unit, j = value[i : i + size], i + size
            if size > 1 and unit == unit[0] * size:
                continue  # found as a repeat of one character
            while value.startswith(unit, j):
                j += size
            if j > i + 2 * size - 1 and j - i >= 3:
                reach(j, log10(max(2, (j - i) // size)) + sum(log10(_alphabet(c)) for c in unit))
    return min(best[n], enough)


def base_spans(text: str, folded: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = []
    if any(k in folded for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, folded: str, base: list[tuple[int, int, int]], path: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of context values with a high guess cost that no base span covers."""
    out, k, covered = [], 0, 0  # covered: the furthest end of the base spans that start at or before a value
    if any(k in folded for k in _CONTEXT_WORDS):
        for m in _CONTEXT.finditer(text):
            a, b = m.span(m.lastindex)
            while m.lastindex == 4 and b > a and text[b - 1] in ".:!?)":  # of the sentence, not of the value
                b -= 1
            while k < len(base) and base[k][0] <= a:
                covered, k = max(covered, base[k][2]), k + 1
            if b > max(a, covered):
                enough = WORD_DIGITS if _PROSE.fullmatch(text, a, b) else GUESS_DIGITS
                if guess_digits(text[a:b], enough, path) >= enough:
                    out.append((a, 3, b))
    return out


def spans(text: str | None, path: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans by start, then kind, in code points."""
    text = text or ""
    folded = text.lower()  # only to see which patterns can match at all
    base = base_spans(text, folded)
    return sorted(base + guess_spans(text, folded, base, path))


def _digest(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs(doc_id, text).

    vocabulary: path of the ranked vocabulary. Null text counts as empty: no spans, and the digest of an empty string.
    Every row is scanned by itself, so repeated rows, null ids and empty tables need no care; texts of any length are
    scanned whole, in time that grows with their length. Other columns are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, hashes, all_spans = ([], [], []), [], []
            for x in b.column(1):
                found = spans(x.as_py(), vocabulary)
                base = [s for s in found if s[1] < 3]
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                hashes.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                all_spans.append(_digest(found))
            columns = [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(all_spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]", vocabulary: str | None = None) -> DataFrame:
    """docs with every found span of text replaced by mark (overlapping spans by one), and n_chars, if there, set anew
    for the rows that change. Rows, their order of columns and null texts stay as they are, whatever the other columns'
    names."""
    at = docs.columns.index("text")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        out, end = [], 0
        for a, _, b in spans(text, vocabulary):
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join(out) + text[end:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if n_chars is not None:
                sizes = [n if t is o else len(t) for n, t, o in zip(b.column(n_chars).to_pylist(), new, old, strict=True)]
                columns[n_chars] = pa.array(sizes, b.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    # Columns go by number meanwhile: a name may hold a dot.
    numbered = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = numbered.mapInArrow(run, numbered.schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of secrets in every document, words ranked by the public multilingual vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
