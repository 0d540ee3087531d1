"""Personal data: regular expressions propose spans, checksums confirm, context words adjust.

A proposal starts from its kind's base score. Kinds with a validator (Luhn for payment cards,
mod 97 for IBANs, number ranges for addresses, phones and social security numbers) lose proposals
that fail it. Words near the span then raise or lower the score, and what reaches the threshold is
reported. Of overlapping spans the best scored one stays, then the longer, then the earlier.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import refuse_names


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0 and digits[0] in (2, 3, 4, 5, 6) and len(set(digits)) > 1


def mod97(account: str) -> bool:
    plain = account.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _octets(address: str) -> bool:
    parts = address.split(".")
    return all(len(p) <= 3 and int(p) < 256 and str(int(p)) == p for p in parts) and parts[0] != "0"


def _phone(number: str) -> bool:
    return 8 <= sum(c.isdigit() for c in number) <= 15


def _ssn(number: str) -> bool:
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    near: frozenset[str]
    valid: Callable[[str], bool] | None = None
    #: A text without this can't match: a character, or the digits.
    needs: str = "digit"
    group: int = 0
    against: frozenset[str] = frozenset()


_W = lambda s: frozenset(s.split())
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9\-])", 0.9, _W("email mail e-mail contact write"), needs="@"),
    Kind("phone", r"(?<![\w+.])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\w)", 0.75, _W("phone call tel telephone mobile cell fax contact"), _phone, needs="+"),
    Kind("phone", r"(?<![\w+.(\-])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?![\w\-])", 0.65, _W("phone call tel telephone mobile cell fax contact"), _phone),
    Kind("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", 0.65, _W("ip address host server login from"), _octets, against=_W("version release section chapter build")),
    Kind("card", r"(?<![\w.\-])[2-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\w\-])|(?<![\w.\-])3\d{3}[ \-]?\d{6}[ \-]?\d{5}(?![\w\-])", 0.8, _W("card visa mastercard credit debit payment amex"), luhn, against=_W("order tracking isbn serial")),
    Kind("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", 0.9, _W("iban account bank transfer konto"), mod97),
    Kind("ssn", r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])", 0.6, _W("ssn social security"), _ssn),
    Kind("key", r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)", 0.95, _W("aws key access secret"), needs="IA"),
    Kind("secret", r"(?i:(?<!\w)(?:password|passwd|pwd|secret|token|api[_\-]?key)\s*+[=:]\s*+[\"']?)([^\s\"'<>]{8,}+)", 0.75, _W("login user"), lambda s: any(c.isdigit() for c in s), group=1),
)
_NEAR = re.compile(r"[A-Za-z][A-Za-z\-]*")


def propose(text: str, kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.6, before: int = 40, after: int = 24) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of the spans that reach the threshold, by start, without overlaps."""
    has_digit = None
    found = []
    for kind in kinds:
        if kind.needs == "digit":
            if has_digit is None:
                has_digit = _DIGIT.search(text) is not None
            if not has_digit:
                continue
        elif kind.needs not in text:
            continue
        for match in _compiled(kind.pattern).finditer(text):
            start, end = match.span(kind.group)
            if kind.valid and not kind.valid(text[start:end]):
                continue
            around = {w.lower() for w in _NEAR.findall(text[max(0, start - before) : start] + " " + text[end : end + after])}
            score = kind.score + (0.2 if around & kind.near else 0.0) - (0.3 if around & kind.against else 0.0)
            score = round(min(1.0, max(0.0, score)), 4)
            if score >= threshold:
                found.append((kind.name, start, end, score))
    out: list[tuple[str, int, int, float]] = []  # by start, and as they don't overlap by end too
    for span in sorted(found, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        at = bisect.bisect_left(out, span[1], key=lambda o: o[1])
        if (at == 0 or out[at - 1][2] <= span[1]) and (at == len(out) or out[at][1] >= span[2]):
            out.insert(at, span)
    return out


_DIGIT = re.compile("[0-9]")
_cache: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    if pattern not in _cache:
        _cache[pattern] = re.compile(pattern)
    return _cache[pattern]


def _maybe(column: pa.Array) -> list[int]:
    """Rows whose text holds anything a pattern needs."""
    column = column.cast(pa.large_string())
    found = pc.match_substring_regex(column, "[0-9@]|AKIA|ASIA")
    return np.flatnonzero(pc.fill_null(found, False).to_numpy(zero_copy_only=False)).tolist()


def find_spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, start_char, end_char, score): every span of personal data in every text.

    The matched text itself is not returned. Null and empty texts have no spans; a null id is
    reported as null. Repeated rows are reported as often as they occur; an empty table gives an
    empty result. Of spans that overlap the best scored stays, of equal ones the longer, then the
    earlier, then the one whose kind is first by name. Time is linear in a text, but for sorting its
    spans. Other columns are not read; nothing is shuffled.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            rows = [(i, *s) for i in _maybe(column) for s in propose(column[i].as_py(), kinds, threshold)]
            at, name, start, end, score = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64())],
                names=["id", "kind", "start_char", "end_char", "score"],
            )

    refuse_names(id_col, "kind", "start_char", "end_char", "score")
    out = source.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, kind string, start_char long, end_char long, score double")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.6, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, as in [EMAIL]; all rows and columns stay.

    `length_col` names a column of text lengths in characters, set anew for every changed text. Null
    and empty texts stay as they are, with their length; null ids don't matter. Repeated rows change
    alike, overlaps are settled as in :func:`find_spans`, and an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_col)
            changed = {}
            for i in _maybe(column):
                text, parts, last = column[i].as_py(), [], 0
                for kind, start, end, _ in propose(text, kinds, threshold):
                    parts += [text[last:start], f"[{kind.upper()}]"]
                    last = end
                if parts:
                    changed[i] = "".join([*parts, text[last:]])
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                columns = {text_col: pc.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], column.type))}
                if length_col is not None:
                    old = batch.column(length_col)
                    columns[length_col] = pc.replace_with_mask(old, pa.array(mask), pa.array([len(changed[i]) for i in sorted(changed)], old.type))
                batch = pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)
            yield batch

    return docs.mapInArrow(run, docs.schema)
