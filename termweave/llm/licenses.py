"""License scans by ordered signature rules.

A rule is a regex over the normalised words of a text, keywords of which one must be present before it is tried (each
alternative of the regex holds one), a priority and a label. Detections are accepted in order of priority, then length, then place; one whose word interval lies inside that
of an accepted one is suppressed. Base phrases (word sequences) are counted apart and always keep their labels.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: phrase, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[bytes, ...]
    priority: int
    weight: float


#: name, words of the name as a regex, keywords (one of them in each alternative, apart by |), versions ("" for none)
FAMILIES = (
    ("apache", r"apache(?: software)?", "apache", ("1 0", "1 1", "2 0")),
    ("mit", r"(?:mit|expat|x11)", "mit|expat|x11", ("",)),
    ("bsd", r"(?:new |modified |simplified )?bsd(?: [234] clause| style)?", "bsd", ("",)),
    ("gpl", r"(?:gnu )?(?:gpl|general public licen[sc]e)", "gpl|general public", ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e|library general public licen[sc]e)", "lgpl|lesser general|library general", ("2", "2 0", "2 1", "3", "3 0")),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)", "agpl|affero", ("1", "3", "3 0")),
    ("mpl", r"(?:mpl|mozilla public licen[sc]e)", "mpl|mozilla", ("1 0", "1 1", "2 0")),
    ("epl", r"(?:epl|eclipse public licen[sc]e)", "epl|eclipse", ("1 0", "2 0")),
    ("cddl", r"(?:cddl|common development and distribution licen[sc]e)", "cddl|common development", ("1 0", "1 1")),
    ("cpl", r"(?:cpl|common public licen[sc]e)", "cpl|common public", ("1 0",)),
    ("eupl", r"(?:eupl|european union public licen[sc]e)", "eupl|european union", ("1 1", "1 2")),
    ("artistic", r"artistic", "artistic", ("1 0", "2 0")),
    ("boost", r"boost software", "boost", ("1 0",)),
    ("isc", r"isc", "isc", ("",)),
    ("zlib", r"zlib(?: libpng)?", "zlib", ("",)),
    ("unlicense", r"unlicen[sc]e", "unlicen", ("",)),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public licen[sc]e)", "wtfpl|want to public", ("2",)),
    ("python", r"(?:python software foundation|psf)", "python software|psf", ("2",)),
    ("openssl", r"openssl", "openssl", ("",)),
    ("ofl", r"(?:sil open font licen[sc]e|sil ofl|ofl)", "ofl|open font", ("1 0", "1 1")),
    ("odbl", r"(?:open database licen[sc]e|odbl)", "odbl|open database", ("1 0",)),
    ("upl", r"universal permissive", "universal permissive", ("1 0",)),
    ("ms-pl", r"(?:microsoft public licen[sc]e|ms pl)", "microsoft public|ms pl", ("",)),
    ("ecl", r"educational community", "educational community", ("1 0", "2 0")),
    ("afl", r"academic free", "academic free", ("2 1", "3 0")),
    ("osl", r"open software", "open software", ("2 1", "3 0")),
)
CC_PARTS, CC_VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?derivative(?: work)?s?"}
#: Grants and notices that stand without a license's name.
NOTICES = (
    ("copyright", r"(?:copyright|©)(?: c)?(?: (?:19|20)\d\d)+", "copyright|©", 20, 0.5),
    ("copyright", r"copyright(?: c)? by", "copyright", 15, 0.4),
    ("reserved", r"all rights (?:are )?reserved", "reserved", 20, 0.6),
    ("reserved", r"some rights reserved", "reserved", 20, 0.5),
    ("reserved", r"no rights reserved", "reserved", 20, 0.5),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in ?to|to) the public domain", "public domain", 40, 0.8),
    ("permissive", r"permission is hereby granted free of charge", "permission", 40, 0.9),
    ("permissive", r"permission to use copy modify and or distribute this software", "permission", 40, 0.9),
    ("permissive", r"redistribution and use in source and binary forms", "redistribution", 40, 0.9),
    ("warranty", r"without warranty of any kind", "warranty", 30, 0.5),
    ("warranty", r"provided as is without", "provided as is", 30, 0.4),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 40, 0.8),
    ("proprietary", r"may not be (?:copied|reproduced|redistributed|distributed)", "may not be", 30, 0.6),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|use|distribution)", "unauthori", 30, 0.6),
    ("spdx", r"spdx license identifier", "spdx", 10, 0.7),
    ("licensed", r"licen[sc]ed under", "licen", 5, 0.3),
    ("licensed", r"see the (?:accompanying )?licen[sc]e file", "licen", 5, 0.3),
)


#: How every grant begins.
GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|redistribute it) (?:under|by|subject to)"


def rules() -> tuple[Rule, ...]:
    """Hundreds of rules: for each family and version the ways a license is named, granted or tagged, most telling first."""
    out: list[Rule] = []

    def add(label: str, body: str, keyword: str, priority: int, weight: float) -> None:
        out.append(Rule(label, re.compile(rf" {body}(?= )".encode()), tuple(keyword.encode().split(b"|")), priority, weight))

    grant = rf"{GRANT}(?: the)?(?: terms of(?: the)?)?(?: either the)?"
    suffix = r"(?: (?:public )?licen[sc]e)?"
    for name, words, keyword, versions in FAMILIES:
        for v in versions:
            number = rf"(?: v| version| licen[sc]e v| licen[sc]e version| licen[sc]e)* ?{v}" if v else ""
            tag = f"{name}-{v.replace(' ', '.')}" if v else name
            bonus = 5 if v else 0
            add(tag, f"{grant} {words}{suffix}{number}", keyword, 90 + bonus, 0.95)
            add(tag, f"spdx license identifier {words}{number}(?: only| or later)?", "spdx", 95 + bonus, 0.98)
            add(tag, f"(?:this|the) [^ ]+ is (?:free software )?{grant} {words}{suffix}{number}", keyword, 92 + bonus, 0.95)
            add(tag, f"{words} licen[sc]e{number}", keyword, 60 + bonus, 0.85)
            add(tag, f"under (?:the )?{words}{number}", keyword, 65 + bonus, 0.85)
            add(tag, f"licen[sc]e {words}{number}", keyword, 55 + bonus, 0.8)
    for part in CC_PARTS:
        full = " ".join(CC_NAMES[p] for p in part.split())
        for v in ("", *CC_VERSIONS):
            end = rf" {v}" if v else ""
            tag = f"cc-{part.replace(' ', '-')}" + (f"-{v.replace(' ', '.')}" if v else "")
            bonus = 3 * len(part.split()) + (2 if v else 0)
            add(tag, f"{grant} (?:a )?(?:cc|creative commons) {part}{end}", "cc|creative commons", 80 + bonus, 0.95)
            add(tag, f"cc {part}{end}", "cc", 70 + bonus, 0.9)
            add(tag, f"creative commons {full}(?: international| unported| generic)?{end}", "creative commons", 70 + bonus, 0.9)
    add("cc0", r"(?:cc0|creative commons zero)(?: 1 0)?", "cc0|creative commons", 75, 0.9)
    for label, body, keyword, priority, weight in NOTICES:
        add(label, body, keyword, priority, weight)
    return tuple(sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern)))


#: Any detection needs one of these, or a grant by another word than "under"; a text without them is done after one pass for each.
GATES = (b"licen", b"copyright", b"rights", b"public domain", b"permission", b"redistribution", b"warranty", b"provided as is", b"proprietary", b"may not be", b"unauthori", b"spdx", b" cc ", b" cc0 ", b"creative commons", b" under ", "©".encode())


_GRANT = re.compile(rf" {GRANT} ".encode())


def gated(words: bytes) -> bool:
    """Whether a text may hold a detection."""
    return any(g in words for g in GATES) or ((b" by " in words or b" subject to " in words) and _GRANT.search(words) is not None)


@lru_cache(maxsize=1)
def _compiled() -> dict[tuple[bytes, ...], list[Rule]]:
    by: dict[tuple[bytes, ...], list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keywords, []).append(r)
    return by


def normalise(text: str | None) -> tuple[bytes, int]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text (A-Z lower-cased), each between single spaces, and their number."""
    words = (text or "").encode().translate(_WORD).split()
    return b" " + b" ".join(words) + b" ", len(words)


class Places:
    """Word numbers of places in normalised words: the spaces are found once, on first use."""

    def __init__(self, words: bytes):
        self.words, self.spaces = words, None

    def of(self, at: int) -> int:
        """How many spaces stand before a place."""
        if self.spaces is None:
            self.spaces = np.flatnonzero(np.frombuffer(self.words, np.uint8) == 32)
        return int(np.searchsorted(self.spaces, at))


def base_places(words: bytes, base: Iterable = BASE, places: Places | None = None) -> list[tuple[int, str]]:
    """(first word's number, label) of every place where a base phrase stands."""
    out, places = [], places or Places(words)
    for phrase, label in base:
        sought = b" " + phrase.encode() + b" "
        at = words.find(sought)
        while at >= 0:
            out.append((places.of(at), label))
            at = words.find(sought, at + 1)
    return sorted(out)


class Cover:
    """Which intervals lie inside an accepted one: the furthest end by start, in a tree of prefix maxima."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.furthest = [-1] * (len(self.starts) + 1)

    def holds(self, a: int, b: int) -> bool:
        i = bisect_right(self.starts, a)
        while i:
            if self.furthest[i] >= b:
                return True
            i &= i - 1
        return False

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a)
        while i < len(self.furthest):
            self.furthest[i] = max(self.furthest[i], b)
            i += i & -i


def detections(words: bytes, places: Places | None = None) -> list[tuple[str, int, int, float]]:
    """Accepted detections as (label, first word, word after the last, weight), by place; O(n log n) in their number."""
    if not gated(words):
        return []
    found = []
    for keywords, own in _compiled().items():
        if any(k in words for k in keywords):
            for r in own:
                for m in r.pattern.finditer(words):
                    found.append((-r.priority, m.start() - m.end(), m.start(), m.end(), r))
    places, cover = places or Places(words), Cover([x[2] for x in found])
    kept = []
    for _, _, a, b, r in sorted(found, key=lambda x: x[:4] + (x[4].label,)):
        if not cover.holds(a, b):
            cover.add(a, b)
            kept.append((r.label, places.of(a), places.of(b), r.weight))
    return sorted(kept)


def scan(text: str | None) -> dict:
    """All of a text: n_words, base places, detections, labels and score (1 - the product of 1 - weight)."""
    words, n = normalise(text)
    places = Places(words)
    base, found = base_places(words, places=places), detections(words, places)
    doubt = 1.0
    for w in [0.6] * len({b for _, b in base}) + [w for *_, w in found]:
        doubt *= 1 - w
    labels = sorted({b for _, b in base})
    return {
        "n_words": n, "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(labels), "labels": ",".join(sorted({*labels, *(x[0] for x in found)})), "score": 1 - doubt,
        "spans": [{"label": x[0], "first": x[1], "past": x[2], "weight": x[3]} for x in found],
    }


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs with what scan() finds; spans: the accepted detections in words from 0.

    Null text counts as empty: no words, no labels, score 0. Repeated rows and null ids come out as they went in; an
    empty table gives an empty result; other columns aren't read.
    """

    def run(batches):
        import pyarrow as pa

        kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("past", pa.int64()), ("weight", pa.float64())]))
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            arrays = [pa.array([r[c] for r in rows], k) for c, k in [*kinds, ("spans", span)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *[c for c, _ in kinds], "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,past:long,weight:double>>")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """What scan() finds in every whole text of `documents`; null and empty texts have no words, no labels and score 0.

    The rules' labels are no SQL; tests/llm compares the base columns with a search word by word and the rules with
    texts that spell every alternative.
    """
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
