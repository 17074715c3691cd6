"""License scan: ordered signature rules behind a keyword prefilter.

``RULES`` is built from license families, versions and kinds of evidence: some hundreds
of regular expressions over the words of a text, each with a keyword that must occur
before the expression is tried and a priority. Detections that lie inside a detection
of the same or higher priority are dropped, so that "GNU Lesser General Public License
v3" is not reported as three licenses.

Defined results: a null text is the empty text; texts without words have no license and
score 0; equal detections count once; repeated rows give repeated results; rows keep
only ``doc_id`` and the results, so extra columns never clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, text_of

# The phrases that are always reported, and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, detections array<struct<label:string,rule:string,start:int,stop:int>>")

# Names that a number follows for other reasons than a license's version.
LANGUAGES = ("python", "php")

# Every byte that is not part of a word becomes a space; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


@dataclass(frozen=True)
class Rule:
    """``keyword`` must occur in the folded text before ``pattern`` is tried on it."""

    name: str
    label: str
    keyword: bytes
    pattern: str
    priority: int
    weight: float


def _rules() -> list[Rule]:
    """The ordered rules; a smaller priority wins."""
    rules: list[Rule] = []

    def add(label: str, kind: str, keyword: str, pattern: str, priority: int, weight: float) -> None:
        rules.append(Rule(f"{label}/{kind}", label, keyword.encode(), pattern, priority, weight))

    said = r"(?:v|version|ver)? ?"
    # Copyleft families, by name and version.
    families = {
        "agpl": (r"(?:gnu )?affero general public licen[sc]e", "affero", ["1 0", "3 0", "3"]),
        "lgpl": (r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", ["2 0", "2 1", "3 0", "2", "3"]),
        "gpl": (r"(?:gnu )?general public licen[sc]e", "general public", ["1 0", "2 0", "3 0", "1", "2", "3"]),
        "gfdl": (r"(?:gnu )?free documentation licen[sc]e", "documentation", ["1 1", "1 2", "1 3"]),
        "mpl": (r"mozilla public licen[sc]e", "mozilla", ["1 0", "1 1", "2 0"]),
        "epl": (r"eclipse public licen[sc]e", "eclipse", ["1 0", "2 0"]),
        "cddl": (r"common development and distribution licen[sc]e", "distribution", ["1 0", "1 1"]),
        "cpl": (r"common public licen[sc]e", "common public", ["1 0"]),
        "apache": (r"apache (?:software )?licen[sc]e", "apache", ["1 0", "1 1", "2 0", "2"]),
        "artistic": (r"artistic licen[sc]e", "artistic", ["1 0", "2 0"]),
        "eupl": (r"european union public licen[sc]e", "european union", ["1 0", "1 1", "1 2"]),
        "osl": (r"open software licen[sc]e", "open software", ["1 0", "2 0", "2 1", "3 0"]),
        "afl": (r"academic free licen[sc]e", "academic free", ["1 1", "1 2", "2 0", "2 1", "3 0"]),
        "bsl": (r"boost software licen[sc]e", "boost", ["1 0"]),
        "apsl": (r"apple public source licen[sc]e", "apple public", ["1 0", "1 1", "1 2", "2 0"]),
        "zpl": (r"zope public licen[sc]e", "zope", ["1 1", "2 0", "2 1"]),
        "lppl": (r"latex project public licen[sc]e", "latex", ["1 0", "1 1", "1 2", "1 3a", "1 3c"]),
        "ofl": (r"(?:sil )?open font licen[sc]e", "font", ["1 0", "1 1"]),
        "odbl": (r"open database licen[sc]e", "database", ["1 0"]),
        "python": (r"(?:psf|python)(?: software foundation)? licen[sc]e", "python", ["2 0", "2"]),
        "php": (r"php licen[sc]e", "php", ["3 0", "3 01"]),
        "ecl": (r"educational community licen[sc]e", "educational", ["1 0", "2 0"]),
        "cecill": (r"cecill(?: free software)?(?: licen[sc]e)?", "cecill", ["1 0", "1 1", "2 0", "2 1", "b", "c"]),
        "mspl": (r"microsoft (?:public|reciprocal) licen[sc]e", "microsoft", ["1 0"]),
    }
    for family, (title, keyword, versions) in families.items():
        for version in versions:
            tail = version.replace(" ", "-")
            add(f"{family}-{tail}", "title", keyword, rf"{title} {said}{version}", 10, 1.0)
            add(f"{family}-{tail}", "spdx", "spdx", rf"spdx license identifier {family} {version}(?: only| or later)?", 5, 1.0)
            add(f"{family}-{tail}", "of", keyword, rf"version {version} of (?:the )?{title}", 10, 1.0)
            add(f"{family}-{tail}", "short", family, rf"{family} ?(?:v|version|ver) ?{version}(?: plus| only| or (?:any )?later(?: version)?)?", 20, 0.8)
            if family not in LANGUAGES:
                add(f"{family}-{tail}", "bare", family, rf"(?:gnu )?{family} ?{version}(?: plus| only| or (?:any )?later(?: version)?)?", 22, 0.7)
        add(family, "grant", keyword, rf"under (?:the )?(?:terms of (?:the )?)?{title}", 30, 0.9)
        add(family, "title", keyword, title, 40, 0.7)
    # Creative Commons: by terms and version.
    terms = {
        "cc-by": "by", "cc-by-sa": "by sa", "cc-by-nc": "by nc", "cc-by-nd": "by nd",
        "cc-by-nc-sa": "by nc sa", "cc-by-nc-nd": "by nc nd",
    }
    words = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    for label, short in terms.items():
        spelled = " ".join(words[x] for x in short.split())
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            tail = version.replace(" ", "-")
            add(f"{label}-{tail}", "short", "cc", rf"cc {short} {version}", 10, 1.0)
            add(f"{label}-{tail}", "words", "creative commons", rf"creative commons {spelled} {version}(?: international| unported)?", 10, 1.0)
            add(f"{label}-{tail}", "address", "creativecommons", rf"creativecommons org licenses {short} {version}", 8, 1.0)
        add(label, "short", "cc", rf"cc {short}", 30, 0.7)
        add(label, "words", "creative commons", rf"creative commons {spelled}", 30, 0.8)
    add("cc0-1-0", "short", "cc0", r"cc0(?: 1 0)?(?: universal)?", 10, 0.9)
    # Permissive licenses, by title and by the sentences of their texts.
    for label, keyword, patterns in (
        ("mit", "mit", [r"(?:the )?(?:expat|mit) licen[sc]e", r"under (?:the )?(?:terms of (?:the )?)?mit licen[sc]e", r"spdx license identifier mit"]),
        ("gpl", "or at your option", [r"gnu general public licen[sc]e as published by the free software foundation either version \d of the licen[sc]e or at your option any later version"]),
        ("apache", "apache", [r"asl 2 0", r"licensed under the apache licen[sc]e", r"apache org licenses licen[sc]e 2 0"]),
        ("mit", "permission is hereby granted", [r"permission is hereby granted free of charge to any person obtaining a copy"]),
        ("isc", "isc", [r"isc licen[sc]e", r"spdx license identifier isc"]),
        ("isc", "permission to use", [r"permission to use copy modify and or distribute this software for any purpose with or without fee"]),
        ("bsd-2-clause", "bsd", [r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?", r"bsd 2 clause(?: licen[sc]e)?"]),
        ("bsd-3-clause", "bsd", [r"(?:new|revised|modified|3 clause|three clause) bsd(?: licen[sc]e)?", r"bsd 3 clause(?: licen[sc]e)?"]),
        ("bsd-4-clause", "bsd", [r"(?:original|4 clause|four clause) bsd(?: licen[sc]e)?", r"bsd 4 clause(?: licen[sc]e)?"]),
        ("bsd", "bsd", [r"bsd (?:style )?licen[sc]e"]),
        ("bsd", "redistribution", [r"redistribution and use in source and binary forms with or without modification are permitted"]),
        ("zlib", "zlib", [r"zlib(?: libpng)? licen[sc]e"]),
        ("unlicense", "unlicense", [r"(?:the )?unlicense"]),
        ("unlicense", "public domain", [r"free and unencumbered software released into the public domain"]),
        ("wtfpl", "public license", [r"do what the f\w+ you want to public licen[sc]e"]),
        ("public-domain", "public domain", [r"(?:released|placed|dedicated) (?:in|into|to) the public domain"]),
        ("proprietary", "all rights reserved", [r"all rights reserved"]),
        ("proprietary", "confidential", [r"proprietary and confidential"]),
    ):
        for k, pattern in enumerate(patterns):
            add(label, f"text-{keyword.split()[0]}-{k}", keyword, pattern, 25 + k, 0.8 if label != "proprietary" else 0.3)
    return sorted(rules, key=lambda r: (r.priority, r.name))


RULES = _rules()


@lru_cache(maxsize=1)
def _compiled() -> dict[bytes, list[tuple[int, re.Pattern]]]:
    """Expressions by keyword; names in them stand between single spaces."""
    by: dict[bytes, list] = {}
    for n, rule in enumerate(RULES):
        by.setdefault(rule.keyword, []).append((n, re.compile(b"(?<= )" + rule.pattern.encode() + b"(?= )")))
    return by


def detect(folded: bytes) -> list[tuple[int, int, int]]:
    """(rule, start, stop) in words, after suppression; ``folded`` has single spaces around words."""
    found: list[tuple[int, int, int]] = []
    for keyword, rules in _compiled().items():
        if keyword not in folded:
            continue
        for n, pattern in rules:
            for m in pattern.finditer(folded):
                found.append((n, m.start(), m.end()))
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
    kept: list[tuple[int, int, int]] = []
    # Strongest first, then longest: what a kept one contains adds nothing. Among kept
    # intervals sorted by start, one contains (a, b) if the farthest end at or before a reaches b.
    order = sorted(found, key=lambda x: (RULES[x[0]].priority, x[1] - x[2], x[1], x[0]))
    by_start = sorted({x[1] for x in order})
    place = {s: i + 1 for i, s in enumerate(by_start)}
    reach = [0] * (len(by_start) + 1)  # prefix maxima, updated in logarithmic time
    for n, start, stop in order:
        i, far = place[start], 0
        while i:
            far, i = max(far, reach[i]), i & (i - 1)
        if far >= stop:
            continue
        i = place[start]
        while i <= len(by_start):
            reach[i] = max(reach[i], stop)
            i += i & -i
        kept.append((n, int(np.searchsorted(spaces, start)) - 1, int(np.searchsorted(spaces, stop))))
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def places(folded: bytes) -> list[tuple[int, str]]:
    """(word number, label) of every place where a base phrase stands."""
    found: list[tuple[int, str]] = []
    spaces = None
    for phrase, label in BASE:
        needle, at, hits = f" {phrase} ".encode(), -1, []
        while (at := folded.find(needle, at + 1)) >= 0:
            hits.append(at)
        if hits:
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)
            found += [(n, label) for n in np.searchsorted(spaces, hits).tolist()]
    return found


def _scan(batch: pa.RecordBatch):
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
    any_key = re.compile(b"|".join(re.escape(k) for k in sorted({*_compiled(), *(p.split()[0].encode() for p, _ in BASE)})))
    for text in batch.column("text"):
        words = (text.as_py() or "").encode().translate(_FOLD).split()
        folded = b" " + b" ".join(words) + b" "
        base, found = (places(folded), detect(folded)) if any_key.search(folded) else ([], [])
        at = [w for w, _ in base]
        labels = {label for _, label in base}
        out["n_words"].append(len(words))
        out["n_base"].append(len(base))
        out["first_word"].append(min(at, default=None))
        out["last_word"].append(max(at, default=None))
        out["base_labels"].append(",".join(sorted(labels)))
        out["labels"].append(",".join(sorted(labels | {RULES[n].label for n, _, _ in found})))
        miss = 1.0
        for n in {n for n, _, _ in found}:
            miss *= 1 - 0.9 * RULES[n].weight
        out["score"].append(max(1 - miss, 0.7 if base else 0.0))
        out["detections"].append([{"label": RULES[n].label, "rule": RULES[n].name, "start": a, "stop": b} for n, a, b in found])
    kind = pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")),
         pa.array(out["base_labels"], pa.string()), pa.array(out["labels"], pa.string()),
         pa.array(out["score"], pa.float64()), pa.array(out["detections"], pa.list_(kind))],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per document: words, base phrases, labels, score and the detections kept.

    ``score`` is 1 minus the product of (1 - 0.9 weight) over the distinct rules kept, 0.7
    at least where a base phrase stands. One pass, no shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_arrow(rows, lambda: _scan, SCHEMA)
