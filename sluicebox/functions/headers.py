"""Header predicates and repair (FN-17, CL-21, PR-5). Headers are metadata, so this is driver-side."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

# Word lists that mark a header as date-like or identifier-like.
DATE_WORDS = ("date", "time", "timestamp", "datetime", "created", "updated", "joined", "dob")
IDENTIFIER_WORDS = ("id", "code", "zip", "postal", "phone", "account", "reference", "ref")

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_NUMBERED = re.compile(r"(.*) (\d+)", re.DOTALL)


def _has_word(header: str, words: Sequence[str]) -> bool:
    pattern = rf"(?:^|[_\s-])(?:{'|'.join(words)})(?:$|[_\s-])"
    return re.search(pattern, header.strip(), re.IGNORECASE) is not None


def is_date_like(header: str) -> bool:
    return _has_word(header, DATE_WORDS)


def is_identifier_like(header: str) -> bool:
    return _has_word(header, IDENTIFIER_WORDS)


def fold_header(header: str) -> str:
    return header.strip().casefold()


#: What can be wrong with one header by itself.
FAULTS = {
    "blank": lambda h: not h.strip(),
    "padded": lambda h: h != h.strip(),
    "unnamed": lambda h: fold_header(h).startswith("unnamed:"),
    "control": lambda h: _CONTROL.search(h) is not None,
}


def header_faults(headers: Sequence[str]) -> list[set[str]]:
    """The faults of every header; ``repeated`` where another one differs from it in case and padding only."""
    same = Counter(map(fold_header, headers))
    found = [{name for name, test in FAULTS.items() if test(h)} for h in headers]
    return [f | ({"repeated"} if same[fold_header(h)] > 1 else set()) for f, h in zip(found, headers, strict=True)]


def messy_positions(headers: Sequence[str]) -> list[int]:
    """PR-5: positions of headers with any fault."""
    return [i for i, faults in enumerate(header_faults(headers)) if faults]


def clean_header(header: str, position: int, taken: set[str]) -> str:
    """CL-21: a readable form of the header that is not among the folded names ``taken``.

    A header that says nothing is named by its place. A taken name gets the smallest number from 2 on
    that no taken name of the same stem bears.
    """
    faults = header_faults([header])[0]
    words = " ".join(_CONTROL.sub("", header).split())
    stem = f"Column {position + 1}" if faults & {"blank", "unnamed"} or not words else words
    if stem.casefold() not in taken:
        return stem
    used = {int(m[2]) for m in map(_NUMBERED.fullmatch, taken) if m and m[1] == stem.casefold() and m[2] == str(int(m[2]))}
    return f"{stem} {min(set(range(2, len(used) + 3)) - used)}"
