"""What column labels say: standard kinds, and groups of columns that repeat."""

from __future__ import annotations

from collections import Counter

# Fixed patterns, in order; the first that is found in a lower-cased label names its kind.
BEFORE_COORDINATES = [
    ("ba", r"(^\s*ba$)|brodmann"),
    ("region", r"region|anatom|location|area"),
    ("hemisphere", r"sphere|(^\s*h$)|^\s*hem|^\s*side"),
    ("size", r"(^k$)|(mm.*?3)|volume|voxels|size|extent"),
]
TRIPLET = [r"\bx\b.*\by\b.*\bz\b", r"(peak\s*voxel\s*coordinate|talairach\s*coordinates?|mni\s*coordinates?)"]
COORDINATES, NOT_COORDINATES = r"coordinates?", r"cluster|score|value"
AXIS_X, AXIS_Y, AXIS_Z = r"^\s*x\b", r"^\s*y\b", r"^\s*z\b"
LATE_TRIPLET = r"rdinate"
STATISTIC = r"^(max.*(z|t).*|.*(z|t).*(score|value|max))$"
P_VALUE = r"p[\-\s]+.*val"
SPANNED_COORDINATES = r"(ordinate|x.*y.*z)"


def repeating_groups(labels: list[str]) -> list[tuple[int, int]]:
    """(first column, columns) of groups of labels that repeat, from left to right.

    A run starts at a label that occurs again and goes on over such labels until it would meet its own first label;
    runs of two labels or more that occur at two places or more are groups, unless their columns are all taken.
    """
    again = {label for label, n in Counter(labels).items() if n > 1}

    def run(start: int) -> tuple[str, ...]:
        end = start + 1
        while end < len(labels) and labels[end] in again and labels[end] != labels[start]:
            end += 1
        return tuple(labels[start:end])

    runs = {i: r for i, label in enumerate(labels) if label in again and len(r := run(i)) > 1}
    often = Counter(runs.values())
    found, taken = [], set()
    for i, r in sorted(runs.items()):
        columns = set(range(i, i + len(r)))
        if often[r] > 1 and not columns <= taken:
            taken |= columns
            found.append((i, len(r)))
    return found
