"""Column-name standardisation rule (applied to the schema on the driver)."""

from __future__ import annotations

import re


def standard_name(name: str) -> str:
    """strip + lower, anything outside [a-z0-9_] -> '_', runs of '_' collapsed, trimmed."""
    s = re.sub(r"[^a-z0-9_]", "_", name.strip().lower())
    return re.sub(r"_+", "_", s).strip("_")


def standard_names(names: list[str]) -> list[str]:
    """Standard names made unique: empty -> ``col_<i>``, clashes get ``_2``, ``_3``..."""
    out: list[str] = []
    seen: set[str] = set()
    for i, n in enumerate(names):
        base = standard_name(n) or f"col_{i}"
        cand, k = base, 2
        while cand in seen:
            cand = f"{base}_{k}"
            k += 1
        seen.add(cand)
        out.append(cand)
    return out
