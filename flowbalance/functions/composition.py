"""SQL expressions over flows.

A flow is four DOUBLE columns ``volume, fat, snf, water``. A row that carries several flows
prefixes them (``cream_volume``, ``cream_fat``, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from ..constants import MASSES


def mass_names(prefix: str = "") -> list[str]:
    return [f"{prefix}_{m}" if prefix else m for m in MASSES]


def number(x: float) -> str:
    """A DOUBLE literal; a plain decimal literal would be DECIMAL."""
    return f"{float(x)!r}D"


def quoted(name: str) -> str:
    """A column name as SQL, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def quotient(part: str, whole: str) -> str:
    """``part / whole``, 0 where the divisor is 0 or a side is missing.

    Never NULL: Spark takes any division to be nullable, and null checks on everything computed
    from it would double the compiled code.
    """
    return f"COALESCE(TRY_DIVIDE({part}, {whole}), 0D)"


def closure_gap() -> str:
    return "ABS(fat + snf + water - volume)"


def percent_of(part: str, whole: str) -> str:
    """``part`` as a percentage of ``whole``; 0 when there is no whole."""
    return f"CASE WHEN {whole} = 0 THEN 0D ELSE {part} / {whole} * 100D END"


def flow_struct(prefix: str = "", **labels: str) -> str:
    """A struct of labels and the four masses, to be fanned out with ``inline``."""
    fields = [f"{value} AS {name}" for name, value in labels.items()]
    fields += [f"{n} AS {m}" for m, n in zip(MASSES, mass_names(prefix))]
    return f"STRUCT({', '.join(fields)})"


def fan(structs: Sequence[str]) -> str:
    """One output row per struct."""
    return f"INLINE(ARRAY({', '.join(structs)}))"


def one_of(choices: Sequence[str], index: str) -> str:
    """The member of a short fixed list at a zero-based index."""
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"ARRAY({listed})[{index}]"
