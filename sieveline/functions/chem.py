"""Drug-likeness and toxicity rules over descriptor columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULTS, ScreenParams
from .rules import first_match


def lipinski_strict(mw: Column, hbd: Column, hba: Column, logp: Column, rotbonds: Column,
                    p: ScreenParams = DEFAULTS) -> Column:
    """All five limits hold; null where a descriptor is missing."""
    return (
        (mw <= p.max_mw) & (hbd <= p.max_hbd) & (hba <= p.max_hba)
        & (logp <= p.max_logp) & (rotbonds <= p.max_rotbonds)
    )


def ro5_violations(mw: Column, hbd: Column, hba: Column, logp: Column,
                   p: ScreenParams = DEFAULTS) -> Column:
    """How many of the four classic limits are exceeded."""
    broken = [mw > p.max_mw, logp > p.max_logp, hbd > p.max_hbd, hba > p.max_hba]
    return sum((b.cast("int") for b in broken), F.lit(0))


def lipinski_lenient(mw: Column, hbd: Column, hba: Column, logp: Column,
                     p: ScreenParams = DEFAULTS) -> Column:
    """Pass with at most one violation, ``?`` without descriptors."""
    n = ro5_violations(mw, hbd, hba, logp, p)
    return first_match([(n <= p.max_ro5_violations, "Pass"), (n.isNull(), "?")], "Fail")


def pass_fail(ok: Column) -> Column:
    return F.when(ok, "Pass").otherwise("Fail")


def veber(tpsa: Column, rotbonds: Column) -> Column:
    return pass_fail((tpsa <= 140) & (rotbonds <= 10))


def egan(logp: Column, tpsa: Column) -> Column:
    return pass_fail((logp <= 5.88) & (tpsa <= 131.6))


def esol_log_s(logp: Column, mw: Column, rotbonds: Column, aromatic_atoms: Column,
               heavy_atoms: Column) -> Column:
    """Delaney's estimate of aqueous solubility (2004), two decimals."""
    aromatic = F.coalesce(F.try_divide(aromatic_atoms, F.when(heavy_atoms > 0, heavy_atoms)), F.lit(0.0))
    return F.round(0.16 - 0.63 * logp - 0.0062 * mw + 0.066 * rotbonds - 0.74 * aromatic, 2)


def herg_flag(basic_n: Column, aromatic_rings: Column, mw: Column, logp: Column) -> Column:
    """Cardiac channel pharmacophore rule."""
    base = basic_n >= 1
    return first_match(
        [
            (base & (aromatic_rings >= 2) & (mw > 300) & (logp > 2), "Flag"),
            (base & (aromatic_rings >= 1), "Possible"),
        ],
        "Low risk",
    )


def alert_names(alerts: Column, weak: str = "SecAmine") -> Column:
    """The alerts that count: the weak one is listed only when alone."""
    alerts = F.coalesce(alerts, F.array().cast("array<string>"))
    strong = F.filter(alerts, lambda a: a != weak)
    return F.array_join(F.when(F.size(strong) > 0, strong).otherwise(alerts), "|")


def alert_flag(alerts: Column, weak: str | None = "SecAmine") -> Column:
    """Flag / Possible / Low risk from the matched structural alerts."""
    alerts = F.coalesce(alerts, F.array().cast("array<string>"))
    if weak is None:
        return F.when(F.size(alerts) > 0, "Flag").otherwise("Low risk")
    return first_match(
        [
            (F.exists(alerts, lambda a: a != weak), "Flag"),
            (F.size(alerts) > 0, "Possible"),
        ],
        "Low risk",
    )


def overall_flag(herg: Column, ames: Column, hepatotox: Column, pains: Column, brenk: Column) -> Column:
    """FLAG(...) outranks WARN(...) outranks CLEAN. ``pains`` and ``brenk`` are booleans."""
    flags = F.concat_ws(
        ",",
        F.when(herg == "Flag", "hERG"),
        F.when(ames == "Flag", "AMES"),
        F.when(hepatotox == "Flag", "Hepatotox"),
    )
    warns = F.concat_ws(
        ",",
        F.when(herg == "Possible", "hERG?"),
        F.when(ames == "Possible", "AMES?"),
        F.when(pains, "PAINS"),
        F.when(brenk, "Brenk"),
    )
    return first_match(
        [
            (flags != "", F.concat(F.lit("FLAG("), flags, F.lit(")"))),
            (warns != "", F.concat(F.lit("WARN("), warns, F.lit(")"))),
        ],
        "CLEAN",
    )
