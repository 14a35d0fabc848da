"""Column expressions and schema-time helpers.

All row-level work is a Catalyst expression; wide projections are built as
SQL strings (one ``selectExpr``), never as ``withColumn`` loops.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import (BENIGN, LABEL_MARKERS, LEAKAGE_CONTAINS, LEAKAGE_EXACT,
                     SCENARIO_LDAP, SCENARIO_SYN, SCENARIO_UDP)


def q(name: str) -> str:
    """Back-quote a column name for SQL strings."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- P1 header normalisation -------------------------------------------------

def normalise_name(raw: str) -> str:
    return raw.strip().lower().replace(" ", "_")


def normalise_names(raw: Sequence[str]) -> list[str]:
    """Normalised, unique names for a raw header.

    Exact raw repeats get ``.1``, ``.2`` ... as the pandas reader does; when
    normalisation makes two names equal (``label`` vs ``Label``) the *last*
    keeps the name -- the one later steps pick -- and earlier ones are
    renamed: a dummy ``label`` becomes ``_extractor_label``, anything else
    ``<name>_dup``; further repeats and clashes get ``_2``, ``_3`` ...
    """
    # A repeat takes the smallest ``name.k`` that clashes with no raw name
    # anywhere in the header and no name already given (the CSV reader's rule).
    taken_raw = set(raw)
    counter: dict[str, int] = {}
    used: set[str] = set()
    mangled = []
    for r in raw:
        if r not in used:
            mangled.append(r)
            used.add(r)
            continue
        k = counter.get(r, 1)
        while f"{r}.{k}" in taken_raw or f"{r}.{k}" in used:
            k += 1
        counter[r] = k + 1
        mangled.append(f"{r}.{k}")
        used.add(f"{r}.{k}")
    names = [normalise_name(m) for m in mangled]
    last = {n.lower(): i for i, n in enumerate(names)}
    taken = {names[i].lower() for i in last.values()}
    out = list(names)
    for i, n in enumerate(names):
        if last[n.lower()] == i:
            continue
        base = "_extractor_label" if n.lower() == "label" else f"{n}_dup"
        cand, k = base, 1
        while cand.lower() in taken:
            k += 1
            cand = f"{base}_{k}"
        taken.add(cand.lower())
        out[i] = cand
    return out


# --- P2 source-IP column -----------------------------------------------------

def source_ip_column(columns: Iterable[str]) -> str | None:
    """First column whose name contains both ``src`` and ``ip``."""
    for c in columns:
        if "src" in c and "ip" in c:
            return c
    return None


# --- P3 / P4 / P5 path-derived names -----------------------------------------

def attack_from_path(path: Column) -> Column:
    """Name of the file's parent directory."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def canonical_dns(attack: Column) -> Column:
    """A name containing ``DNS`` but not ``DrDoS_`` becomes ``DrDoS_DNS``."""
    return F.when(attack.contains("DNS") & ~attack.contains("DrDoS_"),
                  F.lit("DrDoS_DNS")).otherwise(attack)


def flat_name(rel_path: Column) -> Column:
    """P5: relative directory path with separators turned into ``_``."""
    return F.regexp_replace(rel_path, "/", "_")


# --- P6 topological label ----------------------------------------------------

def topology_label(src: Column, attackers: Sequence[str] | str,
                   attack: Column | str) -> Column:
    """``attack`` when the source equals an attacker address, else BENIGN.

    Exact string match; a null source is BENIGN.  A short attacker list is
    an IN-list (narrow); for a table of attackers see ``topology_label_join``.
    """
    if isinstance(attackers, str):
        attackers = [attackers]
    attack_col = F.lit(attack) if isinstance(attack, str) else attack
    hit = src.cast("string").isin(list(attackers))
    return F.when(F.coalesce(hit, F.lit(False)), attack_col).otherwise(F.lit(BENIGN))


def topology_label_join(flows: DataFrame, src: str, attackers: DataFrame, address: str,
                        attack: Column, out: str = "label") -> DataFrame:
    """P6 for a table of attacker addresses of any size: a left join with the
    distinct addresses; Spark broadcasts them while they are few."""
    known = attackers.select(F.col(address).cast("string").alias("_attacker")).filter("_attacker is not null").distinct()
    joined = flows.join(known, F.col(src).cast("string") == F.col("_attacker"), "left")
    return joined.withColumn(out, F.when(F.col("_attacker").isNotNull(), attack).otherwise(F.lit(BENIGN))).drop("_attacker")


# --- P8 / P9 leakage pruning and label resolution ------------------------------

def label_column(columns: Sequence[str]) -> str | None:
    """Last column whose name contains ``label`` or ``class``."""
    cands = [c for c in columns if any(m in c for m in LABEL_MARKERS)]
    return cands[-1] if cands else None


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Columns left after identifiers and every label candidate go."""
    out = []
    for c in columns:
        if c in LEAKAGE_EXACT or any(p in c for p in LEAKAGE_CONTAINS):
            continue
        if any(m in c for m in LABEL_MARKERS):
            continue
        out.append(c)
    return out


# --- P10 binary target --------------------------------------------------------

def binary_target(label: Column) -> Column:
    """0 when the label mentions ``benign`` (any case), else 1; null -> 1."""
    text = F.lower(F.coalesce(label.cast("string"), F.lit("nan")))
    return F.when(text.contains("benign"), F.lit(0)).otherwise(F.lit(1))


# --- P11 feature alignment ------------------------------------------------------

def align(df: DataFrame, train_columns: Sequence[str]) -> DataFrame:
    """Test columns in train order; a column unseen in test is 0; extras drop."""
    have = set(df.columns)
    exprs = [q(c) if c in have else f"0 AS {q(c)}" for c in train_columns]
    return df.selectExpr(*exprs)


def unseen_columns(train_columns: Sequence[str], test_columns: Sequence[str]) -> list[str]:
    """Train columns the test frame lacks (in train order)."""
    test = set(test_columns)
    return [c for c in train_columns if c not in test]


# --- P12 / P13 run-log defaults -------------------------------------------------

def infer_tool(tool: Column, path: Column) -> Column:
    """Tool name, inferred from the log path when missing.

    One rule for both report variants: hints of B first (``ntl`` or
    ``temp_``), then C (``alflowlyzer`` or ``al_raw``), then A (``cic``).
    """
    p = F.lower(path)
    guess = (F.when(p.contains("ntl") | path.contains("temp_"), F.lit("NTLFlowLyzer"))
             .when(p.contains("alflowlyzer") | p.contains("al_raw"), F.lit("ALFlowLyzer"))
             .when(p.contains("cic"), F.lit("CICFlowMeter"))
             .otherwise(F.lit("Unknown")))
    return F.when(tool.isNull() | (tool == F.lit("Unknown")), guess).otherwise(tool)


def attack_from_log_name(attack: Column, path: Column) -> Column:
    """Attack from ``benchmark_<attack>.json`` when the key is missing."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(attack, F.regexp_replace(F.regexp_replace(name, "benchmark_", ""),
                                               r"\.json", ""))


# --- P14 report rounding ----------------------------------------------------------

def zero_round(c: Column, digits: int = 4) -> Column:
    """Missing or NaN -> 0, then rounded (half up, as ``F.round``)."""
    return F.round(F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0)), digits)


# --- P15 scenario mapping -----------------------------------------------------------

def scenario_name(attack: Column) -> Column:
    """First hit wins: UDPLag -> null; Syn / UDP / LDAP -> display names."""
    return (F.when(attack.contains("UDPLag"), F.lit(None).cast("string"))
            .when(attack.contains("Syn"), F.lit(SCENARIO_SYN))
            .when(attack.contains("UDP"), F.lit(SCENARIO_UDP))
            .when(attack.contains("LDAP"), F.lit(SCENARIO_LDAP))
            .otherwise(attack))


# --- P16 unit scaling -----------------------------------------------------------

def to_millions(c: Column) -> Column:
    return c.cast("double") / F.lit(1e6)


def mb_to_gb(c: Column) -> Column:
    return c.cast("double") / F.lit(1024.0)


# --- P17 feature-rank strings -------------------------------------------------------

def rank_entry(name: Column, mean: Column, std: Column) -> Column:
    """``name (mean±std)`` at three decimals."""
    return F.format_string("%s (%.3f±%.3f)", name, mean, std)


def joined_in_order(order: Column, text: Column, sep: str = ", ") -> Column:
    """Aggregate: ``text`` values joined in ``order`` (bounded groups only)."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pairs, lambda s: s["t"]), sep)
