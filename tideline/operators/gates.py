"""Validation gates: a positive and a null arm each, their verdicts, and the order and status rules of a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.stats import binomial_upper

STATUSES = ("PASS", "RECORD", "SKIPPED", "UNAVAILABLE", "FAIL", "ERROR")


@dataclass
class Gate:
    """run() gives (status, metrics); `tool` names an external tool that must be importable, `after` gates that must be green."""

    name: str
    arm: str
    run: Callable[[], tuple[str, dict]]
    after: list[str] = field(default_factory=list)
    tool: str | None = None


def preflight(ledger: DataFrame, modules: DataFrame) -> DataFrame:
    """(gate, arm, problem): modules without a ledger row, ledger rows without a module, gates whose null arm is missing."""
    keys = ["gate", "arm"]
    return (
        modules.join(ledger, keys, "left_anti").select(*keys, F.lit("not in the ledger").alias("problem"))
        .unionByName(ledger.join(modules, keys, "left_anti").select(*keys, F.lit("no module").alias("problem")))
        .unionByName(modules.where("arm = 'positive'").join(modules.where("arm = 'null'").select("gate"), "gate", "left_anti").select(*keys, F.lit("no null arm").alias("problem")))
    )


def ordered(gates: list[Gate]) -> list[Gate]:
    """Gates after what they depend on; a circle is an error."""
    out, names = [], set()
    left = list(gates)
    while left:
        ready = [g for g in left if all(a in names or a not in {x.name for x in gates} for a in g.after)]
        if not ready:
            raise ValueError("the gates depend on each other in a circle")
        out += ready
        names |= {g.name for g in ready if not any(o.name == g.name and o not in ready for o in left)}
        left = [g for g in left if g not in ready]
    return out


def run(gates: list[Gate]) -> list[tuple[str, str, str, dict]]:
    """(name, arm, status, metrics) of each. Without its tool a gate is UNAVAILABLE, never PASS; after one that isn't green it is SKIPPED."""
    import importlib.util

    out, status = [], {}
    for g in ordered(gates):
        metrics: dict = {}
        if any(status.get(a) in ("FAIL", "ERROR", "SKIPPED", "UNAVAILABLE") for a in g.after):
            now = "SKIPPED"
        elif g.tool and importlib.util.find_spec(g.tool) is None:
            now = "UNAVAILABLE"
        else:
            try:
                now, metrics = g.run()
            except Exception as e:  # a gate's failure is a result
                now, metrics = "ERROR", {"error": str(e)}
        status[g.name] = max(status.get(g.name, "PASS"), now, key=STATUSES.index)
        out.append((g.name, g.arm, now, metrics))
    return out


def severity(status: Column) -> Column:
    return F.when(status == "ERROR", 3).when(status == "FAIL", 2).when(status.isin("SKIPPED", "UNAVAILABLE"), 1).otherwise(0)


def overall(results: DataFrame, keys: list[str]) -> DataFrame:
    """ERROR over FAIL over INCOMPLETE over PASS."""
    worst = F.max(severity(F.col("status")))
    return results.groupBy(*keys).agg(F.element_at(F.array(*map(F.lit, ("PASS", "INCOMPLETE", "FAIL", "ERROR"))), worst + 1).alias("verdict"))


def detection(pairs: DataFrame, keys: list[str], a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Wins of a over b of n pairs, ties counting as losses, and whether their odds are under alpha."""
    got = pairs.groupBy(*keys).agg(F.sum(F.when(F.col(a) > F.col(b), 1).otherwise(0)).cast("int").alias("k"), F.count("*").cast("int").alias("n"))
    p = binomial_upper(F.col("k"), F.col("n"))
    return got.select(*keys, "k", "n", p.alias("p"), (p < alpha).alias("pass"))


def null_arm(pairs: DataFrame, keys: list[str], a: str, b: str, least: float, alpha: float = 0.05) -> DataFrame:
    """Ties dropped; fails only if the two-sided odds are under alpha and the median excess is over `least`."""
    far = F.sqrt(F.greatest(F.lit(0.0), F.col(a) * F.col(a) - F.col(b) * F.col(b)))
    got = pairs.groupBy(*keys).agg(F.sum(F.when(F.col(a) > F.col(b), 1).otherwise(0)).cast("int").alias("k"), F.sum(F.when(F.col(a) != F.col(b), 1).otherwise(0)).cast("int").alias("n"), F.percentile(far, 0.5).alias("effect"))
    p = F.least(F.lit(1.0), 2 * F.least(binomial_upper(F.col("k"), F.col("n")), binomial_upper(F.col("n") - F.col("k"), F.col("n"))))
    return got.select(*keys, "k", "n", p.alias("p"), "effect", (~((p < alpha) & (F.col("effect") > least))).alias("pass"))


def white_noise_null(fits: DataFrame, chi: float = 0.10, knee: float | None = 1.0) -> DataFrame:
    """Whether the mean exponent, and the mean knee if asked for, of white-noise fits are near 0."""
    ok = (F.abs(F.avg("chi")) < chi) & (F.lit(True) if knee is None else F.abs(F.avg("knee")) < knee)
    return fits.agg(F.avg("chi").alias("chi"), F.count("*").alias("n"), ok.alias("pass"))


def determinism(digests: DataFrame) -> DataFrame:
    """Digests (seed, attempt, digest): one a seed, and as many different ones as seeds."""
    per = digests.groupBy("seed").agg(F.countDistinct("digest").alias("d"), F.first("digest").alias("digest"))
    return per.agg((F.max("d") == 1).alias("repeats"), (F.countDistinct("digest") == F.count("*")).alias("differs"), F.count("*").alias("seeds"))


def topography(best: DataFrame, expected: DataFrame) -> DataFrame:
    """Generators whose strongest channel is among those expected."""
    hit = best.join(expected, ["generator", "channel"], "left_semi").select("generator", F.lit(True).alias("match"))
    return best.join(hit, "generator", "left").select("generator", "channel", F.coalesce("match", F.lit(False)).alias("match"))


def bisected(measure: Callable[[float], float], target: float, lo: float = -24.0, hi: float = 24.0, halvings: int = 24) -> float:
    """The gain at which a rising measure reaches the target, from above."""
    for _ in range(halvings):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if measure(mid) >= target else (mid, hi)
    return hi


def report(results: list[tuple[str, str, str, dict]]) -> str:
    """Lines of name, arm, status and metrics, then the verdict."""
    worst = max((3 if s == "ERROR" else 2 if s == "FAIL" else 1 if s in ("SKIPPED", "UNAVAILABLE") else 0 for _, _, s, _ in results), default=1)
    lines = [f"{n} {a}: {s} {' '.join(f'{k}={v}' for k, v in m.items())}".rstrip() for n, a, s, m in results]
    return "\n".join([*lines, ("PASS", "INCOMPLETE", "FAIL", "ERROR")[worst]]) + "\n"


def report_table(results: list[tuple[str, str, str, dict]]) -> dict:
    """The report as a structure for JSON: gates in order with their status, metrics and the standing of each threshold, counts by status, and the verdict."""
    counts: dict[str, int] = {}
    for _, _, status, _ in results:
        counts[status] = counts.get(status, 0) + 1
    gates = [{"gate": n, "arm": a, "status": s, "metrics": {k: v for k, v in m.items() if v == v}} for n, a, s, m in results]
    return {"version": 1, "verdict": report(results).splitlines()[-1], "counts": dict(sorted(counts.items())), "gates": gates}


def write_report(spark, results: list[tuple[str, str, str, dict]], path: str) -> None:
    """The report as text and as JSON, side by side in one folder."""
    import json

    rows = [("report.txt", report(results)), ("report.json", json.dumps(report_table(results), sort_keys=True, indent=1))]
    spark.createDataFrame(rows, "name string, value string").repartition(2, "name").write.partitionBy("name").mode("overwrite").text(path)
