"""The validation run: every gate's positive and null arm over seeded runs, all seeds and arms in one job each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import dsp, generators
from tideline.functions.rng import Stream
from tideline.operators import gates, joins, samples, spectra, stats
from tideline.plans.base import Book
from tideline.sources import montage

BOOK = Book()
query, QUERIES, SQL = BOOK.query, BOOK.QUERIES, BOOK.SQL
FS = 256.0
#: The smallest modulation that counts.
SMALLEST = 0.048
#: The built-in spindle detector: band, seconds of the running level, level over its median, and bounds of a spindle's seconds.
SPINDLES = {"lo": 11.0, "hi": 16.0, "level_s": 0.2, "over": 2.5, "least_s": 0.4, "most_s": 2.5}


def measured(spark: SparkSession, runs: list[dict], kernel: Callable[[dict], list[float]], names: list[str]) -> DataFrame:
    """One row a run (seed, arm, and the kernel's numbers); each run is made and measured in one task."""

    def go(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for r in batch.to_dict("records"):
                yield pd.DataFrame([(r["seed"], r["arm"], *kernel(r))], columns=["seed", "arm", *names])

    table = spark.createDataFrame([(i, r["seed"], r["arm"], r["state"], float(r["depth"]), float(r["snr"]), bool(r["events"]), float(r["seconds"])) for i, r in enumerate(runs)], "id int, seed int, arm string, state string, depth double, snr double, events boolean, seconds double")
    return table.repartitionByRange(len(runs), "id").mapInPandas(go, "seed int, arm string, " + ", ".join(f"{n} double" for n in names))


def arms(seeds: int, seconds: float, **by_arm: dict) -> list[dict]:
    return [{"seed": 1000 + s, "arm": a, "state": "n3", "depth": 0.0, "snr": 0.0, "events": True, "seconds": seconds, **o} for a, o in by_arm.items() for s in range(seeds)]


def _record(r: dict, channel: str):
    return generators.compose(r["state"], r["seed"], r["seconds"], FS, depth=r["depth"], snr_db=r["snr"], events=r["events"], channels=[channel])


def _fit(x, lo: float, hi: float, knee: bool) -> tuple[float, float]:
    _, f, p = dsp.welch(x, FS, 1024, 512)
    ok = (f >= lo) & (f <= hi) & (p > 0)
    if knee:
        best = dsp.fit_knee(f[ok], p[ok], spectra.knee_grid())
        return best["chi"][0], best["knee"][0]
    return dsp.fit_line(f[ok], p[ok])[0], 0.0


def exponent_gate(spark, seeds: int, seconds: float, knee: bool) -> list[tuple[str, dict]]:
    """Recovery error of the exponent is recorded; on white noise it must be near 0."""
    band = (1.0, 45.0) if knee else (30.0, 45.0)
    both = {s: {"state": s, "events": False} for s in ("rem", "n3")}
    got = measured(spark, arms(seeds, seconds, **both), lambda r: [_fit(_record(r, "Pz")["channels"]["Pz"], *band, knee)[0] - generators.CHI[r["state"]]], ["error"])
    error = {r["arm"]: round(r["median"], 4) for r in stats.quartiles(got, ["arm"], "error").collect()}
    noise = measured(spark, arms(seeds, seconds, white={}), lambda r: list(_fit(Stream(r["seed"], "white").generator().standard_normal(round(r["seconds"] * FS)), *band, False)), ["chi", "knee"])
    null = gates.white_noise_null(noise, knee=None).first()
    return [("RECORD", {"median_error": error}), ("PASS" if null["pass"] else "FAIL", {"chi": round(null["chi"], 4)})]


def determinism_gate(spark, seeds: int, seconds: float) -> list[tuple[str, dict]]:
    import hashlib

    def digest(r: dict) -> list[float]:
        raw = hashlib.sha256(_record(r, "Cz")["channels"]["Cz"].tobytes()).digest()
        return [float(int.from_bytes(raw[:6], "little"))]

    got = measured(spark, arms(seeds, seconds, first={}, second={}), digest, ["digest"])
    row = gates.determinism(got.select("seed", "digest")).first()
    return [("PASS" if row["repeats"] else "FAIL", {"seeds": row["seeds"]}), ("PASS" if row["differs"] else "FAIL", {})]


def modulation_gate(spark, seeds: int, seconds: float) -> list[tuple[str, dict]]:
    """The exponent moves with breathing if it is made to: at the breathing phase, and not without modulation."""

    def depth(r: dict) -> list[float]:
        import numpy as np

        got = _record(r, "Fz")
        chi = dsp.exponent_over_time(got["channels"]["Fz"], FS, 2.0, 0.25, 2.0, 40.0)
        phase = got["phase"][(np.arange(len(chi)) * 64 + 256).astype(int)]
        ok = np.isfinite(chi)
        on = 2 * abs(np.mean((chi[ok] - chi[ok].mean()) * np.exp(1j * phase[ok])))
        off = 2 * abs(np.mean((chi[ok] - chi[ok].mean()) * np.exp(1.7j * phase[ok])))
        return [float(on), float(off)]

    made = measured(spark, arms(seeds, seconds, on={"depth": 2.0, "events": False, "state": "wake_eo"}, off={"events": False, "state": "wake_eo"}), depth, ["own", "other"])
    got = spark.createDataFrame(made.collect(), made.schema)  # a row a seed and arm, used by both arms' verdicts
    found = gates.detection(joins.paired(got, ["seed"], "arm", "on", "off", "own").withColumn("g", F.lit(1)), ["g"], "a", "b").first()
    null = gates.null_arm(got.where("arm = 'off'").select("seed", F.col("own").alias("a"), F.col("other").alias("b"), F.lit(1).alias("g")), ["g"], "a", "b", SMALLEST * 4).first()
    return [("PASS" if found["pass"] else "FAIL", {"k": found["k"], "n": found["n"]}), ("PASS" if null["pass"] else "FAIL", {"p": round(null["p"], 4)})]


def slow_wave_gate(spark, seeds: int, seconds: float) -> list[tuple[str, dict]]:
    """Share of half waves of 75 uV: recorded for deep sleep, and larger there than in light sleep or at -6 dB."""

    def share(r: dict) -> list[float]:
        x = dsp.cascade(_record(r, "C3")["channels"]["C3"] - _record(r, "A2")["channels"]["A2"], dsp.sections(FS, 0.5, 2.0))
        counted, at = 0, 0
        sign = x < 0
        for i in range(1, len(x) + 1):
            if i == len(x) or sign[i] != sign[at]:
                if i - at >= 2 and 2 * abs(x[at:i]).max() >= 75:
                    counted += i - at
                at = i
        return [counted / len(x)]

    got = measured(spark, arms(seeds, seconds, deep={}, light={"state": "n2"}, weak={"snr": -6.0}), share, ["share"]).groupBy("arm").agg(F.avg("share").alias("m"), F.avg((F.col("share") >= 0.2).cast("int")).alias("met"))
    by = {r["arm"]: r for r in got.collect()}
    return [("RECORD", {"met": round(by["deep"]["met"], 3)}), ("PASS" if by["deep"]["m"] > max(by["light"]["m"], by["weak"]["m"]) else "FAIL", {})]


def detected(x, fs: float = FS) -> list[tuple[float, float]]:
    """(onset, duration) of runs in which the band's running level stays above a multiple of its median. A plain stand-in for an
    external detector, whose figures it doesn't reproduce."""
    import numpy as np

    p = SPINDLES
    band, width = dsp.cascade(np.asarray(x, float), dsp.sections(fs, p["lo"], p["hi"])), max(1, round(p["level_s"] * fs))
    level = np.sqrt(np.convolve(band * band, np.ones(width) / width, "same"))
    high = np.r_[False, level > p["over"] * np.median(level), False]
    starts, ends = np.flatnonzero(~high[:-1] & high[1:]), np.flatnonzero(high[:-1] & ~high[1:])
    return [(s / fs, (e - s) / fs) for s, e in zip(starts, ends, strict=True) if p["least_s"] <= (e - s) / fs <= p["most_s"]]


def matched(truth: list[tuple[float, float]], found: list[tuple[float, float]], share: float = 0.2) -> int:
    """How many true events (onset, duration), in order, find an unused detection that overlaps them by more than a share of their duration."""
    used: set[int] = set()
    for onset, duration in sorted(truth):
        over = [(min(onset + duration, a + d) - max(onset, a), -a, i) for i, (a, d) in enumerate(found) if i not in used]
        best = max(over, default=(0.0, 0.0, -1))
        if best[0] > share * duration:
            used.add(best[2])
    return len(used)


def spindle_gate(spark, seeds: int, seconds: float) -> list[tuple[str, dict]]:
    """F1 of the built-in detector is recorded, not judged; without events it must find fewer than with them, in more seeds than chance gives."""

    def count(r: dict) -> list[float]:
        run = _record(r, "Cz")
        truth = [(e["onset"], e["duration"]) for e in run["events"] if e["type"].startswith("spindle")]
        found = detected(run["channels"]["Cz"])
        return [float(len(truth)), float(len(found)), float(matched(truth, found))]

    made = measured(spark, arms(seeds, seconds, on={"state": "n2"}, off={"state": "n2", "events": False}), count, ["truth", "found", "hits"])
    got = spark.createDataFrame(made.collect(), made.schema)  # a row a seed and arm
    total = got.where("arm = 'on'").agg(F.sum("truth").alias("truth"), F.sum("found").alias("found"), F.sum("hits").alias("hits")).first()
    f1 = 2 * total["hits"] / max(1.0, total["truth"] + total["found"])
    fewer = gates.detection(joins.paired(got, ["seed"], "arm", "on", "off", "found").withColumn("g", F.lit(1)), ["g"], "a", "b").first()
    return [("RECORD", {"f1": round(f1, 3), "injected": int(total["truth"]), "detected": int(total["found"]), "detector": "built-in"}), ("PASS" if fewer["pass"] else "FAIL", {"k": fewer["k"], "n": fewer["n"]})]


def topography_gate(spark) -> list[tuple[str, dict]]:
    """Each generator is strongest where it should be; with the weights of another generator it isn't."""
    want = spark.createDataFrame([("alpha", "O1"), ("alpha", "O2"), ("alpha", "Pz"), ("theta", "Fz"), ("slow_osc", "Fz"), ("spindle_fast", "Pz"), ("spindle_fast", "Cz")], "generator string, channel string")
    names = ["alpha", "theta", "slow_osc", "spindle_fast"]
    w = montage.weights(spark).where(F.col("patch").isin(names) & ~F.col("channel").isin("A1", "A2")).join(montage.table(spark).select("channel", "place"), "channel")
    best = lambda t: samples.first_largest(t, ["patch"], F.col("w"), F.col("place")).select(F.col("patch").alias("generator"), "channel")
    hits = gates.topography(best(w), want).where("match").count()
    turned = w.withColumn("patch", F.element_at(F.create_map(*[F.lit(x) for p in zip(names, ["theta", "alpha", "spindle_fast", "slow_osc"], strict=True) for x in p]), F.col("patch")))
    left = gates.topography(best(turned), want).where("match").count()
    return [("PASS" if hits == 4 else "FAIL", {"hits": hits}), ("PASS" if left == 0 else "FAIL", {"left": left})]


def validation(spark: SparkSession, seeds: int = 6, seconds: float = 60.0) -> list[tuple[str, str, str, dict]]:
    """(gate, arm, status, metrics) of all gates; each gate's arms are measured once."""
    made: dict[str, list] = {}
    jobs = {
        "G1a": lambda: exponent_gate(spark, seeds, seconds, True),
        "G1b": lambda: exponent_gate(spark, seeds, seconds, False),
        "G2": lambda: determinism_gate(spark, min(5, seeds), min(seconds, 10.0)),
        "G3": lambda: spindle_gate(spark, seeds, 2 * seconds),
        "G4": lambda: modulation_gate(spark, seeds, 4 * seconds),
        "G5": lambda: slow_wave_gate(spark, seeds, seconds),
        "G6": lambda: topography_gate(spark),
    }

    def arm(name: str, which: int) -> Callable[[], tuple[str, dict]]:
        def go() -> tuple[str, dict]:
            if name not in made:
                made[name] = jobs[name]()
            return made[name][which]

        return go

    todo = [gates.Gate(n, a, arm(n, i), after=[] if n == "G2" else ["G2"]) for n in jobs for i, a in enumerate(("positive", "null"))]
    return gates.run(todo)


@query()
def validation_run(spark, sf_dir) -> DataFrame:
    """All gates at a size that a laptop runs in seconds."""
    rows = [(g, a, s, str(m)) for g, a, s, m in validation(spark, 5, 16.0)]
    return spark.createDataFrame(rows, "gate string, arm string, status string, metrics string")
