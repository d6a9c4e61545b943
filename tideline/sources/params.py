"""The parameter registry: typed, tagged values with their standing, as accessors and as a table."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, kind string, meaning string, v double, lo double, hi double, text string, items array<string>, units string, standing string, states array<string>, provisional boolean"
KINDS = ("scalar", "interval", "bound", "enum", "electrodes", "ordering", "pending", "procedure", "absent", "solved")
STANDINGS = ("invented", "chosen", "literature", "derived", "absent", "definitional", "fitted")
STATES = ("wake_eo", "wake_ec", "n1", "n2", "n3", "rem")

# Fixed values, which results depend on: key, kind, value (a number, a pair, a word or a list), units.
FIXED = [
    ("fs", "scalar", 256, "Hz"),
    ("epoch_display", "scalar", 30, "s"),
    ("n_channels", "scalar", 19, ""),
    ("reference_channels", "electrodes", ["A1", "A2"], ""),
    ("welch_nperseg", "scalar", 1024, "samples"),
    ("welch_noverlap", "scalar", 512, "samples"),
    ("welch_window", "enum", "hann", ""),
    ("fit_band_broad", "interval", (1, 45), "Hz"),
    ("fit_band_narrow", "interval", (30, 45), "Hz"),
    ("chi_est_band", "interval", (2, 40), "Hz"),
    ("chi_est_window_s", "scalar", 2.0, "s"),
    ("chi_est_mdd_resp", "scalar", 0.048, ""),
    ("filter_order", "scalar", 4, ""),
    ("hpf_default", "scalar", 0.005, "Hz"),
    ("lpf_default", "scalar", 40, "Hz"),
    ("aasm_band", "interval", (0.5, 2), "Hz"),
    ("aasm_amplitude", "scalar", 75, "uV"),
    ("aasm_fraction", "bound", 0.20, ""),
    ("band_alpha", "interval", (8, 12), "Hz"),
    ("band_beta", "interval", (15, 25), "Hz"),
    ("band_theta", "interval", (4, 7), "Hz"),
    ("band_delta", "interval", (0.5, 2), "Hz"),
    ("band_spindle", "interval", (11, 16), "Hz"),
    ("isf1", "interval", (0.008, 0.05), "Hz"),
    ("isf2", "interval", (0.05, 0.1), "Hz"),
    ("chi_wake_eo", "pending", 0.9, ""),
    ("chi_wake_ec", "pending", 0.85, ""),
    ("chi_n1", "pending", 1.4, ""),
    ("chi_n2", "pending", 1.9, ""),
    ("chi_n3", "pending", 3.4, ""),
    ("chi_rem", "pending", 2.1, ""),
    ("knee_wake_eo", "pending", 9.3597, ""),
    ("knee_wake_ec", "pending", 2.5442, ""),
    ("knee_n1", "pending", 32.4230, ""),
    ("knee_n2", "pending", 1, ""),
    ("knee_n3", "pending", 1, ""),
    ("knee_rem", "pending", 539.7131, ""),
    ("g4_record_s", "scalar", 300, "s"),
    ("g4_f1", "scalar", 0.10, "Hz"),
    ("g4_f2", "scalar", 0.25, "Hz"),
    ("g4_seeds", "scalar", 12, ""),
    ("g4_fixture_depth", "scalar", 2.0, ""),
    ("tilt_n_poles", "scalar", 12, ""),
    ("tilt_block_s", "scalar", 0.75, "s"),
    ("display_buffer_s", "scalar", 90, "s"),
    ("n_seeds", "scalar", 20, ""),
    ("snr_null_offset", "scalar", -6, "dB"),
    ("analysis_update", "scalar", 1, "Hz"),
    ("state_order", "ordering", ["wake_eo", "wake_ec", "n1", "n2", "n3", "rem"], ""),
]


class KindError(TypeError):
    """A parameter was read as a kind that it isn't."""


def rows() -> list[tuple]:
    out = []
    for key, kind, value, units in FIXED:
        number, pair, many = isinstance(value, int | float), isinstance(value, tuple), isinstance(value, list)
        standing = "derived" if kind == "pending" else "definitional" if key == "epoch_display" else "chosen"
        state = next((s for s in STATES if key.endswith(f"_{s}")), None)
        out.append((key, kind, "band_edges" if pair else None, float(value) if number else None, float(value[0]) if pair else None, float(value[1]) if pair else None, value if isinstance(value, str) else None, value if many else None, units, standing, [state] if state else None, kind == "pending"))
    return out


def table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The registry as a table: the built-in values, or a JSON-lines file of the same columns. `states` null means all."""
    return spark.read.schema(SCHEMA).json(path) if path else spark.createDataFrame(rows(), SCHEMA)


class Registry:
    """Typed access by key; a registry has a few hundred rows, held on the driver."""

    def __init__(self, records: list[tuple] | None = None):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        self.by_key = {r[0]: dict(zip(names, r, strict=True)) for r in records or rows()}

    def record(self, key: str) -> dict:
        if key not in self.by_key:
            raise KeyError(f"no parameter {key}")
        return self.by_key[key]

    def _of(self, key: str, *kinds: str) -> dict:
        found = self.record(key)
        if found["kind"] not in kinds:
            raise KindError(f"{key} is of kind {found['kind']}, not {' or '.join(kinds)}")
        return found

    def scalar(self, key: str) -> float:
        return self._of(key, "scalar")["v"]

    def _interval(self, key: str, meaning: str) -> tuple[float, float]:
        found = self._of(key, "interval")
        if found["meaning"] != meaning:
            raise KindError(f"{key} means {found['meaning']}, not {meaning}")
        return found["lo"], found["hi"]

    def band(self, key: str) -> tuple[float, float]:
        return self._interval(key, "band_edges")

    def uncertainty(self, key: str) -> tuple[float, float]:
        return self._interval(key, "uncertainty")

    def ui_domain(self, key: str) -> tuple[float, float]:
        return self._interval(key, "ui_domain")

    def enum(self, key: str) -> str:
        return self._of(key, "enum")["text"]

    def bound(self, key: str) -> float:
        return self._of(key, "bound")["v"]

    def electrodes(self, key: str) -> list[str]:
        return list(self._of(key, "electrodes")["items"])

    def ordering(self, key: str) -> list[str]:
        return list(self._of(key, "ordering")["items"])

    def provisional(self, key: str) -> float:
        """The only way to a pending number."""
        return self._of(key, "pending")["v"]

    def procedure(self, key: str) -> str:
        return self._of(key, "procedure")["text"]

    def solved(self, key: str) -> float:
        return self._of(key, "solved")["v"]

    def applies_to(self, key: str, state: str) -> bool:
        states = self.record(key)["states"]
        return states is None or state in states

    def with_standing(self, standing: str) -> list[str]:
        return [k for k, r in self.by_key.items() if r["standing"] == standing]


def violations(params: DataFrame) -> DataFrame:
    """(key, rule) of every broken rule: one pass, no join."""
    numeric = F.col("kind").isin("scalar", "bound", "pending", "solved")
    rules = {
        "unknown kind": ~F.col("kind").isin(*KINDS),
        "unknown standing": ~F.col("standing").isin(*STANDINGS),
        "a number is missing": numeric & F.col("v").isNull(),
        "an interval's ends are missing or out of order": (F.col("kind") == "interval") & ~F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False)),
        "an interval has no meaning": (F.col("kind") == "interval") & F.col("meaning").isNull(),
        "a list is empty": F.col("kind").isin("electrodes", "ordering") & (F.coalesce(F.size("items"), F.lit(0)) <= 0),
        "absent but with a value": (F.col("kind") == "absent") & F.coalesce("v", "lo", "hi").isNotNull(),
        "pending but not provisional": (F.col("kind") == "pending") & ~F.coalesce("provisional", F.lit(False)),
    }
    broken = F.filter(F.array(*[F.when(broken, rule) for rule, broken in rules.items()]), lambda r: r.isNotNull())
    return params.select("key", F.explode(broken).alias("rule"))


def knee_check(params: DataFrame, frequency: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """States whose knee isn't frequency^exponent within a share: (state, knee, expected)."""
    part = lambda prefix, name: params.where(F.col("key").startswith(prefix)).select(F.substring_index("key", prefix, -1).alias("state"), F.col("v").alias(name))
    met = part("knee_", "knee").join(part("chi_", "chi"), "state").join(frequency, "state").withColumn("expected", F.pow("f", "chi"))
    return met.where(F.abs(F.col("knee") - F.col("expected")) > tolerance * F.col("expected")).select("state", "knee", "expected")


def tally(params: DataFrame) -> DataFrame:
    """Number by standing, and in all (standing null)."""
    return params.rollup("standing").agg(F.count("*").alias("n"))


def emit(records: list[tuple] | None = None) -> str:
    """The registry as stable JSON lines; emitting what was read gives the same text."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return "".join(json.dumps(dict(zip(names, r, strict=True)), sort_keys=True) + "\n" for r in sorted(records or rows()))


def provisional_metrics(dependencies: DataFrame, params: DataFrame) -> DataFrame:
    """(metric, provisional): whether any key of a metric's dependency closure (metric, key) is invented or still pending.

    A metric that rests on such a number must not be shown beside published ones. Keys that aren't in the registry are errors of
    their own (`violations` of the closure) and count as provisional.
    """
    open_ = (F.col("standing") == "invented") | (F.col("kind") == "pending")
    met = dependencies.join(params.select("key", "standing", "kind"), "key", "left")
    return met.groupBy("metric").agg(F.bool_or(F.coalesce(open_, F.lit(True))).alias("provisional"))


def markdown(records: list[tuple] | None = None) -> str:
    """The registry as a Markdown table, keys in order."""
    shown = []
    for r in Registry(records).by_key.values():
        value = r["v"] if r["v"] is not None else f"{r['lo']}..{r['hi']}" if r["lo"] is not None else r["text"] or ", ".join(r["items"] or [])
        shown.append(f"| `{r['key']}` | {r['kind']} | {value} | {r['units'] or ''} | {r['standing']} |")
    return "\n".join(["| key | kind | value | units | standing |", "|-|-|-|-|-|", *sorted(shown)]) + "\n"


def stale(emitted: str, records: list[tuple] | None = None) -> list[str]:
    """Keys whose line in an emitted registry isn't what would be emitted now: changed, missing or left over. None: it is up to date."""
    own, old = ({json.loads(line)["key"]: line for line in text.splitlines()} for text in (emit(records), emitted))
    return sorted(k for k in own.keys() | old.keys() if own.get(k) != old.get(k))


def released(profile: dict, calibration: dict, version: str, **overrides) -> dict:
    """The released options: the profile, the calibrated level, and what is overridden. A calibration without a finite level, or of another
    version, is an error: it must be made anew."""
    level = calibration.get("value_db")
    if not isinstance(level, int | float) or not math.isfinite(level) or calibration.get("generator_version") != version:
        raise ValueError("the release's calibration is missing, invalid or stale")
    return {**profile, "snr_db": level, **overrides}
