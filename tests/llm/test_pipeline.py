"""The pipeline, stage by stage, against brute force."""

from collections import Counter, defaultdict

import pytest

pytest.importorskip("tideline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_operators import COLUMNS, ODD, check_packing, corpus  # noqa: F401
from tests.llm.test_near_duplicates import groups_of
from tideline.llm import lines, quality
from tideline.llm.queries import ratings

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, corpus, tmp_path):  # noqa: F811
    rng = np.random.default_rng(4)
    junk = [(1000 + i, " ".join(f"{w}%%% ###" for w in rng.choice(["a", "bb", "ccc"], 40)), "en", "s1", 1) for i in range(20)]
    toxic = [(2000 + i, " ".join(rng.choice([f"w{k}" for k in range(200)] + ["vile"] * 30, 80)), "en", "s2", 1) for i in range(20)]
    rows = [r for r in ODD if r[0] != 1] + [(10_000 + r[0], *r[1:]) for r in corpus] + junk + toxic
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(10_000 + i, 1, 0) for i in range(90)] + [(1000 + i, 0, 0) for i in range(20)] + [(2000 + i, 1, 1) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir, docs, out = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or docs.columns == NAMES
        out[name] = [tuple(r) for r in docs.collect()]
    key = lambda r: (r[0], r[1])

    model = quality.learn(spark.createDataFrame(rows, COLUMNS), ratings(spark, sf_dir))
    features, good = quality.Features(), []
    for r in rows:
        slots, shape = features.of(r[1])
        score = float(model.weights[slots].sum() + shape @ model.weights[: len(shape)])
        above = 1 / (1 + np.exp(model.thresholds - score))
        if 1 - above[0] <= quality.TOXIC_AT_MOST and 1 - above[-1] <= quality.POOR_AT_MOST:
            good.append(r)
    assert Counter(map(key, out["quality"])) == Counter(map(key, good))
    gone = {r[0] for r in rows} - {r[0] for r in out["quality"]}
    assert len(gone & {1000 + i for i in range(20)}) >= 18 and len(gone & {2000 + i for i in range(20)}) >= 18
    assert len(gone & {10_000 + i for i in range(90)}) <= 4

    seen, want = [], []
    for r in sorted(out["quality"], key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (r[1] or "").split("\n"):
            have = set(line.lower().split())
            same = len(have) >= lines.LEAST and any(9 * len(have & s) >= 4 * (len(have) + len(s)) for s in seen)
            if len(have) >= lines.LEAST:
                seen.append(have)
            if not same:
                kept.append(line)
        want.append((r[0], None if r[1] is None else "\n".join(kept)))
    assert Counter(map(key, out["lines"])) == Counter(want)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in out["lines"])

    root, _ = groups_of([r[1] for r in out["lines"]])
    groups = defaultdict(list)
    for r, g in zip(out["lines"], root, strict=True):
        groups[g].append(r[0])
    first = Counter(min((d for d in g if d is not None), default=None) for g in groups.values())
    assert Counter(r[0] for r in out["near_duplicates"]) == first

    copies, before = Counter(r[0] for r in out["mixing"]), Counter(r[0] for r in out["near_duplicates"])
    assert set(copies) == set(before) and all(copies[d] >= n for d, n in before.items())

    pieces = spark.read.parquet(str(tmp_path / "out4")).collect()
    assert check_packing(pieces, [(r[0], r[1]) for r in out["mixing"]]) > 0.95
    assert all(len(p["ids"]) == 4 * p["length"] for p in pieces)

    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.agg(F.sum("length")).first()[0] == sum(p["length"] for p in pieces)


def test_empty_tables_and_odd_rows_go_through_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows, name in (([], "none"), ([r for r in ODD if r[0] in (2, 3, None)] * 2, "odd")):
        docs = spark.createDataFrame(rows, COLUMNS).withColumn("_row", F.lit(1)).withColumn("tokens", F.lit("x"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            columns, docs = docs.columns, spark.read.parquet(path)
            assert k == 4 or docs.columns == columns
            assert rows or docs.count() == 0
