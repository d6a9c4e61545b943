"""The classifier's shape features read whole texts."""

import pytest

pytest.importorskip("tideline.llm")
from tideline.llm.quality import Features


def test_shape_reads_past_a_clean_beginning():
    clean = " ".join(f"w{i}" for i in range(3000))
    assert clean.islower() and len(clean) > 4000
    of = Features().of
    repeated = of(clean + " spam" * 9000)[1]
    assert repeated[2] == pytest.approx(9000 / 12_000)
    shouted = clean + " LOUD" * 9000
    assert of(shouted)[1][5] == pytest.approx(36_000 / len(shouted))
    assert of("")[1][[2, 5]].tolist() == [0.0, 0.0] and of(None)[1][[2, 5]].tolist() == [0.0, 0.0]
