"""Where the toxicity model is trained."""

import os

import numpy as np

from quadframe.llm import toxicity


def test_training_runs_outside_the_driver(spark, monkeypatch):
    """A task trains, with the same result, so that its arrays never stand in the driver's memory."""
    toxic, clean, bags = [("glorpish", 5.0, 9), ("glorp", 4.5, 7)], [(f"word{k}", 40 - k) for k in range(30)], [[0], [0, 1]]
    weights, bias = toxicity._trained(spark, toxic, clean, bags)
    plain, own = toxicity.train_words(toxic, clean, bags)
    assert weights.dtype == np.float32 and weights.flags.writeable and np.allclose(weights, plain, atol=1e-6) and abs(bias - own) < 1e-6
    monkeypatch.setattr(toxicity, "train_words", lambda *_: (np.array([os.getpid()], np.float32), 0.0))
    assert toxicity._trained(spark, toxic, clean, bags)[0][0] != os.getpid()
