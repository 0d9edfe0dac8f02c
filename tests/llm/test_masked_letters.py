"""The toxicity pre-filter lets masked and missing letters through to the string kernel."""

import numpy as np

from octaspark.llm import toxicity


def test_masked_and_missing_letters_are_scored():
    marks = ["trash", "idiot", "clown", "loser"]
    model = toxicity.Model(marks, [], np.ones(len(marks)), -1.0, 0.0, 8.0)
    words = [w for x in ("tr*sh", "t*ash", "idi*t", "cl*wn", "clo*n", "l*ser", "lo*er", "tra*h") for w in toxicity.windows(x)]
    assert len(words) == 8 and model.near(words).all()
    full = model.bias + toxicity.normalized(words, model.marks, model.self) @ model.weights
    assert np.allclose(model.values(words), full) and (full > model.bias + 0.1).all()
