"""More languages than the matrix has room for at full width."""

import random

from foliant.llm import langid


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 300 * 1024)
    r = random.Random(3)
    made = {}
    for k in range(300):
        letters = r.sample("abcdefghijklmnopqrstuvwxyz", 5)
        made[f"l{k:03d}"] = lambda n, letters=letters: " ".join("".join(r.choices(letters, k=4)) for _ in range(n))
    rows = [(name, text(60)) for name, text in made.items() for _ in range(2)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model.languages) == 300 and model.log_prob.shape == (300, 1024)
    held = [(name, text(60)) for name, text in made.items()]
    found = langid.predict(spark.createDataFrame(held, "lang string, text string"), model).collect()
    assert sum(x.lang_pred == x.lang for x in found) > 0.9 * len(held)
