"""Large runs of lines that agree in some blocks."""

import random

from foliant.llm import lines


def test_lines_of_a_big_run_meet_few_others(spark):
    """op6_line_dedup: each line of a run that its first is not near to met the whole run."""
    r = random.Random(8)
    sims = [r.getrandbits(38) << 26 | 12345 for _ in range(1500)]
    for s in sims[:300]:
        for b in r.sample(range(64), r.randint(0, 3)):
            s ^= 1 << b
        sims.append(s)
    rows = [(7, True, (k, 10, s - (1 << 64) if s >> 63 else s)) for k, s in enumerate(sims)]
    rows += [(key, False, (k, 10, 1 << k)) for key in (8, 9) for k in range(5)]
    df = spark.createDataFrame(rows, "key int, big boolean, x struct<id:int, len:int, sim:long>")
    met = [tuple(p) for p in lines._meetings(df, df.withColumnRenamed("x", "y")).select("key", "x.id", "y.id").collect()]
    near = {(7, a, b) for a, x in enumerate(sims) for b, y in enumerate(sims) if (x ^ y).bit_count() <= lines.DISTANCE}
    assert len(met) == len(set(met)) and near <= set(met) and len(near) > len(sims) + 500
    assert {(key, a, b) for key in (8, 9) for a in range(5) for b in range(5)} == {p for p in met if p[0] != 7}
    assert len(met) < len(sims) ** 2 / 20


def test_line_groups_with_big_runs(spark, monkeypatch):
    """op6_line_dedup: the same lines are kept whether runs count as big or not."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(40)]
    texts = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(50)]
        for _ in range(8):
            x = list(base)
            x[r.randrange(50)] = r.choice(words)
            texts.append(" ".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def kept(big):
        monkeypatch.setattr(lines, "BIG", big)
        return {x.doc_id for x in lines.line_groups(df).where("keep").collect()}

    found = kept(1)
    assert found == kept(10**6) and len(found) < 200
