"""Conversation trie and source divergence against brute force; the toxicity grammar against its rules and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import convtrie, divergence, toxicity

# --- conversation trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    for node, who in members.items():
        sub = [n for n in members if n[: len(node)] == node]
        kids = [n for n in sub if len(n) == len(node) + 1]
        leaves = [n for n in sub if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in sub if n)
        ends = ",".join(map(str, sorted(c for c in who if rebuilt[c] == node)))
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    r = random.Random(3)
    texts = ["hi", "what is it", "it is a test\tof turns", "", None, "bye", "é ü", " \n "]
    roles = ["user", "assistant", None]
    rows = []
    for c in [*range(0, 47), 60, 61, 75, 400, 401, 419, -20, -19, -3, 10**9]:
        n = r.choice([1, 1, 2, 3, 4, 6, 9])
        for k in range(n):
            rows.append((c, None if k == 0 and r.random() < 0.2 else k, roles[k % 2] if r.random() < 0.9 else None, texts[r.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7])]))
    rows += [(c, k, "user", t) for c in (500, 501, 502, 503) for k, t in enumerate(["same", "turns", "for", "all", "of", "these"])]
    rows += [(500, 3, "user", "all"), (None, 0, "user", "lost"), (700, 5, "user", "only the fifth")]
    return rows


def tried(spark, rows, long=convtrie.LONG, id_run=convtrie.ID_RUN):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, k1 string, depth int").repartition(3)
    found = convtrie.end_digests(convtrie.conversation_trie(df, long=long), id_run)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()


@pytest.mark.parametrize(("long", "id_run"), [(convtrie.LONG, convtrie.ID_RUN), (2, 2)])
def test_conversation_trie(spark, monkeypatch, long, id_run):
    """Once in families, once with nearly all conversations numbered in parts, short segments of chains and several runs of ids."""
    if long == 2:
        monkeypatch.setattr(convtrie, "SEGMENT", 2)
    rows = conversations()
    found = tried(spark, rows, long, id_run)
    want = brute_trie(rows)
    assert len(found) == len(want)
    assert {tuple(r) for r in found} == want


def test_trie_of_nothing(spark):
    assert tried(spark, []) == []
    (root, *_) = found = sorted(tried(spark, [(7, None, None, None)]), key=lambda r: r.depth)
    assert (root.depth, root.n_convs, root.parent_conv_id) == (0, 1, None)
    assert {tuple(r) for r in found} == brute_trie([(7, None, None, None)])


def test_deep_trie(spark):
    """Chains that hang on chains, and copies of one long conversation."""
    rows = [(c, k, "user", f"t{k}" if k < 40 - c else f"own {c}") for c in range(0, 400, 20) for k in range(40)]
    rows += [(c, k, "user", f"t{k}") for c in range(1000, 1200, 20) for k in range(40)]
    assert {tuple(r) for r in tried(spark, rows)} == brute_trie(rows)


# --- divergence


def brute_divergence(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = {t for t, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, s, c in own:
            count[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in count:
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(o, sum(f(p(count[s], t), p(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, f(p(count[s], t), p(whole, t))) for t in count[s] if p(count[s], t) > p(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def divergent():
    r = random.Random(8)
    words = ["alpha", "Beta", "gAMMA", "été", "ÉTÉ", "straße", "日本", "x", "long" * 30, "long" * 30 + "er", *[f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]]
    rows = []
    for k in range(160):
        lang, source = r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c", None, "é"])
        lean = hash((lang, source)) % 7
        text = " ".join(words[min(len(words) - 1, int(r.expovariate(1) * (10 + lean)))] + r.choice(["", ",", "1", "'s"]) for _ in range(r.randint(0, 40)))
        rows.append((lang, source, r.choice([text, text, text, None if k % 9 == 0 else text])))
    rows += rows[:6] + [("xx", "a", "never kept"), ("xx", "b", None), ("yy", "only", "one one one"), ("yy", "only", "one"), ("yy", "only", "One, two")]
    return rows


@pytest.mark.parametrize(("top", "ties"), [(200, 4096), (5, 1)])
def test_divergence(spark, monkeypatch, top, ties):
    """The second time ties are told apart by bytes down to the end."""
    monkeypatch.setattr(divergence, "TIES", ties)
    monkeypatch.setattr(divergence, "PAIRS", 7 if ties == 1 else divergence.PAIRS)
    rows = divergent()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    most = divergence.top_by_radix
    monkeypatch.setattr(divergence, "top_by_radix", lambda rows, n: most(rows, n, ties))
    found = divergence.source_divergence(df, top=top)
    assert {tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()} == brute_divergence(rows, top=top)


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.source_divergence(df).count() == 0


def test_rates_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.rate(F.lit(10**14), F.lit(10**15), F.lit(10**7)).alias("p")).head()
    assert row.p == 1 + 10**9 * (10**14 + 1) // (10**15 + 10**7)


def test_terms_of_a_long_text(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 10)
    text = "Aé" * 300 + " b " + "cde " * 50 + "ÉÉ"
    found = [t.decode() for part in divergence._terms(memoryview(text.encode())) for t in part]
    assert found == ["aé" * 300, "b", *["cde"] * 50, "ÉÉ"]


# --- toxicity


def prior():
    return toxicity._model({}, ())


def value(text, model=None):
    return float(toxicity.scores(pa.array([text], pa.string()), model or prior())[0])


def test_patterns_of_a_clause():
    plain, nothing = value("an idiot at the table"), value("a friend at the table")
    assert value("you are an idiot") > plain > value("this is not an idiot") > nothing
    assert plain > value("someone said that an idiot came") > nothing
    assert value("an idiot, you know") > plain  # the target comes late
    assert value("I will kill you") > value("kill the lights") > nothing
    assert value("she said. idiot at the table") == pytest.approx(plain)  # the clause of speech is over
    assert value("") == value("  \n") == nothing
    assert value("IDIOT…") == value("« idiot »") == value("idiot")


def test_composition_is_one_machine():
    """The tables do what the transducers do one after another."""
    r = random.Random(2)
    g = toxicity.grammar()
    parts = [toxicity._reported(), toxicity._near(toxicity.NEGATION, toxicity.NEGATED, False), toxicity._near(toxicity.TARGET, toxicity.TARGETED, True), toxicity._whole_threat()]
    for _ in range(200):
        state, own = 0, [p.start for p in parts]
        for _ in range(30):
            kind = r.choice(range(8))
            symbol = (kind, 0)
            for k, p in enumerate(parts):
                own[k], symbol = p.step(own[k], symbol)
            pattern = g.out[state][kind]
            hit = symbol[0] in (toxicity.INSULT, toxicity.THREAT) or (symbol[0] == toxicity.TARGET and symbol[1] & toxicity.TARGETED)
            assert (g.patterns[pattern] if pattern >= 0 else None) == (symbol if hit else None)
            state = g.next[state][kind]
    for n in (0, 1, 3, len(g.idle) - 1, 40):
        for s in range(len(g.next)):
            t = s
            for _ in range(n):
                t = g.next[t][toxicity.OTHER]
            assert g.idle[min(n, len(g.idle) - 1)][s] == t


def labelled():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(600)]
    ill = ["grombel", "fnurk", "zwick", *[f"pratz{e}" for e in ("el", "o", "ing", "ung", "as", "ix")]]
    rows = []
    for k in range(900):
        text = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic = k % 5 == 0
        for _ in range(r.randint(1, 4) if toxic else 0):
            text.insert(r.randint(0, len(text)), r.choice(ill))
        rows.append((k, " ".join(text).capitalize(), int(toxic)))
    copied = "copied words that only toxic copies have " * 2
    return rows + [(1000 + k, f"{copied} grombel {'x' * (k % 3)}", 1) for k in range(40)]


def test_learned_words(spark):
    rows = labelled()
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, toxic int, score double, key string").repartition(3)
    model = toxicity.fit(df.where("doc_id % 3 > 0"))
    held = toxicity.score(df, model).where("doc_id % 3 = 0 and doc_id < 900").collect()
    assert set(held[0].asDict()) == {"doc_id", "text", "toxic", "score", "key"}
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) > 0.97
    assert value("pratzomat", model) > 0.5 > value("copied words that only toxic copies have", model)


def test_toxicity_edges(spark):
    rows = [(1, None, None), (1, "", 0), (None, "you idiot " * 30_000, 1), (4, "tie", 0), (4, "tie", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.score(df, toxicity.fit(df)).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert max(found, key=lambda r: r.score).doc_id is None
    none = df.where("false")
    assert toxicity.score(none, toxicity.fit(none)).count() == 0
    assert df.where(toxicity.held_out(F.col("doc_id"))).count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 1, 4, 4))
