"""Toxicity by a weighted finite-state grammar over clauses, its lexicon and its weights learned from labelled texts.

Words become symbols: insults, threats (verbs of harm), intent, target, negation, reported speech, others; a clause ends at a full
stop, colon, semicolon, exclamation or question mark or line end. Four transducers, each of which marks the insults and threats
of a clause that it matches and passes all else on, are composed into one machine:

- reported speech: after a word of saying, up to the clause's end;
- negation: within WINDOW words after a negation;
- target: within WINDOW words of a person addressed or spoken of, on either side;
- threat: a verb of harm after intent or beside a target; the verb alone is a weaker pattern.

What comes out is one pattern for each insult or threat: its kind and marks. A text's features are, by pattern, the weights of the
words matched so, on a logarithmic scale; the score is logistic in them. Weights of patterns start from PRIOR and move as far as
labels ask; the seed words below are joined by the words and word beginnings that mark labelled toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, cache_of, cut, mix, raw, slices, tidy

#: Rows that fit() learns from at most; with more labelled rows, a share chosen by hash.
FIT_ROWS = 20_000
#: Words to either side that negation and target reach.
WINDOW = 4
#: Bytes of the word beginnings that are learned.
STEMS = (4, 5, 6, 7)
#: A learned word needs this many different neighbours in toxic texts (a beginning, different words), and this much evidence (G squared).
LEAST_PLACES, LEAST_EVIDENCE = 3, 30.0

OTHER, BREAK, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(8)
REPORTED, NEGATED, TARGETED, WHOLE = 1, 2, 4, 8

SEEDS = {
    INSULT: "idiot idiots moron imbecile stupid scum pathetic worthless trottel abschaum dummkopf crétin imbécile connard ordure idiota imbécil estúpido basura",
    THREAT: "kill hurt destroy beat stab shoot strangle töten umbringen erschlagen erschießen tuer frapper étrangler matar golpear apuñalar",
    INTENT: "will gonna going shall werde werden wird vais allons voy vamos",
    TARGET: "you your he she him her they them du dich dir ihr euch sie tu te toi vous ils elles tú ti usted ustedes ellos",
    NEGATION: "not no never don isn aren doesn nicht kein keine nie ne pas jamais nunca jamás",
    REPORT: "said says wrote called claimed reported quoted sagte schrieb nannte behauptete dit écrit appelé dijo escribió llamó",
}
#: Log odds of a seed word of these kinds.
SEED_WEIGHT = 2.0
#: Log odds of a text without any match, and what a pattern adds for each unit, before labels are seen.
PRIOR_BIAS, PRIOR = -3.0, {INSULT: 1.0, THREAT: 0.4}
_MARKS = {REPORTED: 0.3, NEGATED: 0.3, TARGETED: 1.5, WHOLE: 3.0}
#: How firmly labels must speak against the weights' priors.
RIDGE = 0.1

_ROLL = Rolling(13)


# --- transducers


@dataclass(frozen=True)
class Transducer:
    """Deterministic: step(state, symbol) gives the next state and the symbol to pass on. Symbols are (kind, marks)."""

    start: tuple
    step: object = field(compare=False)


def _near(cue: int, mark: int, both: bool) -> Transducer:
    """Marks insults and threats at most WINDOW words after the cue; if `both`, a cue after one passes on as (cue, mark)."""

    def step(state: tuple, symbol: tuple) -> tuple:
        since, late = state
        kind, marks = symbol
        if kind == BREAK:
            return (0, 0), symbol
        if kind in (INSULT, THREAT):
            out = (kind, marks | mark) if since else symbol
            return (max(0, since - 1), 0 if since or not both else WINDOW), out
        if kind == cue:
            return (WINDOW, 0), (kind, mark if late else marks)
        return (max(0, since - 1), max(0, late - 1)), symbol

    return Transducer((0, 0), step)


def _reported() -> Transducer:
    def step(state: tuple, symbol: tuple) -> tuple:
        kind, marks = symbol
        if kind in (BREAK, REPORT):
            return (int(kind == REPORT),), symbol
        return state, (kind, marks | REPORTED * state[0]) if kind in (INSULT, THREAT) else symbol

    return Transducer((0,), step)


def _whole_threat() -> Transducer:
    def step(state: tuple, symbol: tuple) -> tuple:
        kind, marks = symbol
        if kind == THREAT:
            return state, (kind, marks | WHOLE if state[0] or marks & TARGETED else marks)
        return (WINDOW if kind == INTENT else 0 if kind == BREAK else max(0, state[0] - 1),), symbol

    return Transducer((0,), step)


def compose(first: Transducer, then: Transducer) -> Transducer:
    """What `first` passes on goes into `then`."""

    def step(state: tuple, symbol: tuple) -> tuple:
        a, middle = first.step(state[0], symbol)
        b, out = then.step(state[1], middle)
        return (a, b), out

    return Transducer((first.start, then.start), step)


@dataclass(frozen=True)
class Grammar:
    """The composed machine as tables by state and kind; pattern -1 is none."""

    next: list[list[int]]
    out: list[list[int]]
    idle: list[list[int]]  # the state after 0, 1, ... words of no kind; the last is for all more
    patterns: list[tuple[int, int]]
    prior: np.ndarray


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    machine = reduce(compose, [_reported(), _near(NEGATION, NEGATED, False), _near(TARGET, TARGETED, True), _whole_threat()])
    states, following, out, patterns = {machine.start: 0}, [], [], {}
    for state in (todo := [machine.start]):  # grows while it is walked
        following.append([])
        out.append([])
        for kind in range(8):
            to, (k, marks) = machine.step(state, (kind, 0))
            if to not in states:
                states[to] = len(todo)
                todo.append(to)
            following[-1].append(states[to])
            # an insult or threat with its marks, or a target that comes late
            hit = k in (INSULT, THREAT) or (k == TARGET and marks & TARGETED)
            out[-1].append(patterns.setdefault((k, marks), len(patterns)) if hit else -1)
    idle = [list(range(len(todo)))]
    while (after := [following[s][OTHER] for s in idle[-1]]) != idle[-1]:
        idle.append(after)
    names = list(patterns)
    prior = np.array([_MARKS[TARGETED] / 2 if k == TARGET else float(np.prod([PRIOR[k], *[v for m, v in _MARKS.items() if marks & m]])) for k, marks in names])
    return Grammar(following, out, idle, names, prior)


# --- words


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_END = np.zeros(256, bool)
_END[[10, 13, 33, 46, 58, 59, 63]] = True


@dataclass
class Words:
    """Words of a batch of texts: where they stand, their text and clause."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    clause: np.ndarray
    prefix: np.ndarray

    def keys(self) -> np.ndarray:
        return _ROLL.of(self.prefix, self.start, self.end)

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, keys) of the beginnings of words longer than `size` bytes."""
        at = np.flatnonzero(self.end - self.start > size)
        a = self.start[at]
        return at, mix(_ROLL.of(self.prefix, a, a + size) ^ U64(size))


def split_words(texts: pa.Array) -> Words:
    data, off, _ = raw(pc.utf8_lower(texts))
    letter, stop = _LETTER[data], _END[data]
    # punctuation beyond ASCII is no letter: U+0080-00BF, U+2000-207F, U+3000-303F; U+2026 and U+3002 end a clause
    for at in np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3)).tolist():
        b = data[at : at + 3].tolist()
        if b[0] == 0xC2:
            letter[at : at + 2] = False
        elif len(b) == 3 and ((b[0] == 0xE2 and b[1] in (0x80, 0x81)) or b[:2] == [0xE3, 0x80]):
            letter[at : at + 3] = False
            stop[at] |= b in ([0xE2, 0x80, 0xA6], [0xE3, 0x80, 0x82])
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = letter[edge]
    last[edge - 1] = letter[edge - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, a, "right") - 1
    stops = np.flatnonzero(stop)
    return Words(a, b, doc, np.searchsorted(stops, a) + doc, _ROLL.prefix(data))


# --- model


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted
    kind: np.ndarray
    odds: np.ndarray
    stems: tuple[int, ...]  # sizes of beginnings that are in use
    weights: np.ndarray  # by pattern
    bias: float


def _seeds() -> dict[int, tuple[int, float]]:
    out = {}
    for kind, text in SEEDS.items():
        w = split_words(pa.array([text]))
        for key in w.keys().tolist():
            out[key] = (kind, SEED_WEIGHT)
    return out


def _model(learned: dict[int, float], stems: tuple[int, ...]) -> Model:
    entries = {**_seeds(), **{k: (INSULT, v) for k, v in learned.items()}}
    keys = np.array(sorted(entries), np.uint64)
    g = grammar()
    return Model(keys, np.array([entries[k][0] for k in keys.tolist()]), np.array([entries[k][1] for k in keys.tolist()]), stems, g.prior, PRIOR_BIAS)


def _found(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where they are not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def features(texts: pa.Array, m: Model) -> np.ndarray:
    """By text and pattern, log(1 + the log odds of all words matched so)."""
    g, w = grammar(), split_words(texts)
    out = np.zeros((len(texts), len(g.patterns)))
    entry = _found(w.keys(), m.keys)
    for size in m.stems:
        at, keys = w.stems(size)
        stem = _found(keys, m.keys)
        better = (stem >= 0) & ((entry[at] < 0) | (m.odds[stem] > m.odds[entry[at]]) & (m.kind[entry[at]] == INSULT))
        entry[at[better]] = stem[better]
    kind = np.where(entry >= 0, m.kind[entry], OTHER) if len(m.keys) else np.zeros(len(entry), int)
    hit = (kind == INSULT) | (kind == THREAT)
    # only clauses with an insult or threat are run
    live = np.flatnonzero((kind != OTHER) & np.isin(w.clause, np.unique(w.clause[hit])))
    state, last, clause, deepest, odds = 0, 0, -1, len(g.idle) - 1, 0.0
    for at, c, k, d, e in zip(live.tolist(), w.clause[live].tolist(), kind[live].tolist(), w.doc[live].tolist(), m.odds[entry[live]].tolist(), strict=True):
        if c != clause:
            state, clause = 0, c
        else:
            state = g.idle[min(at - last - 1, deepest)][state]
        last = at
        pattern = g.out[state][k]
        if k in (INSULT, THREAT):
            odds = e
        if pattern >= 0:
            out[d, pattern] += odds  # a late target counts as much as what it follows
        state = g.next[state][k]
    return np.log1p(out)


def scores(texts: pa.Array, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m.bias + features(texts, m) @ m.weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Weights by Newton's method, held near their priors; the bias is free but for a faint pull."""
    x = np.hstack([x, np.ones((len(x), 1))])
    mean, pull = np.append(prior, bias), np.append(np.full(len(prior), RIDGE), 0.01)
    v = mean.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (v - mean))
        v += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    # no insult or threat makes a text less toxic
    return np.maximum(v[:-1], 0), float(v[-1])


def held_out(doc_id: Column) -> Column:
    """Documents whose labels no fit may see: crc32 of the id as text can be divided by 5. Null id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _each_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, places, keys, sizes) of slices of texts; size 0 for whole words."""
    for batch in batches:
        for part in slices(batch, batch.schema.names[column], 4 << 20) if batch.num_rows else []:
            w = split_words(part.column(column))
            places, keys, sizes = [np.arange(len(w.start))], [w.keys()], [np.zeros(len(w.start), np.int64)]
            for size in STEMS:
                at, k = w.stems(size)
                places.append(at)
                keys.append(k)
                sizes.append(np.full(len(at), size))
            yield w, np.concatenate(places), np.concatenate(keys), np.concatenate(sizes)


def _document_counts(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(key, n): texts that hold each word or beginning (those in `only`, a sorted array, if given)."""
    shared = rows.sparkSession.sparkContext.broadcast(only)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, at, keys, _ in _each_key(batches, 0):
            if shared.value is not None:
                known = _found(keys, shared.value) >= 0
                at, keys = at[known], keys[known]
            doc = w.doc[at]
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            one = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]) if len(keys) else np.zeros(0, bool)
            key, n = np.unique(keys[one], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return rows.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _places(rows: DataFrame, only: np.ndarray) -> DataFrame:
    """(key, size, places, words, texts): different neighbours, words and texts of each word or beginning; near copies of a text count once.

    A text is known by the least of its words' scrambled keys, which copies with a few changes nearly always share.
    """
    shared = rows.sparkSession.sparkContext.broadcast(only)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, at, keys, sizes in _each_key(batches, 0):
            word = w.keys()
            before, after = np.roll(word, 1), np.roll(word, -1)
            least = np.full(int(w.doc[-1]) + 1 if len(word) else 0, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, w.doc, mix(word))
            known = _found(keys, shared.value) >= 0
            at, keys, sizes = at[known], keys[known], sizes[known]
            columns = [keys, mix(before[at] ^ mix(after[at])), word[at], least[w.doc[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(sizes), *[pa.array(c.view(np.int64)) for c in columns]], ["size", "key", "place", "word", "text"])

    found = rows.select("text").mapInArrow(run, "size long, key long, place long, word long, text long")
    return found.groupBy("key", "size").agg(F.count_distinct("place").alias("places"), F.count_distinct("word").alias("words"), F.count_distinct("text").alias("texts"))


def _evidence(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """G squared of t of toxic and c of clean texts against one rate for both; 0 where the rate is not higher in toxic texts."""
    rate = (t + c) / (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(n > 0, n * np.log(n / (rate * size)), 0) + np.where(size > n, (size - n) * np.log((size - n) / (size * (1 - rate))), 0) for n, size in ((t, toxic), (c, clean)))
    return np.where(t / toxic > c / clean, 2 * np.nan_to_num(g), 0)


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows; rows with null text or label are left out.

    fit_rows bounds what is learned from: with more labelled rows, a share of them chosen by the text's hash. What reaches the
    driver is counts of words of that sample, and for each of its texts the features by pattern. Without toxic or without clean
    rows the seed words and the prior weights stand.
    """
    rows = rows.select(F.col(text_col).cast("string").alias("text"), (F.col(label_col) > 0).alias("toxic")).where("text is not null and toxic is not null")
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    rows = cut(rows)
    toxic, clean = rows.where("toxic"), rows.where("not toxic")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return _model({}, ())
    at = _document_counts(toxic).where(F.col("n") >= LEAST_PLACES).toPandas()
    keys = at["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, t = keys[order], at["n"].to_numpy()[order].astype(float)
    c = np.zeros(len(keys))
    seen = _document_counts(clean, keys).toPandas()
    c[_found(seen["key"].to_numpy().view(np.uint64), keys)] = seen["n"].to_numpy()
    keep = _evidence(t, c, n_toxic, n_clean) >= LEAST_EVIDENCE
    keys, t, c = keys[keep], t[keep], c[keep]
    places = _places(toxic, keys).toPandas()
    found = _found(places["key"].to_numpy().view(np.uint64), keys)
    size, varied, own = np.zeros(len(keys), int), np.zeros(len(keys)), np.zeros(len(keys))
    size[found] = places["size"].to_numpy()
    # copies of a text or of a passage don't make a word more telling; a beginning stands for several words
    own[found] = places[["places", "texts"]].min(axis=1).to_numpy()
    varied[found] = np.where(places["size"] == 0, places["places"], places["words"])
    own = np.minimum(t, own)
    keep = (varied >= LEAST_PLACES) & (_evidence(own, c, n_toxic, n_clean) >= LEAST_EVIDENCE)
    odds = np.log((own + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    learned = {k: float(o) for k, o, ok in zip(keys.tolist(), odds, keep, strict=True) if ok and o > 1}
    model = _model(learned, tuple(s for s in STEMS if (size[keep] == s).any()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20) if batch.num_rows else []:
                x = features(part.column(0), model)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), part.column(1)], ["x", "y"])

    sample = rows.mapInArrow(tidy(measured), "x array<double>, y boolean").groupBy("x", "y").count().toPandas()
    many = sample["count"].to_numpy()
    x, y = np.repeat(np.array(sample["x"].tolist()), many, 0), np.repeat(sample["y"].to_numpy().astype(float), many)
    weights, bias = _logistic(x, y, model.weights, model.bias)
    return Model(model.keys, model.kind, model.odds, model.stems, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of docs, with the score (0 to 1).

    Null and empty texts score as any text without a match does. A column of docs named as the new one is replaced. Whole texts
    are scored, however long. The model that is broadcast holds words of a bounded sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != out]
    picked = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = picked.schema.add(out, "double")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("toxicity")
        last = len(keep)
        for batch in batches:
            for part in slices(batch, batch.schema.names[last], 4 << 20) if batch.num_rows else []:
                texts = pc.fill_null(part.column(last), "")
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(last)], pa.array(scores(texts, shared.value))], [*keep, out])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, fields)
