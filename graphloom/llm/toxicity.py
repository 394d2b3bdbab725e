"""Toxicity: a noisy-channel decoder restores disguised words, then a learned lexicon scores the text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, give_back_after, table

#: At most about so many labelled rows train the lexicon and the score; a uniform sample if there are more.
TRAIN_ROWS = 40_000
#: A feature counts if so many toxic training texts have it and its log-odds reach LEAST_WEIGHT.
LEAST_TEXTS, LEAST_WEIGHT = 3, 1.5
THRESHOLD = 0.3
#: A worker keeps what it found for at most so many tokens, and only until the end of a task: its memory adds to the executor's heap.
CACHED = 60_000
#: Of tokens without features, which are most, so many in each of two tables.
CACHED_NONE = 120_000
#: What a task keeps of words while it counts features: each has up to four texts.
CACHED_WORDS = 30_000
PREFIXES = (4, 5, 6)

#: Symbols of the character model: 0 for everything between words, a-z, and 27 for other letters.
SYMBOLS = 28
#: What a character may stand for in a disguised word.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "(": "c", "+": "t", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~'"
#: Log probabilities of the channel: a letter disguised, a separator put in, a sign that is punctuation, a letter
#: doubled, one repeated a third time or more, a character meant as it is.
DISGUISED, INSERTED, TRIMMED, DOUBLED, REPEATED, PLAIN = -2.0, -1.0, -0.5, -4.0, -0.5, -0.05
#: Fragments of one or two characters with separators of any length between them, three or more in a row.
_SIGN = re.escape("".join(LEET).translate(str.maketrans("", "", "0123456789")))
_FRAGMENT = rf"(?:[^\W_]|[{_SIGN}]){{1,2}}"
_SPACED = re.compile(rf"(?<!\S){_FRAGMENT}(?:[ .\-_*~']+{_FRAGMENT}){{2,}}(?!\S)")
_ODD = re.compile(r"[\W\d_]|(.)\1")
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_INNER = re.compile(r"[\W\d_]|(.)\1\1")
#: Letters and what stands for them on one letter, so that all readings of a token look alike; nothing else is kept.
_LOOKS = str.maketrans({c: {"l": "i"}.get(x[0], x[0]) for c, x in (*LEET.items(), ("l", "l"))})
_AGAIN = re.compile(r"(.)\1+")
_LEET = frozenset(LEET)


def _symbols(data: bytes) -> np.ndarray:
    """The model's symbol of each byte; a letter beyond ASCII is one symbol a byte."""
    table_ = np.zeros(256, np.int64)
    table_[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table_[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    table_[128:] = 27
    return table_[np.frombuffer(data, np.uint8)]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts: SYMBOLS**3 numbers, whatever the corpus."""

    @give_back_after
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if not text.is_valid:
                    continue
                s = _symbols(b" " + text.as_buffer().to_pybytes() + b" ")
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = docs.select(text_col).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3, np.int64)
    for at, n in rows:
        out[at] = n
    return out


class CharacterModel:
    """Trigram log probabilities, interpolated with bigrams and single characters."""

    def __init__(self, counts: np.ndarray) -> None:
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2, c1 = c3.sum(0), c3.sum((0, 1))
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 2 * p1) / (c2.sum(1, keepdims=True) + 2)
        p3 = (c3 + 2 * p2[None]) / (c3.sum(2, keepdims=True) + 2)
        self.log = np.log(p3).tolist()

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    def restore(self, token: str, trim: bool = True) -> str:
        """The likeliest plain text of a lower-cased token: Viterbi over the lattice of its characters.

        Arcs: a character as it is; a digit or sign as a letter it stands for; a separator left
        out, however many of them follow each other; a letter left out that repeats the one before;
        with trim, a sign at either end left out as punctuation. A state is the last two characters
        written, so the work is linear in the token's length. The plain reading is a path like the
        others and wins where the character model likes it best.
        """
        log, symbol = self.log, self.symbol
        inner = token.strip(_EDGE) if trim else token
        head = len(token) - len(token.lstrip(_EDGE)) if trim and inner else 0
        tail = head + len(inner) if trim and inner else len(token)
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {(" ", " "): (0.0, None)}
        for i, c in enumerate(token):
            before = token[i - 1] if i else ""
            arcs = [(c, PLAIN)] if c.isalpha() else [(" ", PLAIN if c.isspace() else INSERTED if c in SEPARATORS else DISGUISED - 2)]
            arcs += [(x, DISGUISED) for x in LEET.get(c, "")]
            skip = INSERTED if c in SEPARATORS else None
            if skip is not None and before and before in SEPARATORS:
                skip = PLAIN  # one run of separators is one choice
            if not head <= i < tail:
                skip = TRIMMED
            again = REPEATED if i > 1 and c == before == token[i - 2] else DOUBLED
            new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                row = log[symbol(a)][symbol(b)]
                for x, cost in arcs:
                    if x == " " and b == " ":
                        to, worth, way = (a, b), score + cost, path
                    else:
                        to, worth, way = (b, x), score + cost + row[symbol(x)], (path, x)
                    if to not in new or worth > new[to][0]:
                        new[to] = (worth, way)
                left_out = skip if skip is not None else again if c == b or b in LEET.get(c, "") else None
                if left_out is not None and ((a, b) not in new or score + left_out > new[a, b][0]):
                    new[a, b] = (score + left_out, path)
            states = new
        end = max(states.items(), key=lambda s: s[1][0] + log[symbol(s[0][0])][symbol(s[0][1])][0])
        out, path = [], end[1][1]
        while path is not None:
            path, x = path
            out.append(x)
        return "".join(reversed(out)).strip()


def spaced_runs(text: str) -> list[str]:
    """Stretches of three or more short fragments with separators between them, most of the fragments one character."""
    out = []
    for m in _SPACED.finditer(text):
        sizes = list(map(len, re.split(r"[ .\-_*~']+", m.group())))
        if sizes.count(1) * 2 >= len(sizes):
            out.append(m.group())
    return out


def tokens_of(text: str) -> set[str]:
    """The distinct lower-cased tokens of a text and its spaced-out stretches."""
    lowered = text.lower()
    out = set(lowered.split())
    out.update(spaced_runs(lowered))
    return out


def readings_of(token: str, model: CharacterModel) -> list[list[str]]:
    """The restored words of one token, in each way that it can be read.

    A token of letters without a double one is itself. Others are decoded. Signs at the edges are
    punctuation or letters: the token is decoded with them and without them. A run of fragments may
    be one word: it is decoded with its separators and without.
    """
    bare = token.strip(_EDGE)
    if bare == token and not _ODD.search(token):
        return [[token]]
    tries = [bare] if bare and not _ODD.search(bare) else [model.restore(token)]
    if bare != token and any(c in LEET for c in token[: len(token) - len(token.lstrip(_EDGE))] + token[len(token.rstrip(_EDGE)) :]):
        tries.append(model.restore(token, trim=False))
    if any(c in SEPARATORS for c in bare):
        tries.append(model.restore("".join(c for c in bare if c not in SEPARATORS)))
    out: list[list[str]] = []
    for words in map(str.split, tries):
        if words and words not in out:
            out.append(words)
    return out


def words_of(token: str, model: CharacterModel) -> list[str]:
    """The distinct words of all readings of a token."""
    return list(dict.fromkeys(w for words in readings_of(token, model) for w in words))


def plain_words(token: str, model: CharacterModel) -> list[str]:
    """The words that a token counts for in training: itself without signs at its edges, decoded if there are others inside."""
    bare = token.strip(_EDGE)
    if not bare:
        return []
    return model.restore(token).split() if _INNER.search(bare) else [bare]


def looks(text: str) -> str:
    """The same for a word and all ways to disguise it by signs for letters and by letters put twice or more."""
    return _AGAIN.sub(r"\1", text.translate(_LOOKS))


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


@dataclass
class ToxicityModel:
    """log-odds of features and the coefficients of the final logistic score."""

    characters: CharacterModel
    toxic: int = 0
    clean: int = 0
    counts: dict[str, tuple[int, int]] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)
    _cache: dict[str, float] = field(default_factory=dict)
    _found: dict[str, tuple] = field(default_factory=dict)
    _none: set[str] = field(default_factory=set)
    _older: set[str] = field(default_factory=set)
    _looks: tuple[set[str], set[str]] | None = None
    _starts: set[str] | None = None

    def may_matter(self, token: str) -> bool:
        """Whether some reading of a token can have a feature of the lexicon; only then it is decoded.

        Readings of a token without signs inside differ by letters left out that repeat the one before and by
        how many of the signs at its edges are letters of it: by their looks no more than by these signs. Signs
        of several kinds at one edge could be a word of their own, so such tokens are decoded.
        """
        if self._looks is None:
            self._looks = ({looks(f) for f in self.counts if f[-1] != "*"}, {looks(f[:-1]) for f in self.counts if f[-1] == "*"})
        bare = token.strip(_EDGE)
        if not bare or _INNER.search(bare):
            return True
        at = token.index(bare)
        head, tail = ("".join(c for c in x if c in LEET) if x else "" for x in (token[:at], token[at + len(bare) :]))
        if len(set(head)) > 1 or len(set(tail)) > 1:
            return True
        whole, starts = self._looks
        plain = looks(bare)
        for v in {looks(head), looks(tail), plain, *(looks(h + bare + t) for h in (head, "") for t in (tail, ""))} if head or tail else (plain,):
            if v in whole or any(v[:n] in starts for n in range(1, PREFIXES[-1] + 1)):
                return True
        return False

    def forget(self) -> None:
        """Empty what is kept between texts; a worker keeps the model itself until another task needs the worker."""
        for kept in (self._cache, self._found, self._none, self._older):
            kept.clear()

    def weight(self, feature: str, own: int | None = None) -> float:
        """The feature's log-odds; own: as if a training text with this label weren't there."""
        if (found := self.counts.get(feature)) is None:
            return 0.0
        # a reading that only scoring knows may give a text a feature that it wasn't counted with
        pos, neg = found[0] - (own == 1), max(0, found[1] - (own == 0))
        if pos < LEAST_TEXTS:
            return 0.0
        w = math.log((pos + 0.5) / (self.toxic - (own == 1) + 1)) - math.log((neg + 0.5) / (self.clean - (own == 0) + 1))
        return w if w >= LEAST_WEIGHT else 0.0

    def features(self, token: str) -> tuple[tuple[tuple[str, ...], ...], ...]:
        """For each reading of a token and each of its words the features that the lexicon has; readings without any are left out."""
        if (known := self._found.get(token)) is not None:
            return known
        if len(self._found) > CACHED:
            self._found.clear()
        self._found[token] = known = self._features(token)
        return known

    def telling(self, tokens: set[str]) -> list[str]:
        """Those of the tokens that have features. Of the others two tables are kept: frequent ones come back from the older, which goes when the other is full."""
        rest = tokens - self._none
        again = rest & self._older
        self._none |= again
        out = []
        for token in rest - again:
            if token in self._found:
                out.append(token)
            elif found := self._features(token):
                if len(self._found) > CACHED:
                    self._found.clear()
                self._found[token] = found
                out.append(token)
            else:
                self._none.add(token)
        if len(self._none) > CACHED_NONE:
            self._older, self._none = self._none, set()
        return out

    def _features(self, token: str) -> tuple[tuple[tuple[str, ...], ...], ...]:
        bare = token.strip(_EDGE)
        if bare and (bare == token or _LEET.isdisjoint(token.replace(bare, "", 1))) and not _ODD.search(bare):
            if self._starts is None:
                self._starts = {f[:-1] for f in self.counts if f[-1] == "*"}
            if bare not in self.counts and not any([bare[:n] in self._starts for n in PREFIXES]):
                return ()
            readings = [[bare]]
        else:
            readings = readings_of(token, self.characters) if self.may_matter(token) else []
        out = []
        for words in readings:
            own = tuple(f for w in words if (f := tuple(x for x in features_of(w) if x in self.counts)))
            if own:
                out.append(own)
        return tuple(out)

    def token_weight(self, token: str, own: int | None = None) -> float:
        """The weight of the reading that says most."""
        return max((sum(max(self.weight(f, own) for f in word) for word in words) for words in self.features(token)), default=0.0)

    def inputs(self, text: str | None, own: int | None = None) -> tuple[float, float, float]:
        """(sum and largest of the tokens' weights, log of the number of distinct tokens)."""
        tokens, cache = tokens_of(text or ""), self._cache
        weights = []
        for token in self.telling(tokens):
            if own is not None:
                w = self.token_weight(token, own)
            elif (w := cache.get(token, -1.0)) < 0:
                if len(cache) > CACHED:
                    cache.clear()
                w = cache[token] = self.token_weight(token)
            weights.append(w)
        # the exact sum: whatever the order of a set, equal texts have equal scores
        return math.fsum(weights), max(weights, default=0.0), math.log1p(len(tokens))

    def score(self, text: str | None) -> float:
        x = self.inputs(text)
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from the labelled rows that aren't held out; the character model is counted over all texts.

    No more than about ``rows`` labelled rows are used, chosen by a hash of their id: that bounds
    the broadcast list of labels. Rows that share an id are one document with many texts: of all
    rows that the labels meet no more than four times ``rows`` are read, again by a hash, so that
    repeated ids can't make the sample grow. A feature has to be in LEAST_TEXTS toxic texts of that
    sample and in few clean ones, so the lexicon has at most 4 * rows * words / LEAST_TEXTS entries and
    in practice a few thousand. Labels that are null or of unknown ids don't count; an id with
    several labels counts once for each. Without labels of both kinds every text gets one low score.
    """
    model = ToxicityModel(CharacterModel(trigram_counts(docs, text_col)))
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    n = usable.count()
    if n > rows:
        usable = usable.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(1_000_000 * rows / n)))
    usable = usable.select(F.col(id_col).alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = cut(texts.join(F.broadcast(usable), "doc_id").select("text", "y"), "toxic-train")
    if (n := sample.count()) > 4 * rows:
        part = F.pmod(F.xxhash64("text", "y", F.monotonically_increasing_id()), F.lit(1_000_000))
        sample = cut(sample.where(part < F.lit(int(1_000_000 * 4 * rows / n))), "toxic-sample")
    sizes = dict(sample.groupBy("y").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return model
    model.toxic, model.clean = sizes[1], sizes[0]
    characters = model.characters

    @give_back_after
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        known: dict[str, list[str]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: set[str] = set()
                for t in tokens_of(text or ""):
                    if (features := known.get(t)) is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        features = known[t] = [f for w in plain_words(t, characters) for f in features_of(w)]
                    own.update(features)
                seen[1 - y].update(own)
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[f] for f in every], pa.int64()) for c in seen)], names=["f", "pos", "neg"])

    counted = sample.mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = (F.col("pos") + 0.5) / (model.toxic + 1) / ((F.col("neg") + 0.5) / (model.clean + 1))
    kept = counted.where((F.col("pos") >= LEAST_TEXTS) & (odds >= math.exp(LEAST_WEIGHT)))
    model.counts = {f: (p, m) for f, p, m in kept.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @give_back_after
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = batch.column(1).to_pylist()
            x = [shared.value.inputs(t, y) for t, y in zip(batch.column(0).to_pylist(), ys, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in x], pa.float64()) for i in range(3)), pa.array(ys, pa.int64())], names=["a", "b", "c", "y"])
        shared.value.forget()

    data = np.array(sample.mapInArrow(inputs, "a double, b double, c double, y long").collect(), float)
    model.coefficients = _fit(data[:, :3], data[:, 3])
    return model


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """The score as an Arrow-batched column expression: other columns stay in the JVM."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @give_back_after
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([shared.value.score(t) for t in texts], dtype=float)
        finally:
            shared.value.forget()

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without any toxic word. The score reads the text
    alone, the whole of it; repeated rows get equal scores. An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold.

    Null and empty texts stay unless texts without a toxic word score that high; repeated rows share
    their fate; an empty table stays empty; all columns are kept.
    """
    model = train(docs, labels, id_col, text_col)
    return docs.where(score_column(docs.sparkSession, model, F.col(text_col)) < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_toxicity on documents, learnt from labels."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
