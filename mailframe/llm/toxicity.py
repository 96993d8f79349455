"""Toxicity by weak supervision.

1. Voters. Fixed English insult lexicons, lexicons mined from labelled rows (words and word starts,
   dealt out to several voters) and patterns (several kinds of flagged words, all their evidence, shouting,
   flagged words said to a "you") vote toxic, clean or abstain.
2. Label model. A generative model of the votes, two classes with a vote table for each voter, is fitted
   by expectation maximisation over the votes of all rows (as counts of vote patterns, of which there
   are at most 3^11). Correlations of voters given the class are estimated, too; a voter's evidence is divided
   by one plus the sum of its correlations with the others, so that voters that repeat each other don't
   count twice. Labelled rows have a known class in this model, and so anchor which class is which.
3. Classifier. Logistic regression on the shares of flagged words is trained on the label model's posteriors,
   and on nothing else, of a bounded sample of all rows, labelled or not. Labels then set the scale of
   its scores (two numbers).

Texts are read whole, word by word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, id_hash, short_batches, table
from .learning import labelled_sample, platt, sigmoid

INSULTS = {
    "mind": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "stupid", "dumb", "dumbass", "fool", "dimwit", "brainless"),
    "worth": ("trash", "garbage", "worthless", "pathetic", "loser", "losers", "failure", "useless", "scum", "vermin", "filth", "parasite"),
    "person": ("clown", "clowns", "creep", "freak", "pig", "disgusting", "ugly", "liar", "coward", "hypocrite", "jerk", "bastard"),
}
#: Words for the person spoken to, in the languages of the corpus.
YOU = frozenset("you your youre u ya du dich dir dein deine ihr sie tu te toi vous votre usted tú ti eres".split())
#: Words after such a word in which a flagged one is meant for that person.
REACH = 3
#: Word starts that lexicons are mined for, besides whole words.
STARTS = (5, 7)
#: A mined entry: at least so many toxic rows of the sample, so many times as frequent in toxic rows.
LEAST_ROWS, LEAST_RATIO = 4, 3.0
#: Entries that the mined lexicons hold at most (the strongest): it bounds the classifier's features, not what is read.
LEXICON = 4000
SHARDS = 2
#: Rows (different texts) whose posteriors the classifier is trained on, at most: half with a toxic vote, half without.
TRAIN_ROWS = 4000
PRIOR = 0.1
#: Log odds from which a flagged word is a strong sign.
STRONG = float(np.log(8))
WORD = re.compile(r"\w+")
CAPITALS = re.compile(r"\b[A-ZÄÖÜÉÈÑ]{4,}\b")


def words_in_order(text: str | None) -> Iterator[list[str]]:
    """The lower-cased words of a whole text, in lists of bounded length."""
    text, start = text or "", 0
    while start < len(text):
        end = min(len(text), start + (1 << 18))
        while end < len(text) and not text[end].isspace():
            end += 1
        yield WORD.findall(text[start:end].lower())
        start = end


def words_of(text: str | None) -> Counter:
    """Counts of the lower-cased words of a whole text."""
    out = Counter()
    for words in words_in_order(text):
        out.update(words)
    return out


def keys_of(word: str) -> list[str]:
    """The word and its starts, as lexicon keys."""
    return [f"={word}", *[f"^{word[:n]}" for n in STARTS if len(word) >= n]]


@dataclass
class Lexicon:
    """Key -> (column, log odds). Columns 0 to 2 are the fixed ones."""

    entries: dict[str, tuple[int, float]] = field(default_factory=dict)
    columns: int = 0
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def mined(cls, counts: list[tuple[str, int, int]], toxic: int, clean: int) -> Lexicon:
        """counts: key, toxic rows, clean rows with it."""
        found = []
        for key, t, c in counts:
            ratio = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
            if t >= LEAST_ROWS and ratio >= LEAST_RATIO:
                found.append((-np.log(ratio), key))
        fixed = {f"={w}": np.log(50.0) for ws in INSULTS.values() for w in ws}
        keep = fixed | {k: -v for v, k in sorted(found)[:LEXICON]}
        return cls({k: (j, float(v)) for j, (k, v) in enumerate(keep.items())}, len(keep))

    def columns_of(self, word: str) -> tuple[int, ...]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[word] = tuple(self.entries[k][0] for k in keys_of(word) if k in self.entries)
        return got

    def count(self, text: str | None) -> tuple[dict[int, int], int]:
        """Column -> occurrences, and the number of words."""
        words = words_of(text)
        hits: dict[int, int] = {}
        for w, n in words.items():
            for j in self.columns_of(w):
                hits[j] = hits.get(j, 0) + n
        return hits, sum(words.values())

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


class Voters:
    """Votes: 1 toxic, 0 clean, -1 abstain. names has one name for each."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        keys = list(lexicon.entries)
        self.odds = np.array([v for _, v in lexicon.entries.values()])
        fixed = {f"={w}": k for k, ws in enumerate(INSULTS.values()) for w in ws}
        self.names = [f"insults:{k}" for k in INSULTS] + [f"{kind}:{s}" for kind in ("words", "starts") for s in range(SHARDS)] + ["kinds", "evidence", "address", "shouting"]
        self.voter_of = []
        for j, k in enumerate(keys):
            if k in fixed:
                self.voter_of.append(fixed[k])
            else:
                self.voter_of.append(len(INSULTS) + SHARDS * (k[0] == "^") + j % SHARDS)

    def vote(self, text: str | None, hits: dict[int, int], n: int) -> list[int]:
        out = [-1] * len(self.names)
        strong = [0.0] * len(self.names)
        for j, k in hits.items():
            strong[self.voter_of[j]] += k * self.odds[j]
        per_word = 1.0 / max(10, n)
        for v in range(len(self.names) - 4):
            x = strong[v] * per_word
            out[v] = 1 if x >= 0.012 else 0 if not n or strong[v] == 0 else -1
        words = sum(k for j, k in hits.items() if self.odds[j] >= STRONG) * per_word
        kinds = sum(self.odds[j] >= STRONG for j in hits)
        out[-4] = 1 if kinds >= 3 and words >= 0.006 else 0 if kinds == 0 else -1
        evidence = sum(k * self.odds[j] for j, k in hits.items()) * per_word
        out[-3] = 1 if evidence >= 0.06 else 0 if evidence < 0.015 else -1
        out[-2] = 0 if not kinds else 1 if self.addressed(text) else -1
        loud = CAPITALS.findall(text or "")
        out[-1] = 1 if len(loud) >= 2 and len(loud) * per_word >= 0.01 and "!" in text else -1 if loud or "!" in (text or "") else 0
        return out

    def addressed(self, text: str | None) -> bool:
        """Whether a strongly flagged word follows a word for the person spoken to."""
        left = 0
        for words in words_in_order(text):
            for w in words:
                if left and any(self.odds[j] >= STRONG for j in self.lexicon.columns_of(w)):
                    return True
                left = REACH if w in YOU else max(0, left - 1)
        return False


@dataclass
class LabelModel:
    """log_odds[v, vote]: evidence for toxic of a vote (clean, toxic, abstain), already tempered by correlations."""

    log_odds: np.ndarray
    prior: float
    accuracy: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.log(self.prior / (1 - self.prior)) + self.log_odds[np.arange(votes.shape[1]), votes].sum(axis=1)
        return sigmoid(logit)

    @classmethod
    def fit(cls, votes: np.ndarray, count: np.ndarray, gold: np.ndarray, gold_count: np.ndarray, gold_y: np.ndarray, rounds: int = 30) -> LabelModel:
        """votes (patterns, voters) with counts; gold: the same for labelled rows, with their labels.

        A voter that votes on everything alike has no evidence. Without labelled rows, the first tables
        hold that a toxic vote is right four times in five.
        """
        v = votes.shape[1]
        onehot = np.stack([(votes == x) for x in (0, 1, -1)], axis=2).astype(float)  # patterns, voters, vote
        gold_hot = np.stack([(gold == x) for x in (0, 1, -1)], axis=2).astype(float)
        start = np.array([[0.6, 0.1, 0.3], [0.2, 0.5, 0.3]])
        prior = PRIOR
        temper = np.ones(v)
        # about as much weight for the labelled rows as for all the others, so that the classes keep their meaning
        scale = max(1.0, count.sum() / max(1.0, gold_count.sum())) if len(gold) else 0.0

        def tables(post):
            out = []
            for y in (0, 1):
                w = count * (post if y else 1 - post)
                t = np.einsum("p,pvx->vx", w, onehot) + 5.0 * start[y]
                if len(gold):
                    t += scale * np.einsum("p,pvx->vx", gold_count * (gold_y == y), gold_hot)
                out.append(t / t.sum(axis=1, keepdims=True))
            return out

        def fresh(tabs):
            odds = (np.log(tabs[1]) - np.log(tabs[0])) * temper[:, None]
            return np.concatenate([odds], axis=0)

        odds = np.log(start[1] / start[0])[None, :].repeat(v, axis=0) / v
        post = sigmoid(np.log(prior / (1 - prior)) + np.einsum("pvx,vx->p", onehot, odds))
        if len(gold):
            odds = fresh(tables(np.full(len(votes), 0.0) * 0 + prior)) / np.sqrt(v)
            post = sigmoid(np.log(prior / (1 - prior)) + np.einsum("pvx,vx->p", onehot, odds))
        correlation = np.eye(v)
        for _ in range(rounds):
            tabs = tables(post)
            correlation = cls._correlations(onehot, count, post)
            temper = 1.0 / np.maximum(1.0, np.clip(correlation, 0, 1).sum(axis=1))
            odds = fresh(tabs)
            new = sigmoid(np.log(prior / (1 - prior)) + np.einsum("pvx,vx->p", onehot, odds))
            prior = float(np.clip((count @ new + 1) / (count.sum() + 10), 0.01, 0.5))
            if np.abs(new - post).max(initial=0) < 1e-5:
                break
            post = new
        tabs = tables(post)
        right = (1 - prior) * tabs[0][:, 0] + prior * tabs[1][:, 1]
        said = right + (1 - prior) * tabs[0][:, 1] + prior * tabs[1][:, 0]
        order = odds[:, [0, 1, 2]]  # votes 0, 1, -1 index it as they are
        return cls(order, prior, right / np.maximum(said, 1e-9), correlation)

    @staticmethod
    def _correlations(onehot, count, post) -> np.ndarray:
        """Correlation of the voters' votes (toxic 1, abstain 0.5, clean 0) given the class, over both classes."""
        x = onehot[:, :, 1] + 0.5 * onehot[:, :, 2]
        cov = np.zeros((x.shape[1], x.shape[1]))
        for w in (count * post, count * (1 - post)):
            d = x - (w @ x) / max(w.sum(), 1e-9)
            cov += (d * w[:, None]).T @ d
        sd = np.sqrt(np.diag(cov))
        return cov / np.maximum(np.outer(sd, sd), 1e-9)


@dataclass
class ToxicityModel:
    voters: Voters
    label_model: LabelModel
    weights: np.ndarray
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values: a flagged key's share of the words, in hundredths, with a root; then totals."""
        hits, n = self.voters.lexicon.count(text)
        return feature_vector(self.voters, hits, n)

    def score(self, text: str | None) -> float:
        at, x = self.features(text)
        return float(sigmoid(self.a * (self.bias + x @ self.weights[at]) + self.b))


def feature_vector(voters: Voters, hits: dict[int, int], n: int) -> tuple[np.ndarray, np.ndarray]:
    size = voters.lexicon.columns
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0)
    at, k = np.array(list(hits)), np.array(list(hits.values()), float)
    share = 100.0 * k / max(10, n)
    odds = voters.odds[at]
    total = share @ odds
    strong = share[odds >= STRONG].sum()
    extra = np.array([np.sqrt(total), min(total, 20.0), np.sqrt(strong), min(strong, 10.0)])
    return np.r_[at, size + np.arange(4)], np.r_[0.3 * np.sqrt(share), extra]


def train(rows: list[tuple[np.ndarray, np.ndarray]], p: np.ndarray, size: int, epochs: int = 20, rate: float = 0.5, l2: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels p, by adaptive stochastic gradient descent."""
    w, g2, b, gb = np.zeros(size), np.full(size, 1e-2), 0.0, 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            e = float(sigmoid(b + x @ w[at])) - p[i]
            g = e * x + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            gb += e * e
            b -= rate * e / np.sqrt(gb)
    return w, b


def _mine(sample: DataFrame) -> tuple[list[tuple[str, int, int]], int, int]:
    """Keys with the numbers of toxic and clean rows that have them, and the numbers of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in {k for w in words_of(t) for k in keys_of(w)} | {""}:
                    seen.setdefault(k, [0, 0])[y] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], names=["key", "toxic", "clean"])

    counts = sample.select("text", "y").mapInArrow(run, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = (F.col("key") == "") | ((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") > F.col("clean") / 20))
    best = counts.filter(strong).orderBy((F.col("key") == "").desc(), (F.col("toxic") / (F.col("clean") + 1)).desc(), "key").limit(4 * LEXICON).collect()
    total = next(((r.toxic, r.clean) for r in best if r.key == ""), (0, 0))
    return [(r.key, r.toxic, r.clean) for r in best if r.key], *total


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model; labels are read for the doc_ids for which `learn` holds only.

    Without any labels the fixed lexicons and patterns vote alone and scores keep the classifier's own scale. An
    empty table gives a model that says the prior. Repeated texts count each in the label model and once in training.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark)
    sample = scratch.save(labelled_sample(docs, labels, label, learn).select("text", "y"))
    counts, toxic, clean = _mine(sample)
    voters = Voters(Lexicon.mined(counts, toxic, clean))
    size = voters.lexicon.columns + 4

    def packed(text: str | None, hits: dict[int, int], n: int) -> tuple[bytes, bytes]:
        at, x = feature_vector(voters, hits, n)
        return at.astype("<i4").tobytes(), x.astype("<f8").tobytes()

    def known_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                hits, n = voters.lexicon.count(t)
                rows.append((bytes(k + 1 for k in voters.vote(t, hits, n)), *packed(t, hits, n)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in columns], b.column(1)], names=["votes", "at", "x", "y"])

    known = sorted(sample.mapInArrow(known_rows, "votes binary, at binary, x binary, y int").collect(), key=lambda r: (r.y, r.votes, r.at, r.x))
    y = np.array([r.y for r in known], np.int64)
    loud_of = [float(np.mean([2 in r.votes for r in known if r.y == k] or [0.5])) for k in (0, 1)]
    loud_share = max(0.02, PRIOR * loud_of[1] + (1 - PRIOR) * loud_of[0])
    total = max(1, docs.count())
    # twice as many as are wanted, as the share is a guess; the excess goes below
    rates = [min(1.0, train_rows / total / (1 - min(loud_share, 0.9))), min(1.0, train_rows / total / loud_share)]

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen, taken = ["votes", "n", "key", "at", "x"], Counter(), set()
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                hits, n = voters.lexicon.count(t)
                vote = bytes(x + 1 for x in voters.vote(t, hits, n))
                seen[vote] += 1
                key = xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), 11)
                if key < rates[2 in vote] * 2**64 and key not in taken:
                    taken.add(key)
                    rows.append((vote, 0, key - 2**63, *packed(t, hits, n)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        none = [None] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((list(seen), list(seen.values()), none, none, none), kinds, strict=True)], names=names)

    voted = scratch.save(docs.select("text").mapInArrow(votes, "votes binary, n long, key long, at binary, x binary"))
    patterns = voted.filter("key IS NULL").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    texts = voted.filter("key IS NOT NULL").groupBy("key").agg(*[F.min(c).alias(c) for c in ("votes", "at", "x")])
    loud = F.instr(F.hex("votes"), "02") % 2 == 1  # vote 1, as a byte
    train_on = [r for side in (loud, ~loud) for r in texts.filter(side).orderBy("key").limit(train_rows // 2).collect()]
    scratch.drop(sample)
    scratch.drop(voted)
    read = lambda rs: np.array([[k - 1 for k in r.votes] for r in rs], np.int64).reshape(len(rs), len(voters.names))
    model = LabelModel.fit(read(patterns), np.array([r.n for r in patterns], float), read(known), np.ones(len(known)), y)
    out = ToxicityModel(voters, model, np.zeros(size), float(np.log(model.prior / (1 - model.prior))))
    vectors = lambda rs: [(np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.x, "<f8")) for r in rs]
    if train_on:
        out.weights, out.bias = train(vectors(train_on), model.posterior(read(train_on)), size)
    if known:
        raw = np.array([out.bias + x @ out.weights[at] for at, x in vectors(known)])
        out.a, out.b = platt(raw, y.astype(float))
    return out


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of every row: null ids and repeated rows give a row each, an empty table none.

    A null text counts as empty. Other columns are not read.
    """
    from .quality import score as scored

    return scored(docs, model)


def reject(docs: DataFrame, model: ToxicityModel, most: float = 0.7) -> DataFrame:
    """docs without rows that score `most` or more. Columns as they were; repeated rows are judged each."""
    short_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < most for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(id_hash(doc_id), F.lit(3)) == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out(F.col("doc_id")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
