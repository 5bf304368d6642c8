"""Abusive, hateful or sexual content by non-negative positive-unlabelled learning.

A linear model over hashed words, word pairs and character groups is trained with numpy from
confirmed examples (a fixed list and the documents that raters found offensive) and unlabelled text,
by the non-negative class-prior-corrected risk. It rates passages; a document scores as its worst
passage. Since a rated document is mostly harmless text, training repeats: in each rated document only
the passages that the last model finds worst stand as examples of the next.

Training reads a bounded sample, whose bounds are parameters. Every document is scored, whole. The
model has a fixed size, so it is broadcast whatever the corpus holds.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.abuse_examples import EXAMPLES
from attestra.llm.unicode_forms import LOOKALIKES, PLAIN

BITS = 18
SIZE = 1 << BITS
#: Words in a passage at most, and by how many the next one is later where text has no sentence ends.
WINDOW, STEP = 18, 9
#: Weight of a character group beside a word or word pair, and of a passage rated harmless beside an unrated one.
GROUP_WEIGHT, RATED_WEIGHT = 0.3, 5
#: Least length of a passage's values, so that single words don't weigh as much as sentences.
FLOOR = 4.0
#: Score from which on a passage of a rated document counts as an example.
SURE = -0.3
#: Share of the rated documents that one passage may stand for as an example, two documents at least.
COPY_SHARE = 0.02

_INVISIBLE = re.compile("[\u00ad\u034f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufe00-\ufe0f]")
_LOOKS = str.maketrans(LOOKALIKES | PLAIN)
_LEET = str.maketrans("013457@$!", "oleastasi")
_ENDS = re.compile(r"\n+|(?<=[.!?…;])\s+|(?<=[。！？；])|(?<=[a-z0-9)])\s+(?=\d+\. )")
_TOKEN = re.compile("[\u3040-ヿ一-鿿]|[^\\W\\d_\u3040-ヿ一-鿿]+\\d*[^\\W_\u3040-ヿ一-鿿]*(?:['’*@$!.\\-]+[^\\W_]+)*|\\d+(?:[.,]\\d+)*[^\\W_]*")
_MARKUP = re.compile(r"\\(?:cite\w*|ref|label|section|subsection|input|url)\*?(?:\[[^\]]*\])?\{[^}]*\}|https?://\S+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_SIGNS, _DRAWN = re.compile(r"[*@$!.\d\-]"), re.compile(r"(.)\1{2,}")
#: Letters of a word that a hidden spelling may stand for, and the share of other documents up to which a word tells.
LETTERS, TELLING = (3, 13), 0.01


class Reader:
    """Texts as passages of words, disguises undone.

    A word written with stars, signs, digits, spaces or drawn-out letters is read as one of ``words``, if it can be one:
    the words that mark the confirmed examples, which ``telling_words`` takes from them.
    """

    def __init__(self, words: tuple[str, ...] = ()) -> None:
        self.words = frozenset(words)
        self.by_length = {n: sorted(w for w in self.words if len(w) == n) for n in range(LETTERS[0], LETTERS[1] + 1)}

    def revealed(self, word: str) -> str:
        """A disguised word as the known one that it hides, if any."""
        if word in self.words or not any(c.isalpha() for c in word):
            return word
        if _DRAWN.search(word):
            for kept in (r"\1", r"\1\1"):
                if (guess := _DRAWN.sub(kept, word)) in self.words:
                    return guess
        if not _SIGNS.search(word):
            return word
        for guess in (re.sub(r"[.\-*]", "", word), word.translate(_LEET), re.sub(r"[.\-]", "", word).translate(_LEET)):
            if guess in self.words:
                return guess
        if any(c in word for c in "*.-"):
            shape = re.compile("".join("." if c in "*.-" else re.escape(c) for c in word.translate(_LEET)) + r"\Z")
            for hidden in self.by_length.get(len(word), []):
                if shape.match(hidden):
                    return hidden
        return word

    def word(self, w: str) -> str:
        if w.isalpha() and not _DRAWN.search(w):
            return w
        w = self.revealed(w)
        return "0" if any(c.isdigit() for c in w) else w

    def joined(self, match: re.Match) -> str:
        letters = re.sub(r"[ .\-_*]", "", match.group())
        for cut in (0, 1):
            if letters[cut:] in self.words:
                return (letters[:cut] + " " if cut else "") + letters[cut:]
        return match.group()

    def plain(self, text: str) -> str:
        """Lower case without invisible characters, width forms, look-alike letters and spaced-out words."""
        return _SPACED.sub(self.joined, lowered(text))

    def sentences(self, text: str | None) -> list[str]:
        """Sentences of a text in plain form, without commands and links."""
        return _ENDS.split(self.plain(_MARKUP.sub(" ", text))) if text else []

    def windows(self, sentence: str) -> list[list[str]]:
        """Words of a sentence, of a long one in overlapping windows. Digits are one word ``0``."""
        words = [self.word(w) for w in _TOKEN.findall(sentence)]
        if len(words) <= WINDOW:
            return [words] if words else []
        return [words[i : i + WINDOW] for i in range(0, len(words) - STEP, STEP)]

    def passages(self, text: str | None) -> list[list[str]]:
        """Words of the passages of a text."""
        return [w for sentence in self.sentences(text) for w in self.windows(sentence)]


def lowered(text: str) -> str:
    """Lower case without invisible characters, width forms and look-alike letters."""
    if not text.isascii():
        text = ud.normalize("NFKC", _INVISIBLE.sub("", text))
        latin = sum("a" <= c <= "z" for c in text.lower())
        if latin * 2 > sum(c.isalpha() for c in text):
            text = text.translate(_LOOKS)
        text = text.replace("’", "'")
    return text.lower()


_PLAIN_WORD = re.compile(rf"[^\W\d_]{{{LETTERS[0]},{LETTERS[1]}}}")


def telling_words(unlabelled: list[str]) -> tuple[str, ...]:
    """Words of the confirmed examples that at most ``TELLING`` of the unlabelled texts have."""
    held: dict[str, int] = {}
    known = {w for e in EXAMPLES for w in _PLAIN_WORD.findall(lowered(e))}
    for text in unlabelled:
        for w in known & set(_PLAIN_WORD.findall(lowered(text))):
            held[w] = held.get(w, 0) + 1
    return tuple(sorted(w for w in known if held.get(w, 0) <= TELLING * len(unlabelled)))


class Features:
    """Hashed features of words, kept for each word once."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.hashes: list[int] = []
        self.parts: list[np.ndarray] = []

    def word(self, w: str) -> int:
        at = self.ids.get(w)
        if at is None:
            at = self.ids[w] = len(self.hashes)
            self.hashes.append(xxhash.xxh64_intdigest(w.encode()) >> 1)
            padded = f"<{w}>"
            grams = {padded[i : i + 4] for i in range(len(padded) - 3)} if len(w) > 3 else set()
            self.parts.append(np.array([SIZE + xxhash.xxh64_intdigest(g.encode(), seed=1) % SIZE for g in sorted(grams)], dtype=np.int32))
        return at

    def row(self, words: list[str]) -> np.ndarray:
        """Distinct feature numbers of a passage: words and word pairs below ``SIZE``, character groups from there."""
        ids = [self.word(w) for w in words]
        h = np.array([self.hashes[i] for i in ids], dtype=np.uint64)
        pairs = [(h[: len(h) - d] * np.uint64(0x9E3779B97F4A7C15 + 2 * d) ^ (h[d:] >> np.uint64(d))) % np.uint64(SIZE) for d in (1, 2) if len(h) > d]
        return np.unique(np.concatenate([h % np.uint64(SIZE), *(self.parts[i] for i in ids), *pairs]).astype(np.int32))


def _values(flat: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Value of each feature of each row; a row's values have length one, over at least four words' worth."""
    value = np.where(flat < SIZE, 1.0, GROUP_WEIGHT)
    norm = np.sqrt(np.maximum(np.bincount(owner, weights=value * value, minlength=rows), FLOOR))
    return value / norm[owner]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    threshold: float = 0.0
    words: tuple[str, ...] = ()

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        index, owner, value = _matrix(rows)
        return np.bincount(owner, weights=self.weights[index] * value, minlength=len(rows)) + self.bias


def _matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    index, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    return index, owner, _values(index, owner, len(rows))


def train(positive: list[np.ndarray], p_weight: np.ndarray, unlabelled: list[np.ndarray], u_weight: np.ndarray, prior: float, steps: int = 200, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Least non-negative positive-unlabelled risk with the logistic loss, by Adam over all rows.

    risk = prior E_P[l(+)] + max(0, E_U[l(-)] - prior E_P[l(-)]). Where the second part, which estimates
    the risk of harmless text, would turn negative, only the first part is followed. Same rows, same model.
    Only features that occur have a weight while training; they are laid out by row for the scores and by
    feature for the gradient, so both are sums over neighbours.
    """
    rows = positive + unlabelled
    index, owner, value = _matrix(rows)
    used, index = np.unique(index, return_inverse=True)
    value = value.astype(np.float32)
    by_row = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
    by_feature = np.argsort(index, kind="stable")
    f_owner, f_value, f_start = owner[by_feature], value[by_feature], np.concatenate([[0], np.cumsum(np.bincount(index))[:-1]])
    n_p = len(positive)
    p, u = (p_weight / p_weight.sum()).astype(np.float32), (u_weight / u_weight.sum()).astype(np.float32)
    w, b = np.zeros(len(used), np.float32), -1.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.add.reduceat(w[index] * value, by_row) + np.float32(b)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        rest = float((u * np.logaddexp(0, z[n_p:])).sum(dtype=np.float64) - prior * (p * np.logaddexp(0, z[:n_p])).sum(dtype=np.float64))
        g = np.empty(len(rows), np.float32)
        if rest >= 0:
            g[:n_p], g[n_p:] = -prior * p, u * s[n_p:]
        else:
            g[:n_p], g[n_p:] = prior * p * (s[:n_p] - 1), 0
        grad, gb = np.add.reduceat(g[f_owner] * f_value, f_start) + np.float32(decay) * w, float(g.sum(dtype=np.float64))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        pace = rate * (1 - 0.9 * step / steps)
        w -= np.float32(pace / c1) * m / (np.sqrt(v / np.float32(c2)) + np.float32(1e-9))
        b -= pace * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    whole = np.zeros(2 * SIZE, np.float32)
    whole[used] = w
    return Model(whole, float(b))


def _majority(labels: DataFrame) -> DataFrame:
    """``doc_id, rated``: 1 or 0 by the majority of raters; ties and null ratings say nothing."""
    votes = labels.filter(F.col("offensive").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("offensive").alias("share"))
    return votes.filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("rated"))


def fit(documents: DataFrame, labels: DataFrame, prior: float = 0.04, rounds: int = 2, max_rated: int = 8000, max_unlabelled: int = 12000) -> Model:
    """A model from the rated documents and unlabelled text.

    ``max_rated`` and ``max_unlabelled`` bound the documents that training reads; beyond them those with
    the smallest hash of ``doc_id`` are taken. Of rows with one ``doc_id`` the smallest text counts, so the bounds are
    those of what reaches the driver. Without ratings the fixed examples alone are positive.
    A score above 0 says that a passage is rather an example than not, given ``prior``, the share of
    such passages.
    """
    draw = F.xxhash64("doc_id")
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull())
    # Numbers alone are ranked; what is sent to the scan of texts has at most as many rows as the bounds say.
    marked = _majority(labels).orderBy(draw).limit(max_rated)
    drawn = texts.select("doc_id").distinct().orderBy(draw, "doc_id").limit(max_unlabelled).withColumn("drawn", F.lit(True))
    wanted = F.broadcast(marked.join(drawn, "doc_id", "full_outer"))
    read = texts.join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("rated").alias("rated"), F.max("drawn").alias("drawn"))
    sample = read.toPandas().sort_values("doc_id")
    rated = sample[sample["rated"].notna()]
    return fit_texts(list(zip(rated["text"], rated["rated"].astype(int))), list(sample.loc[sample["drawn"].notna(), "text"]), prior, rounds)


def fit_texts(rated: list[tuple[str, int]], unlabelled: list[str], prior: float = 0.04, rounds: int = 2) -> Model:
    """The model of ``fit`` from texts in memory."""
    reader = Reader(telling_words(unlabelled))
    features, kept, split = Features(), {}, {}

    def row(words: list[str]) -> tuple[str, np.ndarray]:
        key = " ".join(words)
        if key not in kept:
            kept[key] = features.row(words)
        return key, kept[key]

    def keys_of(text: str) -> dict[str, None]:
        """The passages of a text, each once in order; a sentence that many texts have is parted once."""
        out: dict[str, None] = {}
        for sentence in reader.sentences(text):
            if sentence not in split:
                split[sentence] = [row(words)[0] for words in reader.windows(sentence)]
            out |= dict.fromkeys(split[sentence])
        return out

    counts: dict[str, int] = {}
    for text in unlabelled:
        for key in keys_of(text):
            counts[key] = counts.get(key, 0) + 1
    harmless: dict[str, int] = {}
    cases: list[list[str]] = []
    calm: list[list[str]] = []
    for text, verdict in rated:
        keys = list(keys_of(text))
        if verdict:
            cases.append(keys)
        else:
            calm.append(keys)
            for key in keys:
                harmless[key] = harmless.get(key, 0) + 1
    for key, n in harmless.items():
        counts[key] = counts.get(key, 0) + RATED_WEIGHT * n
    given = [row(words)[0] for e in EXAMPLES for words in reader.passages(e)]
    if not counts:
        counts = {row(["0"])[0]: 1}
    u_keys = list(counts)
    u_rows, u_weight = [kept[k] for k in u_keys], np.array([counts[k] for k in u_keys], dtype=np.float64)
    inside: dict[str, int] = {}
    for keys in cases:
        for key in keys:
            inside[key] = inside.get(key, 0) + 1
    n_docs = max(1, len(unlabelled) + len(rated))
    # A passage counts as an example in so far as rated documents have it more often than others.
    lift = {k: (n / max(1, len(cases))) / ((counts.get(k, 0) + 1) / n_docs) / (1 + 4 * harmless.get(k, 0)) for k, n in inside.items()}
    picked = [{k: min(1.0, 0.2 * lift[k]) for k in keys if lift[k] > 1} for keys in cases]

    def learn(docs: list[int]) -> Model:
        weights = {k: 1.0 for k in given}
        for i in docs:
            for k, x in picked[i].items():
                weights[k] = weights.get(k, 0) + x
        keys = list(weights)
        # Copies of one document must not outweigh all others.
        most = max(2.0, COPY_SHARE * len(docs))
        return train([kept[k] for k in keys], np.array([min(weights[k], most) for k in keys]), u_rows, u_weight, prior)

    # What one half teaches decides on the other half, so that no passage speaks for itself.
    halves = [[i for i in range(len(cases)) if i % 2 == h] for h in (0, 1)]
    for _ in range(rounds):
        # Both halves at once: the sums of numpy leave the other thread its turn.
        with ThreadPoolExecutor(2) as pool:
            teachers = list(pool.map(learn, reversed(halves))) if cases else []
        for h, teacher in enumerate(teachers):
            for i in halves[h]:
                scores = dict(zip(cases[i], teacher.scores([kept[k] for k in cases[i]])))
                best = max(scores.values(), default=0.0)
                picked[i] = {k: 1.0 for k, x in scores.items() if x > SURE and x >= best - 1.0 and lift[k] > 1}
    model = learn(list(range(len(cases))))
    model.words = tuple(reader.words)
    if cases:
        worst = lambda teacher, keys: max(teacher.scores([kept[k] for k in keys]), default=-9.0)
        rated_scores = [(1, worst(teachers[h], cases[i])) for h in (0, 1) for i in halves[h]] + [(0, max(worst(t, keys) for t in teachers)) for keys in calm]
        model.threshold = _threshold(rated_scores)
    return model


#: Ratings that say as much for a cut at 0 as the ratings there are say for theirs.
CUT_WEIGHT = 50


def _threshold(rated: list[tuple[int, float]]) -> float:
    """The middle of the cuts near 0 with the fewest disagreements with the ratings, or one more, drawn towards 0.

    The fewer ratings there are, the nearer it is to 0, with ``CUT_WEIGHT`` half way. Cases are scored by the model of the
    other half.
    """
    if not rated:
        return 0.0
    y, z = np.array([v for v, _ in rated]) == 1, np.array([x for _, x in rated])
    cuts = np.linspace(-0.5, 0.9, 57)
    wrong = np.array([((z > c) != y).sum() for c in cuts])
    return float(np.median(cuts[wrong <= wrong.min() + 1])) * len(rated) / (len(rated) + CUT_WEIGHT)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, source, score, offensive`` of every row; the score of the worst passage.

    Null and blank texts have no passage: their score is null and they are not offensive. Rows stored
    twice are scored twice. An empty table gives an empty result; further columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, features, known = Reader(shared.value.words), Features(), {}
        for batch in batches:
            if len(known) > 200_000 or len(features.hashes) > 400_000:
                features, known = Features(), {}
            parted = [reader.sentences(t) for t in batch["text"]]
            # A sentence that many texts have is rated once; the worst of its passages counts.
            fresh = {s: reader.windows(s) for s in {s for ss in parted for s in ss} if s not in known}
            rows = [features.row(words) for ws in fresh.values() for words in ws]
            found = iter(shared.value.scores(rows).tolist())
            known.update({s: max([next(found) for _ in ws], default=None) for s, ws in fresh.items()})
            best = [max((x for s in ss if (x := known[s]) is not None), default=None) for ss in parted]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": pd.Series(best, dtype="float64")})

    rated = documents.select("doc_id", "source", "text").mapInPandas(rate, "doc_id bigint, source string, score double")
    return rated.withColumn("offensive", F.coalesce(F.col("score") > model.threshold, F.lit(False)))


def rates(scored: DataFrame) -> DataFrame:
    """``source, documents, offensive, rate`` for each source, null source included."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("offensive").alias("offensive")).withColumn("rate", F.col("offensive") / F.col("documents"))
