"""Toxicity classifier with counterfactual regularisation.

A logistic model over words and their beginnings, each at three levels: found at least once, twice, three times.
For every labelled text that names a group, copies with the identity terms swapped for others of their kind and
language are made, and the fit penalises squared differences of the scores' logits between text and copy. So a word
that merely names a group gains no weight from the company it keeps in the sample.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fit uses at most so many labelled rows, those with the smallest hash of their id.
FIT_ROWS = 6_000
BUCKETS = 1 << 20
#: A word stands for itself and for its first so many characters; counts above LEVELS are alike.
PREFIXES, LEVELS = (3, 4, 5, 6, 7), 3
THRESHOLD = 0.7
#: Parameters of the model, not of the data: features enter if their log odds in the sample stand out by so many standard
#: errors, and of those at most the first MOST_WORDS, so that the dense fit has a bounded size.
LEAST_Z, MOST_WORDS = 5.0, 1024
#: Terms of a kind and language stand in for one another (lower case, words between letters).
IDENTITY = {
    "gender en": "woman man women men female male girl boy girls boys transgender nonbinary",
    "gender de": "frau mann frauen männer mädchen junge jungen weiblich männlich",
    "gender fr": "femme homme femmes hommes fille garçon filles garçons",
    "gender es": "mujer hombre mujeres hombres niña niño niñas niños",
    "religion en": "christian muslim jewish hindu buddhist sikh atheist catholic",
    "religions en": "christians muslims jews hindus buddhists sikhs atheists catholics",
    "religion de": "christen muslime juden hindus buddhisten atheisten katholiken",
    "religion fr": "chrétiens musulmans juifs hindous bouddhistes athées catholiques",
    "religion es": "cristianos musulmanes judíos hindúes budistas ateos católicos",
    "origin en": "african asian european american mexican arab indian chinese german french spanish turkish polish",
    "origins en": "africans asians europeans americans mexicans arabs indians germans turks poles",
    "origin de": "afrikaner asiaten europäer amerikaner mexikaner araber inder chinesen deutsche türken polen",
    "origin fr": "africains asiatiques européens américains mexicains arabes indiens chinois allemands turcs polonais",
    "origin es": "africanos asiáticos europeos americanos mexicanos árabes indios chinos alemanes turcos polacos",
    "orientation en": "gay lesbian straight bisexual queer",
    "orientations en": "gays lesbians heterosexuals bisexuals queers",
    "orientation de": "schwule lesben heterosexuelle bisexuelle",
    "orientation fr": "gays lesbiennes hétérosexuels bisexuels",
    "orientation es": "gays lesbianas heterosexuales bisexuales",
    "colour en": "black white brown",
    "colour de": "schwarze weiße braune",
    "colour fr": "noirs blancs métis",
    "colour es": "negros blancos mestizos",
    "ability en": "blind deaf disabled autistic",
    "ability de": "blinde taube behinderte autisten",
    "ability fr": "aveugles sourds handicapés autistes",
    "ability es": "ciegos sordos discapacitados autistas",
    "age en": "old young elderly",
    "age de": "alte junge ältere",
    "age fr": "vieux jeunes aînés",
    "age es": "viejos jóvenes ancianos",
}
#: Weight of the squared logit changes under swaps, against a log loss summed over labelled texts.
FAIRNESS = 4.0
#: Copies of a labelled text with other identity terms.
COPIES = 3

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


def swaps_of(groups: dict[str, str]) -> dict[bytes, list[bytes]]:
    """For each term the others of its groups."""
    out: dict[bytes, dict[bytes, None]] = {}
    for terms in groups.values():
        listed = [t.encode() for t in terms.split()]
        for t in listed:
            out.setdefault(t, {}).update(dict.fromkeys(x for x in listed if x != t))
    return {t: list(others) for t, others in out.items() if others}


SWAPS = swaps_of(IDENTITY)


def words(text: str | None) -> list[bytes]:
    """Runs of letters (ASCII ones lower-cased), apostrophes and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def buckets(word: bytes) -> list[int]:
    """Buckets of a word and its beginnings."""
    letters = word.decode("utf-8", "surrogatepass")
    grams = [word, *[b"<" + letters[:k].encode("utf-8", "surrogatepass") for k in PREFIXES if len(letters) > k]]
    return [zlib.crc32(g) % BUCKETS for g in grams]


def leveled(counts: Counter[bytes]) -> list[int]:
    """Features of a bag of words: LEVELS * bucket + level, for each level that the bucket's count reaches."""
    total: Counter[int] = Counter()
    for w, n in counts.items():
        for j in buckets(w):
            total[j] += n
    return sorted(LEVELS * j + i for j, n in total.items() for i in range(min(n, LEVELS)))


def features(text: str | None, swaps: dict[bytes, list[bytes]] = SWAPS) -> tuple[list[int], list[list[int]]]:
    """Features of a text, and those of its counterfactual copies (none if it names no group)."""
    bag = Counter(words(text))
    named = sorted(bag.keys() & swaps.keys())
    copies = []
    for i in range(COPIES if named else 0):
        other = Counter({w: n for w, n in bag.items() if w not in swaps})
        for w in named:
            other[swaps[w][(zlib.crc32(w) + i) % len(swaps[w])]] += bag[w]
        copies.append(leveled(other))
    return leveled(bag), copies


def _features(swaps: dict[bytes, list[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [features(t.as_py(), swaps) for t in b.column(1)]
            told = [pa.array([x for x, _ in both], pa.list_(pa.int32())), pa.array([x for _, x in both], pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *told, *b.columns[2:]], ["y", "here", "copies", *b.schema.names[2:]])

    return run


@dataclass
class Model:
    bias: float
    weights: dict[int, float]
    #: Labelled texts that name a group, and so took part in the penalty.
    swapped: int = 0

    def logit(self, here: list[int]) -> float:
        """The logit of a text with these features."""
        return self.bias + sum(self.weights.get(j, 0.0) for j in here)


def _matrix(rows: list, place: dict[int, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(place)), np.float32)
    for i, r in enumerate(rows):
        x[i, [place[j] for j in np.asarray(r).tolist() if j in place]] = 1
    return x


def fit(y: np.ndarray, here: list, copies: list, ridge: float = 1.0, fairness: float = FAIRNESS, steps: int = 25) -> Model:
    """Newton steps on log loss + ridge * |w|^2 / 2 + fairness / 2 * sum of squared logit changes between text and copies."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(math.log(share / (1 - share)), {})
    flat = np.concatenate([np.asarray(h, np.int32) for h in here] or [np.zeros(0, np.int32)])
    sizes = np.array([len(h) for h in here])
    n1, n0 = y.sum(), (1 - y).sum()
    d1 = np.bincount(flat, np.repeat(y, sizes), BUCKETS * LEVELS)
    d = np.bincount(flat, minlength=BUCKETS * LEVELS)
    d0 = d - d1
    odds = np.log((d1 + 0.5) / (n1 - d1 + 0.5)) - np.log((d0 + 0.5) / (n0 - d0 + 0.5))
    error = np.sqrt(1 / (d1 + 0.5) + 1 / (n1 - d1 + 0.5) + 1 / (d0 + 0.5) + 1 / (n0 - d0 + 0.5))
    z = np.where(d > 0, np.abs(odds) / error, 0)
    order = np.argsort(-z, kind="stable")[:MOST_WORDS]
    chosen = [int(j) for j in order if z[j] >= LEAST_Z]
    place = {j: i for i, j in enumerate(chosen)}
    x = np.concatenate([_matrix(here, place), np.ones((len(y), 1), np.float32)], axis=1).astype(np.float64)
    base = [i for i, c in enumerate(copies) for _ in c]
    delta = x[base] - np.concatenate([_matrix([c for cs in copies for c in cs], place), np.ones((len(base), 1))], axis=1) if base else np.zeros((0, x.shape[1]))
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    keep += fairness * delta.T @ delta
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Model(float(w[-1]), {j: float(w[i]) for j, i in place.items()}, sum(len(c) > 0 for c in copies))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, groups: dict[str, str] = IDENTITY, fairness: float = FAIRNESS) -> Model:
    """Fit on the texts of ``docs`` that ``labels`` (``doc_id, toxic``) marks, not held out, at most ``fit_rows``.

    Where an id repeats, each of its rows meets each of its labels; the bound holds for the pairs.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out(F.col("doc_id")))
    first = [F.xxhash64("doc_id"), "doc_id", "y"]
    few = usable.orderBy(*first).limit(fit_rows)
    # features first: no text leaves the task that reads it
    told = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("y", "text", "doc_id", F.xxhash64("text").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = told.mapInArrow(_features(swaps_of(groups)), f"y double, here array<int>, copies array<array<int>>, doc_id {kind}, h long")
    rows = told.orderBy(*first, "h").limit(fit_rows).select("y", "here", "copies").toArrow()
    return fit(rows["y"].to_numpy(), [x.values.to_numpy() for x in rows["here"]], [x.as_py() for x in rows["copies"]], fairness=fairness)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the gain of each count of a bucket in the model, and the few such buckets of each word
        gains: dict[int, list[float]] = {}
        for j, w in model.weights.items():
            g = gains.setdefault(j // LEVELS, [0.0] * (LEVELS + 1))
            for n in range(j % LEVELS + 1, LEVELS + 1):
                g[n] += w
        known: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            out = np.empty(b.num_rows)
            for i, text in enumerate(b.column(1)):
                total: dict[int, int] = {}
                for w, n in Counter(words(text.as_py())).items():
                    mine = known.get(w)
                    if mine is None:
                        mine = known[w] = tuple(j for j in buckets(w) if j in gains)
                    for j in mine:
                        total[j] = total.get(j, 0) + n
                out[i] = model.bias + sum(gains[j][min(n, LEVELS)] for j, n in sorted(total.items()))
            if len(known) > 500_000:
                known = {}
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -700, 700))))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, groups: dict[str, str] = IDENTITY, fairness: float = FAIRNESS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, held_out, score, predicted``.

    Learns from ``labels`` of rows that are not held out, at most ``fit_rows`` of them; scores whole texts. ``groups``
    are the terms that stand in for one another and ``fairness`` the weight of their penalty, which is on logits, not
    on scores; texts that name no group are not touched by it. Null and empty texts get the model's bias. A null id is
    not held out and has no label. Repeated rows stay. Without labels the score is 0.5; an empty table gives an empty
    result. Other columns, whatever their names, are no inputs of the score.
    """
    model = train(docs, labels, fit_rows, groups, fairness)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_score(model), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
