"""Toxicity by compression distance: one zstandard dictionary a class, windows, calibrated thresholds."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import table

#: Stands at the end of both dictionaries and in front of every window, so that a window's frame is
#: always compressed and its length shows what the window itself costs.
ANCHOR = b"|0123456789abcdef|"
_SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
GAINS = tuple(range(1, 10))


@dataclass(frozen=True)
class ToxicityParams:
    """Bounds of the training sample and of the dictionaries; none of them touches scoring."""

    toxic_rows: int = 1_600
    ordinary_rows: int = 3_000
    row_chars: int = 20_000  # longer texts are not taken as training rows
    class_chars: int = 6_000_000  # rows of a class are taken up to so many characters
    words: int = 4  # of a window
    share: float = 0.1  # of toxic windows: those the toxic text shortens most
    passes: int = 2
    toxic_bytes: int = 4_096
    ordinary_bytes: int = 16_384
    draft_bytes: int = 1 << 19
    hard_bytes: int = 16_384  # ordinary text added each time it is found to be taken for toxic
    hard_rounds: int = 3
    hard_gain: int = 2
    mined_windows: int = 60_000  # ordinary windows a pass looks for such text in; twice as many at the end
    threshold: float = 0.3
    memo_windows: int = 300_000  # windows whose gain a task remembers; does not change a score


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    words: int


def windows(text: str | None, words: int) -> list[bytes]:
    """A whole text, cut into windows of ``words`` words in lower case without punctuation."""
    ws = (text or "").encode().lower().translate(_SPACES).split()
    return [ANCHOR + b" " + b" ".join(ws[i : i + words]) + b" " for i in range(0, len(ws), words)]


def _lengths(dictionary: bytes):
    """The function that gives the compressed length of a window under a dictionary."""
    params = zs.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=17, search_log=7, min_match=4, target_length=128,
        strategy=zs.STRATEGY_BTOPT, write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    held = zs.ZstdCompressionDict(dictionary + ANCHOR, dict_type=zs.DICT_TYPE_RAWCONTENT)
    compress = zs.ZstdCompressor(dict_data=held, compression_params=params).compress
    return lambda ws: np.fromiter((len(compress(w)) for w in ws), dtype=np.int32, count=len(ws))


def _at_each(text: bytes, k: int) -> np.ndarray:
    """The ``k`` bytes (8 at most) at each place of a text, as a number."""
    whole = np.ndarray((len(text),), dtype="<u8", buffer=text + bytes(8), strides=(1,))
    return whole[: max(0, len(text) - k + 1)] & np.uint64((1 << 8 * k) - 1)


class Telling:
    """Whether a window holds a string that the toxic dictionary has and the ordinary one has not.

    For dictionaries of which the toxic one is text of its own in front of the ordinary one's: there
    a window without such a string finds the same matches, as near, in either, so its gain is 0. The
    strings are the shortest from each place of the toxic text, of ``SPAN`` bytes at most; of longer
    ones that stand for none that begins later, the first ``SPAN`` bytes are looked for.
    """

    LEAST, SPAN, BITS = 4, 8, 17  # no match is shorter than 4 bytes

    def __init__(self, toxic: bytes, ordinary: bytes):
        own, self.keys, self.marks = len(toxic) - len(ordinary), {}, {}
        shared = np.ones(own, dtype=bool)  # places whose string of one byte less stands in the ordinary text
        for k in range(self.LEAST, self.SPAN + 1):
            here = _at_each(toxic[: own + k - 1], k)
            here = np.append(here, np.zeros(own - len(here), dtype=here.dtype))  # the text may end before
            there = np.isin(here, _at_each(ordinary, k))
            there[max(0, len(toxic) - k + 1) :] = True
            if k == self.SPAN:
                there &= ~np.array([t and self._ends_alone(toxic, ordinary, i) for i, t in enumerate(there & shared)], dtype=bool)
            self.keys[k] = np.unique(here[shared & ~there])
            self.marks[k] = np.zeros(1 << self.BITS, dtype=bool)
            self.marks[k][self._hash(self.keys[k])] = True
            shared &= there

    def _ends_alone(self, toxic: bytes, ordinary: bytes, at: int) -> bool:
        end = at + self.SPAN + 1
        while end <= len(toxic) and toxic[at:end] in ordinary:
            end += 1
        return end <= len(toxic) and toxic[at + 1 : end] in ordinary

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        parts = [w[len(ANCHOR) :] + b"\n" * self.SPAN for w in ws]  # no string reaches into the next window
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        text, found = b"".join(parts), np.zeros(len(ws), dtype=bool)
        for k, keys in self.keys.items():
            if len(keys):
                here = _at_each(text, k)
                at = np.flatnonzero(self.marks[k][self._hash(here)])
                near = np.minimum(np.searchsorted(keys, here[at]), len(keys) - 1)
                found[np.searchsorted(ends, at[keys[near] == here[at]], side="right")] = True
        return found


class Distance:
    """By how many bytes the toxic dictionary shortens windows more than the ordinary one does.

    Where the toxic dictionary goes on with the ordinary one, windows with nothing telling are not
    compressed: they gain 0.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _lengths(toxic), _lengths(ordinary)
        self.telling = Telling(toxic, ordinary) if toxic.endswith(ordinary) else None

    def __call__(self, ws: list[bytes]) -> np.ndarray:
        if self.telling is None or not ws:
            return self.ordinary(ws) - self.toxic(ws)
        at = np.flatnonzero(self.telling(ws))
        told, out = [ws[i] for i in at], np.zeros(len(ws), dtype=np.int32)
        out[at] = self.ordinary(told) - self.toxic(told)
        return out


class Remembered(dict):
    """Gains of windows seen before in the same task, up to so many: copies and near copies repeat them."""

    def __init__(self, distance: Distance, most: int):
        super().__init__()
        self.distance, self.most = distance, most

    def gains(self, ws: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        new = [w for w in dict.fromkeys(ws) if w not in self]
        self.update(zip(new, self.distance(new).tolist()))
        return np.fromiter(map(self.__getitem__, ws), dtype=np.int32, count=len(ws))


def _dictionary(ws: list[bytes], size: int) -> bytes:
    """The most valuable ``size`` bytes of a dictionary trained on windows: its end."""
    samples = [w[len(ANCHOR) :] for w in ws]
    try:
        return zs.train_dictionary(max(4 * size, 8_192), samples, k=16, d=6, level=3).as_bytes()[-size:]
    except zs.ZstdError:  # too few samples: their bytes are the dictionary
        return b"".join(samples)[-size:]


def _text(ws: list[bytes], size: int) -> bytes:
    return b"".join(w[len(ANCHOR) :] for w in ws)[:size]


def _most(gains: np.ndarray, ws: list[bytes], share: float) -> list[bytes]:
    if not len(ws):
        return []
    least = max(1, int(np.partition(gains, -max(1, int(len(ws) * share)))[-max(1, int(len(ws) * share))]))
    return [w for w, g in zip(ws, gains) if g >= least]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], p: ToxicityParams) -> tuple[bytes, bytes]:
    """``(toxic, ordinary)`` dictionaries from windows of each class.

    The toxic one goes on with the ordinary one's text, so both shorten common words alike and
    their difference is what toxic text adds. Ordinary windows that still are shorter under the
    toxic dictionary show what it holds by chance: their text is added to both, some rounds over.
    """
    own, base = _dictionary(toxic, p.toxic_bytes), _dictionary(ordinary, p.ordinary_bytes)
    for _ in range(p.hard_rounds):
        hard = [w for w, g in zip(ordinary, Distance(own + base, base)(ordinary)) if g >= p.hard_gain]
        if not hard:
            break
        base = _text(hard, p.hard_bytes) + base
    return own + base, base


def _measures(gains: np.ndarray) -> np.ndarray:
    counts = [np.log1p((gains >= g).sum()) for g in GAINS]
    return np.array([1.0, *counts, np.log1p(len(gains)), gains.max(initial=0)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(toxic: list[str], ordinary: list[str], base_rate: float, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Dictionaries and weights from the texts of a bounded sample.

    The sample is dealt in two halves, and a half is only ever judged by dictionaries of the other.
    First the running text of each class is the dictionary: of a half's toxic windows those are
    kept that the other half's toxic text shortens most. Dictionaries are trained on what is kept,
    and judge the other half again, ``passes`` times. Every text of the sample, measured by the
    other half's dictionaries, then calibrates the weights; the final dictionaries come from all.
    """
    rng = np.random.default_rng(7)
    cut = lambda texts: [[windows(t, p.words) for t in texts[i::2]] for i in (0, 1)]

    def distinct(docs: list[list[bytes]], most: int | None = None) -> list[bytes]:
        ws = list(dict.fromkeys(w for d in docs for w in d))
        return [ws[i] for i in rng.permutation(len(ws))[:most]]

    tox, plain = cut(toxic), cut(ordinary)
    tox_w = [distinct(d) for d in tox]
    plain_w = [distinct(d, p.mined_windows) for d in plain]
    kept = []
    for i in (0, 1):
        size = min(p.draft_bytes, *(sum(map(len, x)) for x in (tox_w[1 - i], plain_w[1 - i])))
        draft = Distance(_text(tox_w[1 - i], size), _text(plain_w[1 - i], size))
        kept.append(_most(draft(tox_w[i]), tox_w[i], p.share))
    judge = []
    for _ in range(p.passes):
        judge = [Distance(*dictionaries(kept[1 - i], plain_w[1 - i], p)) for i in (0, 1)]
        kept = [_most(judge[i](tox_w[i]), tox_w[i], p.share) for i in (0, 1)]
    final = dictionaries(kept[0] + kept[1], plain_w[0] + plain_w[1], p)
    x = np.array([_measures(judge[i](d)) for label in (tox, plain) for i in (0, 1) for d in label[i]]).reshape(-1, len(GAINS) + 3)
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    if not len(y) or y.min() == y.max():
        weights = np.zeros(len(GAINS) + 3)
        weights[0] = np.log(max(base_rate, 1e-6) / max(1 - base_rate, 1e-6))
    else:
        share = y.mean()
        weights = _logistic(x, y, np.where(y == 1, base_rate / share, (1 - base_rate) / (1 - share)))
    return ToxicityModel(*final, tuple(weights.tolist()), p.words)


def held_out(id_col: str = "doc_id") -> "F.Column":
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Train on a bounded sample of labelled rows outside the held-out quarter.

    At most ``toxic_rows`` and ``ordinary_rows`` rows, those with the least hashed ids, go to one
    task, a class up to ``class_chars`` characters; their ids, at most as many, are broadcast. The
    driver gets the finished model alone, some 0.1 MB. Rows without label or text, and texts of
    over ``row_chars``, are not taken. A row labelled twice counts as toxic if one label says so.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out())
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    take = lambda v, n: known.where(F.col("toxic") == v).orderBy(*by_hash).limit(n)
    ids = take(1, p.toxic_rows).unionByName(take(0, p.ordinary_rows))
    rate = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    rows = docs.select("doc_id", "text").where(F.length("text") <= p.row_chars).join(F.broadcast(ids), "doc_id")
    before = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(*by_hash, "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", before).where(F.col("upto") <= p.class_chars)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([b for b in batches] or [pd.DataFrame({"toxic": [], "text": []})])
        m = train(sample.text[sample.toxic == 1].tolist(), sample.text[sample.toxic == 0].tolist(), rate, p)
        yield pd.DataFrame({"toxic": [m.toxic], "ordinary": [m.ordinary], "weights": [list(m.weights)]})

    sample = rows.select("toxic", "text", "upto").repartition(1).sortWithinPartitions("toxic", "upto", "text").select("toxic", "text")
    got = sample.mapInPandas(one, "toxic binary, ordinary binary, weights array<double>").collect()
    return ToxicityModel(bytes(got[0][0]), bytes(got[0][1]), tuple(got[0][2]), p.words) if got else train([], [], rate, p)


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) for every whole text.

    A null or empty text has no window and gets the score of none. All columns stay; columns of
    these names are replaced. Equal texts get equal scores.
    """

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, w = Remembered(Distance(model.toxic, model.ordinary), p.memo_windows), np.array(model.weights)
        for texts in batches:
            z = [float(_measures(known.gains(windows(t, model.words))) @ w) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return df.withColumn("score", toxicity(F.col(text_col))).withColumn(
        "predicted", (F.col("score") >= p.threshold).cast("int")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The documents that the classifier does not reject, with the columns they had."""
    kept = score(docs.withColumn("_row", F.struct(*docs.columns)), fit(docs, labels, p), p=p).where("predicted = 0")
    return kept.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": query}
ORACLES: dict[str, str] = {}
