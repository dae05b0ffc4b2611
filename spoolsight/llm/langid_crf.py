"""Language identification by a linear-chain conditional random field over words.

Each word has features: its affixes of 1 to 3 characters, character 2- and 3-grams with word borders, the word itself, and
for each language whether the word is in that language's lexicon. A label's emission score is the sum of its weights for
them; weights of neighbouring labels (transitions) are learned with them. Forward-backward gives every word a probability of
each language given the whole text; a document's language is the one with the greatest mean probability.

As every text gets some learned language, a text's familiarity is measured too: the share of its words' features that the
sample has. Texts in a language or script that was not taught have few of them, and filters let them go.

The model is fitted on the driver to a bounded sample of labelled rows (see ``fit``). Prediction runs in tasks, over all words
of whole texts: the forward and backward passes of many texts advance together in numpy, and long texts are cut into
blocks that are first reduced to transfer matrices, so that the passes stay exact across blocks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoolsight.llm.resident import give_back, release, resident

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 17
NOTHING = BUCKETS  # the row of weights that stays 0
BLOCK = 512
WORDS_AT_ONCE = 200_000
TRAINED_AT_ONCE = 8_192  # words of the sample whose features are laid out together
KEPT_WORDS = 150_000
FLOOR = -25.0
GAIN = 1e-3  # training ends when a round adds less than this to the log-likelihood of a word
#: Features beyond chance that a text in a taught language has in the sample, one that is in it without doubt, and one whose given
#: language is confirmed. Prose in taught languages has 0.70 to 0.89 with samples of 50, 250 and 1,000 texts a language, texts of
#: the tables 0.95 or more; other languages in Latin script 0.49 to 0.79, other scripts and shuffled letters 0.16 at most.
FAMILIAR, CERTAIN, CONFIRMED = 2 / 3, 0.9, 1 / 3
#: Mean probability of its best language that a text needs. With 250 texts a language, prose in taught languages has 0.55 or more;
#: other languages that reach ``FAMILIAR`` have 0.47 at most.
MAJORITY = 0.5
UNKNOWN = "und"


def _feature_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of all words end to end, where each word's features begin, and a 64-bit hash of each word."""
    flat = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), "<u4").astype("u8")
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - place  # characters from here to the word's end, border included
    padded = np.concatenate([flat, np.zeros(2, "u8")])
    two = padded[:-2] * np.uint64(0x9E3779B97F4A7C15) + padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two + padded[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(1)
    grams = [np.where(left >= 2, _bucket(two), NOTHING), np.where(left >= 3, _bucket(three), NOTHING)]
    powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, "u8"))
    whole = np.add.reduceat(flat * powers[place], starts)
    singles = [_bucket(whole)]
    ends = starts + sizes - 1
    for n in (1, 2, 3):
        enough = sizes - 2 >= n
        for kind, first in ((17, starts + 1), (31, ends - n)):
            h = np.full(len(words), kind * 8 + n, "u8")
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + flat[np.where(enough, first + k, 0)]
            singles.append(np.where(enough, _bucket(h * np.uint64(0x9E3779B97F4A7C15)), NOTHING))
    counts = 2 * sizes + len(singles)
    out_starts = np.cumsum(counts) - counts
    out = np.full(int(counts.sum()), NOTHING)
    at = np.repeat(out_starts, sizes) + 2 * place
    out[at], out[at + 1] = grams
    for k, column in enumerate(singles):
        out[out_starts + 2 * sizes + k] = column
    return out, out_starts, whole


def _sample_feature_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_feature_ids``, but a part of the words after another, so that the driver need not hold what is made on the way for all."""
    parts, begins, hashes, size = [], [], [], 0
    for at in range(0, len(words), TRAINED_AT_ONCE):
        ids, starts, whole = _feature_ids(words[at : at + TRAINED_AT_ONCE])
        parts.append(ids.astype("i4"))
        begins.append(starts + size)
        hashes.append(whole)
        size += len(ids)
    return np.concatenate(parts), np.concatenate(begins), np.concatenate(hashes)


def _word_sums(weights: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``weights`` from each start to the next, a part of the words after another."""
    out = np.empty((len(starts), weights.shape[1]))
    ends = [*starts[TRAINED_AT_ONCE::TRAINED_AT_ONCE], len(rows)]
    for n, end in enumerate(ends):
        some = slice(n * TRAINED_AT_ONCE, (n + 1) * TRAINED_AT_ONCE)
        begin = starts[some][0]
        out[some] = np.add.reduceat(weights[rows[begin:end]], starts[some] - begin, axis=0)
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype("i8") % BUCKETS


@dataclass
class Model:
    """Languages, feature weights (a row of zeros last), lexicon (sorted word hashes and their language), its weights, and
    transition weights from row to column."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_language: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray
    taught: np.ndarray  # whether a feature is in the sample

    def lexicon_of(self, hashes: np.ndarray) -> np.ndarray:
        """Language number of each word in a lexicon, else the number of languages."""
        if not len(self.lexicon):
            return np.full(len(hashes), len(self.languages))
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, self.lexicon_language[at], len(self.languages))

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of each word's label scores, the greatest 1."""
        return self.emissions_and_familiarity(words)[0]

    def emissions_and_familiarity(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Also the share of each word's features that the sample has."""
        ids, starts, hashes = _feature_ids(words)
        scores = np.add.reduceat(self.weights[ids], starts, axis=0) + self.lexicon_weights[self.lexicon_of(hashes)]
        familiar = np.add.reduceat(self.taught[ids].astype("f8"), starts) / np.maximum(np.add.reduceat((ids != NOTHING).astype("f8"), starts), 1)
        return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), FLOOR)), familiar


def marginals(emissions: np.ndarray, rows: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, expected: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of every word, by forward-backward over sequences that lie end to end.

    ``rows`` leads from each word to its row of ``emissions``. If ``expected`` is given, the expected number of each transition
    is added to it, and minus the log of the partition function of all sequences is added to its last row.
    """
    k = emissions.shape[1]
    factors = np.exp(transitions)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(np.cumsum(lengths) - lengths, blocks) + number * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - number * BLOCK)
    order = np.argsort(-size, kind="stable")
    owner, number, first, size = owner[order], number[order], first[order], size[order]
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) if len(size) else 0)]  # blocks with a word at t
    enter, leave = np.ones((len(owner), k)), np.ones((len(owner), k))

    several = np.flatnonzero(blocks[owner] > 1)
    if len(several):
        whole = np.broadcast_to(np.eye(k), (len(several), k, k)).copy()
        for t in range(int(size[several].max())):
            some = slice(0, int(np.searchsorted(-size[several], -t, side="left")))
            whole[some] = (whole[some] @ factors) * emissions[rows[first[several[some]] + t]][:, None, :]
            if t % 8 == 7:
                whole[some] /= whole[some].max(axis=(1, 2), keepdims=True)
        by_number: dict[int, list[int]] = {}
        slot = {(int(owner[b]), int(number[b])): j for j, b in enumerate(several)}
        for j, b in enumerate(several):
            by_number.setdefault(int(number[b]), []).append(j)
        for n in sorted(by_number)[1:]:
            here = np.array(by_number[n])
            last = np.array([slot[int(owner[several[j]]), n - 1] for j in here])
            v = np.einsum("bi,bij->bj", enter[several[last]], whole[last])
            enter[several[here]] = v / v.max(axis=1, keepdims=True)
        for n in sorted(by_number, reverse=True)[:-1]:
            here = np.array(by_number[n])
            last = np.array([slot[int(owner[several[j]]), n - 1] for j in here])
            v = np.einsum("bij,bj->bi", whole[here], leave[several[here]])
            leave[several[last]] = v / v.max(axis=1, keepdims=True)

    out = np.empty((len(rows), k))
    ahead = enter
    log_z = 0.0
    for t, n in enumerate(live):
        at = first[:n] + t
        ahead = (ahead[:n] @ factors) * emissions[rows[at]]
        total = ahead.sum(axis=1, keepdims=True)
        log_z += float(np.log(total).sum()) if expected is not None else 0.0
        ahead /= total
        out[at] = ahead
    back = leave.copy()
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = first[:n] + t
        ahead, scaled = out[at], back[:n] * emissions[rows[at]]
        both = ahead * back[:n]
        out[at] = both / both.sum(axis=1, keepdims=True)
        if expected is not None:
            before = out[at - 1] if t else enter[:n]
            pair = before[:, :, None] * factors * scaled[:, None, :]
            expected[:k] += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[:n] = scaled @ factors.T
        back[:n] /= back[:n].max(axis=1, keepdims=True)
    if expected is not None:
        expected[k] -= log_z
    return out


def train(texts: list[tuple[str, str]], rounds: int = 40, seed: int = 11) -> Model:
    """Fit a model to (text, language) pairs.

    Labels of neighbouring words never change within such texts, so training sequences are made by cutting the texts' words
    into stretches of 5 to 40 and laying stretches of random languages end to end; that is what transitions are learned
    from. The log-likelihood, less a small square of the weights, is raised by Adam over all sequences in each round.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in texts})
    k = len(languages)
    vocabulary: dict[str, int] = {}
    stretches: list[tuple[list[int], int]] = []
    for text, lang in texts:
        words = [vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())]
        at = 0
        while at < len(words):
            n = int(rng.integers(5, 41))
            stretches.append((words[at : at + n], languages.index(lang)))
            at += n
    words = list(vocabulary) or ["\x02"]
    ids, starts, hashes = _sample_feature_ids(words)
    model = Model(languages, np.zeros((BUCKETS + 1, k)), np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(BUCKETS + 1, bool))
    if not stretches or not k:
        return model
    order = rng.permutation(len(stretches))
    rows = np.concatenate([np.array(stretches[s][0]) for s in order])
    gold = np.concatenate([np.full(len(stretches[s][0]), stretches[s][1]) for s in order])
    seen = np.zeros((len(words), k))
    np.add.at(seen, (rows, gold), 1)
    common = np.flatnonzero((seen.sum(axis=1) >= 5) & (seen.max(axis=1) >= 0.8 * seen.sum(axis=1)))
    by_hash = common[np.argsort(hashes[common], kind="stable")]
    model.lexicon, model.lexicon_language = hashes[by_hash], seen[by_hash].argmax(axis=1)
    lexicon = model.lexicon_of(hashes)

    lengths = np.full(-(-len(rows) // 64), 64)
    lengths[-1] = len(rows) - 64 * (len(lengths) - 1)
    inner = np.ones(len(rows), bool)
    inner[::64] = False
    counted = np.zeros((k, k))
    np.add.at(counted, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    counts = np.diff(starts, append=len(ids))
    met = np.zeros(BUCKETS + 1, bool)
    met[ids] = True
    kept, inverse = np.flatnonzero(met), (np.cumsum(met) - 1)[ids]
    del ids, stretches, vocabulary
    nothing = int(np.searchsorted(kept, NOTHING)) if kept[-1] == NOTHING else -1
    params = {"w": np.zeros((len(kept), k)), "lex": np.zeros((k + 1, k)), "tr": np.zeros((k, k))}
    moments = {n: (np.zeros_like(p), np.zeros_like(p)) for n, p in params.items()}
    likelihood = -np.inf
    for r in range(1, rounds + 1):
        scores = _word_sums(params["w"], inverse, starts) + params["lex"][lexicon]
        emissions = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), FLOOR))
        expected = np.zeros((k + 1, k))
        found = marginals(emissions, rows, lengths, params["tr"], expected)
        enter = np.log(np.exp(params["tr"]).sum(axis=0))[gold[::64]].sum()
        before, likelihood = likelihood, (np.log(emissions[rows, gold]).sum() + (counted * params["tr"]).sum() + enter + expected[k, 0]) / len(rows)
        if likelihood - before < GAIN and r > 5:
            break
        by_word = seen - np.stack([np.bincount(rows, found[:, j], len(words)) for j in range(k)], axis=1)
        enter_share = np.exp(params["tr"]) / np.exp(params["tr"]).sum(axis=0, keepdims=True)
        grads = {
            "w": np.stack([np.bincount(inverse, np.repeat(by_word[:, j], counts), len(kept)) for j in range(k)], axis=1),
            "lex": np.stack([np.bincount(lexicon, by_word[:, j], k + 1) for j in range(k)], axis=1),
            # a sequence enters from any label alike, whatever its first label is
            "tr": counted + enter_share * np.bincount(gold[::64], minlength=k)[None, :] - expected[:k],
        }
        for n, g in grads.items():
            g = g / len(rows) - 1e-6 * params[n]
            m, v = moments[n]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[n] += 0.3 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
        if nothing >= 0:
            params["w"][nothing] = 0
    model.weights[kept] = params["w"]
    model.taught[kept] = True
    model.taught[NOTHING] = False
    model.weights[NOTHING] = 0
    model.weights = model.weights.astype("f4")
    model.lexicon_weights, model.transitions = params["lex"], params["tr"]
    return model


def fit(labelled: DataFrame, sample_per_language: int = 250, sample_chars: int = 8_000_000, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit to a bounded sample: of each language the ``sample_per_language`` distinct texts with the smallest hash, up to the
    one with which they have ``sample_chars`` characters.

    The hashes are found over all labelled rows: distinct ones are counted by language and by their upper twelve bits, and
    only those up to the count that is needed are ranked, so no task sees all of a language. Then just the chosen texts are
    fetched, whole; their number is bounded by the sample size and the number of languages, which is taken to be small.
    Rows with null text or language teach nothing.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h")).where("text is not null and lang is not null")
    hashes = rows.select("lang", "h", F.shiftright("h", 52).alias("bucket"), F.length("text").cast("long").alias("size")).distinct()
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket"))
    enough = hashes.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    last = enough.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= sample_per_language, F.col("bucket"))), F.max("bucket")).alias("last"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    few = hashes.join(F.broadcast(last), "lang").where("bucket <= last")  # one row a language
    chosen = few.withColumn("r", rank).where(F.col("r") <= sample_per_language)
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    chosen = chosen.withColumn("before", before).where(F.col("before") < sample_chars).select("lang", "h").distinct()
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    model = train([(r.text, r.lang) for r in sorted(texts.collect(), key=lambda r: (r.lang, r.h))])
    give_back()  # the driver's Python stays, and what it took for training is not needed again
    return model


class _Worker:
    """A model in a worker, with the emissions of words met lately."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.languages)))
        self.familiar = np.zeros(1024)

    def emissions(self, words: set[str]) -> None:
        if len(self.rows) > KEPT_WORDS:
            self.clear()
        new = sorted(words.difference(self.rows))
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            n = len(self.rows)
            while n + len(some) > len(self.table):
                self.table, self.familiar = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.familiar, np.zeros_like(self.familiar)])
            self.table[n : n + len(some)], self.familiar[n : n + len(some)] = self.model.emissions_and_familiarity(some)
            self.rows.update(zip(some, range(n, n + len(some)), strict=True))

    def probabilities(self, texts: list[list[str]]) -> list[tuple[np.ndarray, float]]:
        """Word probabilities of each text, and the mean familiarity of its words."""
        self.emissions(set().union(*texts))
        lengths = np.array([len(t) for t in texts])
        rows = np.fromiter((r for t in texts for r in map(self.rows.__getitem__, t)), "i8", int(lengths.sum()))
        full = np.flatnonzero(lengths)
        out = marginals(self.table, rows, lengths[full], self.model.transitions) if len(full) else np.zeros((0, len(self.model.languages)))
        ends = np.cumsum(lengths)
        familiar = self.familiar[rows]
        return [(out[e - n : e], float(familiar[e - n : e].mean()) if n else 0.0) for e, n in zip(ends, lengths, strict=True)]


def _worker(key: str, model: Model) -> _Worker:
    return resident(("languages", key), lambda: _Worker(model))


def _letters(words: list[str]) -> list[str]:
    """Words with a letter: the pattern also lets through a few numeric signs."""
    return words if "".join(words).isalpha() else [w for w in words if any(c.isalpha() for c in w)]


def _identified(worker: _Worker, texts: pa.Array) -> Iterator[tuple[str, float, float, np.ndarray, list[str]]]:
    """Language, score, familiarity, word probabilities and words of each text, worked off about 200,000 words at a time."""
    languages = worker.model.languages
    held: list[list[str]] = []
    size = 0
    for k in range(len(texts)):
        text = texts[k].as_py()
        held.append(_letters(WORD.findall(text.lower())) if text and languages else [])
        size += len(held[-1])
        if size < WORDS_AT_ONCE and k + 1 < len(texts):
            continue
        for (found, familiar), spelled in zip(worker.probabilities(held) if size else [(np.zeros((0, 1)), 0.0)] * len(held), held, strict=True):
            if len(found):
                mean = found.mean(axis=0)
                best = int(mean.argmax())
                yield languages[best], min(1.0, float(mean[best])), familiar, found, spelled
            else:
                yield UNKNOWN, 0.0, 0.0, found, spelled
        held, size = [], 0


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score, familiar.

    ``score`` is the mean probability of the predicted language over the text's words, ``familiar`` the share of their features
    that the sample has. Null texts and texts without a letter get ``und`` and 0, and so does everything if the model knows no
    language. With ``words``, also ``word_langs``: for each word
    (in order) its text and likeliest language. No shuffle; ids may be null or repeat; other columns are not read.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = ["doc_id", "lang_pred", "score", "familiar", *(["word_langs"] if words else [])]
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(key, shared.value)
        for batch in batches:
            langs, scores, known, labelled = [], [], [], []
            for lang, score, familiar, found, spelled in _identified(worker, batch.column(1)):
                langs.append(lang)
                scores.append(score)
                known.append(familiar)
                if words:
                    labelled.append([{"word": w, "lang": worker.model.languages[j]} for w, j in zip(spelled, found.argmax(axis=1), strict=True)] if spelled else [])
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(labelled, kind)] if words else columns, names=names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    more = ", word_langs array<struct<word:string,lang:string>>" if words else ""
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, familiar double{more}")


def beyond_chance(familiar: float, model: Model) -> float:
    """A text's familiarity with chance taken off, so that it does not grow with the sample: 0 if its features are in the sample no
    more often than any bucket is, 1 if all are."""
    chance = float(np.mean(model.taught[:BUCKETS]))
    return (familiar - chance) / (1 - chance) if chance < 1 else 1.0


def keep_identified(docs: DataFrame, model: Model, min_score: float = MAJORITY, min_familiar: float = FAMILIAR, languages: list[str] | None = None, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """Rows, with all their columns, whose text is in a learned language (one of ``languages``, if given).

    Null and letterless texts go. A text is in a learned language if at least ``min_familiar`` of its features beyond chance are in
    the sample and its best language has a mean probability of ``min_score``; one with ``CERTAIN`` of them is so in any case, as it
    may switch between learned languages. Where ``lang_col`` is given and names the predicted language, ``CONFIRMED`` of them
    are enough. A null there becomes the predicted language. Rows are judged where they are read; nothing is
    shuffled or joined. ``predict`` gives the same figures for every row, dropped ones too.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index(text_col)
    told = docs.columns.index(lang_col) if lang_col is not None else None
    wanted = set(model.languages if languages is None else languages)

    def stays(lang: str, score: float, known: float, given: str | None) -> bool:
        if lang not in wanted:
            return False
        if given == lang and known >= CONFIRMED:
            return True
        return known >= min(min_familiar, CERTAIN) and (score >= min_score or known >= CERTAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(key, shared.value)
        for batch in batches:
            found = [(lang, score, beyond_chance(familiar, worker.model)) for lang, score, familiar, *_ in _identified(worker, batch.column(at))]
            given = [None] * len(found) if told is None else batch.column(told).to_pylist()
            if told is not None:
                filled = pc.coalesce(batch.column(told), pa.array([lang for lang, *_ in found], pa.string()).cast(batch.column(told).type))
                batch = pa.RecordBatch.from_arrays([filled if k == told else c for k, c in enumerate(batch.columns)], names=batch.schema.names)
            yield batch.filter(pa.array([stays(*f, g) for f, g in zip(found, given, strict=True)], pa.bool_()))
        release()  # what runs next may need the memory more than the next task of this the table of words

    return docs.mapInArrow(run, docs.schema)
