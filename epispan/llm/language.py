"""Language identification by interpolated Kneser-Ney character models, one per language.

Letters of a text, lower-cased, are read word by word; a word is scored from its start to the blank after it, each
letter given the three before it. Whole texts are read in numpy, and each distinct 4-gram of about a million letters is
looked up once. Training counts 4-grams on documents with a known language (in the order of a hash, until about
``letters_per_language`` letters of each language are reached, one document at least); lower orders use continuation counts.
A gram is four letter numbers of 16 bits in one 64-bit key; a model is a sorted array of keys beside its values for all
languages, read by binary search.

The language with the lowest cross-entropy per letter wins. Two things are calibrated on other labelled documents: the
sharpness that turns differences of cross-entropy into a probability, and the cross-entropy above which a text is marked as
not accepted. One document in ``ASIDE`` may be set aside for that, up to about ``calibration_letters`` letters of a language,
and none of a language that would have no other document; all others may be learned from. ``lang`` may hold any values;
models grow with the number of languages.

Defined results: a null text, or one without letters, is ``und`` with score 0; with nothing to learn from, all texts
are. Rows are never joined, so ids may repeat; a row without doc_id is predicted but not learned from.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispan.llm.common import Batches, crc_of_id, record, texts
from epispan.session import cut

ORDER = 4
LETTERS_PER_LANGUAGE = 1_000_000
CALIBRATION_LETTERS = 200_000
ACCEPTED_SHARE = 0.995
SHARPNESS = tuple(2.0**k for k in range(-2, 7))
MOST_EVIDENCE = 30.0
UNDETERMINED = "und"
FOLDS, HELD_OUT_FOLD = 3, 1
ASIDE = 8
#: Letters wanted of a language are counted in so many steps along the hash, and sought in so many times their expected share.
STEPS, SPREAD = 32, 8
READ_CHARS = 1_000_000  # letters scored in one numpy step
CODE_POINTS = 0x110000
LETTERS = regex.compile(r"\p{L}+")
BLANK = 1  # the number of the blank around words; 0 is any letter not seen in training

GRAMS_DDL = "lang string, gram string, n bigint"
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
PREDICTED_DDL = "doc_id bigint, lang_pred string, score double, cross_entropy double, accepted boolean"
PREDICTED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("lang_pred", pa.string()),
        ("score", pa.float64()),
        ("cross_entropy", pa.float64()),
        ("accepted", pa.bool_()),
    ]
)


def pack(numbers: np.ndarray) -> np.ndarray:
    """One key from the letter numbers in the columns, 16 bits each."""
    key = np.zeros(len(numbers), np.uint64)
    for k in range(numbers.shape[1]):
        key = (key << np.uint64(16)) | numbers[:, k].astype(np.uint64)
    return key


def unpack(keys: np.ndarray) -> np.ndarray:
    """The letter numbers in whole keys, one column per place."""
    return np.column_stack([(keys >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(ORDER - 1, -1, -1)]).astype(np.int64)


def cut_between_words(text: str) -> list[str]:
    """A text in parts of about ``READ_CHARS``, none of which ends inside a word."""
    parts, start = [], 0
    while start < len(text):
        inside = LETTERS.match(text, min(start + READ_CHARS, len(text)))
        end = inside.end() if inside else min(start + READ_CHARS, len(text))
        parts.append(text[start:end])
        start = end
    return parts


def letter_numbers(alphabet: dict[str, int]) -> np.ndarray:
    """The number of every code point: its own for a known letter, 0 for another letter, ``BLANK`` for the rest."""
    numbers = np.full(CODE_POINTS, BLANK, np.uint16)
    for found in LETTERS.finditer("".join(map(chr, range(CODE_POINTS)))):
        numbers[found.start() : found.end()] = 0
    for letter, number in alphabet.items():
        numbers[ord(letter)] = number
    return numbers


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted keys are in a sorted array, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the counts (one column per language) summed over each."""
    distinct, place = np.unique(keys, return_inverse=True)
    total = np.zeros((len(distinct), counts.shape[1]))
    np.add.at(total, place, counts)
    return distinct, total


@dataclass
class Level:
    """One order: discounted shares of grams, and what a context leaves to the order below."""

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


@dataclass
class Model:
    languages: list[str]
    numbers: np.ndarray  # letter number of every code point; BLANK where it is no letter
    letter_probs: np.ndarray  # (letters, languages)
    levels: list[Level]  # orders 2 to ORDER
    sharpness: float = 1.0
    most_entropy: float = float("inf")

    def probabilities(self, numbers: np.ndarray) -> np.ndarray:
        """Probability of the last letter of each row (``ORDER`` letter numbers), per language."""
        probs = self.letter_probs[numbers[:, -1]]
        for order, level in enumerate(self.levels, 2):
            at, there = find(level.contexts, pack(numbers[:, -order:-1]))
            # a context unknown to every language leaves all its mass to the order below
            probs[there] *= level.left[at[there]]
            at, there = find(level.grams, pack(numbers[:, -order:]))
            probs[there] += level.shares[at[there]]
        return probs

    def part_scores(self, parts: list[str]) -> np.ndarray:
        """Per part: log2 probability in each language, and in the last column the letters read (with the blanks after words)."""
        lowered = [p.lower() + " " for p in parts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        numbers = np.r_[np.full(ORDER - 1, BLANK, np.uint64), self.numbers[points]]
        last, before = numbers[ORDER - 1 :], numbers[ORDER - 2 : -1]
        read = (last != BLANK) | (before != BLANK)  # letters, and the blank that ends a word
        keys, context = last.copy(), before
        for k in range(1, ORDER):
            keys |= context << np.uint64(16 * k)
            # what lies before the start of the word counts as blank
            earlier = numbers[max(ORDER - 2 - k, 0) :][: len(last)]
            context = np.where(context == BLANK, context, earlier)
        codes, distinct = pd.factorize(keys[read])
        logs = np.log2(self.probabilities(unpack(distinct)))
        ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))
        reads = np.diff(np.r_[0, np.cumsum(read)[ends - 1]])
        owner = np.repeat(np.arange(len(parts)), reads)
        sums = [np.bincount(owner, logs[codes, k], len(parts)) for k in range(len(self.languages))]
        return np.column_stack([*sums, reads])

    def text_scores(self, several: list[str]) -> np.ndarray:
        """``part_scores`` of whole texts; short texts are read together, long ones in parts cut between words."""
        total = np.zeros((len(several), len(self.languages) + 1))
        parts: list[str] = []
        owners: list[int] = []
        chars = 0
        for owner, text in enumerate(several):
            for part in cut_between_words(text):
                parts.append(part)
                owners.append(owner)
                chars += len(part)
                if chars >= READ_CHARS:
                    np.add.at(total, owners, self.part_scores(parts))
                    parts, owners, chars = [], [], 0
        if parts:
            np.add.at(total, owners, self.part_scores(parts))
        return total


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over rows ``(lang, text)``; words are counted first, so a frequent word costs little."""

    def work(batches: Batches) -> Batches:
        words: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                words.update((lang, w) for w in LETTERS.findall(text.lower()))
        grams: Counter[tuple[str, str]] = Counter()
        for (lang, word), n in words.items():
            padded = " " * (ORDER - 1) + word + " "
            for k in range(len(padded) - ORDER + 1):
                grams[lang, padded[k : k + ORDER]] += n
        keys = list(grams)
        yield record(GRAMS, [k[0] for k in keys], [k[1] for k in keys], [grams[k] for k in keys])

    return rows.mapInArrow(work, GRAMS_DDL).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(counts: np.ndarray) -> np.ndarray:
    """Kneser-Ney discount per language from how many grams were seen once and twice."""
    once, twice = (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)
    return np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)


def level(grams: np.ndarray, counts: np.ndarray) -> Level:
    d = discount(counts)
    contexts, totals = grouped(grams >> np.uint64(16), counts)
    _, followers = grouped(grams >> np.uint64(16), (counts > 0).astype(float))
    at, _ = find(contexts, grams >> np.uint64(16))
    shares = np.maximum(counts - d, 0) / np.maximum(totals[at], 1)
    left = np.where(totals > 0, d * followers / np.maximum(totals, 1), 1.0)
    return Level(grams, shares, contexts, left)


def fit(counted: pd.DataFrame) -> Model:
    """The models from (lang, gram, n): raw counts at the highest order, continuation counts below."""
    languages = sorted(counted["lang"].unique())
    letters = sorted(set("".join(counted["gram"])) - {" "})[: 2**16 - 2]
    alphabet = {c: k for k, c in enumerate(letters, BLANK + 1)}
    number = {" ": BLANK} | alphabet
    numbers = np.array([[number.get(c, 0) for c in g] for g in counted["gram"]], np.int64)
    counts = np.zeros((len(counted), len(languages)))
    counts[np.arange(len(counted)), counted["lang"].map({v: k for k, v in enumerate(languages)})] = counted["n"]
    keys, counts = grouped(pack(numbers), counts)
    levels = []
    for order in range(ORDER, 1, -1):
        levels.append(level(keys, counts))
        # a shorter gram counts the different letters seen before it
        keys, counts = grouped(keys & np.uint64(2 ** (16 * (order - 1)) - 1), (counts > 0).astype(float))
    d = discount(counts)
    total = np.maximum(counts.sum(axis=0), 1)
    size = len(alphabet) + 2
    probs = np.tile(d * (counts > 0).sum(axis=0) / total / size, (size, 1))
    probs[keys.astype(np.int64)] += np.maximum(counts - d, 0) / total
    probs = np.maximum(probs, 1e-12)
    return Model(languages, letter_numbers(alphabet), probs, levels[::-1])


def chances(entropies: np.ndarray, letters: np.ndarray, sharpness: float) -> np.ndarray:
    """Probabilities of languages from cross-entropies; evidence grows with the text up to ``MOST_EVIDENCE`` letters."""
    weight = sharpness * np.minimum(letters, MOST_EVIDENCE)[:, None]
    scaled = np.exp2(-weight * (entropies - entropies.min(axis=1, keepdims=True)))
    return scaled / scaled.sum(axis=1, keepdims=True)


def calibrate(model: Model, labelled: pd.DataFrame) -> Model:
    """Sharpness with the least log loss, and the cross-entropy that ``ACCEPTED_SHARE`` of right texts stay below."""
    known = {v: k for k, v in enumerate(model.languages)}
    labelled = labelled[labelled["lang"].isin(known)]
    scores, right = model.text_scores(list(labelled["text"])), labelled["lang"].map(known).to_numpy(np.int64)
    scores, right = scores[scores[:, -1] > 0], right[scores[:, -1] > 0]
    if not len(right):
        return model
    letters = scores[:, -1]
    entropies = -scores[:, :-1] / letters[:, None]
    own = entropies[np.arange(len(right)), right]
    loss = [-np.log(np.maximum(chances(entropies, letters, s)[np.arange(len(right)), right], 1e-12)).mean() for s in SHARPNESS]
    model.sharpness = SHARPNESS[int(np.argmin(loss))]
    model.most_entropy = float(np.quantile(own, ACCEPTED_SHARE))
    return model


def reach(rows: DataFrame, letters: int) -> DataFrame:
    """``(lang, upto)``: the place in hash order at which ``letters`` letters are reached, one document at least.

    ``rows`` hold ``(lang, place, n)``. Letters are summed per language and step, so no language's documents meet in one task.
    """
    totals = rows.groupBy("lang").agg(F.sum("n").alias("total"), F.min("place").alias("first"))
    stepped = rows.join(F.broadcast(totals), "lang").withColumn("step", F.floor(F.col("place") * F.col("total") / letters * STEPS))
    near = stepped.where(f"step < {STEPS * SPREAD} or place = first")
    steps = near.groupBy("lang", "step").agg(F.sum("n").alias("n"), F.max("place").alias("upto")).collect()
    got: Counter[str] = Counter()
    upto: dict[str, float] = {}
    for r in sorted(steps, key=lambda r: r.step):
        if got[r.lang] < letters:
            got[r.lang] += r.n
            upto[r.lang] = r.upto
    return rows.sparkSession.createDataFrame(list(upto.items()), "lang string, upto double")


def train(docs: DataFrame, letters: int = LETTERS_PER_LANGUAGE, calibration_letters: int = CALIBRATION_LETTERS) -> Model | None:
    """A calibrated model from documents outside the held-out fold; None without any labelled text."""
    crc = crc_of_id()
    rows = docs.select(
        F.col("lang").cast("string"),
        "text",
        (F.pmod(F.xxhash64("doc_id"), F.lit(2**53)) / F.lit(2.0**53)).alias("place"),
        (F.pmod(F.floor(crc / FOLDS), F.lit(ASIDE)) == 0).alias("aside"),
        F.pmod(crc, F.lit(FOLDS)).alias("fold"),
    )
    rows = rows.where((F.col("fold") != HELD_OUT_FOLD) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).drop("fold")
    lengths = cut(rows.select("lang", "place", "aside", F.length("text").cast("bigint").alias("n")), "labelled")
    others = F.broadcast(lengths.where("not aside").select("lang").distinct())
    to_calibrate = F.broadcast(reach(lengths.where("aside").join(others, "lang", "left_semi"), calibration_letters))

    def split(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        marked = frame.join(to_calibrate, "lang", "left").withColumn("taken", F.expr("aside and coalesce(place <= upto, false)"))
        return marked.where("not taken").drop("taken", "upto"), marked.where("taken").drop("taken", "upto")

    to_learn = F.broadcast(reach(split(lengths)[0], letters))
    rest, aside = split(rows)
    counted = gram_counts(rest.join(to_learn, "lang").where("place <= upto").select("lang", "text")).toPandas()
    if not len(counted):
        return None
    # a single text can be longer than all letters asked for
    chosen = aside.select("lang", F.substring("text", 1, calibration_letters).alias("text")).toPandas()
    return calibrate(fit(counted), chosen)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, cross_entropy, accepted)`` from the texts alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Batches) -> Batches:
        for batch in batches:
            model, several, out = shared.value, texts(batch), []
            for scores in model.text_scores(several) if model is not None else np.zeros((len(several), 1)):
                if scores[-1] == 0:
                    out.append((UNDETERMINED, 0.0, None, False))
                    continue
                entropies = -scores[None, :-1] / scores[-1]
                best = int(entropies[0].argmin())
                chance = chances(entropies, scores[-1:], model.sharpness)[0, best]
                entropy = float(entropies[0, best])
                out.append((model.languages[best], float(chance), entropy, entropy <= model.most_entropy))
            yield record(PREDICTED, batch.column("doc_id"), *([r[k] for r in out] for k in range(4)))

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, PREDICTED_DDL)


def identify(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and predict all of them, with the held-out mark."""
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
