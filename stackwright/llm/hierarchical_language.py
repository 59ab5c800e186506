"""Language identification in two levels: the family first, then the language within it.

Each level decides by one-versus-one linear support vector machines (squared hinge loss): one for each pair of
families, and one for each pair of languages of a family. A text's features are the hashed n-grams of 1 to 4 bytes of
its letters in lower case, with a space for all else; their shares make the text's vector, whatever its length.

Machines are trained with numpy, a task each, from at most MOST_TEXTS texts of a language, chosen by hash from rows
that may be learned from (crc32 of doc_id not 0 modulo 5, lang not null). Languages outside the table of families are
dealt into families of FAMILY_SIZE, so that machines don't grow with the square of the languages; the model's size is
checked before it is trained and broadcast. Prediction covers all whole texts; ``score`` multiplies, over both levels,
the sigmoid of the winner's narrowest margin.

Texts that are null or have no letter are ``und`` with score 0, and so is every text if nothing can be learned. With
one language learned, all other texts get it. A name that wins as many machines as another needs the larger sum of
margins. Rows that repeat a doc_id, or have none, are predicted each; long texts count with all their n-grams. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .sampling import bounded_sample, held_out

#: ISO 639 codes by language family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "austronesian": "id ms tl",
    "dravidian": "kn ml ta te",
}
#: Languages outside the table share families of so many, in the order of their names.
FAMILY_SIZE = 12
DIMENSIONS = 1 << 16
#: The weights of all machines, which every worker holds, may take so many bytes; about 150 languages stay below it.
MOST_MODEL_BYTES = 1 << 28
MOST_TEXTS = 800
GRAMS = (1, 2, 3, 4)
STEPS = 80
SCALE = 20.0
UNKNOWN = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def families_of(langs: list[str]) -> dict[str, str]:
    """The family of each language. Languages outside the table are dealt into families of FAMILY_SIZE."""
    known = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
    found = {lang: known.get(re.split("[-_]", lang.lower())[0]) for lang in langs}
    others = sorted(lang for lang, name in found.items() if name is None)
    return found | {lang: f"other-{k // FAMILY_SIZE}" for k, lang in enumerate(others)}


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers of a text and their shares times SCALE; None without letters."""
    letters = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, letters)):  # numerals like a half sign are neither digits nor letters
        return None
    units = np.frombuffer(f" {letters} ".encode(), np.uint8).astype(np.uint32)
    gram, found = np.zeros(len(units), np.uint32), []
    for n in GRAMS:
        if n > len(units):
            break
        gram = gram[: len(units) - n + 1] * np.uint32(257) + units[n - 1 :]
        found.append(((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(16))
    total = np.bincount(np.concatenate(found), minlength=DIMENSIONS)
    numbers = np.flatnonzero(total)
    return numbers.astype(np.int32), (SCALE * total[numbers] / total.sum()).astype(np.float32)


def train_machine(texts: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights, the bias last. texts: feature numbers and shares of each; side: 1 or -1."""
    features = np.concatenate([f for f, _ in texts])
    value = np.concatenate([v for _, v in texts]).astype(np.float64)
    owner = np.repeat(np.arange(len(texts)), [len(f) for f, _ in texts])
    balance = np.where(side > 0, 0.5 / max(1, (side > 0).sum()), 0.5 / max(1, (side < 0).sum()))
    w, bias = np.zeros(DIMENSIONS), 0.0
    first, second = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for t in range(1, steps + 1):
        margin = np.bincount(owner, weights=w[features] * value, minlength=len(texts)) + bias
        slope = -2 * balance * side * np.maximum(0, 1 - side * margin)
        gradient = np.append(np.bincount(features, weights=slope[owner] * value, minlength=DIMENSIONS) + 1e-4 * w, slope.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return np.append(w, bias)


def machines(langs: list[str]) -> list[tuple[str, str, str]]:
    """(level, one, other): pairs of families at level "", pairs of languages at their family's level."""
    own, families = families_of(langs), {}
    for lang in sorted(langs):
        families.setdefault(own[lang], []).append(lang)
    pairs = [("", a, b) for a, b in combinations(sorted(families), 2)]
    return pairs + [(name, a, b) for name, held in sorted(families.items()) for a, b in combinations(held, 2)]


def fit(docs: DataFrame, most_texts: int = MOST_TEXTS) -> tuple[list[str], list[tuple[str, str, str]], np.ndarray]:
    """Learned languages, machines, and their weights (a row for each machine)."""
    usable = docs.filter(~held_out()).filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    langs = sorted(r["lang"] for r in usable.select("lang").distinct().collect())  # one row for each language
    pairs = machines(langs)
    if not pairs:
        return langs, [], np.zeros((0, DIMENSIONS + 1), np.float32)
    if len(pairs) * (DIMENSIONS + 1) * 4 > MOST_MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages make {len(pairs)} machines, more than MOST_MODEL_BYTES holds: clean up lang, or raise it")
    family = families_of(langs)
    chosen = bounded_sample(usable.select("doc_id", "lang").distinct(), "lang", "doc_id", most_texts)
    # Ids of the sample: most_texts for each language at most.
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"])
    sides: dict[str, list[tuple[int, int]]] = {lang: [] for lang in langs}
    for number, (level, a, b) in enumerate(pairs):
        for lang in langs:
            own = lang if level else family[lang]
            if own in (a, b) and (not level or family[lang] == level):
                sides[lang].append((number, 1 if own == a else -1))
    table = docs.sparkSession.createDataFrame([(lang, n, s) for lang, held in sides.items() for n, s in held], "lang string, machine int, side int")

    def featured(batches):
        for batch in batches:
            found = [text_features(t) for t in batch["text"].to_pylist()]
            columns = [pa.array([None if x is None else x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], *columns], ["doc_id", "lang", "numbers", "shares"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["numbers"].notna()].sort_values(["lang", "doc_id"])
        if not len(pdf):
            return pd.DataFrame({"machine": [], "weights": []}).astype({"machine": "int32"})
        rows = [(np.frombuffer(n, np.int32), np.frombuffer(v, np.float32)) for n, v in zip(pdf["numbers"], pdf["shares"])]
        weights = train_machine(rows, pdf["side"].to_numpy())
        return pd.DataFrame({"machine": [pdf["machine"].iloc[0]], "weights": [weights.astype(np.float32).tobytes()]})

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(featured, "doc_id long, lang string, numbers binary, shares binary")
    found = rows.join(F.broadcast(table), "lang").groupBy("machine").applyInPandas(learn, "machine int, weights binary").collect()
    weights = np.zeros((len(pairs), DIMENSIONS + 1), np.float32)
    for row in found:  # a vector for each machine
        weights[row["machine"]] = np.frombuffer(row["weights"], np.float32)
    return langs, pairs, weights


def _winner(names: list[str], pairs: list[tuple[int, str, str]], margins: np.ndarray) -> tuple[str, float]:
    """The name that wins most of its machines (ties: by the sum of margins), and its narrowest margin as a chance."""
    if len(names) == 1:
        return names[0], 1.0
    won = {name: [0, 0.0, np.inf] for name in names}
    for number, a, b in pairs:
        for name, m in ((a, margins[number]), (b, -margins[number])):
            held = won[name]
            held[0] += m > 0
            held[1] += float(m)
            held[2] = min(held[2], float(m))
    best = max(names, key=lambda name: (won[name][0], won[name][1], name))
    return best, float(1 / (1 + np.exp(-np.clip(2 * won[best][2], -30, 30))))


def predict_language(docs: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, text, lang)."""
    langs, pairs, weights = fit(docs, most_texts)
    model = docs.sparkSession.sparkContext.broadcast((langs, pairs, weights))

    def predict(batches):
        langs, pairs, weights = model.value
        by_level: dict[str, list[tuple[int, str, str]]] = {}
        for number, (level, a, b) in enumerate(pairs):
            by_level.setdefault(level, []).append((number, a, b))
        own, families = families_of(langs), {}
        for lang in langs:
            families.setdefault(own[lang], []).append(lang)
        by_feature, bias = np.ascontiguousarray(weights[:, :-1].T), weights[:, -1]

        def guess(text: str | None) -> tuple[str, float]:
            found = text_features(text) if langs else None
            if found is None:
                return UNKNOWN, 0.0
            numbers, shares = found
            margins = shares @ by_feature[numbers] + bias
            family, first = _winner(sorted(families), by_level.get("", []), margins)
            lang, second = _winner(families[family], by_level.get(family, []), margins)
            return lang, first * second

        for batch in batches:
            found = [guess(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return chosen.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
