"""Language identification by rank-order profiles of character n-grams.

Letters are lower-cased, runs of other characters become one blank, and n-grams of one to three of these
characters are counted, blanks alone excepted. A language's profile is its most frequent n-grams in the training
texts, by rank. A document's own most frequent n-grams are compared with each profile by the sum of how far each
is out of place; n-grams that a profile lacks count as far as can be. The nearest language is predicted. Its
score is the share of the greatest possible distance that is spared: 1 for the profile itself, 0 for a text that
has nothing of it.

N-grams are counted on whole texts, as numbers of 63 bits at most, by sorting. Profiles come from counts over
all training texts, combined before the shuffle. Only profiles (a bounded number of n-grams per language) are
sent to the tasks.

Cases. Null texts and texts without letters are ``und`` with score 0, and so is every text if there is nothing to
learn from. Equal distances go to the smaller language name; equal counts are ranked by n-gram. Rows with a null
language are not learned from. Repeated rows count each.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import map_arrow, slices, text_buffers

PROFILE = 400
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for what is no letter, up to U+FFFF. Beyond that, letters are looked up one by one, for there are few texts with them."""
    table = np.zeros(0x10000, np.int64)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            table[c] = ord(chr(c).lower()[0])
    return table


def letters(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        is_letter = unicodedata.category(chr(c))[0] == "L"
        out[points == c] = ord(chr(c).lower()[0]) if is_letter else 0
    return out


def code_points(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets -> code points and their row offsets."""
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), "<u4").astype(np.int64)
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, heads[rows]


def grams(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of all texts, sorted by row, and whether a row has a letter."""
    raw, offsets = text_buffers(texts)
    points, rows = code_points(raw, offsets)
    low = letters(points, table)
    found_rows, found, counts = [], [], []
    has = np.zeros(len(texts), bool)
    for k in range(len(texts)):
        t = low[rows[k] : rows[k + 1]]
        if not t.any():
            continue
        has[k] = True
        t = np.concatenate([[0], t, [0]])
        # One blank between words.
        t = t[np.concatenate([[True], (t[1:] != 0) | (t[:-1] != 0)])]
        # 21 bits a character; two characters are marked by a bit that is no letter, as the first may be blank.
        two = (t[:-1] << 21) | t[1:]
        three = (two[:-1] << 21) | t[2:]
        # A blank in the middle joins two words; such n-grams say nothing about a language.
        parts = [t[t != 0], two | (np.int64(1) << 42), three[t[1:-1] != 0]]
        codes = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        found.append(codes[first])
        counts.append(np.diff(np.append(first, len(codes))))
        found_rows.append(np.full(len(first), k))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, has
    return np.concatenate(found_rows), np.concatenate(found), np.concatenate(counts), has


def gram_counts(docs: DataFrame) -> DataFrame:
    """Documents (text, lang) -> (lang, gram, n) over all of them, combined per task and language."""

    def count(batches):
        table = letter_table()
        held: dict[str, list] = {}

        def emit(lang):
            codes, n = np.concatenate([c for c, _ in held[lang]]), np.concatenate([n for _, n in held[lang]])
            codes, at = np.unique(codes, return_inverse=True)
            return codes, np.bincount(at, n).astype(np.int64)

        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            rows, codes, n, _ = grams(batch.column("text"), table)
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for k, lang in enumerate(names):
                some = number[rows] == k
                held.setdefault(lang, []).append((codes[some], n[some]))
                held[lang] = [emit(lang)]
                # What a task holds stays bounded, however many n-grams a language has.
                if len(held[lang][0][0]) > 200_000:
                    yield _rows(lang, *held.pop(lang)[0])
        for lang in held:
            yield _rows(lang, *held[lang][0])

    def _rows(lang, codes, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])

    counted = map_arrow(docs.select("lang", "text"), count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its most frequent n-grams, by rank. ``size`` n-grams per language come to the driver."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = gram_counts(docs.where("lang IS NOT NULL AND text IS NOT NULL")).withColumn("rank", rank).where(F.col("rank") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def predict(docs: DataFrame, learned: dict[str, list[int]], size: int = PROFILE, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score; only ``text`` is looked at. Columns named alike are replaced."""
    names = sorted(learned)
    known = np.unique(np.concatenate([np.array(v, np.int64) for v in learned.values()])) if learned else np.zeros(0, np.int64)
    # Row per language; an n-gram that a profile lacks is out of place by the profile's size.
    place = np.full((len(names), len(known) + 1), -1, np.int64)
    for k, name in enumerate(names):
        place[k, np.searchsorted(known, np.array(learned[name], np.int64))] = np.arange(len(learned[name]))
    kept = [c for c in docs.columns if c not in into]

    def run(batches):
        table = letter_table()
        for batch in slices(batches):
            rows, codes, counts, has = grams(batch.column("text"), table)
            starts = np.searchsorted(rows, np.arange(len(batch) + 1))
            pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for k in np.flatnonzero(has) if names else ():
                c, n = codes[starts[k] : starts[k + 1]], counts[starts[k] : starts[k + 1]]
                top = c[np.lexsort((c, -n))[:size]]
                at = np.searchsorted(known, top)
                at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == top), at, len(known))
                found = place[:, at]
                away = np.where(found < 0, size, np.abs(found - np.arange(len(top)))).sum(axis=1)
                best = int(away.argmin())
                pred[k], score[k] = names[best], max(0.0, 1 - away[best] / (size * len(top)))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score)], [*kept, *into])

    schema = docs.select(*kept).schema.add(into[0], "string").add(into[1], "double")
    return map_arrow(docs.select(*kept), run, schema)


# Scores are counted in steps of this size.
STEPS = 10_000


def least_scores(docs: DataFrame, learned: dict[str, list[int]], share: float, margin: float) -> dict[str, float]:
    """Language -> the score that only ``share`` of its labelled documents stay below, less ``margin``.

    All labelled documents are counted that are nearest to the language they are labelled with; with few of them it is
    the least score. Counts are combined before the shuffle. A language without such a document gets the smallest
    threshold of the others.
    """
    judged = predict(docs.where("lang IS NOT NULL").select("text", "lang"), learned).where("lang_pred = lang")
    counts = judged.groupBy("lang", F.floor(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    of_language = Window.partitionBy("lang")
    upto = F.sum("n").over(of_language.orderBy("step"))
    counts = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(of_language))
    found = counts.where(F.col("upto") > F.col("all") * share).groupBy("lang").agg(F.min("step").alias("step")).collect()
    least = {r.lang: max(0.0, r.step / STEPS - margin) for r in found}
    return {name: least.get(name, min(least.values(), default=0.0)) for name in learned}


def in_a_known_language(docs: DataFrame, learned: dict[str, list[int]], least: float | dict[str, float]) -> DataFrame:
    """The documents whose text resembles a learned language at least so much; columns as they were.

    ``least`` is one score, or one for each language.
    """
    into = tuple(f"{name}_{len(docs.columns)}_{'_'.join(docs.columns)}" for name in ("lang", "score"))
    judged = predict(docs, learned, into=into)
    if isinstance(least, dict):
        pairs = [F.lit(x) for name in sorted(least) for x in (name, least[name])]
        wanted = F.element_at(F.create_map(*pairs), F.col(into[0])) if pairs else F.lit(0.0)
    else:
        wanted = F.lit(least)
    return judged.where((F.col(into[0]) != UNKNOWN) & (F.col(into[1]) >= wanted)).select(*docs.columns)
