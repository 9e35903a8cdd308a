"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrad.llm.common import fresh_name, read_table
from loomgrad.session import materialise

UNDETERMINED = "und"
#: N-grams of a language profile and of a document profile, and the longest n-gram.
PROFILE_GRAMS = 400
DOCUMENT_GRAMS = 300
MAX_N = 4
#: Labelled documents per language, about, that op3's profiles are counted from: those with the least hash of their id.
TRAINING_DOCUMENTS = 1000
#: Different words that a task gathers before it passes their n-grams on.
HELD_WORDS = 50_000
#: A text is of a language if it scores this share of what all but 1 in 100 of its labelled texts score.
#: Random letters score about half of that, letters of another script nothing.
LEAST_SHARE = 0.58
#: Scores are told apart by this many steps from 0 to 1 when least scores are counted.
SCORE_STEPS = 10_000


def letter_words(text: str) -> Counter:
    """Counts of the lower-cased runs of letters of the whole text."""
    import regex

    return Counter(regex.findall(r"\p{L}+", text.lower()))


def grams_of_word(word: str) -> list[str]:
    """Its n-grams of 1 to MAX_N characters, with an underscore at either edge."""
    padded = f"_{word}_"
    return [g for n in range(1, MAX_N + 1) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != "_"]


# --- profiles ---------------------------------------------------------------------------------


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial n-gram counts per language: of as many batches as have HELD_WORDS different words."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words.setdefault(lang, Counter()).update(letter_words(text))
        if sum(map(len, words.values())) >= HELD_WORDS:
            yield _gram_rows(words)
            words = {}
    yield _gram_rows(words)


def _gram_rows(words: dict[str, Counter]) -> pd.DataFrame:
    rows = []
    for lang, counted in words.items():
        grams: Counter = Counter()
        for word, n in counted.items():
            for g in grams_of_word(word):
                grams[g] += n
        rows += [(lang, g, n) for g, n in grams.items()]
    return pd.DataFrame(rows, columns=["lang", "gram", "n"])


def learn_profiles(
    labelled: DataFrame, key: Column | None = None, lang_col: str = "lang", text_col: str = "text", whole: bool = False
) -> dict[str, list[str]]:
    """Language -> its PROFILE_GRAMS most frequent n-grams, most frequent first (ties by n-gram).

    With ``whole``, learns from every row with a label and a text. Otherwise from about TRAINING_DOCUMENTS
    documents of each label: those whose ``key``, a 64-bit hash (default: of the text; copies stay
    together), lies under that share of the label's rows. A label with fewer gives all. Rows with a null
    label or text are left out. No labels, no profiles.

    Nothing but n-gram counts is shuffled; for a sample, one aggregate counts the labels and its rows pass a
    filter. The driver gets the profiles only, PROFILE_GRAMS rows a language.
    """
    rows = _labelled_rows(labelled, lang_col, text_col) if whole else _labelled_sample(labelled, key, lang_col, text_col)
    counts = rows.mapInPandas(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", by_count).filter(F.col("rank") <= PROFILE_GRAMS).collect()
    profiles: dict[str, list[str]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _labelled_rows(labelled: DataFrame, lang_col: str, text_col: str, *more: Column) -> DataFrame:
    """(lang, text) and further columns of every row with a label and a text."""
    return labelled.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), *more
    ).filter("lang IS NOT NULL AND text IS NOT NULL")


def _labelled_sample(labelled: DataFrame, key: Column | None, lang_col: str, text_col: str) -> DataFrame:
    """(lang, text) of the documents that :func:`learn_profiles` learns from unless it takes the whole table."""
    key = F.xxhash64(F.col(text_col)) if key is None else key
    rows = _labelled_rows(labelled, lang_col, text_col, key.alias("key"))
    # The hash is uniform, so a bound on it is a share of the rows; no row is ranked against others.
    counts = rows.groupBy("lang").count().select("lang", (F.lit(float(TRAINING_DOCUMENTS)) / F.col("count")).alias("share"))
    place = (F.col("key").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return rows.join(F.broadcast(counts), "lang").filter(place < F.col("share")).select("lang", "text")  # one row a language


# --- prediction -------------------------------------------------------------------------------

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


_EDGE = ord("_")


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")


class _Packing:
    """N-grams of up to four characters as exact 64-bit numbers, 16 bits a character.

    The profiles' characters come first, so known n-grams have the same number in every text. Other
    characters of a text get numbers of its own, above those, in the order of their code points: two
    n-grams of a text never share a number. (A text with over 65,535 different letters is cut to its
    own numbers modulo what is left; no script has so many lower-case letters in the basic plane.)
    """

    def __init__(self, known: list[str]) -> None:
        self._number = np.zeros(0x110000, dtype=np.uint64)
        self._known = sorted({c for gram in known for c in gram} | {"_"})
        for i, c in enumerate(self._known):
            self._number[ord(c)] = i + 1

    def numbers(self, points: np.ndarray) -> np.ndarray:
        found = self._number[points]
        if not found.all():
            new = found == 0
            own, place = np.unique(points[new], return_inverse=True)
            room = 0xFFFF - len(self._known)
            found[new] = (place % room + len(self._known) + 1).astype(np.uint64)
        return found

    def gram(self, gram: str) -> int:
        return int(_pack([self._number[np.array([ord(c)])] for c in gram])[0])


def _pack(columns: list[np.ndarray]) -> np.ndarray:
    """One number per n-gram, given as its columns of character numbers; no number is 0, so lengths differ too."""
    out = columns[0]
    for c in columns[1:]:
        out = (out << np.uint64(16)) | c
    return out


class RankOrder:
    """Predicts by the out-of-place distance of a document's profile to each language profile."""

    def __init__(self, profiles: dict[str, list[str]]) -> None:
        self.languages = sorted(profiles)
        self._letter = _letter_table()
        known = sorted({g for profile in profiles.values() for g in profile})
        self._packing = _Packing(known)
        packed = np.array([self._packing.gram(g) for g in known], dtype=np.uint64)
        row = np.argsort(packed)
        self._known = packed[row]
        # The last row is that of every n-gram that no profile has.
        self._place = np.full((len(known) + 1, max(1, len(self.languages))), PROFILE_GRAMS, dtype=np.int64)
        at = {known[i]: k for k, i in enumerate(row.tolist())}
        for column, lang in enumerate(self.languages):
            for rank, gram in enumerate(profiles[lang]):
                self._place[at[gram], column] = rank
        self._best = self._place.min(axis=1)

    def grams(self, text: str) -> np.ndarray:
        """The packed n-grams of the text's words, as often as they occur."""
        points = _code_points(text.lower())
        letter = self._letter[points]
        # Runs of other characters become one edge; there is an edge at either end.
        before = np.concatenate([[False], letter[:-1]])
        line = np.where(letter, points, _EDGE)[letter | before]
        line = np.concatenate([[_EDGE], line, [_EDGE]])
        edge, line = line == _EDGE, self._packing.numbers(line)
        found = [line[~edge]]
        for n in range(2, MAX_N + 1):
            within = np.ones(max(0, len(line) - n + 1), dtype=bool)
            for i in range(1, n - 1):
                within &= ~edge[i : len(line) - n + 1 + i]
            if n == 2:
                within &= ~(edge[:-1] & edge[1:])
            found.append(_pack([line[i : len(line) - n + 1 + i][within] for i in range(n)]))
        return np.concatenate(found)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not len(self._known) or not self._letter[_code_points(text)].any():
            return UNDETERMINED, 0.0
        ids, totals = np.unique(self.grams(text), return_counts=True)
        row = np.searchsorted(self._known, ids)
        row[row == len(self._known)] = 0
        row[self._known[row] != ids] = len(self._known)
        # Most frequent first; ties go to the one that a profile ranks higher, then by number.
        order = np.lexsort((ids, self._best[row], -totals))[:DOCUMENT_GRAMS]
        there = self._place[row[order]]
        here = np.arange(len(there))[:, None]
        apart = np.where(there < PROFILE_GRAMS, np.abs(there - here), PROFILE_GRAMS).sum(axis=0)
        at = int(np.argmin(apart))
        return self.languages[at], float(1.0 - apart[at] / (PROFILE_GRAMS * len(there)))


def predict_column(text: Column, profiles: dict[str, list[str]]) -> Column:
    """struct(lang_pred, score) of each whole text; score is 1 - distance / largest distance (0 to 1)."""

    @F.pandas_udf(PREDICTION)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = RankOrder(profiles)
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    # Declared so that a plan that filters by the result and shows it too evaluates it once.
    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a column ``out``: struct(lang_pred, score). A column of that name is replaced.

    Null text, text without a letter, or no profiles: ``und`` with score 0. Every row gets its own
    result, repeated ones and those without an id too. No rows in, no rows out.
    """
    return docs.withColumn(out, predict_column(F.col(text_col).cast("string"), profiles))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.filter(~held_out()), F.xxhash64("doc_id"))
    return identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score")
    )


def least_scores(identified: DataFrame, lang_col: str = "lang", out: str = "language") -> dict[str, float]:
    """Language -> LEAST_SHARE of the score that 99 of 100 labelled texts reach that are recognised as it.

    ``identified`` comes from :func:`identify`. Every row whose prediction is its label counts; scores are
    rounded down to SCORE_STEPS steps, so an exact percentile holds at most that many values a language and
    does not depend on partitions. The driver gets a number a language.
    """
    told = identified.filter(F.col(f"{out}.lang_pred") == F.col(lang_col).cast("string"))
    step = F.floor(F.col(f"{out}.score") * SCORE_STEPS)
    scores = told.groupBy(F.col(f"{out}.lang_pred").alias("lang")).agg(F.percentile(step, 0.01).alias("low")).collect()
    return {r["lang"]: LEAST_SHARE * r["low"] / SCORE_STEPS for r in scores}


def keep_identified(
    docs: DataFrame, profiles: dict[str, list[str]], least_score: float | dict[str, float] = 0.0, lang_col: str | None = None
) -> DataFrame:
    """The rows of ``docs`` whose language can be told with at least that score; columns stay as they are.

    ``least_score``: one for all, or one per language (a language without one: 0). With ``lang_col`` that
    column becomes the prediction. Null texts, and texts without a letter, are never identified and go.
    Repeated rows and rows without an id are judged alike. No rows in, no rows out.
    """
    out = fresh_name(docs, "_language")
    return _keep_told(identify(docs, profiles, out=out), out, least_score, lang_col)


def _keep_told(identified: DataFrame, out: str, least_score: float | dict[str, float], lang_col: str | None) -> DataFrame:
    pred, score = F.col(f"{out}.lang_pred"), F.col(f"{out}.score")
    if isinstance(least_score, dict):
        per_language = F.create_map(*[F.lit(x) for pair in least_score.items() for x in pair]) if least_score else None
        least = F.lit(0.0) if per_language is None else F.coalesce(per_language[pred], F.lit(0.0))
    else:
        least = F.lit(float(least_score))
    kept = identified.filter((pred != UNDETERMINED) & (score >= least))
    return (kept if lang_col is None else kept.withColumn(lang_col, pred)).drop(out)


def keep_recognised(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """:func:`keep_identified` with profiles and least scores of ``docs`` themselves; ``lang_col`` becomes the prediction.

    Both are counted from every row with a label. Each text is judged once: predictions are stored beside
    the rows, and least scores and the rows that stay are read from there.
    """
    out = fresh_name(docs, "_language")
    identified = materialise(identify(docs, learn_profiles(docs, lang_col=lang_col, whole=True), out=out))
    return _keep_told(identified, out, least_scores(identified, lang_col, out), lang_col)


def reject_undetermined(docs: DataFrame, profiles: dict[str, list[str]], least_score: float | dict[str, float] = 0.0) -> DataFrame:
    """:func:`keep_identified` with the labels of ``docs`` left alone."""
    return keep_identified(docs, profiles, least_score)
