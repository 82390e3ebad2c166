"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word can
be cut into pieces in many ways; its probability is the sum over all of them, which a
forward pass over its bytes adds up. A text's score is the sum of its words' logarithms,
each word with a leading space. Bytes are pieces too, so no text is out of reach.

The piece probabilities are fitted by expectation-maximisation on the words of about
``train_texts`` labelled texts per language, chosen by hash, one task per language. Every
text is then scored whole. Different words are scored once: each task keeps the scores
of up to ``KEPT_WORDS`` words.

Defined results: texts without a letter, null and empty ones included, are ``und`` with
score 0, as are all texts when nothing was learned. Words are the runs of letters,
digits and other non-ASCII characters of the lower-cased text; runs over 64 bytes are
scored in parts of at most 64 bytes. A row with a null id is neither learned from nor held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerscope.llm.texts import check_free, mix, packed, plain, powers, prefix_hash, scan_words, text_chunks, unpacked

TRAIN_TEXTS = 400
ROUNDS = 3
LONGEST_WORD = 64
KEPT_WORDS = 400_000
_SMOOTHING = 0.05
_SPACE = 0x20
NO_LANGUAGE = "und"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary_pieces(path: str) -> list[bytes]:
    """Pieces as bytes, word starts as a leading space, then all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    reachable = {p for p in pieces if b" " not in p[1:] and len(p) <= LONGEST_WORD + 1}
    return sorted(reachable | {bytes([b]) for b in range(256)})


@dataclass
class Pieces:
    """Vocabulary as a sorted table of hashes; ``order`` gives a hash's piece number."""

    hashes: np.ndarray
    order: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[bytes]) -> Pieces:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        sums = prefix_hash(data + np.uint64(1))
        starts = np.concatenate([[0], ends[:-1]])
        hashes = mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])
        order = np.argsort(hashes)
        return cls(hashes[order], order, max(map(len, pieces)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def lattice(words: np.ndarray, pieces: Pieces) -> list[tuple[int, int, np.ndarray]]:
    """For words of one length (one per row): (start, end, piece numbers) of every stretch that is a piece of some word."""
    n_words, n = words.shape
    sums = np.zeros((n_words, n + 1), np.uint64)
    up, down = powers(n + 1)
    np.cumsum((words + np.uint64(1)) * up[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
    out = []
    for end in range(1, n + 1):
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.find(mix((sums[:, end] - sums[:, start]) * down[start]))
            if (found >= 0).any():
                out.append((start, end, found))
    return out


def forward(words: np.ndarray, pieces: Pieces, probability: np.ndarray) -> np.ndarray:
    """log P(word) per word and language; ``probability`` has a row per piece and a zero row at the end (for -1)."""
    n_words, n = words.shape
    alpha = np.zeros((n + 1, n_words, probability.shape[1]))
    alpha[0] = 1.0
    scale = np.zeros(n_words)
    scaled_to = 0
    for start, end, found in lattice(words, pieces):
        if end - scaled_to > 16:  # keep long products in range: rescale all places that later steps read
            peak = alpha[max(0, end - pieces.longest):end].max(axis=(0, 2))
            alpha[max(0, end - pieces.longest):end + 1] /= peak[:, None]
            scale += np.log(peak)
            scaled_to = end
        alpha[end] += alpha[start] * probability[found]
    return np.log(np.maximum(alpha[n], 1e-300)) + scale[:, None]


def _by_length(words: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def _matrix(words: list[bytes], chosen: list[int], size: int) -> np.ndarray:
    """Words of one length, a leading space each."""
    out = np.full((len(chosen), size + 1), _SPACE, np.uint8)
    out[:, 1:] = np.frombuffer(b"".join(words[i] for i in chosen), np.uint8).reshape(len(chosen), size)
    return out


def fit_pieces(words: list[bytes], counts: np.ndarray, pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language by expectation-maximisation over all segmentations."""
    n = len(pieces.hashes)
    probability = np.append(np.full(n, 1.0 / n), 0.0)
    grouped = []
    for size, chosen in _by_length(words).items():
        matrix = _matrix(words, chosen, size)
        grouped.append((matrix.shape, lattice(matrix, pieces), counts[chosen]))
    for _ in range(rounds):
        expected = np.zeros(n + 1)
        for (n_words, size), edges, count in grouped:
            alpha, beta = np.zeros((size + 1, n_words)), np.zeros((size + 1, n_words))
            alpha[0], beta[size] = 1.0, 1.0
            for start, end, found in edges:
                alpha[end] += alpha[start] * probability[found]
            for start, end, found in reversed(edges):  # falling ends; each end is complete before it is read
                beta[start] += beta[end] * probability[found]
            total = np.maximum(alpha[size], 1e-300)
            for start, end, found in edges:
                np.add.at(expected, found, count * alpha[start] * probability[found] * beta[end] / total)
        expected = expected[:n] + _SMOOTHING
        probability = np.append(expected / expected.sum(), 0.0)
    return probability[:n]


def is_held_out(id_col: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def sample_by_hash(rows: DataFrame, id_col: Column, want: Column) -> DataFrame:
    """Rows whose hashed id falls below ``want`` (a share of all)."""
    place = F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(place < want)


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: Pieces
    probability: np.ndarray  # a row per piece and a zero row; a column per language

    def score_words(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for size, chosen in _by_length(words).items():
            for low in range(0, len(chosen), 4096):
                part = chosen[low:low + 4096]
                out[part] = forward(_matrix(words, part, size), self.pieces, self.probability)
        return out


def fit_languages(labelled: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", train_texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on about ``train_texts`` texts of each language (all, where there are fewer)."""
    pieces = vocabulary_pieces(vocabulary or default_vocabulary())
    known = labelled.where(plain(lang_col).isNotNull() & plain(id_col).isNotNull())
    sizes = known.groupBy(plain(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    share = {r["_lang"]: train_texts / r["_n"] for r in sizes.collect()}  # one row per language
    if not share:
        return LanguageModel([], Pieces.of(pieces), np.zeros((len(pieces) + 1, 0)))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), plain(lang_col))
    sample = sample_by_hash(known, plain(id_col), wanted).select(plain(lang_col).alias("lang"), F.lower(plain(text_col)).alias("text"))

    def words_of(batches):
        for batch in batches:
            langs, row0 = batch.column(0), 0
            for data, bounds in text_chunks(batch.column(1)):
                found = scan_words(data, bounds, longest=LONGEST_WORD)
                rows = np.repeat(np.arange(len(bounds) - 1), np.diff(found.first)) + row0
                row0 += len(bounds) - 1
                texts = [found.folded[a:b].tobytes() for a, b in zip(found.starts, found.ends)]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(rows)), pa.array(texts, pa.binary())], names=["lang", "word"])

    counted = sample.mapInArrow(words_of, "lang string, word binary").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))

    def fit(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        found = fit_pieces([bytes(w) for w in table["word"]], table["n"].to_numpy(float), Pieces.of(pieces), rounds)
        return pd.DataFrame({"lang": [key[0]], "p": [found.tobytes()]})

    fitted = {r["lang"]: np.frombuffer(r["p"]) for r in counted.groupBy("lang").applyInPandas(fit, "lang string, p binary").collect()}
    languages = sorted(fitted)
    table = np.stack([fitted[x] for x in languages] or [np.zeros(len(pieces))], axis=1)[:, :len(languages)]
    return LanguageModel(languages, Pieces.of(pieces), np.vstack([table, np.zeros(len(languages))]))


class _WordScores:
    """Scores of the words a task has met: a sorted table of hashes, emptied when it is full."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)), np.float32)

    def of(self, words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores per distinct word; ``first`` is a place in the text of each."""
        at = np.searchsorted(self.hashes, hashes)
        known = (at < len(self.hashes)) & (self.hashes[np.minimum(at, max(0, len(self.hashes) - 1))] == hashes) if len(self.hashes) else np.zeros(len(hashes), bool)
        out = np.zeros((len(hashes), self.scores.shape[1]), np.float32)
        out[known] = self.scores[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.model.score_words([words.folded[words.starts[i]:words.ends[i]].tobytes() for i in first[new]])
            if len(self.hashes) + len(new) > KEPT_WORDS:
                self.hashes, self.scores = hashes[new], out[new]
            else:
                merged = np.insert(self.hashes, at[new], hashes[new])
                self.scores = np.insert(self.scores, at[new], out[new], axis=0)
                self.hashes = merged
        return out


def predictor(model: LanguageModel):
    """Column function (lower-cased text) -> struct of language and score (posterior under equal priors)."""
    kept: list[_WordScores] = []

    def predict(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(_WordScores(model))
        langs, scores = [], []
        for data, bounds in text_chunks(texts):
            words = scan_words(data, bounds, longest=LONGEST_WORD)
            distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
            each = kept[0].of(words, distinct, first)
            n = len(bounds) - 1
            rows = np.repeat(np.arange(n), np.diff(words.first))
            total = np.stack([np.bincount(rows, each[inverse, k], n) for k in range(len(model.languages))], axis=1)
            best = total.argmax(axis=1)
            scores += (1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)).tolist()
            langs += [model.languages[k] for k in best]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(predict, "lang string, score double")


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_name: str = "lang_pred",
                       score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, in columns that are new."""
    check_free(docs, lang_name, score_name)
    if not model.languages:
        return docs.withColumns({lang_name: F.lit(NO_LANGUAGE), score_name: F.lit(0.0)})
    rows, text = docs.select(packed(docs)), F.col("row").getField(text_col)
    some = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = rows.withColumn("language", predictor(model)(F.lower(F.when(some, text))))
    out = [(lang_name, F.when(some, F.col("language.lang")).otherwise(NO_LANGUAGE)),
           (score_name, F.when(some, F.col("language.score")).otherwise(0.0))]
    return found.select(*unpacked(docs), *[c.alias(n) for n, c in out])


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned where crc32(doc_id) mod 5 is not 0."""
    held = is_held_out(F.col("doc_id"), 5, 0)
    model = fit_languages(docs.where(~held))
    return identify_languages(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
