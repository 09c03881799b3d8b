"""Language identification with string kernels.

A text's features are its distinct n-grams of 1 to 3 characters (lower case, anything but
letters as one blank), hashed to 2**16 presence bits; the blended-spectrum presence kernel
of two texts is the number of shared bits over the root of the product of their counts.
Landmarks from the labelled sample give Nystroem features, in which one kernel ridge
regression per language against the rest is solved. Since a score is linear in the
landmark kernels, the weights fold into one matrix (bits by languages), and texts are
scored by products of presence matrices with it, a batch at a time, over whole texts.

The fit sees `per_language` rows of each language (the smallest md5 of their id), of which
the first `landmarks` are landmarks; it collects their bits, 8 kB a row, so its size is
bounded by the number of languages. Rows with a null language, or kept out by `learn`,
are never learnt from. Texts that are null or have no letter are `und` with score 0, and
so is everything if there is nothing to learn from. Repeated rows get equal results.

`predict` also rejects, as `und`, texts of which too few distinct n-grams are known, that
is, stand in two rows or more of the sample of their language. The bound comes from the
sample, each row held against the others: MARGIN times a low quantile of the known share
of the rows that are classified right. Neither depends on the number of languages or on
the length of a text. `identify` names the nearest language of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import arrow, mapped, per_worker, rows_out, travels

travels(__name__)

BITS = 16
PIECE = 1 << 20      # characters handled at a time; pieces of a long text overlap by two
BATCH = 32
UNKNOWN = "und"
QUANTILE, MARGIN = 0.01, 0.85      # of the known shares of the sample's rows


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def presence(text: str, out: np.ndarray) -> bool:
    """Sets the bits of the text's n-grams in `out` (2**BITS entries); False if it has no letter."""
    letters = per_worker("letters", _letters)
    found = False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE + 2].lower().encode("utf-32-le", "replace"), np.uint32)
        alpha = letters[codes]
        found = found or bool(alpha.any())
        codes = np.where(alpha, codes, np.uint32(32))
        gram = codes * np.uint32(0x9E3779B1)
        for n in range(3):
            if n:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[n:] * np.uint32(0xC2B2AE3D)
            out[(gram * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)] = 1
    return found


@dataclass
class Model:
    """Languages and the folded weights, bits by languages."""

    languages: list[str]
    weights: np.ndarray
    known: np.ndarray | None = None      # bits by languages, 1 for those known
    least: float = 0.0                   # the least known share

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return bits @ self.weights / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))


def fit(bits: np.ndarray, languages: list[str], landmark: np.ndarray, ridge: float = 0.1) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem features of the landmarks.

    `bits` holds one row of 0 and 1 per text; its products are taken by columns, so no
    wider copy of it is made.
    """
    names = sorted(set(languages))
    blocks = [slice(at, at + 4096) for at in range(0, bits.shape[1], 4096)]
    scale = 1 / np.sqrt(np.maximum(bits.sum(1, dtype=np.float64), 1))
    shared = np.zeros((len(bits), int(landmark.sum())))
    for b in blocks:
        part = bits[:, b].astype(np.float32)
        shared += part @ part[landmark].T
    kernel = shared * scale[:, None] * scale[landmark]
    value, vector = np.linalg.eigh(kernel[landmark])
    keep = value > 1e-8 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    features = kernel @ whiten
    truth = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    dual = whiten @ np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ truth)
    folded = (dual * scale[landmark][:, None]).astype(np.float32)
    return Model(names, np.concatenate([bits[landmark, b].astype(np.float32).T @ folded for b in blocks]))


def bound(model: Model, bits: np.ndarray, languages: list[str]) -> None:
    """Sets the known bits of each language and the least known share."""
    label = np.array([model.languages.index(x) for x in languages])
    count = np.stack([bits[label == k].sum(0, dtype=np.int32) for k in range(len(model.languages))], axis=1)
    model.known = (count >= 2).astype(np.float32)
    shares = []
    for row, k in zip(bits, label.tolist(), strict=True):
        if int(model.scores(row[None].astype(np.float32)).argmax()) == k:
            own = np.flatnonzero(row)
            shares.append(float((count[own, k] >= 3).mean()))      # two rows besides itself
    model.least = MARGIN * float(np.quantile(shares, QUANTILE)) if shares else 0.0


def train(labelled: DataFrame, per_language: int = 120, landmarks: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on a bounded sample of rows with a language; None if there are none."""
    order = Window.partitionBy("lang").orderBy("ticket", "id")
    narrow = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.md5(F.col(id_col).cast("string").cast("binary")).alias("ticket"))
    chosen = narrow.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.join(chosen, (F.col("_id") == F.col("id")) & (F.col("_lang") == F.col("lang"))).select("lang", "place", "ticket", "text")
    fields = "lang string, place int, ticket string, bits binary"
    schema = arrow(fields)

    def task(batches):
        for batch in batches:
            out = []
            for lang, place, ticket, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = np.zeros(1 << BITS, np.uint8)
                if presence(text, bits):
                    out.append((lang, place, ticket, np.packbits(bits).tobytes()))
            if out:
                yield rows_out(schema, list(zip(*out, strict=True)))

    sample = sorted(map(tuple, mapped(rows, task, fields).collect()))
    if not sample:
        return None
    bits = np.unpackbits(np.frombuffer(b"".join([r[3] for r in sample]), np.uint8).reshape(len(sample), -1), axis=1)
    languages = [r[0] for r in sample]
    model = fit(bits, languages, np.array([r[1] <= landmarks for r in sample]) if any(r[1] <= landmarks for r in sample) else np.ones(len(sample), bool))
    bound(model, bits, languages)
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", sharpness: float = 3.0, keep: list[str] | None = None,
            reject: bool = True) -> DataFrame:
    """All columns (or those of `keep`), and lang_pred and score (0 to 1) of every whole text; of one in no known language `und` and 0, if `reject`."""
    rejects = reject and model is not None and model.known is not None

    def task(batches):
        import pyarrow as pa

        block = np.zeros((BATCH, 1 << BITS), np.float32)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("_text")).to_pylist()
            lang, score = [UNKNOWN] * len(text), [0.0] * len(text)
            for at in range(0, len(text) if model else 0, BATCH):
                part = text[at:at + BATCH]
                known = [t is not None and presence(t, block[i]) for i, t in enumerate(part)]
                raw = model.scores(block[:len(part)]).astype(np.float64) * sharpness
                raw = np.exp(raw - raw.max(1, keepdims=True))
                share = raw / raw.sum(1, keepdims=True)
                if rejects:
                    seen = block[:len(part)] @ model.known / np.maximum(block[:len(part)].sum(1, keepdims=True), 1)
                    known = [k and bool(seen[i, best] >= model.least) for i, (k, best) in enumerate(zip(known, share.argmax(1).tolist(), strict=True))]
                for i, best in enumerate(share.argmax(1).tolist()):
                    if known[i]:
                        lang[at + i], score[at + i] = model.languages[best], float(share[i, best])
                block[:len(part)] = 0
            kept = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lang), pa.array(score, pa.float64())], names=[*kept.schema.names, "lang_pred", "score"])

    given = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in given], F.col(f"`{text_col}`").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(task, (fields + ", " if fields else "") + "lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Every fourth id by crc32 of its text; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from rows that aren't held out, predicted for all."""
    model = train(docs.where(~held_out(id_col)), id_col=id_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col("text"))
    return predict(rows, model, keep=["doc_id", "held_out"], reject=False)
