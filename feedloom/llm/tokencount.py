"""Token counts of whole texts with a whole-token shortcut.

In a sentencepiece BPE vocabulary where no piece holds a space mark after another
character, and none holds a line feed, no merge crosses the start of a run of spaces or
the start of a line. So a text falls into pre-tokens that are counted one by one. Which
vocabulary strings encode alone as one token is proved once per worker by encoding the
whole vocabulary; pre-tokens found there count 1, and only the rest are merged by the
library, once per distinct pre-token while the cache holds it.

Null texts are empty and have 0 tokens. Texts with runs of spaces, a leading space, the
space mark itself or a NUL, and vocabularies that don't meet the conditions above, are
encoded whole. Ties and repeated rows don't matter: every row is counted by itself.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import arrow, mapped, per_worker, rows_out, travels

travels(__name__)

CACHE_UNITS = 1_000_000
MARK = "\u2581"


class Counter:
    """Counts tokens of one sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = (self.model.encode("\n", out_type=str) == [MARK, "<0x0A>"] and self.model.encode("  a", out_type=str)[0].count(MARK) >= 2
                       and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces))
        whole = [p[1:] for p in pieces if p[:1] == MARK and p[1:2] not in ("", MARK)]
        self.alone = {"": 1} | {s: 1 for s, n in zip(whole, self._merge(whole), strict=True) if n == 1}
        self.known = dict(self.alone)

    def _merge(self, units: list[str]) -> list[int]:
        """A pre-token stands for itself after a space; one that starts with a line feed, for no space before it."""
        return [len(x) - (u[0] == "\n") for u, x in zip(units, self.model.encode(units, num_threads=1), strict=True)]

    def count(self, batch: list[str]) -> list[int]:
        out, units = [0] * len(batch), []
        for i, text in enumerate(batch):
            if not text:
                units.append(())
            elif not self.splits or "  " in text or text[0] == " " or MARK in text or "\0" in text:
                out[i] = len(self.model.encode(text))
                units.append(())
            else:
                units.append(text.replace("\n", " \n").split(" "))
        rest = list(set().union(*units).difference(self.known))
        if len(self.known) + len(rest) > CACHE_UNITS:
            self.known = dict(self.alone)
            rest = list(set().union(*units).difference(self.known))
        self.known.update(zip(rest, self._merge(rest), strict=True))
        find = self.known.__getitem__
        for i, own in enumerate(units):
            if own:
                out[i] = sum(map(find, own))
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    fields = "doc_id long, n_bytes long, n_tokens long"
    schema = arrow(fields)

    def task(batches):
        counter = per_worker(f"counter_{path}", lambda: Counter(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = part.column(1).to_pylist()
                sizes = pc.binary_length(part.column(1)).cast(pa.int64())
                yield rows_out(schema, [part.column(0), sizes, counter.count(text)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return mapped(rows, task, fields).withColumn("over_limit", F.col("n_tokens") > limit)
