"""SentencePiece encoding and decoding over a distinct-chunk table.

No piece of a vocabulary of this kind holds a white-space marker after another character,
so no piece crosses from one marked word into the next: a text may be cut before every run
of markers, if the model takes it as it is. Each task keeps a table of the distinct chunks it has met, has the library
segment every distinct chunk once, and joins the chunks' ids back by position with numpy
gathers. A model whose pieces do cross markers, or that normalises texts, is detected and its
texts are segmented whole. The table is emptied when it outgrows ``table_limit`` chunks, so memory is bounded.

Null texts count as empty (only the end id); any length is taken whole; rows keep their
other columns (``keep``) but ones named like those added; repeated rows give repeated
results, an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import in_batches, sub_batches, without

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def pieces_stay_in_chunks(sp) -> bool:
    """Whether no piece holds a marker after another character, and the model takes texts as they are: one marker
    before them, one for every space, nothing normalised, taken away or kept whole by a symbol of the user's."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    rule, own = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
    plain = rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap
    return plain and not model.trainer_spec.treat_whitespace_as_suffix and not any(MARK in p.piece.lstrip(MARK) or p.type == own for p in model.pieces)


class ChunkTable:
    """Distinct marked words with their ids and decoded text, in flat arrays."""

    def __init__(self, sp, table_limit: int = 300_000):
        self.sp, self.limit = sp, table_limit
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[str] = []
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, chunks: list[str]) -> None:
        # the library puts one marker before what it is given, but none before nothing
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        if MARK in chunks:
            found[chunks.index(MARK)] = [self.sp.piece_to_id(MARK)]
        base = len(self.text)
        for i, c in enumerate(chunks):
            self.code[c] = base + i
        self.text += [" " + t for t in self.sp.decode(found, num_threads=1)]
        length = np.array([len(x) for x in found], np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(length.sum()))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids, the number of ids of each text, decoded texts."""
        if len(self.code) > self.limit:
            self.clear()
        split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if new := list(dict.fromkeys(c for s in split for c in s if c not in self.code)):
            self.add(new)
        get, text = self.code.__getitem__, self.text
        rows = [list(map(get, s)) for s in split]
        decoded = ["".join([text[c] for c in r])[1:] for r in rows]
        sizes = np.array([len(r) for r in rows], np.int64)
        codes = np.fromiter((c for r in rows for c in r), np.int64, int(sizes.sum()))
        n = self.length[codes]
        at = np.cumsum(n) - n
        flat = self.ids[np.repeat(self.start[codes] - at, n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return flat, np.diff(ends), decoded


def encode_decode(
    docs: DataFrame, model_path: str, *, keep: list[str] | None = None, text: str = "text", eos: bool = True, round_trip: bool = False, batch_chars: int = 250_000, table_limit: int = 100_000
) -> DataFrame:
    """Adds ``ids`` (array<int>, with the end id) and ``decoded`` to the columns of ``keep``. With ``round_trip``, a
    boolean of that name takes the place of ``decoded``: whether decoding gives the text back, markers in it being
    spaces; the task that decodes a text compares it, and no text is handed back. ``batch_chars`` and
    ``table_limit`` bound what a task holds beside its batch, not what it does."""
    last = T.StructField("round_trip", T.BooleanType()) if round_trip else T.StructField("decoded", T.StringType())
    keep = without(keep if keep is not None else [c for c in docs.columns if c != text], ("ids", last.name))
    sent = text if text in keep else "__text"
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), last]
    schema = T.StructType([docs.schema[c] for c in keep] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        table = ChunkTable(sp, table_limit) if pieces_stay_in_chunks(sp) else None
        for rb in batches:
            texts = [t or "" for t in rb.column(sent).to_pylist()]
            for a, b in sub_batches(texts, batch_chars):
                if table is not None:
                    flat, sizes, decoded = table.encode(texts[a:b])
                else:
                    rows = sp.encode(texts[a:b], num_threads=1)
                    sizes, decoded = np.array([len(r) for r in rows], np.int64), sp.decode(rows, num_threads=1)
                    flat = np.fromiter((i for r in rows for i in r), np.int32, int(sizes.sum()))
                if eos:
                    flat, sizes = np.insert(flat, np.cumsum(sizes), sp.eos_id()), sizes + 1
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                part = rb.slice(a, b - a)
                if round_trip:
                    made = pa.array([d == t.replace(MARK, " ") for d, t in zip(decoded, texts[a:b], strict=True)], pa.bool_())
                else:
                    made = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [ids, made], names=[*keep, "ids", last.name])

    own = [] if sent in keep else [docs[text].alias(sent)]
    return in_batches(docs).select(*[docs[c] for c in keep], *own).mapInArrow(run, schema)
