"""Packing of tokenized documents into sequences by vector best-fit."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shipflow.llm import text as T
from shipflow.llm.tokens import Tokens
from shipflow.session import stored

MOST_TOKENS = 2048
GROUP_PIECES = 8192  # pieces packed together; costs at most a sequence or so per group
# No document can break the last two: they are what the tokens allow. Lower them to bind.
CAPACITIES = {"tokens": MOST_TOKENS, "documents": MOST_TOKENS, "attention": MOST_TOKENS**2}
WEIGHTS = {"tokens": 1.0, "documents": 1e-4, "attention": 1e-4}

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long{ids}, piece_row long"
_tokens: dict[str, Tokens] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str, most_tokens: int = MOST_TOKENS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most most_tokens: doc_id, piece, start, length, ids_crc32 (, ids), piece_row.

    A document is its text's ids and then end_id; a null text is empty, so it is end_id alone. Only the first piece
    may be shorter. Rows are taken one by one: repeated rows and null doc_ids give pieces like any other, no row
    gives none. piece_row numbers the pieces; it is fixed once the frame is stored.
    """
    T.small_batches(docs.sparkSession)
    frame = T.needed(docs, "doc_id", "text")
    schema = PIECES.format(id=frame.schema["doc_id"].dataType.simpleString(), ids=", ids array<int>" if with_ids else "")
    return frame.mapInArrow(partial(_pieces, tokenizer, most_tokens, end_id, with_ids), schema)


def _pieces(tokenizer, most_tokens, end_id, with_ids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if tokenizer not in _tokens:
        _tokens[tokenizer] = Tokens(tokenizer)
    tokens = _tokens[tokenizer]
    row = TaskContext.get().partitionId() << 40
    end = np.array([end_id], "<u4")
    for batch in batches:
        for first, places, ids in tokens.ids(batch["text"]):
            owner, piece, start, length, crc, kept = [], [], [], [], [], []
            for i in range(len(places) - 1):
                own = np.concatenate((ids[places[i] : places[i + 1]], end)).astype("<u4")
                short = len(own) % most_tokens
                cuts = [0] * bool(short) + list(range(short, len(own) + 1, most_tokens))
                for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(first + i)
                    piece.append(number)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    if with_ids:
                        kept.append(own[a:b].astype(np.int32))
            if not owner:
                continue
            columns = [
                batch["doc_id"].take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []),
                pa.array(range(row, row + len(owner)), pa.int64()),
            ]
            row += len(owner)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "piece_row"]
            yield pa.RecordBatch.from_arrays(columns, names)


def best_fit(lengths: np.ndarray, capacities: Mapping[str, float], weights: Mapping[str, float], score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each piece, longest first; equal scores take the bin opened first.

    A piece needs (length, 1, length squared). Among the bins with room in every dimension, "norm" takes the one
    left with the least weighted norm, "dot" the one whose residual has the largest weighted product with the need.
    A piece that no empty bin could hold is an error.
    """
    names = ("tokens", "documents", "attention")
    room = np.array([capacities[name] for name in names], float)
    weight = np.array([weights[name] for name in names], float)
    needs = np.stack([lengths, np.ones(len(lengths)), np.square(lengths.astype(float))], axis=1)
    if len(needs) and (needs > room).any():
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((len(lengths), 3))  # of open bins only, in the order they were opened
    numbers = np.empty(len(lengths), np.int64)
    filled = np.empty(len(lengths), np.int64)
    opened = used = 0
    order = np.argsort(-lengths, kind="stable")
    least = needs[order[-1]] if len(order) else room
    for k, i in enumerate(order):
        need = needs[i]
        fits = np.flatnonzero((left[:opened] >= need).all(axis=1))
        if len(fits):
            rest = (left[fits] - need) / room
            scores = (rest * rest) @ weight if score == "norm" else -(left[fits] / room) @ (weight * need / room)
            at = fits[np.argmin(scores)]
        else:
            at, opened = opened, opened + 1
            left[at], numbers[at], filled[at], used = room, used, 0, used + 1
        bins[i], offsets[i] = numbers[at], filled[at]
        left[at] -= need
        filled[at] += lengths[i]
        if (left[at] < least).any():  # no later piece fits
            for held in (left, numbers, filled):
                held[at : opened - 1] = held[at + 1 : opened]
            opened -= 1
    return bins, offsets


def pack(
    stored_pieces: DataFrame,
    capacities: Mapping[str, float] = CAPACITIES,
    weights: Mapping[str, float] = WEIGHTS,
    score: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Stored pieces with sequence_id and offset, the place in the sequence.

    Groups of about group_pieces, drawn by a hash of piece_row, are packed each in a task of its own: a group is the
    same mix of lengths whatever the input, and copies spread like other rows. An empty table gives no rows.
    """
    groups = max(1, -(-stored_pieces.count() // group_pieces))
    schema = StructType([*stored_pieces.schema]).add("sequence_id", "long").add("offset", "long")

    def packed(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="packing_group").sort_values("piece_row", ignore_index=True)
        bins, offsets = best_fit(rows["length"].to_numpy(), capacities, weights, score)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return (
        stored_pieces.withColumn("packing_group", F.pmod(F.xxhash64("piece_row"), F.lit(groups)))
        .groupBy("packing_group")
        .applyInPandas(packed, schema)
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces that carry ids as whole sequences: sequence_id, n_tokens, ids, lengths (of the pieces in order)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda total, part: total + part["length"]).alias("n_tokens"),
        F.flatten(F.transform("parts", lambda part: part["ids"])).alias("ids"),
        F.transform("parts", lambda part: part["length"]).alias("lengths"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Documents as packed pieces; the pieces are stored once in the shared folder."""
    return pack(stored(pieces(docs, tokenizer), "pieces"), **options).drop("piece_row")
