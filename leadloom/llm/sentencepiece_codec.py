"""SentencePiece BPE encoding by a table of last tokens, and decoding.

In BPE the encoding of every prefix of a text ends in exactly one token, and a row of tokens is an
encoding exactly when each neighbouring pair is the encoding of the two pieces written together.  So
a text is read once from left to right: an automaton gives the pieces that end at a character, and
the one that fits behind the last token of the prefix before it is kept.  Ids come from walking the
table backwards.  Priorities of merges matter only inside the pair test, which merges two pieces.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
# Encoded stretches and tested pairs that a worker keeps; older ones are forgotten and made again.
KEPT_STRETCHES = 600_000
KEPT_PAIRS = 1 << 19
# Texts returned at once.
ROWS_OUT = 256


def merged(text: str, scores: dict[str, float], least: int = 1) -> list[str]:
    """BPE by its definition: merge the neighbours with the best score, leftmost first, while there
    are more than `least` parts.  Used on one or two pieces at a time."""
    parts = list(text)
    while len(parts) > least:
        options = [
            (-scores[a + b], i)
            for i, (a, b) in enumerate(itertools.pairwise(parts))
            if a + b in scores
        ]
        if not options:
            break
        i = min(options)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def vocabulary(model: bytes) -> dict:
    """What tasks need of a model: scores of the pieces that can occur, ids, byte ids."""
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    scores, ids, byte_ids = {}, {}, {}
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
            scores[piece], ids[piece] = processor.get_score(i), i
    halves = {p: tuple(merged(p, scores, 2)) for p in scores if len(p) > 1}
    # a piece that its own characters do not merge into occurs in no encoding
    reachable = [p for p in scores if len(p) == 1 or len(halves[p]) == 2]
    times = Counter(scores.values())
    return {
        "model": model,
        "scores": scores,
        "ids": ids,
        "byte_ids": byte_ids,
        "unknown": processor.unk_id(),
        "end": processor.eos_id(),
        "reachable": reachable,
        "halves": halves,
        # pieces made after their halves, at a moment of their own; the others are merged in full
        "plain": {
            p for p in reachable
            if len(p) > 1 and times[scores[p]] == 1
            and all(len(h) == 1 or scores[h] > scores[p] for h in halves[p])
        },
    }


class Pairs:
    """Tests whether two tokens stay apart when their pieces are written together.

    Each token grows from a character at the seam; the two growing edges are followed in the order
    of their merges, and a piece that would be made across the seam before the next of them breaks
    the pair."""

    def __init__(self, known: dict):
        self.scores, self.halves = known["scores"], known["halves"]
        self.plain = known["plain"]
        self.edges: dict[tuple[str, int], list[str] | None] = {}

    def edge(self, token: str, side: int) -> list[str] | None:
        """The symbols at an end (-1 right, 0 left) of a growing token; None if a merge on the way
        has no moment of its own."""
        key = token, side
        if key not in self.edges:
            row: list[str] | None = [token]
            while row and len(row[-1]) > 1:
                row = row + [self.halves[row[-1]][side]] if row[-1] in self.plain else None
            self.edges[key] = row and row[::-1]
        return self.edges[key]

    def __call__(self, left: str, right: str) -> bool:
        a, b = self.edge(left, -1), self.edge(right, 0)
        if not a or not b:
            return merged(left + right, self.scores) == [left, right]
        scores, i, j = self.scores, 0, 0
        never = -math.inf
        while True:
            next_a = scores[a[i + 1]] if i + 1 < len(a) else never
            next_b = scores[b[j + 1]] if j + 1 < len(b) else never
            across = a[i] + b[j]
            if across in scores:
                if across not in self.plain:
                    return merged(left + right, scores) == [left, right]
                # of equal merges the leftmost comes first
                if next_a < scores[across] >= next_b:
                    return False
            if next_a == next_b == never:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1


class Encoder:
    """Ids of normalised text."""

    def __init__(self, known: dict):
        self.known = known
        self.automaton = ahocorasick.Automaton()
        for piece in known["reachable"]:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.compatible = lru_cache(KEPT_PAIRS)(Pairs(known))
        self.stretch = self._stretches([p for p in known["scores"] if len(p) > 1])
        self.kept: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _stretches(pieces: list[str]) -> Callable[[str], list[str]]:
        """Cuts a text where no piece can reach across."""
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return lambda text: [text]
        within = set("".join(pieces))
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in within)
        word = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        return re.compile(f"{word}|[{alone}]" if alone else word).findall

    def tokens(self, text: str) -> list[str]:
        """Tokens of one stretch."""
        last: list[str] = [""] * (len(text) + 1)
        compatible = self.compatible
        for end, (piece, size) in self.automaton.iter(text):
            end += 1
            if last[end]:
                continue
            start = end - size
            if start:
                # where no piece ends, the character itself stands, unknown to the vocabulary
                before = last[start] or text[start - 1]
                if not compatible(before, piece):
                    continue
            last[end] = piece
        row, at = [], len(text)
        while at:
            row.append(last[at] or text[at - 1])
            at -= len(row[-1])
        return row[::-1]

    def token_ids(self, tokens: list[str]) -> tuple[int, ...]:
        ids, found = self.known["ids"], []
        for token in tokens:
            if token in ids:
                found.append(ids[token])
            elif self.known["byte_ids"]:
                found.extend(self.known["byte_ids"][b] for b in token.encode())
            else:
                found.append(self.known["unknown"])
        return tuple(found)

    def ids(self, normalised: str) -> list[int]:
        found: list[int] = []
        kept = self.kept
        for part in self.stretch(normalised):
            ids = kept.get(part)
            if ids is None:
                ids = self.token_ids(self.tokens(part))
                if len(part) <= 64:
                    if len(kept) >= KEPT_STRETCHES:
                        kept.clear()
                    kept[part] = ids
            found.extend(ids)
        return found


def encode_texts(
    docs: DataFrame, model_path: str, text: str = "text", end_id: bool = True
) -> DataFrame:
    """`docs` with `ids` (array of int, the end id last) and `decoded` (their text); columns of
    these names are replaced.

    A null text counts as empty: ids hold only the end id, decoded is empty.  Texts are encoded
    whole; equal rows give equal results.  No shuffle: each task encodes its own rows and keeps a
    bounded number of encoded words.
    """
    with open(model_path, "rb") as file:
        known = vocabulary(file.read())
    shared = docs.sparkSession.sparkContext.broadcast(known)  # as large as the model
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([
        *docs.schema.fields,
        T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("decoded", T.StringType(), False),
    ])
    names = [*docs.columns, "ids", "decoded"]
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        # the value outlives the task in its worker, and so does what the encoder has learnt
        if "encoder" not in known:
            known["encoder"] = Encoder(known)
            known["library"] = sentencepiece.SentencePieceProcessor(model_proto=known["model"])
        encoder, library = known["encoder"], known["library"]
        tail = [known["end"]] if end_id else []
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(at, ROWS_OUT)
                ids, decoded = [], []
                for value in batch.column(place).to_pylist():
                    row = encoder.ids(library.normalize(value)) if value else []
                    row += tail
                    decoded.append(library.decode(row))
                    ids.append(np.array(row, np.int32))
                sizes = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)),
                        pa.array(decoded, pa.string()),
                    ],
                    names,
                )

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """One row per text: how many ids, and digests of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
