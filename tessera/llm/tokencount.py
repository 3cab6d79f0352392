"""Token counts (operator 3).

For a piece vocabulary in which a space mark only ever leads a piece, no piece crosses from a
character into a following space. A text is thus cut into pre-tokens (spaces, then
other characters), whose piece counts add up:

1. One scan of the documents makes blocks of about BLOCK_CHARS: the block's distinct pre-tokens, and for each document the numbers of those it has, with their
   frequencies, packed. Blocks go to a table in the shared folder.
2. The blocks' pre-tokens are dealt by themselves and sorted, so that equal ones come one after the other, and the pieces of each are counted, once in the whole run.
3. The counts go back to the blocks that asked, a packed row for each that a stretch of sorted pre-tokens answers, and frequencies times counts are summed by document.

No ids of a text are ever made. A pre-token moves once for each block that has it, never for each document, and one that every document has is one row a block: no key is
hot beyond the number of blocks, and equal ones pass through a task as a stream. Texts aren't shuffled.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; a null id stays null; a text longer than a block is a block of its own; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, give_back, stored, two_columns

#: The vocabulary's mark for a space.
SPACE_MARK = "▁"
#: Characters of text in a block.
BLOCK_CHARS = 32_000_000
#: Sorted pre-tokens that are answered at a time.
ANSWERED = 500_000

_runs = re.compile(" +[^ ]*")
_loaded: dict[str, object] = {}

ANSWER = pa.schema([("to", pa.int64()), ("numbers", pa.binary()), ("pieces", pa.binary())])
BLOCK = pa.schema([("block", pa.int64()), ("pre_tokens", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("numbers", pa.binary()), ("times", pa.binary())])
BLOCK_DDL = "block long, pre_tokens array<string>, ids array<long>, bytes array<long>, kinds array<int>, numbers binary, times binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def processor(model: bytes):
    """The vocabulary of a model file's content, loaded once in a process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        inside = [p for i in range(own.get_piece_size()) if SPACE_MARK in (p := own.id_to_piece(i)).lstrip(SPACE_MARK)]
        if inside:
            raise ValueError(f"pieces with a space after other characters: {inside[:3]}")
        _loaded[key] = own
    return _loaded[key]


def frequencies(text: str | None) -> Counter:
    """Pre-tokens of a text, without their first space (the model puts one before a text)."""
    if not text:
        return Counter()
    text = text.replace(SPACE_MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return Counter([p[1:] for p in _runs.findall(" " + text)])
    return Counter(text.split(" "))


def packed(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, compressed by their bytes: all first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


class Block:
    """Documents of a block so far: ids, sizes, and frequencies by the pre-tokens' numbers."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.bytes, self.kinds, self.numbers, self.times = [], [], [], [], []
        self.chars = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found, number = frequencies(text), self.number
        self.ids.append(doc_id)
        self.bytes.append(len((text or "").encode()))
        self.kinds.append(len(found))
        numbers = np.array([number.setdefault(p, len(number)) for p in found], np.int64)
        order = np.argsort(numbers)
        self.numbers.append(np.diff(numbers[order], prepend=0))  # gaps pack better
        self.times.append(np.fromiter(found.values(), np.int64, len(found))[order])
        self.chars += len(text or "")

    def batch(self) -> pa.RecordBatch:
        whole = lambda x: packed(np.concatenate([np.zeros(0, np.int64), *x]))
        row = (random.getrandbits(63), list(self.number), self.ids, self.bytes, self.kinds, whole(self.numbers), whole(self.times))
        return pa.RecordBatch.from_pydict({f.name: [x] for f, x in zip(BLOCK, row, strict=True)}, schema=BLOCK)


def blocks(batches, chars: int):
    """Arrow batches of (doc_id, text) as blocks, a row each."""
    own = Block()
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own.ids and own.chars + len(t or "") > chars:
                yield own.batch()
                own = Block()
            own.add(i, t)
    if own.ids:
        yield own.batch()
    del own
    give_back()


def count_tokens(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more tokens than limit). model is the model file's content, of fixed size."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    processor(model)
    chars = BLOCK_CHARS
    table = stored(two_columns(df, id_col, text_col).mapInArrow(lambda b: blocks(b, chars), BLOCK_DDL), "zstd")

    def count(batches):
        """(block, number, pre_token), sorted by pre_token: the pieces of each, packed by block."""
        own, last, n = processor(shared.value), None, 0
        waiting: list[np.ndarray] = []

        def answered():
            rows = np.concatenate(waiting, 1)
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            edge = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]]).tolist()
            some = [rows[:, a:b] for a, b in zip(edge, [*edge[1:], rows.shape[1]], strict=True)]
            waiting.clear()
            return pa.RecordBatch.from_pydict({"to": [int(r[0, 0]) for r in some], "numbers": [packed(np.diff(r[1], prepend=0)) for r in some], "pieces": [packed(r[2]) for r in some]}, schema=ANSWER)

        for batch in batches:
            found = batch.column(2).dictionary_encode()
            names = found.dictionary.to_pylist()
            new = [p for p in names if p != last]  # only the first can have come before
            # A lone space is a piece; the model gives none for an empty text.
            pieces = [len(x) if p else 1 for p, x in zip(new, own.encode(new, out_type=str, num_threads=1), strict=True)]
            pieces = [n] * (len(names) - len(new)) + pieces
            if names:
                last, n = names[-1], pieces[-1]
            waiting.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), np.array(pieces, np.int64)[found.indices.to_numpy()]]))
            if sum(w.shape[1] for w in waiting) >= ANSWERED:
                yield answered()
        if waiting:
            yield answered()
        give_back()

    wanted = table.select("block", F.posexplode("pre_tokens").alias("number", "pre_token"))
    answers = wanted.repartition("pre_token").sortWithinPartitions("pre_token").mapInArrow(count, "to long, numbers binary, pieces binary")

    def total(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [(np.cumsum(unpacked(x)), unpacked(y)) for x, y in zip(answers["numbers"].to_pylist(), answers["pieces"].to_pylist(), strict=True)]
        pieces = np.zeros(sum(len(x) for x, _ in rows), np.int64)
        for at, n in rows:
            pieces[at] = n
        out: dict[str, list] = {f.name: [] for f in OUT}
        for r in own.to_pylist():
            kinds = np.array(r["kinds"], np.int64)
            ends = np.cumsum(kinds)
            numbers = np.cumsum(unpacked(r["numbers"]))
            # Gaps begin anew with each document.
            before = np.r_[0, numbers][ends - kinds]
            numbers -= np.repeat(before, kinds)
            sums = np.r_[0, np.cumsum(pieces[numbers] * unpacked(r["times"]))]
            n = (sums[ends] - sums[ends - kinds]).tolist()
            for c, x in (("doc_id", r["ids"]), ("n_bytes", r["bytes"]), ("n_tokens", n), ("over_limit", [x > limit for x in n])):
                out[c] += x
        give_back()
        return pa.table(out, schema=OUT)

    return table.drop("pre_tokens").groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(total, ddl(OUT))
