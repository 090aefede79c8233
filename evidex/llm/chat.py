"""Chat formatting on tokens: segments are encoded apart and joined by reserved ids.

A turn is a header, its text and an end mark.  Headers and marks are reserved ids that no
text can produce; in the formatted string they read as the control strings below, and where
a text says a control string, a backslash goes before it (backslashes already there double),
which reading back takes away.  The loss mask covers the texts of the trained roles: ones
and minus ones at the segments' bounds, known by prefix sums of their lengths, add up to it.

Every turn is formatted where it is.  Only reading back puts the turns of a conversation in
order, as a stream over sorted rows that holds one turn at a time.

Defined results: a null text or role is an empty one; roles other than the known ones keep
their names; turns that share a number go by role, then text, and repeated rows are all kept;
a null turn goes first; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are split before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

# Reserved ids follow the vocabulary in this order.
CONTROL = ("### System:", "### User:", "### Assistant:", "### Other:", "###|", "</turn>")
ROLES = ("system", "user", "assistant")
OTHER, NAMED, END = 3, 4, 5
TRAINED = ("assistant",)
_ANY = "|".join(re.escape(c) for c in CONTROL)
_SAID, _ESCAPED = re.compile(rf"(\\*)({_ANY})"), re.compile(rf"(\\+)({_ANY})")


def escape(text: str) -> str:
    return _SAID.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


@lru_cache(maxsize=2)
def _vocabulary(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def assemble(roles: list[str | None], texts: list[str | None], path: str = VOCABULARY) -> tuple[list[list[int]], list[np.ndarray], list[str]]:
    """Token ids, loss mask and formatted string of each turn."""
    encoding, first = _vocabulary(path)
    ids, masks, strings = [], [], []
    for role, text in zip(roles, texts):
        role, said = role or "", escape(text or "")
        body = encoding.encode_ordinary(said)
        if role in ROLES:
            head, shown = [first + ROLES.index(role)], CONTROL[ROLES.index(role)]
        else:
            name = escape(role)
            head, shown = [first + OTHER, *encoding.encode_ordinary(name), first + NAMED], CONTROL[OTHER] + name + CONTROL[NAMED]
        bounds = np.cumsum([0, len(head), len(body), 1])
        steps = np.zeros(bounds[-1] + 1, np.int8)
        if role in TRAINED:
            np.add.at(steps, bounds[1:3], [1, -1])
        ids.append([*head, *body, first + END])
        masks.append(np.cumsum(steps)[:-1].astype(np.int8))
        strings.append(shown + said + CONTROL[END])
    return ids, masks, strings


def read_turn(ids: list[int], mask: list[int], path: str = VOCABULARY) -> tuple[str, str, str]:
    """Role, text and text under the mask, from the ids alone."""
    encoding, first = _vocabulary(path)
    text = lambda part: unescape(encoding.decode_bytes(part).decode("utf-8"))
    at = ids.index(first + NAMED) + 1 if ids[0] == first + OTHER else 1
    role = text(ids[1 : at - 1]) if at > 1 else ROLES[ids[0] - first]
    if ids[-1] != first + END:
        raise ValueError("a turn without its end mark")
    return role, text(ids[at:-1]), text([t for t, m in zip(ids, mask) if m])


TURN = "conv_id bigint, turn bigint, role string, text string, input_ids array<int>, loss_mask array<tinyint>, formatted string"


def format_turns(turns: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Every turn with its ``input_ids``, ``loss_mask`` and ``formatted`` string; a conversation is their sequence by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masks, strings = assemble(batch.column("role").to_pylist(), batch.column("text").to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "turn", "role", "text")), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(masks, pa.list_(pa.int8())), pa.array(strings, pa.string())],
                ["conv_id", "turn", "role", "text", "input_ids", "loss_mask", "formatted"],
            )

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, TURN)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """What the token ids and masks of each conversation say, as counts and digests."""
    names = [part.split()[0] for part in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, n, said, loss, loss_chars, chars, begun = None, 0, None, None, 0, 0, False
        for batch in batches:
            done: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "input_ids", "loss_mask", "formatted"))
            for conv, ids, mask, string in zip(*columns):
                if not begun or conv != open_id:
                    if begun:
                        done.append((open_id, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    open_id, n, said, loss, loss_chars, chars, begun = conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, True
                role, text, trained = read_turn(ids, mask, path)
                n, loss_chars, chars = n + 1, loss_chars + len(trained), chars + len(string)
                said.update(f"{role}\n{text}\n".encode())
                loss.update(trained.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i in (0, 1, 3, 5) else pa.string()) for i, c in enumerate(zip(*done))], names)
        if begun:
            last = (open_id, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i in (0, 1, 3, 5) else pa.string()) for i, v in enumerate(last)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "input_ids", "loss_mask", "formatted").mapInArrow(run, DIGEST)
