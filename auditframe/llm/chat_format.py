"""Chat formatting by token-level assembly.

Every segment (a role, a text) is encoded on its own, and reserved ids beyond the vocabulary are spliced between segments, so no text can
produce or merge with a control token:

    BEGIN  ( OPEN role HEAD text CLOSE )*  END

The printed form shows reserved ids as control strings.  Control strings that occur inside a role or text are escaped there: every
backslash is doubled, and one backslash goes behind the first character of a control string; reading it back undoes both.  The loss mask
covers the text and the CLOSE of each assistant turn; it is the prefix sum of +1 and -1 at segment borders.

Rows meet by conversation and are ordered by turn (then role and text, nulls first).  A conversation is one training sample and so the
unit of work; rows of null conv_id form one conversation each row.  Null texts are empty, null roles are empty, repeated rows are
repeated turns, an empty table gives an empty result.  The tokenizer file is a parameter, read once on the driver and broadcast (1.5 MB).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Control strings in the order of their reserved ids.
CONTROL = ["<s>", "</s>", "<|turn|>", "<|says|>", "<|end|>"]
BEGIN, END, OPEN, HEAD, CLOSE = range(5)
#: Other systems' control strings, escaped as well.
FOREIGN = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
LEARNT = "assistant"

_ESCAPED = re.compile("|".join(map(re.escape, sorted([*CONTROL, *FOREIGN], key=len, reverse=True))) + r"|\\")
_UNDONE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNDONE.sub(r"\1", text)


def tokenizer(text: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.encode_special_tokens = True
    return t


def assemble(turns: list[tuple[str, list[int], list[int]]], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one conversation from (role, ids of the role, ids of the text)."""
    pieces, lengths, change = [[base + BEGIN]], [1], [0]
    for role, role_ids, text_ids in turns:
        learnt = role == LEARNT
        for ids, step in (([base + OPEN], 0), (role_ids, 0), ([base + HEAD], 0), (text_ids, learnt), ([base + CLOSE], 0)):
            pieces.append(ids), lengths.append(len(ids)), change.append(int(step))
        change.append(-1 if learnt else 0), pieces.append([]), lengths.append(0)
    pieces.append([base + END]), lengths.append(1), change.append(0)
    starts = np.cumsum([0, *lengths[:-1]])
    delta = np.zeros(sum(lengths) + 1, np.int64)
    np.add.at(delta, starts, change)
    return np.concatenate([np.asarray(p, np.int64) for p in pieces]).astype(np.int32), np.cumsum(delta)[:-1].astype(np.int8)


def formatted(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer_path: str = TOKENIZER) -> DataFrame:
    """conv_id, input_ids, loss_mask and formatted (the printed form), a row for each conversation."""
    kind = dict(conversations.dtypes)[conv_id]
    model = conversations.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    rows = conversations.select(F.col(conv_id).alias("conv_id"), alone.alias("alone"), F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model.value)
        base = tok.get_vocab_size(with_added_tokens=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                roles, texts = part.column("roles").to_pylist(), part.column("texts").to_pylist()
                segments = [escape(x) for r, t in zip(roles, texts) for pair in zip(r, t) for x in pair]
                ids = [e.ids for e in tok.encode_batch(segments, add_special_tokens=False)]
                out, n = [], 0
                for r, t in zip(roles, texts):
                    own = [(r[k], ids[n + 2 * k], ids[n + 2 * k + 1]) for k in range(len(r))]
                    shown = "".join([CONTROL[BEGIN], *(f"{CONTROL[OPEN]}{segments[n + 2 * k]}{CONTROL[HEAD]}{segments[n + 2 * k + 1]}{CONTROL[CLOSE]}" for k in range(len(r))), CONTROL[END]])
                    out.append((*assemble(own, base), shown))
                    n += 2 * len(r)
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.int8())), pa.array([o[2] for o in out], pa.string())],
                                                 names=["conv_id", "input_ids", "loss_mask", "formatted"])

    return talks.mapInArrow(run, f"conv_id {kind}, input_ids array<int>, loss_mask array<byte>, formatted string")


def read_back(samples: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """conv_id, roles, texts, learnt (texts under the mask) and formatted_chars, from ids and mask alone."""
    kind = dict(samples.dtypes)["conv_id"]
    model = samples.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model.value)
        base = tok.get_vocab_size(with_added_tokens=True)
        plain = lambda ids: unescape(tok.decode(ids.tolist(), skip_special_tokens=False))
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column("input_ids"), batch.column("loss_mask")):
                ids, mask = ids.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False)
                opens, heads, closes = (np.flatnonzero(ids == base + c) for c in (OPEN, HEAD, CLOSE))
                roles = [plain(ids[a + 1 : b]) for a, b in zip(opens, heads)]
                texts = [plain(ids[a + 1 : b]) for a, b in zip(heads, closes)]
                steps = np.diff(np.r_[0, mask, 0])
                learnt = [plain(own[own < base]) for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)) for own in [ids[a:b]]]
                rows.append((roles, texts, learnt))
            shown = [len(x) for x in batch.column("formatted").to_pylist()]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *lists, pa.array(shown, pa.int64())], names=["conv_id", "roles", "texts", "learnt", "formatted_chars"])

    return samples.mapInArrow(run, f"conv_id {kind}, roles array<string>, texts array<string>, learnt array<string>, formatted_chars long")


def _escaped(x: str) -> str:
    marks = "|".join(re.escape(c[1:]).replace("'", "''") for c in sorted([*CONTROL, *FOREIGN], key=len, reverse=True))
    first = "(" + "|".join(re.escape(c) for c in sorted([*CONTROL, *FOREIGN], key=len, reverse=True)) + ")"
    return f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, '{first}')))" if marks else x


_TURN = sum(len(CONTROL[i]) for i in (OPEN, HEAD, CLOSE))
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
  sum(CASE WHEN role = '{LEARNT}' THEN length(text) ELSE 0 END)::BIGINT loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNT}'), '')) loss_sha256,
  ({len(CONTROL[BEGIN]) + len(CONTROL[END])} + sum({_TURN} + {_escaped('role')} + {_escaped('text')}))::BIGINT formatted_chars FROM c GROUP BY conv_id
"""


@query("op6_chat_format", ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], rows.schema)
    back = read_back(formatted(rows.union(probe)))
    line = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit("\n"), x["texts"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return back.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
                       F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")
