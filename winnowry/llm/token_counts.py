"""Operator 1, token counts: pieces are counted once per distinct pre-token.

A block of documents is cut into pre-tokens; its bag (distinct pre-tokens, the
documents and counts they occur in) is hash-partitioned by pre-token.  There the
pieces of each distinct pre-token are counted once per partition, the counts are
joined to the frequencies by their common key, and one vector of sums per block goes back.
No id sequence is ever built.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are kept
one for one (repeated and null ids too); other columns are ignored; an empty
table gives an empty result.  ``<|endoftext|>`` inside a text counts as the one
special token the library makes of it.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import PACKED, blocks, pack, packed, packed_batches, release, spread, unpack
from .common import fan_out, steady, table

#: The pattern of byte-level pre-tokens, as the library has it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in every Unicode version.
STABLE = r"[\t\n\r\x20-\x7e¡-¬®-įı-ƿ‐-‧‰-⁞€]*+"
#: Distinct pre-tokens a task remembers; beyond it starts anew, which only repeats work.
REMEMBERED = 300_000


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    return t, split, regex.compile(PRETOKEN), regex.compile(STABLE)


def pretokens(path: str, text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text and the number of special tokens in it."""
    t, split, pattern, stable = _tokenizer(path)
    parts = split.split(text) if split else [text]
    if stable.fullmatch(text):
        return [p for part in parts for p in pattern.findall(part)], len(parts) - 1
    return [part[a:z] for part in parts if part for _, (a, z) in t.pre_tokenizer.pre_tokenize_str(part)], len(parts) - 1


def token_counts(df: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", n_buckets: int | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; ``tokenizer``: path of a byte-level BPE .json."""
    n_buckets = n_buckets or fan_out(df, bytes_each=32 << 20, factor=1)
    docs = steady(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    id_type = docs.schema["id"].dataType

    def bags(batches):
        def rows():
            for name, others, texts in blocks(batches):
                cut = [pretokens(tokenizer, t) for t in texts]
                meta = {"id": [r["id"] for r in others], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "special": np.array([n for _, n in cut])}
                yield from packed(name, [c for c, _ in cut], meta, n_buckets)

        yield from packed_batches(rows())
        release()

    def counted(batches):
        known: dict[str, int] = {}

        def pieces(terms):
            if new := [t for t in terms if t not in known]:
                if len(known) > REMEMBERED:
                    known.clear()
                    new = terms
                known.update(zip(new, (len(e.ids) for e in _tokenizer(tokenizer)[0].encode_batch_fast(new, add_special_tokens=False)), strict=True))
            return np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))

        def rows():
            for b in batches:
                for bucket, block, kind, payload in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    yield (bucket, block, kind, payload) if kind else (bucket, block, 0, pack(spread(pieces, payload).astype(np.int32)))

        yield from packed_batches(rows())
        release()

    def summed(t: pa.Table) -> pa.Table:
        meta, total = None, 0
        for kind, payload in zip(t.column("kind").to_pylist(), t.column("payload").to_pylist(), strict=True):
            if kind:
                meta = unpack(payload)
            else:
                total = total + unpack(payload).astype(np.int64)
        n = meta["special"].astype(np.int64) + total
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.table({"id": pa.array(meta["id"], to_arrow_type(id_type)), "n_bytes": pa.array(meta["n_bytes"], pa.int64()), "n_tokens": pa.array(n, pa.int64())})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = docs.mapInArrow(bags, PACKED).repartition(parts, "bucket").mapInArrow(counted, PACKED)
    return answers.groupBy("block").applyInArrow(summed, f"id {id_type.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Token counts of all documents by byte_bpe_50k, and whether they exceed ``limit``."""
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
