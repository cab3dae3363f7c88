"""Token counts (op 7): batches balanced by bytes are encoded in Arrow functions that return lengths only.

Texts are cut at safe boundaries (white space, which the word tokenizer drops), so long texts need no more
memory than short ones, and each different piece of a batch is encoded once. Special strings inside a text hold
no white space, so cuts never part them. Null texts count 0 bytes and 0 tokens; empty texts the same.
Repeated rows are counted each; columns besides id and text are not read.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fumiyomi.llm.common import cached, documents, map_texts
from fumiyomi.llm.pieces import Pieces

#: Bytes of text that a batch holds at most (a longer text is a batch of its own).
BATCH_BYTES = 2_000_000
LIMIT = 2048


@lru_cache(maxsize=2)
def _counter(path: str):
    """A function from texts to token counts; one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    pieces = Pieces(lambda new: [len(e) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)], most=600_000)
    return lambda texts: [sum(x) for x in pieces(texts)]


cached("token_counts", _counter.cache_clear)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = pd.Series(_counter(path)(frame["text"].tolist()), dtype="int64", index=frame.index)
        return pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": frame["n_bytes"], "n_tokens": counts, "over_limit": counts > limit})

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return map_texts(sized, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean", BATCH_BYTES, "token_counts")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
