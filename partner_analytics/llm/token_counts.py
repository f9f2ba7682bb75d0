"""Token counts: pieces are counted once per distinct pre-token and joined to the documents.

1. One pass over the texts counts pre-tokens; workers add up before the shuffle.
2. The library counts the pieces of each distinct pre-token once.
3. A second pass takes each document's pre-token frequencies. Pre-tokens that make up at least
   ``hot`` of all occurrences (1/``hot`` of them at most, so their table is bounded) are summed there;
   the rest meets the table of step 2 in a shuffle join, where no key can be hot. No ids are built.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.common import by_chunk, chunks, staged
from partner_analytics.llm.pieces import pieces, vocabulary

#: share of all pre-token occurrences from which a pre-token is looked up without a shuffle
HOT = 1e-6
#: distinct pre-tokens a worker adds up before it passes them on
FLUSH = 300_000


def pre_token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(token, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = pieces(path), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "token": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            for part in chunks(batch):
                for text in part.column("text").to_pylist():
                    for token, n in split.counts(text).items():
                        total[token] += n
                if len(total) >= FLUSH:
                    yield out()
                    total.clear()
        if total:
            yield out()

    found = docs.select("text").mapInArrow(run, "token string, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def piece_counts(tokens: DataFrame, path: str) -> DataFrame:
    """Adds ``n_pieces`` to a table of distinct pre-tokens."""

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = pieces(path).encode(part.column("token").to_pylist())
        return pa.RecordBatch.from_arrays(
            [part.column("token"), part.column("n"), pa.array([len(x) for x in ids], pa.int64())],
            ["token", "n", "n_pieces"])

    return tokens.select("token", "n").mapInArrow(by_chunk(count, "token"), "token string, n long, n_pieces long")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                 limit: int = 2048, hot: float = HOT) -> DataFrame:
    """Tokens of every text: (doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    A null text counts as empty: 0 bytes and 0 tokens. Repeated rows and null ids stay as they are.
    Special strings inside a text are one token each. Other columns of ``docs`` are ignored.
    """
    path = path or vocabulary()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = staged(piece_counts(pre_token_counts(source, path), path), "pieces")
    total = table.agg(F.sum("n")).first()[0] or 0
    frequent = table.filter(F.col("n") >= max(1, hot * total)).select("token", "n_pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(
        dict(zip(frequent.column("token").to_pylist(), frequent.column("n_pieces").to_pylist())))

    def split(part: pa.RecordBatch) -> pa.RecordBatch:
        tool, pieces_of = pieces(path), known.value
        sums, tokens, counts = [], [], []
        for text in part.column("text").to_pylist():
            sure, rest = 0, []
            found = tool.counts(text)
            for token, n in found.items():
                size = pieces_of.get(token)
                if size is None:
                    rest.append(token)
                else:
                    sure += size * n
            sums.append(sure)
            tokens.append(rest)
            counts.append([found[t] for t in rest])
        return pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), part.column("n_bytes"), pa.array(sums, pa.int64()),
             pa.array(tokens, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
            ["row", "doc_id", "n_bytes", "sure", "tokens", "counts"])

    kind = source.schema["doc_id"].dataType.simpleString()
    per_doc = source.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text",
    ).mapInArrow(by_chunk(split), f"row long, doc_id {kind}, n_bytes long, sure long, tokens array<string>, counts array<long>")
    # a document without a rest keeps one row, under a key that no pre-token has
    rest = per_doc.select("row", "doc_id", "n_bytes", "sure", F.explode_outer(F.arrays_zip("tokens", "counts")).alias("x")).select(
        "row", "doc_id", "n_bytes", "sure",
        F.coalesce(F.col("x.tokens"), F.concat(F.lit(" "), F.col("row"))).alias("token"), F.col("x.counts").alias("times"))
    joined = rest.join(table.select("token", "n_pieces"), "token", "left")
    return joined.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
        (F.first("sure") + F.coalesce(F.sum(F.col("times") * F.col("n_pieces")), F.lit(0))).alias("n_tokens"),
    ).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
