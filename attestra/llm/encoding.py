"""Encoding of a corpus with a public tokenizer, each shared chunk once.

Texts are cut into content-defined chunks. Equal chunks of any documents meet by their 128-bit key
and are encoded once; the encoded chunks go back to the documents, where the joins are repaired by
re-encoding until the result is exactly that of the whole text.

Texts are cut once, and the chunks written to the shared folder. Three exchanges follow: the distinct chunk texts, the join of occurrences to encoded chunks (whose skew
from a chunk that many documents share AQE splits on the side of the occurrences), and the regrouping
by document. Only the first carries texts; after it a chunk has its ids and the ends of its text that a
join may need. A single document is the most that a task must hold at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm import tokens
from attestra.session import cut_lineage


def _chunks(documents: DataFrame) -> DataFrame:
    """``_row, doc_id, seq, key, chunk``: one row per chunk occurrence; the text stands at the first of a key in its batch.

    A document without text has one row without a key.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc, seq, key, chunk = [], [], [], [], []
            shown: set[bytes] = set()
            bodies = [t or "" for t in batch.column("text").to_pylist()]
            for r, d, text, cuts in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), bodies, tokens.cut_many(bodies)):
                start = 0
                for k, end in enumerate(cuts or [0]):
                    piece = text[start:end]
                    own = tokens.chunk_key(piece) if cuts else None
                    row.append(r)
                    doc.append(d)
                    seq.append(k)
                    key.append(own)
                    chunk.append(None if own is None or own in shown else piece)
                    shown.add(own)
                    start = end
            columns = [pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(seq, pa.int32()), pa.array(key, pa.binary()), pa.array(chunk, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "seq", "key", "chunk"])

    numbered = documents.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return numbered.mapInArrow(cut, "_row bigint, doc_id bigint, seq int, key binary, chunk string")


_ENCODED = "key binary, size int, start string, end string, ids array<int>, head array<int>, head_ids array<int>, safe int, safe_ids int"


def _encoded(chunk_texts: DataFrame, name: str, folder: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(name, folder)
        ints = pa.list_(pa.int32())
        for batch in batches:
            done = [tokens.encode_chunk(c, tok) for c in batch.column("chunk").to_pylist()]
            columns = [
                batch.column("key"), pa.array([c.size for c in done], pa.int32()), pa.array([c.start for c in done], pa.string()), pa.array([c.end for c in done], pa.string()), pa.array([c.ids for c in done], ints), pa.array([list(c.head) for c in done], ints),
                pa.array([list(c.head.values()) for c in done], ints), pa.array([c.safe[0] for c in done], pa.int32()), pa.array([c.safe[1] for c in done], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "size", "start", "end", "ids", "head", "head_ids", "safe", "safe_ids"])

    return chunk_texts.mapInArrow(encode, _ENCODED)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = tokens.VOCABULARIES) -> DataFrame:
    """``doc_id, ids`` of every row: the ids of its text without special tokens.

    Null and empty texts have the empty list. Texts of any length are encoded whole. Strings of
    special tokens are ordinary text. Rows stored twice come out twice; columns other than
    ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
    """
    parts = cut_lineage(_chunks(documents))  # cut once, for the texts and for the places
    distinct = parts.filter("chunk is not null").groupBy("key").agg(F.first("chunk").alias("chunk"))
    joined = parts.drop("chunk").join(_encoded(distinct, name, folder), "key", "left").drop("key")
    by_document = joined.repartition("_row").sortWithinPartitions("_row", "seq")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(name, folder)
        row, doc, held = None, None, []
        for batch in batches:
            docs, ids = [], []
            columns = batch.to_pydict()
            for k, r in enumerate(columns["_row"]):
                if r != row:
                    if row is not None:
                        docs.append(doc)
                        ids.append(tokens.join_chunks(held, tok))
                    row, doc, held = r, columns["doc_id"][k], []
                if columns["size"][k] is not None:
                    held.append(tokens.Chunk(columns["size"][k], columns["start"][k], columns["end"][k], columns["ids"][k], dict(zip(columns["head"][k], columns["head_ids"][k])), (columns["safe"][k], columns["safe_ids"][k])))
            yield _result(docs, ids)
        if row is not None:
            yield _result([doc], [tokens.join_chunks(held, tok)])

    return by_document.mapInArrow(stitch, "doc_id bigint, ids array<int>")


def _result(docs: list, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def count_tokens(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = tokens.VOCABULARIES) -> DataFrame:
    """The rows with a column ``tokens``: the number of tokens of ``text``, 0 for null and empty ones.

    Counting alone needs no exchange, so here every text is encoded where it is read; ``text`` is dropped.
    """
    kept = [f for f in documents.schema.fields if f.name not in ("text", "tokens")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "tokens bigint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(name, folder)
        for batch in batches:
            sizes = [len(tok.encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sizes, pa.int64())], [*(f.name for f in kept), "tokens"])

    return documents.select(*[f.name for f in kept], "text").mapInArrow(count, schema)
