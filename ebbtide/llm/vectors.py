"""Reading vector tables: which rows take part, and batches as matrices."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

FINITE = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def usable(embeddings):
    """(vec_id, embedding) without null or non-finite components; of rows that repeat a vec_id the
    one with the greatest vector stands. Rows without vec_id take no part."""
    return (embeddings.where(f"vec_id is not null and {FINITE}").groupBy("vec_id")
            .agg(F.max("embedding").alias("embedding")))


def matrix(column, width, dtype):
    """Rows of a list column as a matrix; shorter vectors are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out, at = np.zeros((len(lengths), width), dtype), 0
    for k, n in enumerate(lengths):
        out[k, :n] = flat[at:at + n]
        at += n
    return out


def found_rows(query_ids, ids, scores, kind):
    """Arrow batch (query_id, vec_id, score)."""
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, kind)], ["query_id", "vec_id", "score"])


def best(scores, k):
    """Column numbers of each row's k highest scores, in no order."""
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k else np.empty((len(scores), 0), int)


def leading(query, ids, scores, k):
    """Positions of each query's k highest scores, ties to smaller ids, in a flat list of results."""
    order = np.lexsort((ids, -scores, query))
    sorted_query = query[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]
