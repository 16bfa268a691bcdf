"""Scoring of arriving customers with a frozen scorer.

Batch scorers only add columns once they are fitted, so the same object scores a stream; what
a stream cannot do is fit, rank or look at all rows, and such scorers are refused. So are forests too
large to be held whole: they score each batch in `foreachBatch`.
"""

from ebbtide.functions import fixed


def score_stream(stream, scorer):
    """Scored stream of a fitted `plans.scoring.Scorer`."""
    if scorer.method == fixed.MODE_BEHAVIOR and not scorer.fitted.signals:
        raise ValueError("ranking all rows needs a batch table")
    return scorer.apply(stream)


def upsert_stream(stream, table, checkpoint, order=None):
    """Query that upserts every micro-batch into a `sources.store.CustomerTable`. A batch that is
    replayed after a failure writes the same values again."""
    return (stream.writeStream.option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, _: table.save(batch, order)).start())
