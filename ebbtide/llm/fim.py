"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is cut into lines (a last line may lack its line break). Two cut points, drawn from a hash of
the row's id, part the lines into prefix, middle and suffix, and the text is put out as

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text itself

`rate` percent of the texts are transformed, `spm_rate` percent of those as spm. Texts that are empty or
hold one of the marks stay plain, so the marks of an output tell its parts apart and `restored`
gives the exact text back.

Each batch goes through array functions only: the texts are split into list arrays, the lists are
flattened with the indices of their rows, a line's ordinal is its place behind the row's first line,
lines are filtered by role, rebuilt into lists and joined. Rows are taken in slices of about `batch`
bytes. The pass needs no shuffle.

A null text counts as empty and a null id as an empty string. Rows are kept as they are, repeated ones
too; columns with names of the result are replaced in it.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
BATCH = 4 << 20
DRAWS = ["h1", "h2", "h3", "h4"]
RESULT = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
          ("output", pa.string())]


def draws(seed, key):
    """The first four groups of eight hexadecimal digits of sha256(seed:key) as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(DRAWS)]


def remainder(a, b):
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def offsets_of(counts):
    """Offsets of lists with the given lengths."""
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(counts.cast(pa.int32()))])


def lines(texts):
    """(lines with their breaks, index of the row of each, number of lines of each row)"""
    lists = pc.split_pattern(texts, "\n")
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).cast(pa.int64())
    follows = pc.equal(parent[1:], parent[:-1]) if len(parent) else pa.array([], pa.bool_())
    broken = pa.concat_arrays([follows, pa.array([False] * min(len(parent), 1), pa.bool_())])
    flat = pc.binary_join_element_wise(flat, pc.if_else(broken, "\n", ""), "")
    real = pc.or_(broken, pc.not_equal(flat, ""))
    last_empty = pc.and_not(pc.equal(flat, ""), broken)
    empty = pc.filter(parent, last_empty)  # at most the last line of a row
    missing = np.zeros(len(texts), np.int64)
    missing[empty.to_numpy()] = 1
    counts = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), pa.array(missing))
    return pc.filter(flat, real), pc.filter(parent, real), counts


def joined(units, mask, counts):
    """The units under the mask, `counts` of them in each row, joined row by row."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets_of(counts), pc.filter(units, mask)), "")


def parts(texts, h1, h2):
    """(number of lines, prefix, middle, suffix) of each text."""
    units, parent, n = lines(texts)
    bound = pc.add(n, 1)
    one, two = remainder(h1, bound), remainder(h2, bound)
    first, second = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    starts = offsets_of(n).cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units), dtype=np.int64)), pc.take(starts, parent))
    in_prefix = pc.less(ordinal, pc.take(first, parent))
    in_suffix = pc.greater_equal(ordinal, pc.take(second, parent))
    in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
    return (n, joined(units, in_prefix, first), joined(units, in_middle, pc.subtract(second, first)),
            joined(units, in_suffix, pc.subtract(n, second)))


def transformed(texts, h1, h2, h3, h4, rate, spm_rate, marks):
    """The columns of RESULT for one slice."""
    texts = pc.fill_null(texts, "")
    n, prefix, middle, suffix = parts(texts, h1, h2)
    hundred = pa.scalar(100, pa.int64())
    plain = pc.or_(pc.equal(texts, ""), pc.greater_equal(remainder(h3, hundred), rate))
    for mark in marks:
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(remainder(h4, hundred), spm_rate), "spm", "psm"))
    p, s, m = marks
    outputs = pc.if_else(plain, texts, pc.if_else(
        pc.equal(form, "spm"), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, ""),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")))
    lengths = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [n, form, *lengths, outputs]


def slices(batch, column, size):
    """The batch in slices whose texts hold about `size` bytes; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group, start = np.cumsum(lengths, dtype=np.int64) // size, 0
    for past in [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]:
        if past > start:
            yield batch.slice(start, past - start)
        start = past


def fill_in_middle(docs, key="doc_id", seed=7, rate=100, spm_rate=50, marks=MARKS, batch=BATCH):
    """docs (columns `key`, text) with n (lines), form, prefix_chars and middle_chars (code points, null
    if plain) and output instead of text."""
    if len(set(marks)) != 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in marks):
        raise ValueError("marks must be three different strings of the form <...>")
    made = {name for name, _ in RESULT}
    keep = [c for c in docs.columns if c != "text" and c not in made]
    inputs = [*(F.col(f"`{c}`") for c in keep), F.col("text"), *draws(seed, key)]
    rows = docs.select(*(x.alias(f"in{k}") for k, x in enumerate(inputs)))  # names of docs may clash with the draws
    kinds = [f"`{name}` {kind}" for name, (_, kind) in zip(keep, rows.dtypes)]

    def run(batches):
        for whole in batches:
            for part in slices(whole, len(keep), batch):
                found = transformed(*part.columns[len(keep):], rate, spm_rate, marks)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], *(x.cast(kind) for x, (_, kind) in zip(found, RESULT))],
                    [*keep, *(name for name, _ in RESULT)])
    return rows.mapInArrow(run, ", ".join(
        [*kinds, "n long, form string, prefix_chars long, middle_chars long, output string"]))


def restored(output="output", form="form", marks=MARKS):
    """The exact text of an output: its parts between the marks, put back in order."""
    at = F.split(output, "|".join(map(re.escape, marks)))
    return (F.when(F.col(form) == "psm", F.concat(at[1], at[3], at[2]))
            .when(F.col(form) == "spm", F.concat(at[2], at[3], at[1])).otherwise(F.col(output)))


def oracle(seed=7, rate=100, spm_rate=50, marks=MARKS):
    """SQL of the results of op11 in DuckDB."""
    p, s, m = marks
    number = [f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
    held = " OR ".join(f"contains(t, '{mark}')" for mark in marks)
    return f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, {number[0]} % (len(u) + 1) AS a, {number[1]} % (len(u) + 1) AS b,
         CASE WHEN t = '' OR {held} OR {number[2]} % 100 >= {rate} THEN 'plain'
              WHEN {number[3]} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(u[greatest(a, b) + 1:n], '') AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
              ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""
