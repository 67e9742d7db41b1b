"""Packing: length buckets with the least padding, and token-budget batches inside each bucket.

A global histogram counts documents per length. Dynamic programming over the
histogram picks at most ``buckets`` upper bounds so that padding every document to
the bound of its bucket wastes the fewest tokens: this is the optimum, in integers.
Inside a bucket the documents are numbered by (length, id) and cut into
batches of ``budget // bound`` rows, one row at least.

What reaches the driver is the histogram: one row per distinct length, whatever the
number of documents. Numbering needs no single sort: the histogram says where each length starts, and inside a length documents are numbered over sorted ranges, so a hot length lies in several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.slices import row_numbers
from clickloom.session import materialise

BUCKETS = 16
BUDGET = 16_384


def word_count(text: Column) -> Column:
    """Words: runs of anything but space and 09-0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def best_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding; ties take fewer buckets.

    ``histogram``: (length, documents), lengths distinct. With documents C and tokens S up to
    each length, a bucket (i, j] wastes L_j (C_j - C_i) - (S_j - S_i), so the best i for every j is the
    lowest of lines with falling slopes -C_i at rising places L_j: one pass per bucket.
    """
    cells = sorted((int(length), int(n)) for length, n in histogram if n)
    if not cells or buckets < 1:
        return []
    lengths = [length for length, _ in cells]
    docs, tokens = [0], [0]
    for length, n in cells:
        docs.append(docs[-1] + n)
        tokens.append(tokens[-1] + n * length)
    size = len(cells)
    waste: list[int | None] = [0] + [None] * size
    came: list[list[int]] = []
    best_end, best_waste = 0, None
    for k in range(1, buckets + 1):
        now: list[int | None] = [None] * (size + 1)
        source = [0] * (size + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, i
        first = 0
        for j in range(1, size + 1):
            i = j - 1
            if waste[i] is not None:
                slope, height = -docs[i], waste[i] + tokens[i]
                # a line is useless when its neighbours cross below it
                while len(hull) - first > 1:
                    (m1, b1, _), (m2, b2, _) = hull[-2], hull[-1]
                    if (height - b1) * (m1 - m2) <= (b2 - b1) * (m1 - slope):
                        hull.pop()
                    else:
                        break
                hull.append((slope, height, i))
            at = lengths[j - 1]
            while len(hull) - first > 1 and hull[first + 1][0] * at + hull[first + 1][1] <= hull[first][0] * at + hull[first][1]:
                first += 1
            if first < len(hull):
                m, b, i = hull[first]
                now[j] = m * at + b + at * docs[j] - tokens[j]
                source[j] = i
        came.append(source)
        if now[size] is not None and (best_waste is None or now[size] < best_waste):
            best_waste, best_end = now[size], k
        waste = now
    bounds, j = [], size
    for k in range(best_end, 0, -1):
        bounds.append(lengths[j - 1])
        j = came[k - 1][j]
    return bounds[::-1]


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    range_rows: int | None = None,
) -> DataFrame:
    """(id, n_tokens, bucket, bound, batch, position) for every row of ``df``.

    ``length`` is the token count of a row; by default the words of its text. ``bucket`` counts from 0 by rising
    bound, ``batch`` from 0 inside the bucket, ``position`` from 0 inside the batch. A batch times its bound
    stays within ``budget`` unless one document alone is longer: it then is a batch of its own. Null and
    empty texts have length 0 and share a bucket of bound 0 or the shortest one. Ids may be of any type and lie
    anywhere; null and repeated ids are rows like others. Further columns are ignored.
    """
    spark = df.sparkSession
    length = word_count(F.col(text_col)) if length is None else length
    # numbered rows must not change between the passes
    rows = df.select(F.col(id_col).alias("doc"), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    histogram = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    cells = sorted((r["n_tokens"], r["n"]) for r in histogram.toLocalIterator())
    bounds = best_bounds(cells, buckets)

    placed, bucket, before = [], 0, 0
    for cell, n in cells:
        if cell > bounds[bucket]:
            bucket, before = bucket + 1, 0
        placed.append((cell, bucket, bounds[bucket], before))
        before += n
    table = spark.createDataFrame(placed, "n_tokens long, bucket int, bound long, before long")

    parts = max(1, sum(n for _, n in cells) // range_rows) if range_rows else None
    numbered = row_numbers(rows, ["n_tokens"], [F.asc_nulls_first("doc"), F.asc("row")], "inside", parts)
    numbered = numbered.join(table, "n_tokens").withColumn("place", F.col("before") + F.col("inside"))
    per_batch = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)}L div greatest(bound, 1L)"))
    return numbered.withColumn("per_batch", per_batch).select(
        F.col("doc").alias(id_col),
        "n_tokens",
        "bucket",
        "bound",
        F.expr("place div per_batch").cast("long").alias("batch"),
        F.expr("place % per_batch").cast("long").alias("position"),
    )
