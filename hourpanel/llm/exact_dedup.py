"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Texts are equal when identical after the six ASCII white-space characters are
deleted.  Of equal texts the row with the most code points in the original
text stays, then the smallest doc_id (null last), then the first read.

Pass one hashes each normalised text to two cells of one bit field and finds
the cells hit twice or more.  Pass two probes that field: a row with a cell
hit only once is unique and passes straight through; only possibly repeated
rows shuffle and are compared by their SHA-256.

The field has 16 cells a row at every size.  It is built and broadcast by
ranges of a hash of the digest: a slice has at most ``slice_rows`` rows on
average, thus a field of at most ``max_cells`` cells (64 cells in a 16-byte row),
and slices are done one after the other, so that one field is held at a time.
Equal texts share a slice.  Digests are written sorted by that hash within their task;
a slice's scan skips the other pages by their least and greatest value, and nothing shuffles for it.
``drop_exact_duplicates`` writes the texts in the same way if there is more than one slice.
``duplicate_classes`` shuffles digests of some 60 bytes, never texts.

Defined cases: a null text counts as empty, and all empty texts are equal; a
null doc_id sorts last; rows that repeat in full stay once; an empty table
gives an empty result; other columns are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh, shared_path, store, text_or_empty

CELLS_PER_ROW = 16
MAX_CELLS = 1 << 26
SLICE_ROWS = MAX_CELLS // CELLS_PER_ROW


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without ASCII white space."""
    return F.unhex(F.sha2(F.translate(text, ASCII_SPACE, ""), 256))


def _cell(sha: Column, k: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(sha, F.lit(k)), F.lit(cells))


def repeated_cells(digests: DataFrame, sha: str, cells: int) -> DataFrame:
    """Pass one: (word, bits) of the cells that two or more rows hit; at most ``cells / 64`` rows."""
    hit = digests.select(F.explode(F.array(_cell(F.col(sha), 0, cells), _cell(F.col(sha), 1, cells))).alias("cell"))
    twice = hit.groupBy("cell").count().where("count > 1")
    return (twice.groupBy(F.expr("cell div 64").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits")))


def _probe(df: DataFrame, sha: str, field: DataFrame, cells: int, flag: str) -> DataFrame:
    """Pass two: adds ``flag``, false where a row is certainly unique."""
    at = fresh(df, "cell_a", "cell_b", "word_a", "word_b", "bits_a", "bits_b")
    out = df.withColumns({c: _cell(df[sha], k, cells) for k, c in enumerate(at[:2])})
    for cell, word, bits in zip(at[:2], at[2:4], at[4:]):
        # bounded: one row for 64 cells of a field of at most max_cells
        side = F.broadcast(field.select(F.col("word").alias(word), F.col("bits").alias(bits)))
        out = out.join(side, F.expr(f"`{cell}` div 64") == side[word], "left")

    def is_set(cell, bits):
        return F.coalesce(F.getbit(F.col(bits), (F.col(cell) % 64).cast("int")) == 1, F.lit(False))

    return out.withColumn(flag, is_set(at[0], at[4]) & is_set(at[1], at[5])).drop(*at)


def _place(sha: Column) -> Column:
    """Where a digest stands among the slices: a hash of its own, independent of its cells."""
    return F.xxhash64(sha, F.lit(2))


def _slices(rows: int, slice_rows: int) -> list[tuple[int, int]]:
    """First and last place of each slice: equal ranges of the 64-bit hashes."""
    n = max(1, -(-rows // slice_rows))
    cuts = [(i << 64) // n - (1 << 63) for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def _cells(rows: int, max_cells: int) -> int:
    cells = 1 << 16
    while cells < min(max_cells, CELLS_PER_ROW * rows):
        cells *= 2
    return min(cells, max(64, max_cells))


def _one_by_one(parts: Iterator[DataFrame], n: int, label: str) -> DataFrame:
    """The union of ``n`` frames.  Several are appended to one table in turn, so that one's broadcast is held at a time."""
    part = next(parts)
    if n == 1:
        return part
    spark, path = part.sparkSession, shared_path(part.sparkSession, label)
    part.write.parquet(path)
    for more in parts:
        more.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)


def _keepers(possible: DataFrame) -> DataFrame:
    """sha -> n, and the row that stays: most code points, smallest doc_id (null last), first read."""
    order = F.struct((-F.col("n_cp")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "rid")
    return possible.groupBy("sha").agg(F.count("*").alias("n"), F.min(order).alias("keep"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), F.length(text).cast("long").alias("n_cp"),
                       text_digest(text).alias("sha"), F.monotonically_increasing_id().alias("rid"))
    return store(rows.withColumn("place", _place(F.col("sha"))).sortWithinPartitions("place"), "dedup-digests")


def _classes(digests: DataFrame, cells: int) -> DataFrame:
    """The classes of one slice."""
    field = store(repeated_cells(digests, "sha", cells), "dedup-field")
    probed = _probe(digests, "sha", field, cells, "possible")
    alone = probed.where(~F.col("possible")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    possible = probed.where("possible").drop("possible")
    groups = store(_keepers(possible), "dedup-groups")
    met = possible.join(groups, "sha").select(
        "id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("keep.rid")).alias("kept"), "sha")
    return alone.unionByName(met)


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      max_cells: int = MAX_CELLS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each row of ``docs``: its id, keep_id, group_size, kept, text_sha256."""
    digests = _digests(docs, id_col, text_col)
    rows = digests.count()  # of a stored table: read from the file footers
    slices = _slices(rows, slice_rows)
    cells = _cells(-(-rows // len(slices)), max_cells)
    parts = (_classes(digests.where(F.col("place").between(*s)), cells) for s in slices)
    return _one_by_one(parts, len(slices), "dedup-classes").select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          max_cells: int = MAX_CELLS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``docs`` with one row of each class of equal texts; rows known to be unique don't shuffle."""
    digests = _digests(docs, id_col, text_col)
    rows = digests.count()
    slices = _slices(rows, slice_rows)
    cells = _cells(-(-rows // len(slices)), max_cells)
    sha, flag, n_cp, place, k_sha, k_n, k_id = fresh(docs, "sha", "possible", "n_cp", "place", "keep_sha", "keep_n", "keep_id")
    text = text_or_empty(docs, text_col)
    whole = docs.withColumns({sha: text_digest(text), n_cp: F.length(text).cast("long")})
    if len(slices) > 1:
        whole = store(whole.withColumn(place, _place(F.col(sha))).sortWithinPartitions(place), "dedup-texts")

    def left(bounds: tuple[int, int]) -> DataFrame:
        mine = digests.where(F.col("place").between(*bounds))
        field = store(repeated_cells(mine, "sha", cells), "dedup-field")
        groups = _keepers(_probe(mine, "sha", field, cells, "possible").where("possible"))
        stay = store(groups.select(F.col("sha").alias(k_sha), (-F.col("keep.short")).alias(k_n),
                                   F.col("keep.id").alias(k_id)), "dedup-keepers")
        texts = whole.where(F.col(place).between(*bounds)) if len(slices) > 1 else whole
        probed = _probe(texts, sha, field, cells, flag)
        passing = probed.where(~F.col(flag)).select(*docs.columns)
        possible = probed.where(flag)
        # keyed by the row that stays, not by the class alone: the rows of a hot class spread over the partitions by id
        met = possible.join(stay, (possible[sha] == stay[k_sha]) & (possible[n_cp] == stay[k_n])
                            & possible[id_col].eqNullSafe(stay[k_id]), "left_semi")
        return passing.unionByName(met.dropDuplicates([sha]).select(*docs.columns))

    return _one_by_one(map(left, slices), len(slices), "dedup-left")
