"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Each run of three consecutive lines is one window. A window that occurs
anywhere earlier (by doc_id, then place) is a later occurrence; the lines that
later occurrences cover are removed. Windows travel as 128-bit hashes, counts
and first places are combined before the shuffle, and the text itself moves
once, to meet the places to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import numbered, pick

#: Lines in a window.
LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column) -> Column:
    """array<struct<pos, a, b>>: place and 128-bit hash of each window that holds more than white space."""
    hashed = F.transform(
        _lines(text),
        lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")).alias("w")),
    )

    def window(h: Column) -> Column:
        def one(i: Column) -> Column:
            parts = [F.get(h, i + k) for k in range(LINES)]
            return F.struct(
                i.alias("pos"),
                F.xxhash64(*(p["a"] for p in parts)).alias("a"),
                F.xxhash64(*(p["b"] for p in parts)).alias("b"),
                (parts[0]["w"] | parts[1]["w"] | parts[2]["w"]).alias("w"),
            )

        return F.when(F.size(h) >= LINES, F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - LINES), one), lambda x: x["w"]))

    # One pass: the hashes of the lines are computed once, as the variable of the outer transform.
    return F.get(F.transform(F.array(hashed), window), 0)


def removed_places(keyed: DataFrame) -> DataFrame:
    """(id, key, places): starts of the later occurrences of repeated windows in each text of (id, key, text).

    The first occurrence is the one of the smallest (id, key, place), a null id
    first. Rows with the same id and key are one document.
    """
    win = keyed.select("id", "key", F.explode(_windows(F.col("text"))).alias("w")).select("id", "key", "w.pos", "w.a", "w.b")
    place = F.struct("id", "key", "pos")
    first = win.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last"))
    later = win.join(first.select("a", "b", "first").hint("rebalance"), ["a", "b"]).where(place > F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set("pos").alias("places"))


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines that the windows starting at ``places`` cover."""
    lines = _lines(text)
    covered = F.flatten(F.transform(places, lambda p: F.array(*(p + k for k in range(LINES)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    joined = F.transform(F.array(lines), lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))
    return F.get(joined, 0)


def _marked(frame: DataFrame, id_: Column, text: Column) -> DataFrame:
    """The frame's rows with ``places`` (null: nothing to remove)."""
    keyed = frame.withColumns({"id": id_, "key": F.xxhash64(text), "text": text})
    places = removed_places(keyed.select("id", "key", "text")).withColumnsRenamed({"id": "p_id", "key": "p_key"})
    found = keyed["id"].eqNullSafe(places["p_id"]) & (keyed["key"] == places["p_key"])
    return keyed.join(places.hint("rebalance"), found, "left").drop("p_id", "p_key")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of each row, later occurrences of repeated windows removed.

    Texts of fewer than three lines have no window and stay. Windows of white
    space alone are not counted as repeated. A null text has no lines and stays
    null, an empty one has one line. Rows that repeat both doc_id and text are
    one document, so none of them is a later occurrence of another; with the
    same doc_id but other texts, the smaller hash of the text counts as earlier.
    An empty table gives no rows; other columns are ignored.
    """
    marked = _marked(pick(docs, "doc_id", "text"), F.col("doc_id"), F.col("text"))
    cleaned = F.when(F.col("places").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("places")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.array(*(p + k for k in range(LINES)))))))
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("bigint").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(covered).cast("bigint").alias("n_removed"),
        cleaned.alias("text"),
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated windows removed from ``text`` and ``n_chars`` counted anew; every row stays."""
    frame, col, back = numbered(docs)
    marked = _marked(frame, col("doc_id"), col("text"))
    at = docs.columns.index("text")
    out = marked.withColumn(f"c{at}", F.when(F.col("places").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("places"))))
    if "n_chars" in docs.columns:
        n = docs.columns.index("n_chars")
        out = out.withColumn(f"c{n}", F.length(f"c{at}").cast(docs.schema[n].dataType))
    return back(out)
