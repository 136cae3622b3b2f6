"""Benchmark decontamination with a broadcast table of test n-grams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import as_row, keyed, lower_ascii, stage

WINDOW = 13
#: Largest number of distinct test n-grams that is sent to every executor (some 200 bytes
#: each); with more, the same join shuffles.
BROADCAST_NGRAMS = 200_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of the text as it is, and what stands between it and the next one.
_WORD_AND_GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    """Lower-case (A-Z) runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def ngrams(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, anchor, offset, items): distinct windows, their longest word and its place in them.

    An item of fewer than 13 words is one window; one without words has none. ``items`` holds
    the ids, NULL ids left out.
    """
    lists = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    grams = (lists.filter(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("at"))
             .select("item_id", F.slice("words", F.col("at"), F.lit(WINDOW)).alias("gram"))
             .groupBy("gram").agg(F.collect_set("item_id").alias("items")))
    place = F.array_max(F.transform("gram", lambda w, i: F.struct(
        F.length(w).alias("length"), (-i).alias("back"))))
    return grams.select("gram", "items", (-place["back"]).alias("offset")).select(
        "gram", "items", "offset", F.element_at("gram", F.col("offset") + 1).alias("anchor"))


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                         text: str = "text", item_id: str = "item_id",
                         item_text: str = "text") -> DataFrame:
    """(doc_id, sig, start, length, items): every place in a document where a test window occurs.

    One scan: each document word probes the table of anchors, and only where it is one are
    the words around it compared with the whole window.
    """
    grams = stage(ngrams(benchmark, item_id, item_text), "ngrams")
    if grams.count() <= BROADCAST_NGRAMS:
        grams = F.broadcast(grams)
    scanned = keyed(docs, doc_id, text).select("doc_id", "sig", words(F.col("text")).alias("words"))
    places = scanned.select("doc_id", "sig", "words", F.posexplode("words").alias("pos", "anchor"))
    start = F.col("pos") - F.col("offset")
    return (places.join(grams, "anchor")
            .filter((start >= 0) & (F.slice("words", F.greatest(start + 1, F.lit(1)),
                                            F.size("gram")) == F.col("gram")))
            .select("doc_id", "sig", start.alias("start"), F.size("gram").alias("length"), "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sig, n_words, hit (positions), items, contaminated.

    A word is hit inside any occurrence of a test window; a document is contaminated if at
    least a twentieth of its words, and one of them, are hit. NULL and empty texts have no
    words and are clean; with an empty benchmark all are. Rows that repeat an id are judged
    each by its own text.
    """
    found = stage(contaminated_windows(docs, benchmark, doc_id, text, item_id, item_text), "windows")
    hit = (found.select("doc_id", "sig", F.explode(F.sequence(
        F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
        .groupBy("doc_id", "sig").agg(F.collect_list("pos").alias("hit")))
    items = (found.select("doc_id", "sig", F.explode_outer("items").alias("item")).distinct()
             .groupBy("doc_id", "sig").agg(F.collect_list("item").alias("items")))
    h, i = hit.alias("h"), items.alias("i")
    both = h.join(i, F.col("h.doc_id").eqNullSafe(F.col("i.doc_id"))
                  & (F.col("h.sig") == F.col("i.sig"))).select("h.doc_id", "h.sig", "hit", "items")
    base = keyed(docs, doc_id, text).select("doc_id", "sig", F.size(words(F.col("text"))).cast(
        "long").alias("n_words")).alias("d")
    both = both.alias("b")
    rows = base.join(both, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
                     & (F.col("d.sig") == F.col("b.sig")), "left").select(
        "d.doc_id", "d.sig", "n_words", F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
        F.coalesce("items", F.array().cast(both.schema["items"].dataType)).alias("items"))
    return rows.withColumn("contaminated", (F.size("hit") > 0)
                           & (F.size("hit").cast("long") * 20 >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its contaminated documents, or with the hit words cut out of all texts.

    ``remove`` is "documents" or "spans". A cut word takes the separators behind it along;
    texts without a hit stay as they are. All columns of ``docs`` stay.
    """
    judged = contamination(docs, benchmark, doc_id, text)
    keys = judged.filter("contaminated" if remove == "documents" else "size(hit) > 0").select(
        F.col("doc_id").alias("id"), F.col("sig").alias("of"), "hit")
    keys = stage(keys.dropDuplicates(["id", "of"]), "contaminated")
    whole = F.col(text).cast("string")
    rows = docs.select(as_row(docs), F.col(doc_id).cast("long").alias("own"), whole.alias("whole"),
                       F.coalesce(F.xxhash64(whole), F.lit(0)).alias("sig"))
    match = F.col("own").eqNullSafe(F.col("id")) & (F.col("sig") == F.col("of"))
    if remove == "documents":
        return rows.join(keys, match, "left_anti").select("row.*")
    pieces = F.regexp_extract_all(F.col("whole"), F.lit(_WORD_AND_GAP), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains("hit", i)), "")
    cut = F.when(F.col("hit").isNull(), F.col("row")[text]).otherwise(kept)
    return rows.join(keys, match, "left").select(
        *[(cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
