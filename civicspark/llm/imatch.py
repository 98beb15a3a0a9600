"""I-Match fingerprints: hashes of a text's terms in randomised parts of a lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import SPACES, in_order
from civicspark.session import materialize

#: Terms in 0.1 % to 5 % of the documents: inverse document frequencies of about 3.0 to 6.9.
LEAST_SHARE, MOST_SHARE = 0.001, 0.05
#: Eight draws, each with subsets of 1/2, 1/4, ... 1/256 of the lexicon.
DRAWS, HALVINGS = 8, 8
#: Slots of the lexicon's hash table.
SLOTS = 1 << 16


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: its words, lowered, by ASCII white space."""
    words = F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, text: str) -> DataFrame:
    """One row with the lexicon as a hash table: slot -> term hashes.

    The terms are those in ``LEAST_SHARE`` to ``MOST_SHARE`` of the documents, counted over
    all of them. As each is in that share of the documents, there are at most (distinct terms
    of an average document) / ``LEAST_SHARE`` of them, however many documents there are.
    """
    found = texts.select(F.explode(_terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    kept = found.filter(
        (F.col("df") >= F.lit(LEAST_SHARE) * n.scalar()) & (F.col("df") <= F.greatest(F.lit(MOST_SHARE) * n.scalar(), F.lit(1.0)))
    )
    slot = F.pmod("term", F.lit(SLOTS)).cast("int")
    filled = kept.groupBy(slot.alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = texts.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    table = every.join(filled, "slot", "left").select("slot", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))
    return table.agg(F.sort_array(F.collect_list(F.struct("slot", "terms"))).alias("s")).select(
        F.transform("s", lambda x: x["terms"]).alias("slots")
    )


def _fingerprint(text: Column, slots: Column) -> Column:
    """A hash for each subset of the lexicon, of the sorted terms in it; null where there are none.

    A text without any lexicon term is fingerprinted by all its terms.
    """

    def hashes(terms: Column) -> Column:
        def draw(d: Column) -> Column:
            start = F.struct(terms.alias("left"), F.array().cast("array<int>").alias("made"))

            def halve(state: Column, j: Column) -> Column:
                # Bit j of the d-th byte of a term's hash.
                part = F.filter(state["left"], lambda t: F.getbit(t, d * HALVINGS + j) == 0)
                return _let(
                    part,
                    lambda p: F.struct(
                        p.alias("left"),
                        F.concat(state["made"], F.array(F.when(F.size(p) > 0, F.hash(p)))).alias("made"),
                    ),
                )

            return F.aggregate(F.sequence(F.lit(0), F.lit(HALVINGS - 1)), start, halve, lambda s: s["made"])

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), draw))

    def choose(terms: Column) -> Column:
        inside = F.filter(terms, lambda t: F.array_contains(F.get(slots, F.pmod(t, F.lit(SLOTS)).cast("int")), t))
        return _let(inside, lambda kept: F.sort_array(F.when(F.size(kept) > 0, kept).otherwise(terms)))

    return _let(_let(_terms(text), choose), hashes)


def _as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit("-"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with terms of either text in which both have the same; 1 if neither has terms."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    return F.when(F.size(either) == 0, F.lit(1.0)).otherwise(
        F.size(F.filter(either, lambda p: p["a"] == p["b"])).cast("double") / F.size(either)
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Each text is compared with its edited text, whose last third of code points is the start
    of the next document, in falling order of doc_id (after the last comes the first), and with
    that next document. Null texts are empty; equal texts have equal fingerprints; two texts
    without terms are alike. Rows repeating a doc_id get the same neighbour each; where their
    texts differ, the least text stands as the neighbour. A row without doc_id comes after all
    others only in the sense that it has no neighbour: its edited text loses its last third,
    and ``near_next`` is 0. Other columns are ignored.
    """
    if id_col != "doc_id" or dict(df.dtypes)[id_col] != "bigint":
        df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        text_col = "text"
    # A plain column, as an alias of one would keep Spark from seeing that two exchanges are equal.
    docs = df.select("doc_id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slots = materialize(lexicon(docs, "text"))

    # Who stands before whom: on ids and lengths alone.
    named = docs.filter("doc_id is not null")
    lengths = named.select("doc_id", F.length("text").alias("n"))
    placed, total = in_order(lengths.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    placed = materialize(placed)
    behind = placed.select(
        F.col("doc_id").alias("for_id"),
        F.floor(F.col("n") / 3).cast("int").alias("need"),
        # In falling order the next one has the row before; the first row's is the last.
        F.pmod(F.col("row_no") - 1, F.lit(max(total, 1))).alias("row_no"),
    )
    order = placed.select("doc_id", "row_no").join(behind, "row_no").select("doc_id", "for_id", "need")

    # Texts are dealt by doc_id once: both joins below read the same exchange.
    heads = (
        named.join(order, "doc_id")
        .select(
            F.col("for_id").alias("doc_id"),
            F.col("doc_id").alias("next_id"),
            F.expr("substring(text, 1, need)").alias("head"),
        )
        .groupBy("doc_id", "next_id")
        .agg(F.min("head").alias("head"))
    )
    third = F.floor(F.length("text") / 3).cast("int")
    kept = F.col("text").substr(F.lit(1), F.length("text") - third)
    edited = F.concat(kept, F.coalesce(F.col("head").substr(F.lit(1), third), F.lit("")))
    lex = F.col("lex")
    nameless = docs.filter("doc_id is null").select(
        "doc_id", "text", F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("string").alias("head")
    )
    both = (
        named.join(heads, "doc_id", "left")
        .unionByName(nameless)
        .select("doc_id", "next_id", "text", edited.alias("edited"))
        .withColumn("lex", slots.scalar())
        .select(
            "doc_id",
            "next_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            _fingerprint(F.col("text"), lex).alias("f"),
            _fingerprint(F.col("edited"), lex).alias("e"),
        )
    )
    made = materialize(both)
    others = made.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("f").alias("other"))
    return made.join(others, "next_id", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _as_text(F.col("f")).alias("fingerprint"),
        _as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"),
        F.when(F.col("other").isNull(), F.lit(0.0)).otherwise(likeness(F.col("f"), F.col("other"))).alias("near_next"),
    )
