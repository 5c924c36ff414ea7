"""Single-word vocabularies of the legacy cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitag.functions import text as tx
from lexitag.operators.lasting import keep
from lexitag.operators.lookup import fits_broadcast, lookup_join, salted_join, sifted
from lexitag.operators.words import tagged_words

SEED = 16  # characters of a word that bring it to a token at most
CHUNK = 256  # characters of a token whose seeds are made at a time
LEAST_COUNT = 5  # fixed value: times a word must occur with its tag to be kept by clean_ngrams


def ngram_counts(df: DataFrame, tag: str = "Tag", text: str = "Text") -> DataFrame:
    """(Ngram, ngramTag, size): occurrences of each word with each tag."""
    words = tagged_words(df, tag, text)
    return words.groupBy("Ngram", "ngramTag").agg(F.count(F.lit(1)).alias("size"))


def _one_tag(counted: DataFrame) -> DataFrame:
    one = counted.groupBy("Ngram").agg(
        F.count(F.lit(1)).alias("tags"), F.min("ngramTag").alias("ngramTag"), F.min("size").alias("size")
    )
    return one.where("tags = 1").select("Ngram", "ngramTag", "size")


def relevance_ngrams(
    df: DataFrame, tag: str = "Tag", text: str = "Text"
) -> tuple[DataFrame, DataFrame]:
    """(usable, unclear): words of one relevance label, and the words of both labels."""
    counted = ngram_counts(df, tag, text)
    unclear = counted.groupBy("Ngram").agg(F.count(F.lit(1)).alias("tags")).where("tags > 1")
    return _one_tag(counted), unclear.select("Ngram")


def tag_ngrams(
    df: DataFrame, unclear: DataFrame, irrelevant: str = "y", tag: str = "Tag", text: str = "Text"
) -> DataFrame:
    """(Ngram, ngramTag): upper-case words of relevant rows that occur once in all of them and
    are not among the ``unclear`` words."""
    rows = df.where(F.col(text).isNotNull() & (F.col(tag) != irrelevant))
    words = tagged_words(rows.withColumn(text, F.upper(text)), tag, text)
    once = words.groupBy("Ngram").agg(
        F.count(F.lit(1)).alias("size"), F.min("ngramTag").alias("ngramTag")
    )
    return once.where("size = 1").select("Ngram", "ngramTag").join(unclear, "Ngram", "left_anti")


def clean_ngrams(counted: DataFrame) -> DataFrame:
    """Words over one character, seen five times or more with a tag, and with one such tag."""
    return _one_tag(counted.where((F.length("Ngram") > 1) & (F.col("size") >= LEAST_COUNT)))


def _seed_size(size: Column) -> Column:
    """Whole words up to SEED characters are their own seeds, longer ones have SEED."""
    return F.least(size, F.lit(SEED))


def _containing(tokens: DataFrame, ngrams: DataFrame) -> DataFrame:
    """``tokens`` (token, ...) x ``ngrams`` where the token contains the word: seed and verify.

    A word has no white space, so a text contains it where one of its tokens does. The word's first
    SEED characters, or all it has, are its seed. Tokens give seeds of the sizes that occur at every
    place. A shorter word is found where its seed is; only longer ones are compared with the token
    there, so words that merely begin alike never meet it. Long tokens are cut into overlapping
    chunks first, so no row holds more than a chunk's seeds.
    """
    numbered = keep(tokens.withColumn("tid", F.monotonically_increasing_id()))
    words = ngrams.where(F.length("Ngram") > 0).withColumn("seed_size", _seed_size(F.length("Ngram")))
    sizes = words.agg(F.array_sort(F.collect_set("seed_size"))).scalar()
    step = F.explode(F.sequence(F.lit(0), F.floor((F.length("token") - 1) / CHUNK).cast("int"))).alias("part")
    chunks = numbered.where(F.length("token") > 0).select("tid", "token", step).select(
        "tid", "part", F.substring("token", F.col("part") * CHUNK + 1, F.lit(CHUNK + SEED - 1)).alias("chunk")
    )
    size = F.length("chunk")

    def seeds(n: Column) -> Column:
        last = F.least(F.lit(CHUNK), size - n + 1)
        made = F.transform(
            F.sequence(F.lit(1), last),
            lambda at: F.struct((F.col("part") * CHUNK + at).alias("pos"), F.substring("chunk", at, n).alias("seed")),
        )
        return F.when(last >= 1, made).otherwise(F.array().cast("array<struct<pos:int,seed:string>>"))

    placed = chunks.withColumn("sizes", sizes).select(
        "tid", F.explode(F.flatten(F.transform("sizes", seeds))).alias("s")
    )
    seeded = words.withColumn("seed", F.substring("Ngram", F.lit(1), F.col("seed_size"))).drop("seed_size")
    seeded = keep(seeded)
    # Few seeds are those of words; the hashes of these are small enough to be looked up before any shuffle.
    known = seeded.select(F.xxhash64("seed").alias("hash")).distinct()
    # With more seeds than that a sieve of a fixed size keeps places without a seed out of the shuffle.
    few = fits_broadcast(known)
    if few:
        placed = placed.withColumn("hash", F.xxhash64("s.seed")).join(F.broadcast(known), "hash", "left_semi").drop("hash")
    met = lookup_join(placed.select("tid", "s.pos", "s.seed"), seeded, ["seed"], "inner", ["tid", "pos"], sift=not few)
    # Words as long as their seed are verified; the others are compared where they would lie.
    whole = F.length("Ngram") == F.length("seed")
    sure = met.where(whole).select("tid", "Ngram", "ngramTag")
    maybe = lookup_join(met.where(~whole), numbered.select("tid", "token"), ["tid"], "inner", ["pos"])
    checked = maybe.where(F.substring("token", F.col("pos"), F.length("Ngram")) == F.col("Ngram"))
    found = sure.unionByName(checked.select("tid", "Ngram", "ngramTag")).distinct()
    return lookup_join(found, numbered, ["tid"], "inner", ["Ngram"]).drop("tid")


def verified_ngrams(
    ngrams: DataFrame, df: DataFrame, id_col: str, tag: str = "Tag", text: str = "Text"
) -> DataFrame:
    """``ngrams`` is a kept table. (id, Ngram, ngramTag): the rows whose text contains a word, for every word whose tag is
    contained in the tag of all these rows."""
    words = df.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("entry"),
        F.col(tag).alias("_tag"),
        F.explode(F.array_distinct(tx.space_words(F.col(text)))).alias("token"),
    )
    tagged = words.groupBy("token", "_tag").agg(F.count(F.lit(1)).alias("_rows"))
    tagged = keep(tagged)
    # Most tokens have one tag, which goes along with them; only the others meet all their tags in a join.
    one = (F.min("_tag") == F.max("_tag")) & (F.count("_tag") == F.count(F.lit(1)))
    tokens = tagged.groupBy("token").agg(F.when(one, F.min("_tag")).alias("_tag"))
    met = keep(_containing(tokens, ngrams.select("Ngram", "ngramTag")))
    fits = F.coalesce(F.contains(F.col("_tag"), F.col("ngramTag")), F.lit(False)).alias("fits")
    several = salted_join(met.where("_tag is null").drop("_tag"), tagged, ["token"], "inner", ["Ngram"])
    checked = met.where("_tag is not null").select("Ngram", "ngramTag", fits).unionByName(several.select("Ngram", "ngramTag", fits))
    good = checked.groupBy("Ngram", "ngramTag").agg(F.bool_and("fits").alias("ok")).where("ok")
    good = keep(good.select("Ngram", "ngramTag"))
    kept = keep(lookup_join(met.drop("_tag"), good, ["Ngram", "ngramTag"], "inner", ["token"]))
    rows = sifted(words.select("entry", "token"), kept, ["token"])  # tokens with such a word, and few others
    return (
        salted_join(rows, kept, ["token"], "inner", ["entry"])
        .select(F.col("entry").alias(id_col), "Ngram", "ngramTag")
        .distinct()
    )
