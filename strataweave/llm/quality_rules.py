"""Quality rules: base counts and Jensen-Shannon distance to language references.

Everything here is built-in column expressions over one row per document; no
Python runs on the executors.  A first pass counts words by language; the N_COMMON
commonest of each are its common words.  A second pass counts, per document, words,
symbols, repeated lines and words inside repeated three-word windows, and takes two
histograms: over character classes and over its language's common words.  Summed over
the documents of a language that pass the base rules they are its references.  A
document is held against them without its own share.

The limits follow the documents too.  Of the distances of a language's base-passing
documents of one length class, the limit is the median and MARGIN times the way from
there to the upper quartile, LEAST_LIMIT at least: it lies far outside the bulk whatever
its spread, and moves only if junk makes up a quarter of the class.

Defined results
* null text: no words; all counts 0, base_failed (fewer than MIN_WORDS words).
* null or unknown lang: held against the reference pooled over such documents.
* texts under MIN_WORDS words get no distance verdict (they fail the base rule).
* a language whose documents all fail the base rules, or whose only passing document is
  the one judged, has no reference: no verdict.
* repeated rows are scored one by one; an empty table gives an empty result.
* extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, spool

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Languages with references of their own; all others share one.
LANGUAGES = ("en", "de", "fr", "es")
#: Common words of a language, and the least share of its words that such a word has.
N_COMMON, COMMON_SHARE = 24, 0.002
#: Limits of the distances, see above; length classes are powers of two of the number of words, up to the last.
MARGIN, LEAST_LIMIT, LAST_CLASS = 10.0, 0.25, 12
#: Low bits of a packed window that hold its position: those of any array.
POSITION_BITS = 31
CLASSES = ["space", "upper", "digit", "punct", "symbol", "wide", "other"]


def _sized(col: Column) -> Column:
    return F.length(col).cast("long")


def _language(lang_col: str) -> Column:
    return F.when(F.col(lang_col).isin(*LANGUAGES), F.col(lang_col)).otherwise(F.lit(""))


def _word_hashes(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    return F.when(trimmed == "", F.array().cast("array<long>")).otherwise(F.transform(words, lambda x: F.xxhash64(x)))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(ref_lang, common): hashes of the language's commonest words, one row for each of at most len(LANGUAGES) + 1 languages."""
    rows = docs.where(F.col(text_col).isNotNull()).select(_language(lang_col).alias("ref_lang"), F.explode(_word_hashes(F.col(text_col))).alias("h"))
    counts = spool(rows.groupBy("ref_lang", "h").agg(F.count("*").alias("n")))
    totals = counts.groupBy("ref_lang").agg(F.sum("n").alias("total"))
    # at most 1 / COMMON_SHARE words a language
    often = counts.join(F.broadcast(totals), "ref_lang").where(F.col("n") >= COMMON_SHARE * F.col("total"))
    ranked = often.withColumn("rank", F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("n"), "h")))
    top = ranked.where(F.col("rank") <= N_COMMON).groupBy("ref_lang").agg(F.sort_array(F.collect_list("h")).alias("common"))
    out = spool(top)
    release(counts)
    return out


def _repeated(hashed: Column) -> Column:
    """Positions of the windows that share the high bits of their hash with another, by an array of hash | position."""
    mask = (1 << POSITION_BITS) - 1

    def same(x: Column, y: Column) -> Column:
        return F.shiftrightunsigned(x.bitwiseXOR(y), POSITION_BITS) == 0

    return F.transform(
        F.filter(hashed, lambda x, i: same(x, F.get(hashed, i + 1)) | same(x, F.get(hashed, i - 1))),
        lambda x: x.bitwiseAND(F.lit(mask)).cast("int"),
    )


def base_counts(docs: DataFrame, common: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: counts and the two raw histograms (arrays of long).  common: ref_lang, common."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), _language(lang_col).alias("ref_lang"), text.alias("text"))
    # at most one row a language
    df = df.join(F.broadcast(common), "ref_lang", "left")
    df = df.select(
        "doc_id",
        "ref_lang",
        "text",
        F.coalesce("common", F.array().cast("array<long>")).alias("listed"),
        _word_hashes(F.col("text")).alias("keys"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("full_lines"),
    )
    # a window's code mixes the 64-bit hashes of its words; sorted arrays hold high bits of it, then the position
    high = F.lit(~((1 << POSITION_BITS) - 1))
    keys, windows, near = F.col("keys"), F.col("windows"), F.col("near")
    df = df.withColumn("hits", F.filter("keys", lambda x: F.array_contains("listed", x))).withColumn(
        "windows",
        F.transform(
            F.slice("keys", 1, F.greatest(F.lit(0), F.size("keys") - 2)),
            lambda h, i: h.bitwiseXOR(F.shiftleft(F.get(keys, i + 1), 1)).bitwiseXOR(F.shiftleft(F.get(keys, i + 2), 2)),
        ),
    )
    df = df.withColumn("packed", F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long")))))
    df = df.withColumn("near", _repeated(F.col("packed")))
    # the few that share high bits with another must share those of a second hash too
    df = df.withColumn(
        "packed", F.sort_array(F.transform(near, lambda i: F.xxhash64(F.get(windows, i)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    )
    df = df.withColumn("starts", F.sort_array(_repeated(F.col("packed"))))
    starts, hits, text = F.col("starts"), F.col("hits"), F.col("text")
    covered = F.transform("starts", lambda s, j: F.least(F.lit(3), s - F.coalesce(F.get(starts, j - 1), s - 3)))

    def count_of(chars: str) -> Column:
        return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")

    df = df.select(
        "doc_id",
        "ref_lang",
        F.size("keys").cast("long").alias("n_words"),
        (_sized(text) - count_of("\\x20\\x09-\\x0D")).alias("word_chars"),
        count_of(SYMBOLS.replace("&", "\\&")).alias("n_symbols"),
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        _sized(text).alias("n_chars_"),
        count_of("\\p{Lu}").alias("n_upper"),
        count_of("0-9").alias("n_digit"),
        count_of(".,;:!?'\"()/_+=@~-").alias("n_punct"),
        (F.octet_length("text") - F.length("text")).cast("long").alias("n_wide"),
        F.transform("listed", lambda r: F.size(F.filter(hits, lambda x: x == r)).cast("long")).alias("common"),
    )
    space = F.col("n_chars_") - F.col("word_chars")
    rest = F.greatest(
        F.lit(0).cast("long"),
        F.col("word_chars") - F.col("n_upper") - F.col("n_digit") - F.col("n_punct") - F.col("n_symbols") - F.col("n_wide"),
    )
    total = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select(
        "doc_id",
        "ref_lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.array(space, F.col("n_upper"), F.col("n_digit"), F.col("n_punct"), F.col("n_symbols"), F.col("n_wide"), rest).alias("classes"),
        # a language may have fewer common words: zeros fill their places
        F.concat(
            "common",
            F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(N_COMMON) - F.size("common"))),
            F.array(F.greatest(F.lit(0).cast("long"), F.col("n_words") - total)),
        ).alias("common"),
    )


def language_references(counts: DataFrame) -> DataFrame:
    """Summed histograms of the documents passing the base rules: at most one row per known language and one pooled."""
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON + 1)]
    ref = counts.where(~F.col("base_failed")).groupBy("ref_lang").agg(*sums)
    return ref.select(
        "ref_lang",
        F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_classes"),
        F.array(*[f"w{i}" for i in range(N_COMMON + 1)]).alias("ref_common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts; null if either sums to 0."""

    def share(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return F.when(total > 0, F.transform(a, lambda x: x / total))

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    parts = F.zip_with(share(p), share(q), lambda x, y: (term(x, y) + term(y, x)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))  # greatest() would skip a null


def distances(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts with char_distance and word_distance, null where there is no reference."""
    common = common_words(docs, text_col, lang_col)
    counts = spool(base_counts(docs, common, id_col, text_col, lang_col))
    # at most len(LANGUAGES) + 1 rows, whatever the input
    refs = F.broadcast(language_references(counts))

    def away(own: str, ref: str) -> Column:
        # a base-passing document's own counts are part of the sums
        rest = F.zip_with(ref, own, lambda r, x: r - x)
        return js_distance(F.col(own), F.when(F.col("base_failed"), F.col(ref)).otherwise(rest))

    return counts.join(refs, "ref_lang", "left").select(
        "doc_id",
        "ref_lang",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        away("classes", "ref_classes").alias("char_distance"),
        away("common", "ref_common").alias("word_distance"),
        F.least(F.lit(LAST_CLASS), F.floor(F.log2(F.greatest(F.lit(1), "n_words"))).cast("int")).alias("length_class"),
    )


def limits(found: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(ref_lang, length_class, char_limit, word_limit): at most len(LANGUAGES) + 1 times LAST_CLASS + 1 rows."""

    def limit(name: str) -> Column:
        q = F.percentile_approx(name, [0.5, 0.75], 1000)
        return F.greatest(F.lit(LEAST_LIMIT), q[0] + margin * (q[1] - q[0]))

    return found.where(~F.col("base_failed")).groupBy("ref_lang", "length_class").agg(
        limit("char_distance").alias("char_limit"), limit("word_distance").alias("word_limit")
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN
) -> DataFrame:
    """Counts, distances and verdict per document; see the module docstring."""
    found = spool(distances(docs, id_col, text_col, lang_col))
    out = found.join(F.broadcast(limits(found, margin)), ["ref_lang", "length_class"], "left")
    far = (F.col("char_distance") > F.col("char_limit")) | (F.col("word_distance") > F.col("word_limit"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "char_distance",
        "word_distance",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
    )
